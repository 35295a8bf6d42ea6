"""Cells against cells: other settings of one lattice are equal, factors are told, odd rows are neither."""

import math

import numpy as np
import pytest

from cellspark.operators import matching as m
from cellspark.operators import reduction


def random_triclinic(r, n):
    out = []
    while len(out) < n:
        c = np.concatenate([r.uniform(4, 12, 3), np.radians(r.uniform(60, 120, 3))])
        if np.linalg.det(reduction.metric(c[None])[0]) > 0.2 * np.prod(c[:3]) ** 2:
            out.append(c)
    return np.array(out)


def test_seven_lengths_are_of_the_lattice():
    r = np.random.default_rng(1)
    cells = random_triclinic(r, 100)
    g = reduction.metric(cells)
    for _ in range(5):
        u = np.eye(3, dtype=int)
        for _ in range(6):
            i, j = r.choice(3, 2, replace=False)
            u[i] += r.integers(-2, 3) * u[j]
        moved = np.einsum("ic,ncd,jd->nij", u, g, u)
        assert np.allclose(m.voronoi_lengths(moved), m.voronoi_lengths(g), rtol=1e-9)
    cube = reduction.metric(np.array([[4, 4, 4, math.pi / 2, math.pi / 2, math.pi / 2]]))
    assert np.allclose(m.voronoi_lengths(cube)[0], np.sqrt([16] * 3 + [32] * 3 + [48]))
    # on the border of two reduced cells a little noise changes the cell, but not the lengths
    edge = np.array([[5.0, 6, 7, math.pi / 2, math.pi / 2, math.pi / 2 + e] for e in (-1e-7, 1e-7)])
    assert np.allclose(*m.voronoi_lengths(reduction.metric(edge)), rtol=1e-6)


@pytest.mark.parametrize("system", list(m.FACTORS))
def test_matches(system):
    r = np.random.default_rng(4)
    size = {"cubic": 1, "tetragonal": 2, "hexagonal": 2, "rhombohedral": 2, "orthorhombic": 3, "monoclinic": 4}.get(system)
    if system == "triclinic":
        truth = random_triclinic(r, 60)
    else:
        truth = r.uniform(5, 15, (60, size))
        if system in ("rhombohedral", "monoclinic"):
            truth[:, -1] = np.radians(r.uniform(*((50, 100) if system == "rhombohedral" else (91, 120)), 60))
    ok, off = m.matches(truth * 1.003, truth, system) if system not in ("rhombohedral", "monoclinic", "triclinic") else m.matches(truth, truth, system)
    assert ok.all() and not off.any()
    far = truth.copy()
    far[:, : {"rhombohedral": 1, "monoclinic": 3}.get(system, min(3, far.shape[1]))] *= 1.23
    ok, off = m.matches(far, truth, system)
    assert not ok.any() and off.mean() < 0.1
    double = truth.copy()
    double[:, 0] *= 2
    ok, off = m.matches(double, truth, system)
    assert not ok.any() and off.all()


def test_related_rhombohedral():
    """The primitive cell of a face-centred rhombohedral lattice has the lattice of the first."""
    a, alpha = 6.0, math.radians(75)
    g = a * a * (np.full((3, 3), math.cos(alpha)) + (1 - math.cos(alpha)) * np.eye(3))
    for d, e in m.RHOMBOHEDRAL:
        k = np.full((3, 3), e) + (d - e) * np.eye(3)
        h = k @ g @ k.T
        found = np.array([[math.sqrt(h[0, 0]), math.acos(h[0, 1] / h[0, 0])]])
        inverse = np.linalg.inv(k)
        known = any(np.allclose(inverse, np.full((3, 3), y) + (x - y) * np.eye(3)) for x, y in m.RHOMBOHEDRAL)
        ok, off = m.matches(found, np.array([[a, alpha]]), "rhombohedral")
        assert ok[0] or off[0] or not known


def test_odd_rows(spark):
    rows = [(1, "cubic", [5.0], [5.01]), (1, "cubic", [5.0], [5.01]), (2, "cubic", None, [5.0]), (3, "cubic", [float("nan")], [5.0]), (4, "tetragonal", [5.0], [5.0, 6.0]), (5, "none", [5.0], [5.0]), (6, None, [5.0], [5.0]), (7, "triclinic", [5.0, 5.0, 5.0, 1.0, 2.5, 1.0], [5.0, 5.0, 5.0, 1.0, 2.5, 1.0]), (8, "cubic", [None], [5.0]), (None, "hexagonal", [10.0, 6.0], [5.0, 6.0]), (9, "cubic", [-5.0], [5.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, system string, f array<double>, t array<double>, off string")
    got = [(r["id"], r["correct"], r["off"]) for r in m.match_cells(df.repartition(3), ["id"], "system", "f", "t").collect()]
    assert sorted(got, key=str) == sorted([(i, i == 1, i is None) for i, *_ in rows], key=str)
    assert m.match_cells(df.limit(0), ["id"], "system", "f", "t").count() == 0


def test_outcomes(spark):
    rows = [(1, "a", "a", 5.0, True, False), (1, "b", "a", 2000.0, False, False), (2, "b", "a", 5.0, True, False), (3, "a", "a", 5.0, False, True), (3, "a", "a", 2000.0, False, False), (4, "a", "a", 1000.5, False, False), (5, "a", "a", None, False, False), (None, "a", None, 1.0, True, False)]
    df = spark.createDataFrame(rows, "p long, lattice string, truth string, m20 double, correct boolean, off boolean")
    got = {r["p"]: r["outcome"] for r in m.classify_outcome(df, "p", "lattice", "truth", "m20").collect()}
    assert got == {1: "found", 2: "incorrect_bl", 3: "off_by_two", 4: "explainer", 5: "not_found", None: "incorrect_bl"}
