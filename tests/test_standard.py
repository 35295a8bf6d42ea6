"""Standard settings: symbols and axes move together, reflections keep their q2, odd entries are null."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.functions import cell
from cellspark.operators import reduction, standard

R = math.pi / 2
ENTRY = "id long, a double, b double, c double, alpha double, beta double, gamma double, lattice_system string, symbol string"
#: Symbols of some groups on the axes abc, acb, bac, bca, cab and cba. Fixed values.
SETTINGS = [
    ("P 21 2 2", "P 21 2 2", "P 2 21 2", "P 2 2 21", "P 2 21 2", "P 2 2 21"),
    ("P n a 21", "P n 21 a", "P b n 21", "P c 21 n", "P 21 n b", "P 21 c n"),
    ("C c m b", "B b c m", "C m c a", "B m a b", "A c a m", "A b m a"),
    ("C m 2 a", "B m a 2", "C 2 m b", "B 2 c m", "A b m 2", "A c 2 m"),
    ("P b c n", "P c n b", "P c a n", "P b n a", "P n c a", "P n a b"),
    ("I m c m", "I m m b", "I c m m", "I b m m", "I m m a", "I m a m"),
]


def q2(c, hkl):
    r = np.linalg.inv(reduction.metric(np.array([c]))[0])
    return np.einsum("hi,ij,hj->h", hkl, r, hkl)


def test_orthorhombic_symbols(spark):
    rows = [(s, tag, group[cell.ORDERS.index(tag)]) for group in SETTINGS for s, tag in [(group[0], t) for t in cell.ORDERS]]
    df = spark.createDataFrame([*rows, ("I b c a", "acb", "I b c a"), ("Pnma", "acb", None)], "symbol string, tag string, want string")
    for r in df.withColumn("got", standard.orthorhombic_symbol(F.col("symbol"), F.col("tag"))).collect():
        assert r["got"] == r["want"], r


def test_axes_keep_reflections(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(60):
        a, b, c = (float(v) for v in r.uniform(4, 12, 3))
        rows += [
            (len(rows), a, b, c, R, R, R, "orthorhombic", ("P n m a", "C m c m", "B m a b", "A b m 2", "I b a m")[i % 5]),
            (len(rows) + 1, a, b, c, R, float(r.uniform(1.2, 2.0)), R, "monoclinic", ("P 1 21/c 1", "C 1 2/c 1", "A 1 m 1", "I 1 c 1", "P 1 21/a 1", "P 1 21/n 1")[i % 6]),
            (len(rows) + 2, a, b, c, *(float(v) for v in r.uniform(1.3, 1.9, 3)), "triclinic", "P -1"),
            (len(rows) + 3, a, a, c, R, R, 2 * math.pi / 3, "rhombohedral", "R -3 c"),
        ]
    out = standard.standardise_entries(spark.createDataFrame(rows, ENTRY).repartition(5), "id")
    out = out.withColumn("ok", standard.reindex_ok(cell.columns(), [F.col(n) for n in standard.NEW], F.col("axes"))).collect()
    assert len(out) == len(rows)
    hkl = np.array(list(itertools.product(range(-2, 3), repeat=3)))
    for x in out:
        old, new = [x[n] for n in cell.NAMES], [x[n] for n in standard.NEW]
        m = np.array(x["axes"]).reshape(3, 3)
        assert x["ok"] and abs(abs(np.linalg.det(m)) - (1 / 3 if x["lattice_system"] == "rhombohedral" else 1)) < 1e-9, x
        assert np.allclose(q2(old, hkl), q2(new, hkl @ m.T), rtol=1e-6, atol=1e-9), x
        assert x["new_volume"] == pytest.approx(math.sqrt(np.linalg.det(reduction.metric(np.array([new]))[0])), rel=1e-6)
        if x["lattice_system"] == "orthorhombic":
            assert x["new_symbol"][0] in "PIC" and new[0] <= new[1] and (x["new_symbol"][0] == "C" or new[1] <= new[2])
        if x["lattice_system"] == "monoclinic":
            assert x["new_symbol"][0] in "PI" and new[0] <= new[2] and new[4] >= R and x["extinction_code"] in (15, 16, 21, 22, 27, 28)
        if x["lattice_system"] == "rhombohedral":
            assert x["extinction_group"] == "R (obv) - c" and new[0] == new[1] == new[2]


def test_odd_entries(spark):
    rows = [
        (1, None, 5.0, 6.0, R, R, R, "orthorhombic", "P n m a"),
        (2, 4.0, 5.0, 6.0, R, R, R, "orthorhombic", None),
        (3, 4.0, 5.0, 6.0, R, 1.8, R, "monoclinic", "B 1 2 1"),
        (4, 5.0, 5.0, 5.0, 1.0, 2.5, 1.0, "triclinic", "P 1"),
        (5, 4.0, 5.0, 6.0, R, R, R, "none", "P 1"),
        (6, 4.0, 5.0, 6.0, R, R, R, None, None),
        (7, 4.0, 4.0, 4.0, R, R, R, "cubic", "F m -3 m"),
        (8, 6.0, 6.0, 6.0, 1.2, 1.2, 1.2, "rhombohedral", "R 3 c"),
    ]
    df = spark.createDataFrame(rows, ENTRY).withColumn("axes", F.lit("clash")).withColumn("extinction_code", F.lit("clash"))
    got = {x["id"]: x for x in standard.standardise_entries(df, "id").withColumn("ok", standard.reindex_ok(cell.columns(), [F.col(n) for n in standard.NEW], F.col("axes"))).collect()}
    assert sorted(got) == list(range(1, 9))
    assert all(got[i]["na"] is None and got[i]["ok"] is None for i in (1, 2, 3, 4, 5, 6))
    assert got[7]["ok"] and got[7]["na"] == 4 and got[7]["extinction_code"] == 212 and got[8]["ok"] and got[8]["extinction_code"] == 190
    assert standard.standardise_entries(df.limit(0), "id").count() == 0
