"""Found cells against true ones, in every lattice system: equal, or off by factors.

Cells are compared a batch of rows at once. Rhombohedral and monoclinic cells are
brought to their other settings by small tables of axis changes, acting on
metrics. Triclinic ones are compared by the squared lengths of the seven vectors
that bound the lattice's Voronoi cell, sorted: they don't depend on the chosen
axes, nor jump where a cell is on the border of being reduced.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.functions.cell import SETTINGS, SWAP
from cellspark.operators import reduction

#: Factors by which an axis may be off. Fixed values.
FACTORS = {"cubic": (0.5, 2.0), "tetragonal": (1 / 3, 0.5, 1.0, 2.0, 3.0), "hexagonal": (1 / 3, 0.5, 1.0, 2.0, 3.0), "rhombohedral": (0.5, 2.0), "orthorhombic": (0.5, 1.0, 2.0), "monoclinic": (0.5, 1.0, 2.0), "triclinic": (0.5, 1.0, 2.0)}
#: Rhombohedral cells of related lattices: (diagonal, else) of a symmetric change of axes. Fixed values.
RHOMBOHEDRAL = ((1, 0), (-1, 1), (3, -1), (0, 0.5), (0.5, 0.25))
#: Of a monoclinic cell: its settings, each with a and c swapped or not and beta acute or obtuse.
MONOCLINIC = [np.diag(o) @ p @ np.reshape(m, (3, 3)) for m in SETTINGS for p in (np.eye(3), np.reshape(SWAP, (3, 3))) for o in ((1, 1, 1), (-1, -1, 1))]
#: M20 beyond which a cell that isn't the true one explains the pattern all the same. Fixed value.
EXPLAINS = 1000.0
SEVEN = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1], [1, 1, 0], [1, 0, 1], [0, 1, 1]])


def _halves() -> list[np.ndarray]:
    """Axes of the seven lattices that hold a lattice with half its volume, and of the seven of twice its volume in it, whatever its axes."""
    out = []
    for v in itertools.product((0, 1), repeat=3):
        if any(v):
            i, larger, smaller = v.index(1), np.eye(3), np.eye(3)
            larger[i] = np.array(v) / 2
            smaller[:, i] += v
            out += [larger, smaller]
    return out


HALVES = _halves()


def close(a: np.ndarray, b: np.ndarray, rtol: float) -> np.ndarray:
    return (np.abs(a - b) <= 1e-8 + rtol * np.abs(b)).all(-1)


def voronoi_lengths(g: np.ndarray, steps: int = 200) -> np.ndarray:
    """Sorted lengths of the seven vectors, of metrics: Selling's reduction to an obtuse superbase. NaN where it doesn't end."""
    base = np.tile(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, -1, -1]]), (len(g), 1, 1))
    pairs = np.array(list(itertools.combinations(range(4), 2)))
    open_ = np.arange(len(g))
    for _ in range(steps):
        b = base[open_]
        dots = np.einsum("npc,ncd,nqd->npq", b, g[open_], b)[:, pairs[:, 0], pairs[:, 1]]
        worst = dots.argmax(1)
        more = dots[np.arange(len(b)), worst] > 1e-9 * np.einsum("nii->n", g[open_])
        open_, b, (i, j) = open_[more], b[more], pairs[worst[more]].T
        if not len(open_):
            break
        rows, turned = np.arange(len(b)), b[np.arange(len(b)), i]
        others = np.ones((len(b), 4), bool)
        others[rows, i] = others[rows, j] = False
        b += others[:, :, None] * turned[:, None, :]
        b[rows, i] = -turned
        base[open_] = b
    v = np.einsum("kp,npc->nkc", SEVEN, base[:, :3])
    out = np.sort(np.sqrt(np.maximum(np.einsum("nkc,ncd,nkd->nk", v, g, v), 0)), 1)
    out[open_] = np.nan
    return out


def matches(found: np.ndarray, truth: np.ndarray, system: str, rtol: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(equal within rtol, off by factors but not equal) of rows of partial cells, angles in radians."""
    factors, off = FACTORS[system], np.zeros(len(found), bool)

    def by_axis(cells: np.ndarray, n: int) -> np.ndarray:
        """Each of the n lengths by some factor, the angles as they are."""
        fits = close(cells[:, n:], truth[:, n:], rtol)
        for i in range(n):
            fits &= np.logical_or.reduce([close(cells[:, i : i + 1] * f, truth[:, i : i + 1], rtol) for f in factors])
        return fits

    if system == "rhombohedral":
        ok = close(found, truth, rtol)
        a2, cos = found[:, 0] ** 2, np.cos(found[:, 1])
        for d, e in RHOMBOHEDRAL:  # axes (d, e, e) and so on, of a lattice of one length and one angle
            own, cross = d * d + 2 * e * e, d * e * 2 + e * e
            length = np.sqrt(np.maximum(a2 * (own + 2 * cos * cross), 0))
            inner = a2 * (cross + cos * (own + cross))
            cells = np.stack([length, np.arccos(np.clip(inner / np.maximum(length**2, 1e-300), -1, 1))], 1)
            ok |= close(cells, truth, rtol)
            off |= by_axis(cells, 1)
    elif system == "orthorhombic":
        true = np.sort(truth, 1)
        ok = close(np.sort(found, 1), true, rtol)
        for f in itertools.product(factors, repeat=3):
            off |= close(np.sort(found * f, 1), true, rtol)
    elif system == "monoclinic":
        a, b, c, beta = found.T
        g = np.zeros((len(found), 3, 3))
        g[:, 0, 0], g[:, 1, 1], g[:, 2, 2] = a * a, b * b, c * c
        g[:, 0, 2] = g[:, 2, 0] = a * c * np.cos(beta)
        ok = np.zeros(len(found), bool)
        for k in MONOCLINIC:
            m = k.T @ g @ k
            x, y, z = (np.sqrt(m[:, i, i]) for i in range(3))
            cells = np.stack([x, y, z, np.arccos(np.clip(m[:, 0, 2] / np.maximum(x * z, 1e-300), -1, 1))], 1)
            ok |= close(cells, truth, rtol)
            off |= by_axis(cells, 3)
    elif system == "triclinic":
        mine, true = reduction.metric(found), voronoi_lengths(reduction.metric(truth))
        ok = close(voronoi_lengths(mine), true, rtol)
        reduced = reduction.reduced(mine)
        g = np.einsum("nic,ncd,njd->nij", reduced, mine, reduced)
        for k in (*(np.diag(f) for f in itertools.product(factors, repeat=3)), *HALVES):
            off |= close(voronoi_lengths(k @ g @ k.T), true, rtol)
    else:
        ok, off = close(found, truth, rtol), by_axis(found, found.shape[1])
    return ok, off & ~ok


def match_cells(df: DataFrame, key: list[str], system: str, found: str, truth: str, rtol: float = 0.01) -> DataFrame:
    """(key, system, correct, off): both false where a cell is null, has a parameter that is null or not finite, or isn't a cell of its system. Columns found and truth are arrays of the system's free parameters."""
    names = [*key, system]
    kinds = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        for pdf in batches:
            ok, off = np.zeros(len(pdf), bool), np.zeros(len(pdf), bool)
            for name in FACTORS:
                rows = np.flatnonzero(pdf[system] == name)
                size = {"cubic": 1, "tetragonal": 2, "hexagonal": 2, "rhombohedral": 2, "orthorhombic": 3, "monoclinic": 4, "triclinic": 6}[name]
                rows = np.array([i for i in rows if all(c is not None and len(c) == size for c in (pdf["_found"].iloc[i], pdf["_truth"].iloc[i]))], int)
                if not len(rows):
                    continue
                a, b = (np.stack([np.asarray(pdf[c].iloc[i], float) for i in rows]) for c in ("_found", "_truth"))
                fine = np.isfinite(a).all(1) & np.isfinite(b).all(1) & (a > 0).all(1) & (b > 0).all(1)
                if name == "triclinic":
                    fine[fine] = (np.linalg.det(reduction.metric(a[fine])) > 1e-9) & (np.linalg.det(reduction.metric(b[fine])) > 1e-9)
                if fine.any():
                    with np.errstate(invalid="ignore"):
                        ok[rows[fine]], off[rows[fine]] = matches(a[fine], b[fine], name, rtol)
            yield pdf[names].assign(correct=ok, off=off)

    return df.select(*names, F.col(found).alias("_found"), F.col(truth).alias("_truth")).mapInPandas(run, f"{kinds}, correct boolean, off boolean")


def classify_outcome(matched: DataFrame, pattern: str, lattice: str, true_lattice: str, m20: str) -> DataFrame:
    """(pattern, outcome), from all matched candidates of each pattern; the first that holds: found (correct, in the true lattice), incorrect_bl (correct, in another), off_by_two, explainer (m20 over EXPLAINS), not_found."""
    right = F.col(lattice).eqNullSafe(F.col(true_lattice))
    rules = (("found", F.col("correct") & right), ("incorrect_bl", F.col("correct") & ~right), ("off_by_two", F.col("off")), ("explainer", F.coalesce(F.col(m20) > EXPLAINS, F.lit(False))))
    flags = matched.groupBy(pattern).agg(*[F.bool_or(c).alias(n) for n, c in rules])
    return flags.select(pattern, F.coalesce(*[F.when(F.col(n), F.lit(n)) for n, _ in rules], F.lit("not_found")).alias("outcome"))
