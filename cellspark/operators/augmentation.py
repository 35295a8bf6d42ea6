"""Copies of entries with changed cells, from the spread of their group; their lines anew."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspark.functions.cell import FREE
from cellspark.operators import indexing
from cellspark.operators.forests import _normal, xnn_of_cells
from cellspark.operators.stats import covariance

#: Groups whose factors are sent to all tasks, a small matrix each.
GROUPS = 1 << 16
METHODS = ("scale", "covariance", "principal")
LENGTHS = {"cubic": 1, "tetragonal": 2, "hexagonal": 2, "rhombohedral": 1}


def group_spread(df: DataFrame, group: str, values: list[str]) -> dict:
    """For each group the matrix whose columns are its principal axes times their deviations: times normal numbers it gives changes with the group's covariance. Rows with a null or non-finite value don't count."""
    fine = df
    for v in values:
        fine = fine.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & (F.abs(v) < float("inf")))
    rows = covariance(fine, values, [group]).limit(GROUPS * len(values) ** 2 + 1).collect()
    if len(rows) > GROUPS * len(values) ** 2:
        raise ValueError(f"more than {GROUPS} groups")
    out: dict = {}
    for r in rows:
        m = out.setdefault(r[group], np.zeros((len(values),) * 2))
        i, j = values.index(r["i"]), values.index(r["j"])
        m[i, j] = m[j, i] = r["covariance"] if r["covariance"] is not None else 0.0
    spread = {}
    for g, m in out.items():
        variance, axes = np.linalg.eigh(m)
        spread[g] = axes * np.sqrt(np.maximum(variance, 0))
    return spread


def restored(cells: np.ndarray, system: str) -> np.ndarray:
    """Axes in their standard order: orthorhombic by length, monoclinic a before c with beta obtuse; others as they are."""
    if system == "orthorhombic":
        return np.sort(cells, 1)
    if system == "monoclinic":
        a, b, c, beta = cells.T
        return np.stack([np.minimum(a, c), b, np.maximum(a, c), np.maximum(beta, np.pi - beta)], 1)
    return cells


def augment_entries(df: DataFrame, key: str, group: str, values: list[str], system: str, method: str, copies: Column | int, share: float = 0.1, limits: tuple[float, float] = (2.25, 250.0), n_peaks: int = 10, tries: int = 100, seed: int = 0) -> DataFrame:
    """(key, copy, cell, q): `copies` copies of each row, its cell (partial, angles in radians) changed and its n_peaks first lines.

    method: scale (each length by its own normal factor of deviation share),
    covariance (share times a draw with the covariance of the row's group) or
    principal (along one principal axis of the group, drawn by hash, by share
    times its deviation). Axes are put in order again; of `tries` draws the first
    counts whose lengths are within the limits and whose angles make a cell; where
    none does there is no copy. Draws depend on the key and the copy alone. A
    null or non-finite value, or no copies, give none; a group of one row has no
    spread, so its copies by covariance are the row itself. The spread is of all
    rows of df; its matrices are sent to all tasks, GROUPS of them at most.
    """
    if method not in METHODS:
        raise ValueError(method)
    spark, p = df.sparkSession, len(values)
    sent = spark.sparkContext.broadcast(group_spread(df, group, values) if method != "scale" else {})
    refs, lengths = indexing.reference_terms(spark, {"cubic": "cP", "tetragonal": "tP", "hexagonal": "hP", "rhombohedral": "hR", "orthorhombic": "oP", "monoclinic": "mP", "triclinic": "aP"}[system]), LENGTHS.get(system, 3)
    times = copies if isinstance(copies, Column) else F.lit(copies)
    rows = indexing.dealt(df.where(times > 0), key).select(key, F.col(key).cast("long").alias("_id"), F.col(group).alias("_g"), F.explode(F.sequence(F.lit(1), times)).alias("copy"), F.array(*[F.col(v).cast("double") for v in values]).alias("_v"))

    def drawn(v: np.ndarray, m: np.ndarray | None, ids: np.ndarray, draw: np.ndarray) -> np.ndarray:
        z = _normal(seed, 0, ids, draw, p)
        if method == "scale":
            cells = v * np.where(np.arange(p) < lengths, 1 + share * z, 1.0)
        elif method == "principal":
            at = (indexing.draws(seed, 1, ids, draw, 1)[:, 0] * p).astype(int)
            cells = v + share * np.take_along_axis(m, at[:, None, None], 2)[:, :, 0] * z[:, :1]
        else:
            cells = v + share * np.einsum("nj,nij->ni", z, m)
        return restored(cells, system)

    def judged(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = xnn_of_cells(cells, system)
        fits = np.isfinite(x).all(1) & (cells[:, :lengths] >= limits[0]).all(1) & (cells[:, :lengths] <= limits[1]).all(1)
        if system in ("rhombohedral", "monoclinic", "triclinic"):
            fits &= (cells[:, lengths:] > 0).all(1) & (cells[:, lengths:] < np.pi).all(1)
        return x, fits

    def run(batches):
        for pdf in batches:
            v = np.stack(pdf["_v"].to_numpy()).astype(float) if len(pdf) else np.empty((0, p))
            ids, copy = pdf["_id"].to_numpy(), pdf["copy"].to_numpy()
            out, lines = np.full(v.shape, np.nan), np.full((len(v), len(FREE[system])), np.nan)
            left = np.flatnonzero(np.isfinite(v).all(1))
            m = None
            if method != "scale" and len(left):
                m = np.full((len(v), p, p), np.nan)
                m[left] = np.stack([sent.value[g if g == g else None] for g in pdf["_g"].to_numpy()[left]])
            for t in range(tries):  # only rows that no draw has fitted yet go on
                if not len(left):
                    break
                cells = drawn(v[left], None if m is None else m[left], ids[left], t + tries * copy[left].astype(np.int64))
                x, fits = judged(cells)
                out[left[fits]], lines[left[fits]] = cells[fits], x[fits]
                left = left[~fits]
            found = np.flatnonzero(np.isfinite(lines).all(1))
            for lo in range(0, len(found), 1024):
                at = found[lo : lo + 1024]
                yield pd.DataFrame({key: pdf[key].to_numpy()[at], "copy": copy[at], "cell": list(out[at]), "q": indexing.first_lines(indexing.calculated(lines[at], refs), n_peaks)})

    kind = df.schema[key].dataType.simpleString()
    return rows.select(key, "_id", "_g", F.col("copy").cast("int").alias("copy"), "_v").mapInPandas(run, f"`{key}` {kind}, copy int, cell array<double>, q array<double>")
