"""Scoring and refining candidate cells, many patterns at once."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspark.functions.cell import FREE, hkl_terms

#: Mean number of symmetry-equal reflections by lattice. Fixed values.
MULTIPLICITY = {"cF": 128, "cI": 64, "cP": 32, "hP": 14, "hR": 8, "tI": 26, "tP": 13, "oC": 14, "oF": 28, "oI": 14, "oP": 7, "mC": 6.4, "mP": 3.5, "aP": 1.8}


def reference_hkl(spark: SparkSession, lattice: str, system: str, n: int, weights: list[float], reach: int = 6) -> DataFrame:
    """(ref_index, h, k, l, terms): n - 1 reflections in order of their terms' product with the weights, and (0, 0, 0) at the end.

    All indices up to reach, without those that the centring forbids (an R
    lattice has its primitive axes, on which nothing is forbidden); of
    reflections with equal terms the largest (h, k, l).
    """
    one = reference_grid(spark, {lattice: system}, reach)
    size = sum((F.get("terms", F.lit(i)) * w for i, w in enumerate(weights)), F.lit(0.0))
    top = one.withColumn("_s", size).orderBy("_s", "terms").limit(n - 1).agg(F.array_sort(F.collect_list(F.struct("_s", "terms", "m"))).alias("all"))
    listed = top.select(F.posexplode("all").alias("ref_index", "x")).select("ref_index", "x.m.h", "x.m.k", "x.m.l", "x.terms")
    zero = spark.range(1).select(F.lit(n - 1).alias("ref_index"), *[F.lit(0).alias(x) for x in "hkl"], F.array(*[F.lit(0)] * len(FREE[system])).alias("terms"))
    return listed.union(zero)


def reference_grid(spark: SparkSession, systems: dict[str, str], reach: int = 6) -> DataFrame:
    """(lattice, terms, m): the different terms of all reflections up to reach of some lattices, given with their systems, and the largest (h, k, l) of each; see reference_hkl."""
    r = spark.range(-reach, reach + 1, 1, 1).select(F.col("id").cast("int").alias("h"))
    grid = r.crossJoin(r.withColumnRenamed("h", "k")).crossJoin(r.withColumnRenamed("h", "l"))  # a fixed (2 * reach + 1)**3 rows
    h, k, l, lattice = (F.col(c) for c in ("h", "k", "l", "lattice"))  # noqa: E741
    even = lambda x: x % 2 == 0
    centring = F.lit(True)
    for kind, left in {"F": even(h + k) & even(k + l), "I": even(h + k + l), "C": even(h + k)}.items():
        centring = F.when(lattice.isin([name for name in systems if (name[1:] if name != "mC" else "I") == kind]), left).otherwise(centring)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("lattice"), F.lit(system).alias("system")) for name, system in systems.items()]))
    rows = grid.where(~((h == 0) & (k == 0) & (l == 0))).withColumn("_of", each).select("h", "k", "l", "_of.*").where(centring)
    return rows.groupBy("lattice", hkl_terms(h, k, l, F.col("system")).alias("terms")).agg(F.max(F.struct("h", "k", "l")).alias("m"))


def m20(observed: Column, calculated: Column, refs: Column) -> Column:
    """Figure of merit: the greatest reference below the last calculated peak, over twice their number and the mean error. 0 without such references, infinite without an error."""
    error = F.aggregate(F.zip_with(observed, calculated, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / F.size(observed)
    below = F.filter(refs, lambda r: r < F.element_at(calculated, -1))
    return F.when(F.size(below) == 0, 0.0).when(error > 0, F.array_max(below) / (2 * F.size(below)) / error).otherwise(float("inf"))


def peak_probability(q2: Column, calculated: Column, reciprocal_volume: Column, multiplicity) -> Column:
    """Probability that a peak is explained, against a chance hit."""
    return 1 / (1 + 8 * math.pi * q2 * F.abs(F.sqrt(q2) - F.sqrt(calculated)) / (reciprocal_volume * multiplicity))


def m_info(probability: Column) -> Column:
    """Sum of the information of the peaks of an array of probabilities, in bits: -log2(1 - exp(-x)) of x = -sum ln p."""
    nats = F.aggregate(probability, F.lit(0.0), lambda s, p: s - F.log(p))
    return -F.log2(1 - F.exp(-nats))


def n_indexed(probability: Column, over: float = 0.95) -> Column:
    return F.size(F.filter(probability, lambda p: p > over))


def weighted_lsq(df: DataFrame, by: list[str], y: Column, terms: list[Column], sigma: Column) -> DataFrame:
    """(by, x0, ...): the least squares solution of y = sum of terms * x, of 1 to 3 terms, by normal equations and Cramer's rule. 0 where they have no rank."""
    n = len(terms)
    w = 1 / (sigma * sigma)
    sums = {f"_h{i}{j}": F.sum(terms[i] * terms[j] * w) for i in range(n) for j in range(i, n)} | {f"_g{i}": F.sum(terms[i] * y * w) for i in range(n)}
    out = df.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])
    matrix = [[F.col(f"_h{min(i, j)}{max(i, j)}") for j in range(n)] for i in range(n)]
    right = [F.col(f"_g{i}") for i in range(n)]

    def det(m: list[list[Column]]) -> Column:
        if len(m) == 1:
            return m[0][0]
        return sum(((-1) ** j * m[0][j] * det([r[:j] + r[j + 1 :] for r in m[1:]]) for j in range(len(m))), F.lit(0.0))

    full = det(matrix)
    solved = [det([r[:i] + [g] + r[i + 1 :] for r, g in zip(matrix, right, strict=True)]) for i in range(n)]
    return out.select(*by, *[F.when(F.abs(full) > 0, s / full).otherwise(0.0).alias(f"x{i}") for i, s in enumerate(solved)])


def cubic_search(peaks: DataFrame, sums: list[int], starts: int = 12, n_peaks: int = 10, top: int = 20) -> DataFrame:
    """(pattern_id, candidate_id, x, m20): the best cubic cells of each pattern.

    Peaks are (pattern_id, peak_index, q2). Each pattern's first peak is taken
    for each of the first sums of squared indices in turn; all peaks are
    assigned to the nearest reference, one least squares step refines the cell,
    and it stays if the figure of merit grew. One grouping gathers a pattern
    (n_peaks values); all its starts are scored in one pass, a batch at once.
    """
    from cellspark.operators.curation import top_n
    from cellspark.operators.indexing import assign

    arrays = peaks.where(F.col("peak_index") < n_peaks).groupBy("pattern_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("peak_index", "q2"))), lambda p: p["q2"]).alias("q"))
    refs = np.array(sums, float)[:, None]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            q = np.repeat(np.stack(pdf["q"].to_numpy()).astype(float), starts, 0)
            x = q[:, :1] / np.tile(refs[:starts], (len(pdf), 1))
            at, calc, old = assign(q, x, refs)
            terms = refs[at, 0]
            weight = q * (np.abs(q - calc) + 1e-10)
            up, down = (reduce(np.add, (terms * z / weight).T) for z in (q, terms))
            y = (up / down)[:, None]
            new = assign(q, y, refs)[2]
            better = new > old
            yield pd.DataFrame({"pattern_id": np.repeat(pdf["pattern_id"].to_numpy(), starts), "candidate_id": np.tile(np.arange(starts, dtype=np.int32), len(pdf)), "x": np.where(better, y[:, 0], x[:, 0]), "m20": np.where(better, new, old)})

    found = arrays.where(F.size("q") == n_peaks).mapInPandas(run, "pattern_id long, candidate_id int, x double, m20 double")
    return top_n(found, ["pattern_id"], [F.col("m20").desc(), F.col("candidate_id")], top)


def keep_improved(old: DataFrame, new: DataFrame, key: list[str], score: str) -> DataFrame:
    """Per candidate the row with the greater score; the old one of equal ones."""
    names = [c for c in old.columns if c not in key]
    both = old.select(*key, F.struct(*names).alias("_o")).join(new.select(*key, F.struct(*names).alias("_n")), key, "left")
    picked = F.when(F.col(f"_n.{score}") > F.col(f"_o.{score}"), F.col("_n")).otherwise(F.col("_o"))
    return both.select(*key, picked.alias("_p")).select(*key, "_p.*")
