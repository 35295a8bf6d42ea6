"""Entries and candidates at scale: validation, noise, generation, refinement, de-duplication."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspark.functions import cell, symmetry
from cellspark.operators.curation import draw, ordinals
from cellspark.operators.indexing import dealt, thinned

#: Widths of the error of q2: constant and in proportion. Fixed values.
NOISE = (8.7e-5, 9.2e-4)


def uniform(seed, *ids: str) -> Column:
    """A number in (0, 1) that depends on the seed and the ids only."""
    return (F.conv(F.substring(draw(seed, *ids), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def uniform_at(seed: int, key: Column, i: Column) -> Column:
    """Likewise, inside higher-order functions."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal_at(seed: int, key: Column, i: Column) -> Column:
    """A standard normal number, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform_at(seed, key, i))) * F.cos(2 * math.pi * uniform_at(seed + 1, key, i))


def validate_entries(df: DataFrame) -> DataFrame:
    """df with status and reason, the short name of the first rule that fails.

    Takes sg, crystal_system, symbol, a to c, angles alpha to gamma in degrees,
    volume and atoms (per cell), and lattice, lattice_system from with_symmetry;
    where df has them, also a reported reduced cell (array of six, angles in
    degrees) and reduced_volume.
    """
    angles = [F.radians(n) for n in cell.ANGLES]
    c = F.col
    calculated = cell.volume(c("a"), c("b"), c("c"), *angles)
    reduced = []
    if {"reduced_cell", "reduced_volume"} <= set(df.columns):
        r = [F.get("reduced_cell", F.lit(i)) for i in range(6)]
        fits = cell.close(cell.volume(*r[:3], *map(F.radians, r[3:])), c("reduced_volume"))
        reduced = [((F.array_min("reduced_cell") == 0) | (c("reduced_volume") == 0), "reduced_zero"), (c("reduced_cell").isNotNull() & ~F.coalesce(fits, F.lit(False)), "reduced_volume")]
    rules = (
        (c("sg") > 230, "sg"),
        (~symmetry.system_matches_lattice(c("crystal_system"), c("lattice")), "system"),
        ((c("lattice_system") == "monoclinic") & c("symbol").startswith("F"), "f_monoclinic"),
        ((c("lattice_system") == "triclinic") & ~c("symbol").startswith("P"), "centred_triclinic"),
        ((F.least(*[c(n) for n in cell.NAMES]) == 0) | (c("volume") == 0), "zero"),
        (~F.coalesce(cell.close(calculated, c("volume")), F.lit(False)), "volume"),
        *reduced,
        (~cell.matches_lattice(c("lattice"), *[c(n) for n in cell.NAMES]), "lattice"),
        (c("atoms").isNull(), "formula"),
        ((c("volume") < 1.8 * c("atoms")) | (c("volume") > 180 * c("atoms")), "atoms"),
    )
    reason = F.coalesce(*[F.when(rule, text) for rule, text in rules])
    return df.withColumn("reason", reason).withColumn("status", F.col("reason").isNull())


def add_q2_noise(df: DataFrame, key: str, q2: str = "q2", times: float = 1.0, seed: int = 0) -> DataFrame:
    """Peak arrays with normal errors, made positive and sorted again."""
    noisy = F.transform(q2, lambda q, i: F.abs(q + times * (NOISE[0] + NOISE[1] * q) * normal_at(seed, F.col(key), i)))
    return df.withColumn(q2, F.array_sort(noisy))


def add_contaminants(df: DataFrame, key: str, k: int, q2: str = "q2", seed: int = 0, tries: int = 50) -> DataFrame:
    """Peak arrays with k more peaks, uniform between half the first and the last one and half a width at least from all; sorted, of the old length."""
    first, last = F.element_at(q2, 1), F.element_at(q2, -1)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: 0.5 * first + (last - 0.5 * first) * uniform_at(seed, F.col(key), i))
    free = F.filter(drawn, lambda x: F.forall(q2, lambda q: F.abs(x - q) >= 0.5 * (0.00007 + 0.002 * q)))
    return df.withColumn(q2, F.slice(F.array_sort(F.concat(q2, F.slice(free, 1, k))), 1, F.size(q2)))


def perturb_at_distances(df: DataFrame, key: str, xnn: str, distances: list[float], n: int, seed: int = 0) -> DataFrame:
    """n cells at each distance from each row's coefficients, in random directions."""
    rows = df.withColumn("distance", F.explode(F.array(*map(F.lit, distances)))).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    id_ = F.concat_ws(":", F.col(key).cast("string"), F.col("distance").cast("string"), F.col("trial").cast("string"))
    rows = rows.withColumn("_w", F.transform(xnn, lambda x, i: normal_at(seed, id_, i)))
    length = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn(xnn, F.zip_with(xnn, "_w", lambda x, w: x + F.col("distance") * w / length)).drop("_w")


def repair_cells(df: DataFrame, key: str, values: list[str], low: dict[str, float], high: dict[str, float], seed: int = 0) -> DataFrame:
    """Values out of range or null are drawn anew within a tenth of the range from the edge they passed."""
    out = {}
    for v in values:
        step = 0.1 * (high[v] - low[v]) * uniform(f"{seed}{v}", key)
        out[v] = F.when(F.col(v) > high[v], high[v] - step).when((F.col(v) < low[v]) | F.col(v).isNull() | F.isnan(v), low[v] + step).otherwise(F.col(v))
    return df.withColumns(out)


#: Rows of a group that lost ones may take their values from.
DONORS = 64


def with_donors(df: DataFrame, by: list[str], key: str, values: list[str], seed: int = 0) -> DataFrame:
    """df where a row with a value that is null or not finite has all values of a sound row of its group, chosen by hash among the DONORS with the least hashes; where the group has none it stays.

    Ties go to the smaller key. Which donor a row takes depends on the ids
    alone, not on partitions or on other lost rows.
    """
    fits = reduce(lambda x, y: x & y, (F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & (F.abs(v) < float("inf")) for v in values))
    sound = F.coalesce(fits, F.lit(False))
    few = df.where(sound).withColumn("_h", draw(seed, key))
    for salt in (F.pmod(F.xxhash64(key), F.lit(32)), F.lit(0)):  # a group that holds most rows is cut down in parts first
        few = few.withColumn("_s", salt).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_s").orderBy("_h", key))).where(F.col("_r") <= DONORS)
    donors = few.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_h", key, *values))), lambda d: F.struct(*[d[v].alias(v) for v in values])).alias("_donors"))
    donors = donors.withColumnsRenamed({b: f"_by_{b}" for b in by})
    lost = df.where(~sound)
    met = lost.join(F.broadcast(donors) if not by else donors, reduce(lambda x, y: x & y, (lost[b].eqNullSafe(donors[f"_by_{b}"]) for b in by), F.lit(True)), "left")
    pick = F.get("_donors", F.pmod(F.xxhash64(F.lit(seed), key), F.size("_donors")).cast("int"))
    filled = met.withColumn("_d", pick).withColumns({v: F.when(F.col("_donors").isNotNull(), F.col(f"_d.{v}")).otherwise(F.col(v)) for v in values})
    return df.where(sound).unionByName(filled.select(*df.columns))


def random_cells(df: DataFrame, key: str, n: int, low: float, high: float, volume: Column, seed: int = 0) -> DataFrame:
    """n orthorhombic cells a row: uniform lengths, scaled to the wanted volume and ordered."""
    rows = dealt(df.withColumn("_volume", volume), key).withColumn("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    lengths = [low + (high - low) * uniform(f"{seed}{a}", key, "candidate_id") for a in "abc"]
    scale = F.cbrt(F.col("_volume") / (lengths[0] * lengths[1] * lengths[2]))
    return rows.withColumn("cell", F.sort_array(F.array(*[v * scale for v in lengths]))).drop("_volume")


def greedy_assignments(df: DataFrame, by: str, peak: str, label: str, p: str) -> DataFrame:
    """(by, peak, label): the most probable pair first, then the next of peaks and labels that are still free. Ties by peak, then label."""
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col(p)).alias("n"), F.col(peak).alias("peak"), F.col(label).alias("label")))).alias("all"))
    none = F.array().cast("array<struct<peak:int,label:int>>")
    taken = F.aggregate("all", none, lambda acc, x: F.when(F.exists(acc, lambda y: (y["peak"] == x["peak"]) | (y["label"] == x["label"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["peak"].cast("int").alias("peak"), x["label"].cast("int").alias("label"))))))
    return rows.select(by, F.explode(taken).alias("t")).select(by, F.col("t.peak").alias(peak), F.col("t.label").alias(label))


def draw_assignments(df: DataFrame, by: str, peak: str, label: str, p: str, seed: int = 0) -> DataFrame:
    """(by, peak, label): peaks in random order draw a label each, in proportion to p among the labels still free."""
    peaks = df.groupBy(by, peak).agg(F.array_sort(F.collect_list(F.struct(F.col(label).cast("int").alias("label"), F.col(p).cast("double").alias("p")))).alias("choices"))
    rows = peaks.withColumn("u", uniform(seed, by, peak)).withColumn("o", draw(seed + 1, by, peak)).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("o", F.col(peak).cast("int").alias("peak"), "u", "choices"))).alias("all"))
    none = F.array().cast("array<struct<peak:int,label:int>>")

    def pick(acc: Column, x: Column) -> Column:
        free = F.filter(x["choices"], lambda c: ~F.exists(acc, lambda y: y["label"] == c["label"]))
        total = F.aggregate(free, F.lit(0.0), lambda s, c: s + c["p"])
        upto = F.aggregate(free, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("l")), lambda s, c: F.struct((s["s"] + c["p"]).alias("s"), F.when(s["l"].isNull() & (s["s"] + c["p"] >= x["u"] * total), c["label"]).otherwise(s["l"]).alias("l")), lambda s: s["l"])
        return F.when(upto.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(x["peak"].alias("peak"), upto.alias("label")))))

    return rows.select(by, F.explode(F.aggregate("all", none, pick)).alias("t")).select(by, F.col("t.peak").alias(peak), F.col("t.label").alias(label))


def thin_peaks(df: DataFrame, key: str, q2: str, keep: float, overlap: float, seed: int = 0) -> DataFrame:
    """Peak arrays walked in order: a peak nearer than overlap to the last kept one goes, another stays with probability keep; the first stays."""
    start = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<double>").alias("kept"))

    def step(acc: Column, q: Column) -> Column:
        stays = (F.size(acc["kept"]) == 0) | ((q - acc["last"] >= overlap) & (uniform_at(seed, F.col(key), q) < keep))
        return F.when(stays, F.struct(q.alias("last"), F.concat(acc["kept"], F.array(q)).alias("kept"))).otherwise(acc)

    return df.withColumn(q2, F.aggregate(q2, start, step, lambda acc: acc["kept"]))


def with_multiples(df: DataFrame, value: str, factors: list[float]) -> DataFrame:
    """A row for each factor, with the coefficient times its square."""
    return df.withColumn("factor", F.explode(F.array(*map(F.lit, factors)))).withColumn(value, F.col(value) * F.col("factor") * F.col("factor"))


def near_truth(candidates: DataFrame, truth: DataFrame, key: str, value: str, most: float) -> DataFrame:
    return candidates.join(truth.select(key, F.col(value).alias("_t")), key).where(F.abs(F.col(value) - F.col("_t")) <= most).drop("_t")


def triplet_difference(observed: Column, h0: list[Column], h1: list[Column], x: list[Column], images: list[tuple]) -> Column:
    """The calculated q2 of S h0 - h1, over the symmetry images S, that is nearest to the observed one; the first of equally near ones."""
    out = []
    for i, m in enumerate(images):
        d = [sum((m[3 * r + c] * h0[c] for c in range(3)), F.lit(0)) - h1[r] for r in range(3)]
        q = x[0] * d[0] * d[0] + x[1] * d[1] * d[1] + x[2] * d[2] * d[2]
        out.append(F.struct(F.abs(observed - q).alias("e"), F.lit(i).alias("i"), q.cast("double").alias("q")))
    return F.array_min(F.array(*out))["q"]


#: Mirror images of a reflection that leave an orthogonal cell as it is. Fixed values.
MIRRORS = [(1, 0, 0, 0, 1, 0, 0, 0, 1), (1, 0, 0, 0, 1, 0, 0, 0, -1), (1, 0, 0, 0, -1, 0, 0, 0, 1), (-1, 0, 0, 0, 1, 0, 0, 0, 1)]


def keep_rate_grid(df: DataFrame, by: str, q2: str, kept: str, gaps: list[float], q_most: float, q_bins: int) -> DataFrame:
    """(gap_bin, q_bin, rate, smooth): share of kept peaks whose next true peak is kept too, by the smaller gap to both sides and by place.

    Cells without peaks count 0.5; smooth is the median of a cell and its four
    neighbours, the edge standing for what lies beyond it.
    """
    w = Window.partitionBy(by).orderBy(q2)
    rows = df.select(by, q2, kept, F.least(F.col(q2) - F.lag(q2).over(w), F.lead(q2).over(w) - F.col(q2)).alias("_g"), F.lead(kept).over(w).alias("_next"), F.lag(q2).over(w).alias("_p")).where(F.col(kept) & F.col("_p").isNotNull() & F.col("_next").isNotNull())
    edges = F.array(*map(F.lit, gaps))
    placed = rows.withColumn("gap_bin", F.size(F.filter(edges, lambda e: e < F.col("_g"))) - 1).withColumn("q_bin", F.least(F.floor(F.col(q2) / (q_most / q_bins)), F.lit(q_bins - 1)).cast("int"))
    rate = placed.where(F.col("gap_bin").between(0, len(gaps) - 2)).groupBy("gap_bin", "q_bin").agg(F.avg(F.col("_next").cast("double")).alias("rate"))
    spark = df.sparkSession
    grid = spark.range((len(gaps) - 1) * q_bins).select((F.col("id") / q_bins).cast("int").alias("gap_bin"), (F.col("id") % q_bins).cast("int").alias("q_bin"))
    whole = grid.join(rate, ["gap_bin", "q_bin"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.5)))
    inside = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top), v))
    around = F.explode(F.array(*[F.struct(inside(F.col("gap_bin") + i, len(gaps) - 2).alias("i"), inside(F.col("q_bin") + j, q_bins - 1).alias("j")) for i, j in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))]))
    near = whole.select("gap_bin", "q_bin", around.alias("s")).join(whole.select(F.col("gap_bin").alias("_i"), F.col("q_bin").alias("_j"), F.col("rate").alias("_r")), (F.col("s.i") == F.col("_i")) & (F.col("s.j") == F.col("_j")))
    return whole.join(near.groupBy("gap_bin", "q_bin").agg(F.percentile("_r", 0.5).alias("smooth")), ["gap_bin", "q_bin"])


def rarity_weights(df: DataFrame, group: str, bin_: str, target: float, most: int) -> DataFrame:
    """df with n_copies: 1 / (share of the group * share of the bin within it), scaled to a median of target, rounded, at most `most`."""
    by = df.groupBy(group, bin_).agg(F.count("*").alias("_n"))  # as many rows as bins: all that follows but the last join is over these
    of_group = by.groupBy(group).agg(F.sum("_n").alias("_g"))
    by = by.join(of_group, by[group].eqNullSafe(of_group[group])).drop(of_group[group])
    by = by.crossJoin(F.broadcast(by.agg(F.sum("_n").alias("_all")))).withColumn("_rarity", 1 / ((F.col("_g") / F.col("_all")) * (F.col("_n") / F.col("_g"))))
    middle = by.agg(F.percentile("_rarity", 0.5, F.col("_n")).alias("_m"))
    copies = by.crossJoin(F.broadcast(middle)).select(F.col(group).alias("_group"), F.col(bin_).alias("_bin"), F.least(F.lit(most), F.round(target * F.col("_rarity") / F.col("_m"))).cast("int").alias("n_copies"))
    return df.join(copies, df[group].eqNullSafe(F.col("_group")) & df[bin_].eqNullSafe(F.col("_bin"))).drop("_group", "_bin")


def coverage_objective(df: DataFrame, by: list[str], value: str, curve: list[tuple[float, float]]) -> DataFrame:
    """(by, objective): over radii, by trapezoids, how far the candidates within each fall short of (or go beyond) 1 / success; 100 more where none reaches it."""
    counts = df.groupBy(*by).agg(*[F.sum((F.col(value) <= r).cast("long")).alias(f"_c{i}") for i, (r, _) in enumerate(curve)])
    excess = [F.col(f"_c{i}") * s - 1 for i, (_, s) in enumerate(curve)]
    area = sum(((curve[i + 1][0] - curve[i][0]) * (F.abs(excess[i]) + F.abs(excess[i + 1])) / 2 for i in range(len(curve) - 1)), F.lit(0.0))
    reached = F.greatest(*excess) >= 0
    return counts.select(*by, (area + F.when(reached, 0.0).otherwise(100.0)).alias("objective"))


def dedup_radius(df: DataFrame, by: list[str], key: str, vec: str, order: str, score: str, radius: float, block: int = 1000) -> DataFrame:
    """Rows of df that stand for all others: in blocks of rows by order, the densest neighbourhood gives way to its best row until none has two.

    Neighbours are nearer than radius. Ties: the densest with the least key,
    the best score with the least key. Rows with a null vector are dropped.
    """
    rows = ordinals(df.where(F.col(vec).isNotNull()), [*by, order, key], "_ordinal")
    first = rows.groupBy(*by).agg(F.min("_ordinal").alias("_first")).withColumnsRenamed({b: f"_by_{b}" for b in by})
    rows = rows.join(first, reduce(lambda x, y: x & y, (rows[b].eqNullSafe(first[f"_by_{b}"]) for b in by))).drop(*[f"_by_{b}" for b in by])
    rows = rows.withColumn("_block", F.floor((F.col("_ordinal") - F.col("_first")) / block)).drop("_ordinal", "_first")

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        return pdf[thinned(np.stack(pdf[vec].to_numpy()).astype(float), pdf[score].to_numpy(), radius)]

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(*by, "_block").applyInPandas(thin, names).drop("_block")
