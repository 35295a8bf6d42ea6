"""Distributions: histograms, order statistics, moments, co-occurrence, calibration."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(x: Column, low, high, bins: int) -> Column:
    """Which of equal bins; the last one has its right edge too. Null outside."""
    low, high = (F.lit(v) if not isinstance(v, Column) else v for v in (low, high))
    width = (high - low) / bins
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] | None = None, density: bool = False) -> DataFrame:
    """(by, bin, n), empty bins too; with density also n / (total * width). Values outside are dropped."""
    by = by or []
    counts = df.withColumn("bin", bin_of(F.col(value), low, high, bins)).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    grid = df.select(*by).distinct().select(*by, every) if by else df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if not density:
        return out
    total = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    out = out.join(total, by, "left") if by else out.crossJoin(F.broadcast(total))
    return out.withColumn("density", F.col("n") / (F.col("_total") * ((high - low) / bins))).drop("_total")


def histogram2d(df: DataFrame, x: str, y: str, low: tuple[float, float], high: tuple[float, float], bins: int) -> DataFrame:
    """(bx, by, n) of the bins that have rows."""
    placed = df.select(bin_of(F.col(x), low[0], high[0], bins).alias("bx"), bin_of(F.col(y), low[1], high[1], bins).alias("by"))
    return placed.where("bx IS NOT NULL AND by IS NOT NULL").groupBy("bx", "by").agg(F.count("*").alias("n"))


#: Groups whose splits are sent to all tasks, PARTS numbers each; more are joined by shuffle.
SENT_GROUPS = 4096


def order_quantile(df: DataFrame, value: str, fractions: list[float], by: list[str] | None = None, parts: int = 100) -> DataFrame:
    """(by, fraction, value): the element at index int(fraction * n) of the sorted values, without interpolation.

    A sketch gives rough splits; the rows between them are counted, and only
    those of the parts that hold an asked rank are looked at again: there equal
    values are counted first, so one that very many rows have is one row.
    Nulls don't count.
    """
    by = by or []
    key = [F.lit(0).alias("_g")] if not by else [F.col(b) for b in by]
    names = by or ["_g"]
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"))
    cuts = F.array_distinct(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 1000)).alias("_splits")
    splits = rows.groupBy(*names).agg(cuts, F.count("*").alias("_n"))
    few = splits.limit(SENT_GROUPS + 1).collect()
    small = len(few) <= SENT_GROUPS
    splits = df.sparkSession.createDataFrame(few, splits.schema) if small else splits
    sent = F.broadcast(splits.select(*names, "_splits")) if small else splits.select(*names, "_splits")
    same = lambda x, y: reduce(lambda p, q: p & q, (x[n].eqNullSafe(y[f"_k_{n}"]) for n in names))
    named = lambda d: d.withColumnsRenamed({n: f"_k_{n}" for n in names})
    gone = [f"_k_{n}" for n in names]
    sent = named(sent)
    placed = rows.join(F.broadcast(sent) if small else sent, same(rows, sent)).drop(*gone)
    placed = placed.select(*names, "_v", F.size(F.filter("_splits", lambda s: s < F.col("_v"))).alias("_part"))
    order = Window.partitionBy(*names).orderBy("_part")
    sizes = placed.groupBy(*names, "_part").agg(F.count("*").alias("_m")).withColumn("_upto", F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    asked = named(splits.select(*names, "_n", F.explode(F.array(*map(F.lit, fractions))).alias("fraction")).withColumn("_rank", F.least(F.floor(F.col("fraction") * F.col("_n")), F.col("_n") - 1)))
    where = sizes.join(asked, same(sizes, asked)).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_m")))
    where = where.select(*names, "_part", "fraction", (F.col("_rank") - F.col("_upto") + F.col("_m")).alias("_k"))
    few_parts = named(where.select(*names, "_part").distinct()).withColumnRenamed("_part", "_p")  # groups times fractions at most
    few_parts = F.broadcast(few_parts) if small else few_parts
    needed = placed.join(few_parts, same(placed, few_parts) & (F.col("_part") == F.col("_p")), "left_semi").groupBy(*names, "_part", "_v").agg(F.count("*").alias("_c"))
    within = Window.partitionBy(*names, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = needed.withColumn("_to", F.sum("_c").over(within))
    ranks = named(where).withColumnRenamed("_part", "_p")
    met = reached.join(ranks, same(reached, ranks) & (F.col("_part") == F.col("_p")))
    return met.where((F.col("_k") < F.col("_to")) & (F.col("_k") >= F.col("_to") - F.col("_c"))).select(*by, "fraction", F.col("_v").alias("value"))


def moments(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def covariance(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """(by, i, j, covariance) of all pairs i <= j."""
    pairs = list(itertools.combinations_with_replacement(values, 2))
    wide = df.groupBy(*by).agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`{a}|{b}`").alias("covariance")) for a, b in pairs]))
    return wide.select(*by, rows.alias("c")).select(*by, "c.*")


def position_frequencies(df: DataFrame, position: str, label: str) -> DataFrame:
    """(position, label, share) of the labels at each position; null labels don't count."""
    n = df.where(F.col(label).isNotNull()).groupBy(position, label).agg(F.count("*").alias("n"))
    return n.select(position, label, (F.col("n") / F.sum("n").over(Window.partitionBy(position))).alias("share"))


def binned_mean(df: DataFrame, x: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, mean) of the bins that have rows, at least the mean of all rows."""
    rows = df.withColumn("bin", bin_of(F.col(x), low, high, bins)).where("bin IS NOT NULL")
    total = rows.agg(F.avg(value).alias("_all"))
    return rows.groupBy("bin").agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(total)).select("bin", F.greatest("mean", "_all").alias("mean"))


def pair_lift(df: DataFrame, frame: str, item: str) -> DataFrame:
    """(i, j, joint, lift) of items i < j that share a frame: joint / (n_i * n_j / frames).

    The pairs of a frame come from its set of items, so their number is bounded
    by the number of different items, not of rows.
    """
    sets = df.groupBy(frame).agg(F.array_sort(F.collect_set(item)).alias("_s"))
    frames = sets.agg(F.count("*").alias("_frames"))
    single = sets.select(F.explode("_s").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    first = sets.select("_s", F.posexplode("_s").alias("_p", "i"))
    pairs = first.select("i", F.explode(F.slice("_s", F.col("_p") + 2, F.size("_s"))).alias("j")).groupBy("i", "j").agg(F.count("*").alias("joint"))
    out = pairs.join(single.toDF("i", "_ni"), "i").join(single.toDF("j", "_nj"), "j").crossJoin(F.broadcast(frames))
    return out.select("i", "j", "joint", (F.col("joint") / (F.col("_ni") * F.col("_nj") / F.col("_frames"))).alias("lift"))


def distribution_distance(df: DataFrame, by: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(g, h, distance) of groups g < h: integral of the absolute difference of their densities, by trapezoids over bin centres."""
    d = histogram(df, value, low, high, bins, [by], density=True)
    x, y = d.select(F.col(by).alias("g"), "bin", F.col("density").alias("p")), d.select(F.col(by).alias("h"), "bin", F.col("density").alias("q"))
    width = (high - low) / bins
    weight = F.when(F.col("bin").isin(0, bins - 1), 0.5).otherwise(1.0) * width
    return x.join(y, "bin").where("g < h").groupBy("g", "h").agg(F.sum(F.abs(F.col("p") - F.col("q")) * weight).alias("distance"))


def running_cdf(df: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    """df with cdf, the share of n up to each row in order."""
    w = Window.partitionBy(*by)
    return df.withColumn("cdf", F.sum(n).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(n).over(w))


def equal_count_edges(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, lo, hi): edges at the rank fractions i / bins, the ends given. Equal values share a bin."""
    inner = order_quantile(df, value, [i / bins for i in range(1, bins)])
    edges = inner.agg(F.array_sort(F.collect_list("value")).alias("e"))
    whole = edges.select(F.concat(F.array(F.lit(low)), "e", F.array(F.lit(high))).alias("e"))
    return whole.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(i.alias("bin"), F.get("e", i).alias("lo"), F.get("e", i + 1).alias("hi")))).alias("b")).select("b.*")


def inverse_density_weights(df: DataFrame, value: str, bins: int = 25, most: float = 10.0) -> DataFrame:
    """df with weight: sqrt(1 / density) over the least such, at most `most`; 25 bins between the 1 % and 99 % order statistics, rows outside as the bins at the ends."""
    q = order_quantile(df, value, [0.01, 0.99]).groupBy().pivot("fraction", [0.01, 0.99]).agg(F.first("value")).toDF("_lo", "_hi")
    placed = df.crossJoin(F.broadcast(q))
    clipped = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col(value)))
    placed = placed.withColumn("_bin", bin_of(clipped, F.col("_lo"), F.col("_hi"), bins)).drop("_lo", "_hi")
    n = placed.groupBy("_bin").agg(F.count("*").alias("_n"))
    top = n.agg(F.max("_n").alias("_top"))
    weights = n.crossJoin(F.broadcast(top)).select("_bin", F.least(F.sqrt(F.col("_top") / F.col("_n")), F.lit(most)).alias("weight"))
    return placed.join(F.broadcast(weights), "_bin").drop("_bin")


def errors(df: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """(by, n, rmse, mae) and the 25, 50 and 75 % order statistics of the absolute error."""
    rows = df.withColumn("_e", F.abs(F.col(guess) - F.col(truth)))
    total = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_e").alias("mae"))
    q = order_quantile(rows, "_e", [0.25, 0.5, 0.75], by).groupBy(*by).pivot("fraction", [0.25, 0.5, 0.75]).agg(F.first("value")).toDF(*by, "q25", "q50", "q75")
    return total.join(q, by)


def calibration(df: DataFrame, truth: str, guess: str, std: str, low: float, high: float, bins: int = 25) -> DataFrame:
    """By bins of the predicted deviation: n, mean and population std of |error|, root mean variance, rmse and their relative difference."""
    e = F.col(guess) - F.col(truth)
    rows = df.withColumn("bin", bin_of(F.col(std), low, high, bins)).where("bin IS NOT NULL")
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mean_error"), F.stddev_pop(F.abs(e)).alias("std_error"), F.sqrt(F.avg(F.col(std) * F.col(std))).alias("rmv"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return out.withColumn("difference", F.abs(F.col("rmv") - F.col("rmse")) / F.col("rmv"))


def expected_calibration_error(df: DataFrame, truth: str, guess: str, prob: str, bins: int = 25) -> DataFrame:
    """One row: sum over equal bins of share * |mean probability - accuracy|, between the least and greatest probability."""
    ends = df.agg(F.min(prob).alias("_lo"), F.max(prob).alias("_hi"))
    rows = df.crossJoin(F.broadcast(ends)).withColumn("_bin", bin_of(F.col(prob), F.col("_lo"), F.col("_hi"), bins))
    each = rows.groupBy("_bin").agg(F.count("*").alias("_n"), F.avg(prob).alias("_p"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("_a"))
    return each.agg((F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_a"))) / F.sum("_n")).alias("ece"))


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, support, precision, recall, f1); 0 where a share has no rows."""
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.sum((F.col(truth) == F.col(guess)).cast("long")).alias("_hit"))
    g = df.groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("_said"))
    both = t.join(g, "label", "full").na.fill(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    both = both.withColumn("precision", share(F.col("_hit"), F.col("_said"))).withColumn("recall", share(F.col("_hit"), F.col("support")))
    return both.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("_hit", "_said")


def nll(df: DataFrame, residual: Column, sigma: Column, by: list[str]) -> DataFrame:
    """Negative log-likelihood of normal errors."""
    return df.groupBy(*by).agg(F.sum(F.log(math.sqrt(2 * math.pi) * sigma) + 0.5 * F.pow(residual / sigma, 2)).alias("nll"))
