"""Entry curation: de-duplication, tolerance joins, splits and samples.

Every draw is an order by md5 of the seed and the row's id, so that it doesn't
depend on partitions. Ties always end at the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Absolute part of all tolerances.
ATOL = 1e-8


def draw(seed: int | str, *ids: str) -> Column:
    """The hash that orders rows for draws."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]).cast("binary"))


def split_accept_reject(df: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; a null status rejects."""
    ok = F.coalesce(F.col(status), F.lit(False))
    return df.where(ok), df.where(~ok)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def keep_best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return ranked(df, by, order).where("_rank = 1").drop("_rank")


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return ranked(df, by, order).where(F.col("_rank") <= n).drop("_rank")


def anti_join_tolerance(left: DataFrame, right: DataFrame, by: list[str], value: str, rtol: float = 0.05) -> DataFrame:
    """Rows of left with no row of right of the same key within ATOL + rtol * |left value|.

    Only equal keys are compared, in a left anti join whose condition carries
    the tolerance.
    """
    r = right.select(*[F.col(b).alias(f"_{b}") for b in by], F.col(value).alias("_value")).distinct()
    near = F.abs(F.col("_value") - F.col(value)) <= ATOL + rtol * F.abs(F.col(value))
    for b in by:
        near = (F.col(b) == F.col(f"_{b}")) & near
    return left.join(r, near, "left_anti")


def tolerance_clusters(df: DataFrame, by: list[str], value: str, key: str, rtol: float = 0.05) -> DataFrame:
    """df with `pivot`, the value of the row that opened its cluster.

    In order of key, a row joins the first pivot of its group within
    ATOL + rtol * |pivot|, or becomes one. Groups are cut where sorted values
    are so far apart that no pivot reaches across (exact for positive values),
    and equal values are folded once, by their first row.
    """
    first = df.groupBy(*by, value).agg(F.min(key).alias("_key"))
    order = Window.partitionBy(*by).orderBy(value)
    gap = F.col(value) - F.lag(value).over(order) > ATOL + rtol * F.abs(F.col(value))
    islands = first.withColumn("_gap", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("_island", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = islands.groupBy(*by, "_island").agg(F.array_sort(F.collect_list(F.struct(F.col("_key").alias("k"), F.col(value).cast("double").alias("v")))).alias("_rows"))
    none = F.array().cast("array<double>")
    near = lambda x, p: F.abs(x["v"] - p) <= ATOL + rtol * F.abs(p)
    pivots = F.aggregate("_rows", none, lambda acc, x: F.when(F.exists(acc, lambda p: near(x, p)), acc).otherwise(F.concat(acc, F.array(x["v"]))))
    placed = rows.withColumn("_pivots", pivots).select(*by, "_pivots", F.explode("_rows").alias("_x"))
    names = {b: f"_by{i}" for i, b in enumerate(by)}
    placed = placed.select(*[F.col(b).alias(n) for b, n in names.items()], F.col("_x.v").alias("_v"), F.filter("_pivots", lambda p: near(F.col("_x"), p))[0].alias("pivot"))
    same = F.col(value).cast("double") == F.col("_v")
    for b, n in names.items():
        same = F.col(b).eqNullSafe(F.col(n)) & same
    return df.join(placed, same).drop("_v", *names.values())


def dedup_tolerance(df: DataFrame, by: list[str], value: str, key: str, prefer: list[Column], rtol: float = 0.05) -> DataFrame:
    """df with `duplicate`: false for the preferred row of each cluster."""
    placed = tolerance_clusters(df, by, value, key, rtol)
    return ranked(placed, [*by, "pivot"], [*prefer, F.col(key)]).withColumn("duplicate", F.col("_rank") > 1).drop("_rank", "pivot")


def stratified_split(df: DataFrame, by: list[str], key: str, seed: int = 0) -> DataFrame:
    """df with `train`. Of n rows of a stratum floor(n * (1 - 0.8)), in double arithmetic, aren't."""
    w = Window.partitionBy(*by)
    out = ranked(df, by, [draw(seed, key), F.col(key)]).withColumn("_n", F.count("*").over(w))
    return out.withColumn("train", F.col("_rank") > F.floor(F.col("_n") * (F.lit(1.0) - F.lit(0.8)))).drop("_rank", "_n")


def ordinals(df: DataFrame, order: list[str], name: str, ranges: int = 64) -> DataFrame:
    """df with `name`: the place of each row by the order of these columns, from 1.

    The rows are cut into ranges at a few of their own keys, drawn by hash;
    each range is numbered on its own, after the rows of all ranges before it.
    Rows of equal keys must be few: they are of one range.
    """
    key = F.struct(*order)
    drawn = df.select(key.alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(ranges - 1).agg(F.array_distinct(F.array_sort(F.collect_list("_key"))).alias("_cuts"))
    placed = df.crossJoin(F.broadcast(drawn)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= key))).drop("_cuts")
    upto = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # `ranges` rows at most
    upto = upto.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_within", within).join(F.broadcast(upto), "_part").withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_within", "_before")


def cap_per_group(df: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n drawn rows a group, with `ordinal`, the group's place among all by name (from 1)."""
    groups = df.select(*by).distinct()
    number = ordinals(groups, by, "ordinal").withColumn("ordinal", F.col("ordinal").cast("int"))
    return top_n(df, by, [draw(seed, key), F.col(key)], n).join(number, by)


def sample_with_fallback(primary: DataFrame, secondary: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n drawn rows a group of primary; groups that are short are filled from secondary. `origin` is 0 or 1."""
    groups = primary.select(*by).distinct()
    both = primary.withColumn("origin", F.lit(0)).unionByName(secondary.join(groups, by, "left_semi").withColumn("origin", F.lit(1)))
    return top_n(both, by, [F.col("origin"), draw(seed, key), F.col(key)], n)


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(seed, key), key)


def balance(df: DataFrame, flag: str, key: str, seed: int = 0) -> DataFrame:
    """As many drawn rows of each class as the smaller one has."""
    least = df.groupBy(flag).count().agg(F.min("count").alias("_least"))
    return ranked(df, [flag], [draw(seed, key), F.col(key)]).crossJoin(F.broadcast(least)).where(F.col("_rank") <= F.col("_least")).drop("_rank", "_least")


def repeat_to_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """n rows a group: its rows in order, over and over; `copy` counts from 0."""
    size = F.count("*").over(Window.partitionBy(*by))
    out = ranked(df, by, order).withColumn("_n", size)
    times = F.floor((F.lit(n) - F.col("_rank")) / F.col("_n"))
    return out.where(F.col("_rank") <= n).withColumn("copy", F.explode(F.sequence(F.lit(0), times.cast("int")))).drop("_rank", "_n")


def distinct_rows_first(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Each distinct row of `by` once, with the least key it has."""
    return df.groupBy(*by).agg(F.min(key).alias(key))


def weighted_subset(df: DataFrame, by: list[str], key: str, weight: Column, k: int, seed: int = 0) -> DataFrame:
    """k distinct rows a group, with probability in proportion to weight: the least exponential keys -ln(u) / weight."""
    u = (F.conv(F.substring(draw(seed, *by, key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return top_n(df, by, [-F.log(u) / weight, F.col(key)], k)


def uniform_subset(df: DataFrame, by: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    return top_n(df, by, [draw(seed, *by, key), F.col(key)], k)


def sample_per_bin(df: DataFrame, value: str, low: float, high: float, bins: int, key: str, n: int, seed: int = 0) -> DataFrame:
    """n drawn rows of each of `bins` equal parts of [low, high]; `bin` counts from 0."""
    placed = df.where((F.col(value) >= low) & (F.col(value) <= high)).withColumn("bin", F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int"))
    return top_n(placed, ["bin"], [draw(seed, key), F.col(key)], n)
