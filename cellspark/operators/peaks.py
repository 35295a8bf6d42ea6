"""Peak lists and reflections: nearest and band joins, pairs, maxima, masks, profiles.

No join here is a bare inequality: each carries an equi key (a frame, a
pattern or a bucket of the value), and the exact test runs within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspark.operators.stats import bin_of


def enough_peaks(df: DataFrame, n: int, peaks: str = "q2") -> DataFrame:
    """Rows with n peaks at least, n of them not zero."""
    return df.where((F.size(peaks) >= n) & (F.size(F.filter(peaks, lambda x: x != 0)) >= n))


def first_n(df: DataFrame, n: int, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.slice(c, 1, n) for c in columns})


def zip_hkl(h: str, k: str, l: str) -> Column:  # noqa: E741
    return F.transform(F.arrays_zip(h, k, l), lambda x: F.struct(x[h].alias("h"), x[k].alias("k"), x[l].alias("l")))


def unzip_hkl(hkl: str) -> list[Column]:
    return [F.col(hkl)[a].alias(a) for a in "hkl"]


#: Halvings of a search in a sorted array: enough for 2**24 values.
HALVINGS = 24


def bound(value: Column, use) -> Column:
    """use(value), with value made once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def place(refs: Column, x: Column) -> Column:
    """How many values of a sorted array are less than x, by halving."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(HALVINGS - 1, -1, -1)]), lambda s: s <= F.size(refs))
    fits = lambda at, s: F.coalesce(F.get(refs, at + s - 1) < x, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(fits(at, s), s).otherwise(F.lit(0)))


def nearest(q2: Column, refs: Column) -> Column:
    """struct<d, i, ref>: the reference at least distance; of equally near ones the first. refs: an ascending array; null for none or a null q2."""
    one = lambda r, i: F.struct(F.abs(F.get(r, i) - q2).alias("d"), i.alias("i"), F.get(r, i).alias("ref"))

    def found(r: Column) -> Column:
        def both(at: Column) -> Column:
            low = F.when(at > 0, one(r, place(r, F.get(r, at - 1))))
            return F.array_min(F.array(low, F.when(at < F.size(r), one(r, at))))

        return bound(place(r, q2), both)

    return F.when(q2.isNotNull() & (F.size(refs) > 0), bound(refs, found))


def k_nearest(q2: Column, refs: Column, k: int) -> Column:
    """array<struct<d, i, ref>> of the k nearest references (all, if fewer), nearest first, of equally near ones the first. refs: an ascending array of different values."""

    def found(r: Column) -> Column:
        def around(at: Column) -> Column:
            first = F.greatest(F.lit(0), at - k)
            part = F.slice(r, first + 1, F.least(F.size(r), at + k) - first)
            return F.slice(F.array_sort(F.transform(part, lambda x, i: F.struct(F.abs(x - q2).alias("d"), (i + first).alias("i"), x.alias("ref")))), 1, k)

        return bound(place(r, q2), around)

    return F.when(q2.isNotNull(), bound(refs, found))


def label_peaks(df: DataFrame, refs: DataFrame, terms: str, sentinel: Column) -> DataFrame:
    """df with label: the ref_index of the one reference with equal terms; the sentinel for none or several."""
    one = refs.groupBy(terms).agg(F.count("*").alias("_n"), F.min("ref_index").alias("_i")).where("_n = 1").drop("_n")
    return df.join(F.broadcast(one), terms, "left").withColumn("label", F.coalesce("_i", sentinel)).drop("_i")


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of rows (of equal `by`) with |a - b| <= width. Columns of both sides must differ by name, but for `by`."""
    by = by or []
    x = left.withColumn("_bucket", F.floor(F.col(a) / width).cast("long"))
    y = right.withColumn("_bucket", F.explode(F.array(*[(F.floor(F.col(b) / width) + d).cast("long") for d in (-1, 0, 1)])))
    return x.join(y, [*by, "_bucket"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_bucket")


def near_peak(reflections: DataFrame, peaks: DataFrame, q2: str, peak: str, width: float, key: list[str]) -> DataFrame:
    """Reflections with the nearest peak (the smaller of equally near ones) within width; the others are dropped."""
    pairs = band_join(reflections, peaks.select(F.col(peak).alias("_peak")).distinct(), q2, "_peak", width)
    best = pairs.groupBy(*key).agg(F.min(F.struct(F.abs(F.col(q2) - F.col("_peak")).alias("d"), F.col("_peak").alias("peak"))).alias("_b"))
    return reflections.join(best, key).withColumn("peak", F.col("_b.peak")).drop("_b")


#: Rows of a block that neighbours() compares at once, and rows of distances that are held.
BLOCK, HELD = 2048, 256


def neighbours(df: DataFrame, key: str, vec: str, radius: float, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(by, key, other) of rows with equal `by` nearer than radius, each row with itself.

    The rows of equal `by` are dealt over blocks by hash, and each pair of blocks
    meets in one task, which holds no more than two blocks. A product of matrices
    leaves out what is clearly farther; the rest is summed in the order of the
    components. A vector that is null, empty or has a null or non-finite
    component has no rows; vectors of unlike lengths are no neighbours.
    """
    by = by or []
    x = F.col(vec).cast("array<double>")
    rows = df.select(*by, F.col(key).alias("_k"), x.alias("_x")).where((F.size("_x") > 0) & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).withColumn("_n", F.size("_x"))
    names = [*by, "_n"]
    parts = rows.groupBy(*names).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    dealt = rows.join(parts, names).withColumn("_p", F.pmod(F.xxhash64("_k", "_x"), F.col("_parts")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.select(*names, "_k", "_x", (F.col("_p") <= F.col("_o")).alias("_first"), F.least("_p", "_o").alias("_i"), F.greatest("_p", "_o").alias("_j"))
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    kinds = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
    schema = f"{kinds}`{key}` {kind}, other {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        one = pdf["_i"].iat[0] == pdf["_j"].iat[0]
        left, right = (pdf, pdf) if one else (pdf[pdf["_first"]], pdf[~pdf["_first"]])
        if not len(left) or not len(right):
            return
        (k, x), (o, y) = ((d["_k"].to_numpy(), np.stack(d["_x"].to_numpy()).astype(float)) for d in (left, right))
        group = {b: pdf[b].iat[0] for b in by}
        x2, y2 = (x * x).sum(1), (y * y).sum(1)
        for lo in range(0, len(x), HELD):
            part = slice(lo, lo + HELD)
            with np.errstate(over="ignore", invalid="ignore"):
                size = x2[part, None] + y2
                far = size - 2 * (x[part] @ y.T) > radius * radius + 1e-9 * (size + 1)
                for at in np.array_split(np.argwhere(~far), max(1, int((~far).sum()) // (1 << 18))):
                    i, j = at[:, 0] + lo, at[:, 1]
                    d2 = np.zeros(len(at))
                    for c in range(x.shape[1]):
                        d2 += (x[i, c] - y[j, c]) ** 2
                    near = np.sqrt(d2) < radius
                    a, b = k[i[near]], o[j[near]]
                    yield pd.DataFrame({**group, key: a if one else np.concatenate([a, b]), "other": b if one else np.concatenate([b, a])})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, *names, "_i", "_j").groupBy(*names, "_i", "_j").applyInPandas(run, schema)


def lookup_curve(df: DataFrame, curve: DataFrame, value: str, x: str, y: str, by: list[str]) -> DataFrame:
    """df with y at the first curve point that isn't less than value; beyond the last point the last one's."""
    order = Window.partitionBy(*by).orderBy(x)
    edges = curve.withColumn("_lo", F.coalesce(F.lag(x).over(order), F.lit(float("-inf")))).withColumn("_hi", F.when(F.lead(x).over(order).isNull(), float("inf")).otherwise(F.col(x))).select(*by, "_lo", "_hi", y)
    return df.join(F.broadcast(edges), by).where((F.col(value) > F.col("_lo")) & (F.col(value) <= F.col("_hi"))).drop("_lo", "_hi")


def usable_frames(df: DataFrame, frame: str, least: int = 3, most: int = 100) -> DataFrame:
    """Reflections of frames with so many of them."""
    fine = df.groupBy(frame).agg(F.count("*").alias("_n")).where(F.col("_n").between(least, most)).select(frame)
    return df.join(fine, frame, "left_semi")


def pairs_within_frame(df: DataFrame, frame: str, order: list[str], values: list[str]) -> DataFrame:
    """Pairs i < j, by order, of the reflections of each frame: values with suffixes 1 and 2. Frames should be cut to usable ones before."""
    rows = df.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias("_r"))
    first = rows.select(frame, "_r", F.posexplode("_r").alias("_i", "x"))
    both = first.select(frame, "x", F.explode(F.slice("_r", F.col("_i") + 2, F.size("_r"))).alias("y"))
    return both.select(frame, *[F.col(f"{s}.{v}").alias(f"{v}{n}") for v in dict.fromkeys([*order, *values]) for n, s in ((1, "x"), (2, "y"))])


def maxima(y: Column, prominence: float, distance: int = 1) -> Column:
    """array<struct<i, height, prominence>> of the local maxima of an array, by place.

    A flat top counts once, at its middle; an end is none. Of maxima nearer
    than distance the higher stays (the later, of equal ones). The prominence
    is the height over the higher of the least values to both sides up to the
    next higher value.
    """
    n = F.size(y)

    def walk(places: Column, top: Column) -> Column:
        start = F.struct(top.alias("low"), F.lit(True).alias("on"))
        return F.aggregate(places, start, lambda acc, v: F.struct(F.when(acc["on"] & (v <= top), F.least(acc["low"], v)).otherwise(acc["low"]).alias("low"), (acc["on"] & (v <= top)).alias("on")), lambda acc: acc["low"])

    # Runs of equal values: where each begins and ends.
    starts = F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i), lambda i: (i > 0) & (F.get(y, i) > F.get(y, i - 1)))
    tops = F.transform(starts, lambda s: F.struct(s.alias("s"), F.aggregate(F.sequence(s, n - 1), F.struct(s.alias("e"), F.lit(True).alias("on")), lambda acc, j: F.struct(F.when(acc["on"] & (F.get(y, j) == F.get(y, s)), j).otherwise(acc["e"]).alias("e"), (acc["on"] & (F.get(y, j) == F.get(y, s))).alias("on")), lambda acc: acc["e"]).alias("e")))
    real = F.filter(tops, lambda t: (t["e"] < n - 1) & (F.get(y, t["e"] + 1) < F.get(y, t["s"])))
    found = F.transform(real, lambda t: F.struct(F.floor((t["s"] + t["e"]) / 2).cast("int").alias("i"), F.get(y, t["s"]).alias("height")))
    if distance > 1:
        by_height = F.reverse(F.array_sort(F.transform(found, lambda m: F.struct(m["height"].alias("height"), m["i"].alias("i")))))
        kept = F.aggregate(by_height, F.array().cast("array<int>"), lambda acc, m: F.when(F.exists(acc, lambda k: F.abs(k - m["i"]) < distance), acc).otherwise(F.concat(acc, F.array(m["i"]))))
        found = F.filter(found, lambda m: F.array_contains(kept, m["i"]))
    scored = F.transform(found, lambda m: F.struct(m["i"].alias("i"), m["height"].alias("height"), (m["height"] - F.greatest(walk(F.reverse(F.slice(y, 1, m["i"])), m["height"]), walk(F.slice(y, m["i"] + 2, n), m["height"]))).alias("prominence")))
    return F.filter(scored, lambda m: m["prominence"] >= prominence)


def detector_mask(df: DataFrame, x: str, y: str, low: tuple, high: tuple, bins: int, radius: Column, rings: int, threshold: float, pad: int) -> DataFrame:
    """(bx, by) of detector bins that have over threshold times the mean count of bins at their radius, and of those around them.

    radius is an expression of bx and by, in bins.
    """
    placed = df.select(bin_of(F.col(x), low[0], high[0], bins).alias("bx"), bin_of(F.col(y), low[1], high[1], bins).alias("by"))
    counts = placed.where("bx IS NOT NULL AND by IS NOT NULL").groupBy("bx", "by").agg(F.count("*").alias("n")).withColumn("ring", bin_of(radius, 0.0, float(bins), rings))
    mean = counts.agg(F.avg("n").alias("_all"))
    around = counts.groupBy("ring").agg(F.avg("n").alias("_ring")).crossJoin(F.broadcast(mean)).select("ring", F.greatest("_ring", "_all").alias("_mean"))
    hot = counts.join(F.broadcast(around), "ring").where(F.col("n") > threshold * F.col("_mean"))
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-pad, pad + 1) for j in range(-pad, pad + 1)])).alias("o")
    return hot.select("bx", "by", offsets).select((F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by")).distinct()


def apply_mask(df: DataFrame, mask: DataFrame, x: str, y: str, low: tuple, high: tuple, bins: int) -> DataFrame:
    placed = df.withColumn("bx", bin_of(F.col(x), low[0], high[0], bins)).withColumn("by", bin_of(F.col(y), low[1], high[1], bins))
    return placed.join(F.broadcast(mask), ["bx", "by"], "left_anti").drop("bx", "by")


def merge_equal_q2(df: DataFrame, by: list[str], q2: str, intensity: str, companion: str) -> DataFrame:
    """Equal positions as one row: intensities summed, the companion of the strongest."""
    return df.groupBy(*by, q2).agg(F.sum(intensity).alias(intensity), F.max_by(companion, F.struct(intensity, companion)).alias(companion))


def profile(df: DataFrame, by: list[str], q2: str, intensity: str, grid: tuple[float, float, int], breadth, reach: float = 5.0) -> DataFrame:
    """(by, g, y): Gaussians of the peaks' intensities, summed at grid points up to reach widths away."""
    low, high, n = grid
    step = (high - low) / (n - 1)
    # One point more to both sides: a division may round past a point just reach widths away, so each is tested itself.
    first = F.greatest(F.lit(0), F.ceil((F.col(q2) - reach * F.col("_w") - low) / step) - 1).cast("int")
    last = F.least(F.lit(n - 1), F.floor((F.col(q2) + reach * F.col("_w") - low) / step) + 1).cast("int")
    rows = df.withColumn("_w", breadth(F.col(q2))).withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("g", F.explode(F.sequence("_a", "_b")))
    rows = rows.where(F.abs(low + F.col("g") * step - F.col(q2)) <= reach * F.col("_w"))
    return rows.groupBy(*by, "g").agg(F.sum(F.col(intensity) * F.exp(-0.5 * F.pow((low + F.col("g") * step - F.col(q2)) / F.col("_w"), 2))).alias("y"))


def reindex_after_edit(df: DataFrame, index: str, removed: list[int], inserted: list[int]) -> DataFrame:
    """Indices after peaks are removed and others put in before the old ones named; rows of removed peaks go."""
    i = F.col(index)
    shift = sum(((i >= k).cast("int") for k in inserted), F.lit(0)) - sum(((i > k).cast("int") for k in removed), F.lit(0))
    rows = df.where(~i.isin(*removed)) if removed else df
    return rows.withColumn(index, i + shift)


def merge_peak_lists(primary: Column, secondary: Column, exclude: Column) -> Column:
    return F.array_sort(F.concat(F.filter(primary, lambda q: ~F.array_contains(exclude, q)), secondary))


def peak_spread(df: DataFrame, offsets: list[tuple], q2_at, peak: str) -> DataFrame:
    """(offset, spread): sum over peaks of the population std of q2 after each detector offset. q2_at(offset columns) gives q2."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("offset"), *[F.lit(float(v)).alias(f"o{j}") for j, v in enumerate(x)]) for i, x in enumerate(offsets)])).alias("o")
    rows = df.withColumn("_o", F.lit(0)).select("*", o).drop("_o")
    q = rows.withColumn("_q", q2_at(*[F.col(f"o.o{j}") for j in range(len(offsets[0]))]))
    return q.groupBy(F.col("o.offset").alias("offset"), peak).agg(F.stddev_pop("_q").alias("_s")).groupBy("offset").agg(F.sum("_s").alias("spread"))
