"""From histograms to peaks and triplets, and candidates drawn from what is known: templates, predictions, augmented cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspark.operators.candidates import coverage_objective, normal_at
from cellspark.operators.curation import draw
from cellspark.operators.indexing import dealt
from cellspark.operators.peaks import bound, maxima, nearest, pairs_within_frame
from cellspark.operators.stats import covariance


def pick_peaks(y: Column, low: float, width: float, prominence: float, first: int = 20, exclude: tuple[int, ...] = (), add: tuple[float, ...] = (), shift: dict[int, float] | None = None) -> Column:
    """Bin centres of the first maxima of a histogram, in order: without the excluded places, with the added ones, some of the result shifted by place."""
    found = F.slice(F.transform(maxima(y, prominence), lambda m: low + (m["i"] + 0.5) * width), 1, first)
    left = F.filter(found, lambda p, i: ~i.isin(*exclude)) if exclude else found
    peaks = F.array_sort(F.concat(left, F.array(*map(F.lit, add)).cast("array<double>")))
    if not shift:
        return peaks
    moved = lambda p, i: sum((F.when(i == k, v).otherwise(0.0) for k, v in shift.items()), p)
    return F.transform(peaks, moved)


def pick_secondary(y: Column, low: float, width: float, prominence: float, include: tuple[int, ...]) -> Column:
    """Bin centres of those maxima of a histogram whose places are named."""
    return F.transform(F.filter(maxima(y, prominence), lambda m, i: i.isin(*include)), lambda m: low + (m["i"] + 0.5) * width)


def nearest_source_peak(picked: Column, true: Column) -> Column:
    """The true peak (of an ascending array) nearest to each picked one; of equally near ones the first."""
    return bound(true, lambda t: F.transform(picked, lambda p: nearest(p, t)["ref"]))


def fit_peaks(df: DataFrame, key: str, x: str, y: str, peaks: str, reach: float = 0.003, steps: int = 20) -> DataFrame:
    """(key, peak, centre, breadth, amplitude) of a Gaussian about each peak; centre and so on are null where the fit doesn't settle within reach.

    df: a histogram (arrays x and y) and its peaks a row. Gauss-Newton over all
    peaks of a row at once, each on the points within reach of it, halving a
    step that makes the fit worse. A peak nearer than 2 * reach to another is
    fitted on the points up to the middle between them.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        gap = np.diff(p) / 2
        lo, hi = p - np.minimum(reach, np.append(np.inf, gap)), p + np.minimum(reach, np.append(gap, np.inf))
        use = (x[None] >= lo[:, None]) & (x[None] <= hi[:, None])
        top = np.where(use, y[None], 0).max(1)
        a = np.stack([np.maximum(top, 1e-9), p, np.full(len(p), reach / 3)], 1)
        value = lambda a: a[:, :1] * np.exp(-(((x[None] - a[:, 1:2]) / a[:, 2:]) ** 2) / 2)
        loss = lambda a: (np.where(use, value(a) - y[None], 0) ** 2).sum(1)
        for _ in range(steps):
            f, z = value(a), (x[None] - a[:, 1:2]) / a[:, 2:]
            j = np.stack([f / a[:, :1], f * z / a[:, 2:], f * z * z / a[:, 2:]], 2) * use[:, :, None]
            h = np.einsum("pni,pnj->pij", j, j)
            h += np.eye(3) * (1e-9 * np.einsum("pii->p", h)[:, None, None] + 1e-30)
            step = np.linalg.solve(h, np.einsum("pni,pn->pi", j, np.where(use, y[None] - f, 0))[..., None])[..., 0]
            old = loss(a)
            for scale in (1.0, 0.5, 0.25, 0.125):
                new = a + scale * step
                new[:, 2] = np.maximum(np.abs(new[:, 2]), reach / 100)
                better = loss(new) < old
                a[better], step[better] = new[better], 0
        fine = (use.sum(1) > 3) & (np.abs(a[:, 1] - p) <= reach) & (a[:, 0] > 0) & np.isfinite(a).all(1)
        out = pd.DataFrame({"peak": p, "centre": a[:, 1], "breadth": a[:, 2], "amplitude": a[:, 0]})
        out.loc[~fine, ["centre", "breadth", "amplitude"]] = np.nan
        return out

    def run(batches):
        for pdf in batches:
            for k, x_, y_, p in zip(pdf[key], pdf[x], pdf[y], pdf[peaks], strict=True):
                if p is not None and len(p):
                    out = one(np.asarray(x_, float), np.asarray(y_, float), np.sort(np.asarray(p, float)))
                    out.insert(0, key, k)
                    yield out

    fitted = df.select(key, x, y, peaks).mapInPandas(run, f"`{key}` {kind}, peak double, centre double, breadth double, amplitude double")
    return fitted.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("centre", "breadth", "amplitude")})


def breadth_line(fits: DataFrame, by: list[str]) -> DataFrame:
    """(by, slope, intercept) of breadth over centre."""
    return fits.where("centre IS NOT NULL").groupBy(*by).agg(F.regr_slope("breadth", "centre").alias("slope"), F.regr_intercept("breadth", "centre").alias("intercept"))


def pair_observations(df: DataFrame, frame: str, order: list[str], q2: str, vector: list[str], peaks: list[float], breadths: list[float], delta: float = 1.0, most: float = 2.8) -> DataFrame:
    """(frame, p0, p1, q2_diff, angle) of pairs of reflections of one frame that lie at two peaks.

    A reflection belongs to the peak that is nearest in breadths, and counts
    within delta breadths of it. q2_diff is the squared distance of the two
    vectors, angle the one between them, `most` at most. p0 <= p1.
    """
    near = lambda q: F.array_min(F.array(*[F.struct((F.abs(q - p) / b).alias("d"), F.lit(i).alias("i")) for i, (p, b) in enumerate(zip(peaks, breadths, strict=True))]))
    pairs = pairs_within_frame(df, frame, order, list(dict.fromkeys([q2, *vector])))
    rows = pairs.withColumns({"_x": near(F.col(f"{q2}1")), "_y": near(F.col(f"{q2}2"))}).where((F.col("_x.d") < delta) & (F.col("_y.d") < delta))
    total = lambda f: sum((f(v) for v in vector), F.lit(0.0))
    dot = total(lambda v: F.col(f"{v}1") * F.col(f"{v}2"))
    norm = F.sqrt(total(lambda v: F.col(f"{v}1") * F.col(f"{v}1"))) * F.sqrt(total(lambda v: F.col(f"{v}2") * F.col(f"{v}2")))
    far = total(lambda v: (F.col(f"{v}1") - F.col(f"{v}2")) * (F.col(f"{v}1") - F.col(f"{v}2")))
    angle = F.when(norm > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm))))
    rows = rows.withColumns({"q2_diff": far, "angle": angle}).where(F.col("angle") < most)
    return rows.select(frame, F.least("_x.i", "_y.i").alias("p0"), F.greatest("_x.i", "_y.i").alias("p1"), "q2_diff", "angle")


def pick_triplets(pairs: DataFrame, peaks: list[float], factor: float = 5.0, bins: int = 100, reach: float = 0.02, snap: float = 0.05) -> DataFrame:
    """(p0, p1, angle, q2_diff, weight) of the angles at which two peaks stand often.

    Angles are folded into the first quadrant and counted in bins; a maximum
    whose prominence is at least factor * (std of the counts + 1), also in the
    first or last bin, gives the median angle within reach of its bin's centre,
    drawn to 0 or a right angle within snap of these. The median is exact, of
    the angles about one maximum of one pair of peaks. What is sent to all tasks
    are the maxima: fewer than the peaks squared times the bins.
    """
    right = math.pi / 2
    width = right / bins
    folded = pairs.withColumn("_a", F.least("angle", math.pi - F.col("angle")))
    counts = folded.groupBy("p0", "p1", F.least(F.floor(F.col("_a") / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    wide = counts.groupBy("p0", "p1").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))
    y = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)).cast("double"))
    wide = wide.select("p0", "p1", y.alias("y"))
    mean = F.aggregate("y", F.lit(0.0), lambda s, v: s + v) / bins
    wide = wide.withColumn("_mean", mean).withColumn("_least", factor * (F.sqrt(F.aggregate("y", F.lit(0.0), lambda s, v: s + (v - F.col("_mean")) * (v - F.col("_mean"))) / bins) + 1))
    zeros = F.array(F.lit(0.0))
    tops = F.filter(maxima(F.concat(zeros, "y", zeros), 0), lambda m: m["prominence"] >= F.col("_least"))
    found = wide.select("p0", "p1", F.explode(tops).alias("m")).select("p0", "p1", ((F.col("m.i") - 0.5) * width).alias("_c"), F.col("m.height").alias("weight"))
    near = folded.join(F.broadcast(found), ["p0", "p1"]).where((F.col("_a") > F.col("_c") - reach) & (F.col("_a") < F.col("_c") + reach))
    median = near.groupBy("p0", "p1", "_c", "weight").agg(F.median("_a").alias("angle"))
    snapped = F.when(F.col("angle") < snap, 0.0).when(F.col("angle") > right - snap, right).otherwise(F.col("angle"))
    q = F.array(*map(F.lit, peaks))
    x, z = F.get(q, F.col("p0")), F.get(q, F.col("p1"))
    return median.withColumn("angle", snapped).select("p0", "p1", "angle", (x + z - 2 * F.sqrt(x * z) * F.cos("angle")).alias("q2_diff"), "weight")


def triplet_reference(refs: DataFrame, images: list[tuple[int, ...]], terms) -> DataFrame:
    """(i, j, k): references i <= j of which the difference, for some image of i, is as long in all terms as reference k.

    refs: (ref_index, h, k, l), a fixed small table. terms(h, k, l) gives the
    array that the join is on.
    """
    image = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"m{i}") for i, v in enumerate(m)]) for m in images]))
    moved = refs.select(F.col("ref_index").alias("i"), "h", "k", "l", image.alias("m"))
    turned = [sum((F.col(f"m.m{3 * r + c}") * F.col(x) for c, x in enumerate("hkl")), F.lit(0)) for r in range(3)]
    first = moved.select("i", *[t.alias(f"{x}1") for t, x in zip(turned, "hkl", strict=True)])
    second = refs.select(F.col("ref_index").alias("j"), *[F.col(x).alias(f"{x}2") for x in "hkl"])
    both = first.crossJoin(F.broadcast(second)).where("i <= j")  # of a fixed number of rows
    gap = both.select("i", "j", terms(*[F.col(f"{x}1") - F.col(f"{x}2") for x in "hkl"]).alias("terms"))
    known = refs.select(F.col("ref_index").alias("k"), terms(*[F.col(x) for x in "hkl"]).alias("terms"))
    return gap.join(F.broadcast(known), "terms").select("i", "j", "k").distinct()


def draw_templates(df: DataFrame, key: str, labels: str, n: int, seed: int | str = 0) -> DataFrame:
    """(key, labels) of n rows in an order by hash: label lists of known patterns.

    To draw the first label by its frequency and each further one among the rows
    that agree in all labels before is to draw a row: so whole rows are drawn.
    """
    return df.select(key, labels, draw(seed, key).alias("_d")).orderBy("_d", key).limit(n).drop("_d")


def resample_predictions(df: DataFrame, key: str, predictions: str, n: int, seed: int = 0) -> DataFrame:
    """(key, candidate_id, values): n of the predictions (array of arrays) of each row, drawn by hash; where there are fewer, all of them and normal draws with their mean and covariance."""
    kind = df.schema[key].dataType.simpleString()
    chosen = dealt(df, key).select(key, F.slice(F.transform(F.array_sort(F.transform(predictions, lambda v, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")).cast("binary")).alias("d"), v.alias("v")))), lambda s: s["v"]), 1, n).alias("own"))
    size, more = F.size(F.get("own", 0)), n - F.size("own")
    noise = F.when((F.size("own") > 0) & (more > 0) & (size > 0), F.transform(F.sequence(F.lit(0), more * size - 1), lambda i: normal_at(seed, F.col(key), i)))
    flat = F.when(F.forall("own", lambda v: F.size(v) == size), F.flatten("own")).otherwise(F.raise_error(F.lit("predictions of unlike lengths")))
    rows = chosen.select(key, F.size("own").alias("n"), F.when(F.size("own") > 0, flat).alias("own"), noise.alias("z"))

    def drawn(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(rows, more, width): normal draws with the mean and covariance of (rows, predictions, width)."""
        mean, many, width = x.mean(1), *x.shape[1:]
        away = x - mean[:, None]
        cov = np.einsum("nki,nkj->nij", away, away) / max(many - 1, 1)
        scale = 1e-12 * np.maximum(np.trace(cov, axis1=1, axis2=2), 1e-12)
        root = np.linalg.cholesky(cov + np.eye(width) * scale[:, None, None])
        return mean[:, None] + np.einsum("nki,nji->nkj", z.reshape(len(x), -1, width), root)

    def run(batches):
        for pdf in batches:
            count, length = pdf["n"].fillna(0).to_numpy(int), pdf["own"].map(lambda v: 0 if v is None else len(v)).to_numpy(int)
            for many, size in sorted({p for p in zip(count, length, strict=True) if p[0] > 0}):
                part = pdf[(count == many) & (length == size)]
                x = np.stack(part["own"].to_numpy()).astype(float).reshape(len(part), many, -1)
                if many < n and size:
                    x = np.concatenate([x, drawn(x, np.stack(part["z"].to_numpy()).astype(float))], 1)
                yield pd.DataFrame({key: part[key].repeat(x.shape[1]).to_numpy(), "candidate_id": np.tile(np.arange(x.shape[1], dtype=np.int32), len(x)), "values": list(x.reshape(-1, x.shape[2]))})

    return rows.mapInPandas(run, f"`{key}` {kind}, candidate_id int, values array<double>")


def augment_cells(df: DataFrame, key: str, values: list[str], copies: Column | int, scale: float, low: float = 2.25, high: float = 250.0, tries: int = 100, seed: int = 0) -> DataFrame:
    """(key, copy, values): copies of each row with its lengths changed by normal factors of deviation scale, in ascending order; of `tries` the first one within low and high, none where all are out."""
    times = copies if isinstance(copies, Column) else F.lit(copies)
    rows = df.where(times > 0).select(key, F.explode(F.sequence(F.lit(1), times)).alias("copy"), F.array(*[F.col(v).cast("double") for v in values]).alias("_v"))
    name = F.concat_ws("/", F.col(key).cast("string"), F.col("copy").cast("string"))
    attempt = lambda t: F.array_sort(F.transform("_v", lambda v, i: v * (1 + scale * normal_at(seed, name, t * len(values) + i))))
    start = F.array().cast("array<double>")
    fits = lambda v: F.forall(v, lambda x: x.between(low, high))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), start, lambda acc, t: F.when(F.size(acc) > 0, acc).otherwise(F.get(F.filter(F.array(attempt(t)), fits), 0)), lambda acc: acc)
    return rows.select(key, "copy", F.coalesce(found, start).alias("_c")).where(F.size("_c") > 0).select(key, "copy", *[F.get("_c", i).alias(v) for i, v in enumerate(values)])


def principal_axes(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """(by, component, variance, axis) of the principal components of each group, the greatest variance first; the first non-zero entry of an axis is positive. Spark sums the covariance; one small matrix a group is solved."""
    pairs = covariance(df, values, by)
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        place = {v: i for i, v in enumerate(values)}
        m = np.zeros((len(values),) * 2)
        for i, j, c in zip(pdf["i"], pdf["j"], pdf["covariance"], strict=True):
            m[place[i], place[j]] = m[place[j], place[i]] = c
        if not np.isfinite(m).all():
            return pd.DataFrame({**{b: [] for b in by}, "component": [], "variance": [], "axis": pd.Series([], dtype=object)})
        w, v = np.linalg.eigh(m)
        v = v[:, ::-1].T
        v = v * np.where(np.take_along_axis(v, (np.abs(v) > 1e-9).argmax(1)[:, None], 1) < 0, -1, 1)
        return pd.DataFrame({**{b: pdf[b].iloc[0] for b in by}, "component": np.arange(len(w), dtype=np.int32), "variance": w[::-1], "axis": list(v)})

    return pairs.groupBy(*by).applyInPandas(solve, f"{kinds}, component int, variance double, axis array<double>")


def tune_mix(df: DataFrame, by: list[str], generator: str, value: str, curve: list[tuple[float, float]], shares: list[float], names: tuple[str, str]) -> DataFrame:
    """One row (share, objective): the share of the first of two generators with the least mean coverage objective, the least share of equal ones.

    For each share that many of the first generator's candidates of a group
    count, in an order by hash, and the rest of the second's.
    """
    size = df.groupBy(*by, generator).agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by, generator).orderBy(draw("mix", value), value))
    rows = df.withColumn("_r", rank).join(size, [*by, generator]).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    part = F.when(F.col(generator) == names[0], F.col("share")).when(F.col(generator) == names[1], 1 - F.col("share"))
    rows = rows.where(F.col("_r") <= part * F.col("_n"))
    mean = coverage_objective(rows, ["share", *by], value, curve).groupBy("share").agg(F.avg("objective").alias("m"))
    return mean.agg(F.min_by("share", F.struct("m", "share")).alias("share"), F.min("m").alias("objective"))
