"""Forests as flat arrays: many small forests that one Arrow pass walks, and the candidates they generate.

MLlib fits the forest of volumes on the cluster; those of cells grow here, all
together, by counts that don't depend on the partitions, which SQL can state
too. Fitted trees become arrays of nodes, which travel to the tasks once; a
batch of rows goes down all trees together, one level a step. So the trees of
all ratio bins add no columns to a plan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspark.functions.cell import FREE
from cellspark.operators import indexing, reduction, stats
from cellspark.operators.models import assembled

_NODE = re.compile(r"^\s*(?:(Tree) \d+|If \(feature (\d+) <= (\S+)\)|(Else)|Predict: (\S+))", re.M)


class Forest(NamedTuple):
    """Nodes of all trees; `root`: the first node of each tree. A leaf has feature -1 and a value."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def flattened(model) -> Forest:
    """The trees of an MLlib regression forest with continuous features, from one listing of the whole model."""
    root, feature, threshold, right, value = [], [], [], [], []
    waiting, after = [], None
    for m in _NODE.finditer(model.toDebugString):
        tree, index, bound, other, leaf = m.groups()
        if tree:
            root.append(len(feature))
        elif other:
            after = waiting.pop()
        else:
            if after is not None:
                right[after], after = len(feature), None
            if index:
                waiting.append(len(feature))
            feature.append(int(index) if index else -1)
            threshold.append(float(bound) if index else np.inf)
            value.append(float(leaf) if leaf else 0.0)
            right.append(-1)
    n = len(feature)
    return Forest(np.array(root, np.int32), np.array(feature, np.int16), np.array(threshold), np.arange(1, n + 1, dtype=np.int32), np.array(right, np.int32), np.array(value))


def merged(forests: list[Forest]) -> Forest:
    """All trees as one forest."""
    at = np.cumsum([0, *(len(f.feature) for f in forests)])
    moved = [f._replace(root=f.root + a, left=f.left + a, right=f.right + a) for f, a in zip(forests, at, strict=False)]
    return Forest(*(np.concatenate(x) for x in zip(*moved, strict=True)))


def walk(forest: Forest, x: np.ndarray) -> np.ndarray:
    """(rows, trees): what each tree says of each row."""
    node = np.tile(forest.root, (len(x), 1))
    rows = np.arange(len(x))[:, None]
    while True:
        f = forest.feature[node]
        inner = f >= 0
        if not inner.any():
            return forest.value[node]
        down = np.where(x[rows, np.maximum(f, 0)] <= forest.threshold[node], forest.left[node], forest.right[node])
        node = np.where(inner, down, node)


def predict_trees(df: DataFrame, model: PipelineModel, out: str = "trees") -> DataFrame:
    """df with the prediction of every tree of a fitted pipeline of features and forest (array), their mean and variance; a row with a null feature is left out, as MLlib does."""
    features, sent = model.stages[0].getInputCols(), df.sparkSession.sparkContext.broadcast(flattened(model.stages[-1]))
    keep = [c for c in df.columns if c not in (out, f"{out}_mean", f"{out}_var")]
    wide = df.select(*keep, F.array(*[F.col(f).cast("double") for f in features]).alias("_x")).dropna(subset=features)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                each = walk(sent.value, np.stack(pdf["_x"].to_numpy()).astype(float))
                yield pdf.drop(columns="_x").assign(**{out: list(each), f"{out}_mean": each.mean(1), f"{out}_var": each.var(1)})

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"{out} array<double>, {out}_mean double, {out}_var double"])
    return wide.mapInPandas(run, schema)


class CellForests(NamedTuple):
    """For each group the forests of the targets (the trees of all ratio bins), the names of features and targets, and the edges of the bins."""

    features: list[str]
    targets: list[str]
    groups: dict
    edges: list[float]


#: Thresholds tried of a feature: as many as between MLlib's 32 bins.
CUTS = 31
#: Labels are summed as whole parts of the largest one, weights as whole parts of one: sums don't depend on their order.
GRID, WEIGHED = 1 << 20, 1 << 10
#: Nodes whose counts a task holds before it gives them away.
HELD = 10_000


def copies(key: Column, trees: int, share: float, seed: int) -> Column:
    """How often each tree draws a row, from its key alone: Poisson's distribution with mean `share`, as in MLlib's subsamples."""
    chance = np.cumsum([math.exp(-share) * share**j / math.factorial(j) for j in range(64)])
    steps = [int(c * 2**32) for c in chance if c * 2**32 < 2**32 - 1]
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key, i)), 1, 8), 16, 10).cast("long"))
    return F.transform(drawn, lambda u: sum(((u >= s).cast("int") for s in steps), F.lit(0)))


def _counted(rows: DataFrame, cuts: dict, grown: dict, trees: int, targets: int) -> DataFrame:
    """(tree, path, f, code, n, w, s): sums of copies, weights and weighted labels of the rows at each open node of the grown trees, by feature and by the number of its thresholds that are below the row's value."""
    sent = rows.sparkSession.sparkContext.broadcast((cuts, grown))

    def told(held):
        for (tree, path), sums in held.items():
            f, code = np.nonzero(sums[0])
            yield pd.DataFrame({"tree": tree, "path": path, "f": f, "code": code, "n": sums[0][f, code], "w": sums[1][f, code], "s": sums[2][f, code]})

    def run(batches):
        cuts, grown = sent.value
        held: dict = {}
        for pdf in batches:
            for part, own in pdf.groupby("part"):
                x, y, w, drawn = (np.stack(own[n].to_numpy()) for n in ("x", "y", "w", "drawn"))
                code = np.stack([np.searchsorted(cut, x[:, f]) for f, cut in enumerate(cuts[part])], 1)
                place = np.arange(x.shape[1]) * (CUTS + 1) + code
                for i, forest in grown.get(part, {}).items():
                    taken = np.flatnonzero(drawn[:, i])
                    paths = walk(forest, x[taken]).astype(np.int64)
                    for t in range(targets):
                        at = taken[paths[:, t] > 0]
                        nodes, node = np.unique(paths[paths[:, t] > 0, t], return_inverse=True)
                        size = x.shape[1] * (CUTS + 1)
                        cell = (node[:, None] * size + place[at]).ravel()
                        n, weight = drawn[at, i], drawn[at, i] * w[at]
                        sums = [np.bincount(cell, np.repeat(v, x.shape[1]), len(nodes) * size).astype(np.int64).reshape(len(nodes), x.shape[1], CUTS + 1) for v in (n, weight, weight * y[at, t])]
                        for path, *own_sums in zip(nodes, *sums, strict=True):
                            name = ((part * targets + t) * trees + i, path)
                            held[name] = held[name] + np.stack(own_sums) if name in held else np.stack(own_sums)
                if len(held) > HELD:
                    yield from told(held)
                    held = {}
        yield from told(held)

    return rows.mapInPandas(run, "tree int, path long, f int, code int, n long, w long, s long")


def _best_splits(cells: DataFrame, least: int, tried: int, seed: int) -> DataFrame:
    """(tree, path, n, w, s, best): the sums of each node and its best split, of as many features as are tried there, drawn by hash: the least sum of squares, then the first feature, then the least threshold."""
    own = Window.partitionBy("tree", "path", "f")
    upto = own.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.groupBy("tree", "path", "f", "code").agg(*[F.sum(c).alias(c) for c in "nws"])
    c = summed.select("tree", "path", "f", "code", *[F.sum(c).over(upto).alias(f"l{c}") for c in "nws"], *[F.sum(c).over(own).alias(c) for c in "nws"])
    square = lambda s, w: s.cast("double") * s.cast("double") / w.cast("double")
    score = square(F.col("ls"), F.col("lw")) + square(F.col("s") - F.col("ls"), F.col("w") - F.col("lw"))
    both = (F.col("ln") >= max(least, 1)) & (F.col("n") - F.col("ln") >= max(least, 1))
    split = F.when(both, F.struct(score.alias("score"), (-F.col("f")).alias("f"), (-F.col("code")).alias("code"), "ln", "lw", "ls"))
    of_feature = c.groupBy("tree", "path", "f").agg(F.max(split).alias("split"), *[F.max(v).alias(v) for v in "nws"])
    drawn = F.slice(F.array_sort(F.collect_list(F.struct(F.md5(F.concat_ws(":", F.lit(seed), "tree", "path", "f")).alias("h"), "split"))), 1, tried)
    return of_feature.groupBy("tree", "path").agg(*[F.max(v).alias(v) for v in "nws"], F.array_max(F.transform(drawn, lambda d: d["split"])).alias("best"))


class _Tree:
    """A tree while it grows: its nodes as in Forest, and the paths of the open ones (1: the root; 2p, 2p + 1: below p)."""

    def __init__(self):
        self.nodes, self.open = [[-1, np.inf, 0, 0, 0.0]], {1: 0}

    def forest(self, paths: bool = False) -> Forest:
        feature, threshold, left, right, value = (np.array(c) for c in zip(*self.nodes, strict=True))
        if paths:
            value = np.zeros(len(value))
            value[list(self.open.values())] = list(self.open)
        return Forest(np.array([0], np.int32), feature.astype(np.int16), threshold.astype(float), left.astype(np.int32), right.astype(np.int32), value.astype(float))


def fit_cell_forests(df: DataFrame, features: list[str], targets: list[str], ratio: str | None = None, group: str | None = None, weight: str | None = None, bins: int = 10, limits: tuple[float, float] = (0.0, 1.0), trees: int = 200, depth: int = 10, least: int = 2, share: float = 0.05, seed: int = 0, key: str | None = None) -> CellForests:
    """A forest for each group, bin of `ratio` and target; rows with a feature, target or ratio that is null or not finite are left out.

    Bins hold about as many rows each; the ends are the limits. `weight` is a
    column whose density the rows are weighted against (see
    stats.inverse_density_weights). Bins of a group without rows have no trees,
    nor has a tree that drew none.

    All trees grow together, a level a pass over the rows: tasks count rows by
    node, feature and threshold, the counts are summed, the best split of each
    node is taken. What a tree draws depends on `key` (without one: on the
    features and targets), sums are of whole numbers; so the same rows make the
    same forests in any session, on any partitioning.
    """
    numbers = [*features, *targets, *([ratio] if ratio else [])]
    given = df.dropna(subset=numbers)
    for n in numbers:
        given = given.where(F.abs(F.col(n).cast("double")) < float("inf"))
    given = given.withColumn("_key", F.col(key) if key else F.xxhash64(*features, *targets)).persist()
    edges = [limits[0], limits[1]]
    if ratio and bins > 1:
        inner = [r["value"] for r in stats.order_quantile(given, ratio, [k / bins for k in range(1, bins)]).orderBy("fraction").collect()]
        edges = [limits[0], *inner, limits[1]]
    top = given.agg(*[F.max(F.abs(F.col(t).cast("double"))) for t in targets]).first()
    unit = [(m or 1.0) / GRID for m in top]
    keys = sorted((r[0] for r in given.select(group).distinct().collect()), key=lambda v: (v is not None, v)) if group else [None]
    place = sum((F.when(F.col(group).eqNullSafe(F.lit(v)), i).otherwise(0) for i, v in enumerate(keys)), F.lit(0)) if group else F.lit(0)
    size = len(edges) - 1
    part = place * size + sum(((F.col(ratio) >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    label = F.array(*[F.floor(F.col(t).cast("double") / F.lit(float(m or 1.0)) * GRID + 0.5).cast("long") for t, m in zip(targets, top, strict=True)])
    weighted = stats.inverse_density_weights(given, weight) if weight else given
    rows = indexing.dealt(weighted.where(F.col(ratio) >= limits[0]) if ratio else weighted, "_key").select(
        part.cast("int").alias("part"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        label.alias("y"),
        (F.floor(F.col("weight") * WEIGHED + 0.5).cast("long") if weight else F.lit(1).cast("long")).alias("w"),
        copies(F.col("_key").cast("string"), trees, share, seed).alias("drawn"),
    )
    rows.persist()
    values = rows.select("part", F.posexplode("x").alias("f", "v"))
    cuts: dict = {p: [[] for _ in features] for p in range(len(keys) * size)}
    for r in stats.order_quantile(values, "v", [j / (CUTS + 1) for j in range(1, CUTS + 1)], ["part", "f"]).select("part", "f", "value").distinct().collect():
        cuts[r["part"]][r["f"]].append(r["value"])
    cuts = {p: [np.sort(np.array(c, float)) for c in own] for p, own in cuts.items()}
    full = {n: _Tree() for n in range(len(cuts) * len(targets) * trees)}
    number = lambda p, t, i: (p * len(targets) + t) * trees + i
    tried = len(features) if trees == 1 else math.ceil(len(features) / 3)
    seen = set()
    for level in range(max(depth, 1)):
        grown = {p: {i: merged([full[number(p, t, i)].forest(paths=True) for t in range(len(targets))]) for i in range(trees) if any(full[number(p, t, i)].open for t in range(len(targets)))} for p in cuts}
        found = _best_splits(_counted(rows, cuts, grown, trees, len(targets)), least, tried, seed).collect()
        following: dict = {n: {} for n in full}
        for r in found:
            tree, n, best = full[r["tree"]], r["tree"], r["best"]
            at, p, worth = tree.open[r["path"]], n // (len(targets) * trees), unit[n // trees % len(targets)]
            seen.add(n)
            tree.nodes[at][4] = r["s"] / r["w"] * worth
            if best is None or level >= depth or not best["score"] > float(r["s"]) * float(r["s"]) / float(r["w"]):
                continue
            new = len(tree.nodes)
            tree.nodes[at][:4] = [-best["f"], cuts[p][-best["f"]][-best["code"]], new, new + 1]
            for side, (m, w, s) in enumerate(((best["ln"], best["lw"], best["ls"]), (r["n"] - best["ln"], r["w"] - best["lw"], r["s"] - best["ls"]))):
                tree.nodes.append([-1, np.inf, 0, 0, s / w * worth])
                if m >= 2 * max(least, 1):
                    following[n][2 * r["path"] + side] = new + side
        for n, tree in full.items():
            tree.open = following[n]
        if not any(following.values()):
            break
    rows.unpersist()
    given.unpersist()
    told = {}
    for g, name in enumerate(keys):
        own = [[full[n].forest() for p in range(g * size, (g + 1) * size) for i in range(trees) if (n := number(p, t, i)) in seen] for t in range(len(targets))]
        if own[0]:
            told[name] = [merged(o) for o in own]
    return CellForests(features, targets, told, edges)


def predict_cells(df: DataFrame, model: CellForests, key: str, group=None) -> DataFrame:
    """(key, trees, mean, var): for each target of the group's forests what every tree says, its mean and its variance. A row with a null feature has nulls."""
    sent = df.sparkSession.sparkContext.broadcast(model.groups[group])
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                x = part.iloc[:, 1:].to_numpy(float)
                fine = np.isfinite(x).all(1)
                each = np.stack([walk(f, x[fine]) for f in sent.value], 1)
                yield pd.DataFrame({key: part[key].to_numpy()[fine], "trees": [list(t) for t in each], "mean": list(each.mean(2)), "var": list(each.var(2))})
                yield pd.DataFrame({key: part[key].to_numpy()[~fine], "trees": None, "mean": None, "var": None})

    return indexing.dealt(df, key).select(key, *[F.col(f).cast("double") for f in model.features]).mapInPandas(run, f"`{key}` {kind}, trees array<array<double>>, mean array<double>, var array<double>")


def xnn_of_cells(cells: np.ndarray, system: str) -> np.ndarray:
    """Free coefficients of partial direct cells, angles in radians; NaN where the angles make no cell."""
    n, right, c = np.ones(len(cells)), np.full(len(cells), np.pi / 2), cells.T
    full = {
        "cubic": lambda: (c[0],) * 3 + (right,) * 3,
        "tetragonal": lambda: (c[0], c[0], c[1], right, right, right),
        "hexagonal": lambda: (c[0], c[0], c[1], right, right, n * 2 * np.pi / 3),
        "rhombohedral": lambda: (c[0],) * 3 + (c[1],) * 3,
        "orthorhombic": lambda: (*c, right, right, right),
        "monoclinic": lambda: (c[0], c[1], c[2], right, c[3], right),
        "triclinic": lambda: tuple(c),
    }
    g = reduction.metric(np.stack(full[system](), 1))
    fine = np.isfinite(g).all((1, 2))
    fine[fine] = np.linalg.det(g[fine]) > 0
    r = np.full(g.shape, np.nan)
    r[fine] = np.linalg.inv(g[fine])
    x = np.stack([r[:, 0, 0], r[:, 1, 1], r[:, 2, 2], 2 * r[:, 1, 2], 2 * r[:, 0, 2], 2 * r[:, 0, 1]], 1)
    return x[:, FREE[system]]


def _normal(seed: int, step: int, pattern: np.ndarray, candidate: np.ndarray, n: int) -> np.ndarray:
    """Standard normal numbers by hash (Box and Muller)."""
    u = indexing.draws(seed, step, pattern, candidate, 2 * n)
    return np.sqrt(-2 * np.log1p(-u[:, :n])) * np.cos(2 * np.pi * u[:, n:])


def _emitted(patterns: np.ndarray, q: np.ndarray, x: np.ndarray) -> pd.DataFrame:
    """Candidates of each pattern, numbered from 0. x: a pattern's cells follow each other."""
    n = len(x) // len(patterns)
    return pd.DataFrame({"pattern_id": np.repeat(patterns, n), "candidate_id": np.tile(np.arange(n, dtype=np.int32), len(patterns)), "q": list(q.repeat(n)), "xnn": list(x), "m20": 0.0})


def _taken(pdf: pd.DataFrame, width: int, most: int = 256):
    """(pattern ids, peaks, the first `width` peaks as a matrix) of the patterns that have as many, some at a time."""
    pdf = pdf[pdf["q"].map(len) >= width]
    for lo in range(0, len(pdf), most):
        part = pdf.iloc[lo : lo + most]
        yield part["pattern_id"].to_numpy(), part["q"].to_numpy(), np.stack(part["q"].map(lambda q: q[:width]).to_numpy()).astype(float)


Generator = Callable[[DataFrame, np.ndarray, str, int], DataFrame]


def tree_candidates(model: CellForests, group=None, seed: int = 0) -> Generator:
    """A generator for indexing.generate: a cell from each of n trees, drawn by hash; beyond their number, from a normal distribution with the trees' mean and covariance. Patterns with fewer peaks than features give none."""

    def make(patterns: DataFrame, refs: np.ndarray, system: str, n: int) -> DataFrame:
        sent, width = patterns.sparkSession.sparkContext.broadcast(model.groups[group]), len(model.features)

        def run(batches):
            for pdf in batches:
                for patterns, q, first in _taken(pdf, width):
                    trees = np.stack([walk(f, first) for f in sent.value], 1)
                    each = np.repeat(patterns, trees.shape[2]), np.tile(np.arange(trees.shape[2]), len(patterns))
                    order = np.argsort(indexing.draws(seed, 0, *each, 1)[:, 0].reshape(len(patterns), -1), axis=1, kind="stable")[:, :n]
                    cells = np.take_along_axis(trees.transpose(0, 2, 1), order[:, :, None], 1)
                    if n > cells.shape[1]:
                        extra, size = n - cells.shape[1], trees.shape[1]
                        away = trees - trees.mean(2, keepdims=True)
                        cov = np.einsum("pit,pjt->pij", away, away) / max(trees.shape[2] - 1, 1)
                        root = np.linalg.cholesky(cov + 1e-9 * np.eye(size))
                        z = _normal(seed, 1, np.repeat(patterns, extra), np.tile(np.arange(extra), len(patterns)), size).reshape(len(patterns), extra, size)
                        cells = np.concatenate([cells, trees.mean(2)[:, None] + np.einsum("pki,pji->pkj", z, root)], 1)
                    yield _emitted(patterns, q, indexing.physical(xnn_of_cells(cells.reshape(-1, trees.shape[1]), system), system))

        return patterns.select("pattern_id", "q").mapInPandas(run, indexing.COLUMNS)

    return make


class VolumeModel(NamedTuple):
    """A forest for the reciprocal volume; its limits and CDF over 100 equal bins in the training rows; root mean square errors of training and held-out rows."""

    features: list[str]
    forest: Forest
    limits: tuple[float, float]
    cdf: list[float]
    rms_train: float
    rms_held: float | None


def fit_volume_forest(df: DataFrame, features: list[str], volume: str, train: Column, trees: int = 50, depth: int = 10, least: int = 5, share: float = 0.05, seed: int = 0) -> VolumeModel:
    """Fits on the rows where `train` holds; null features or volumes are left out."""
    rows = assembled(features).transform(df.dropna(subset=[*features, volume]).withColumn("_train", train)).persist()
    own = rows.where("_train")
    fitted = RandomForestRegressor(featuresCol="features", labelCol=volume, predictionCol="_guess", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=share, seed=seed).fit(own)
    low, high = own.agg(F.min(volume), F.max(volume)).first()
    counts = {r["bin"]: r["n"] for r in stats.histogram(own, volume, low, high, 100).collect()}
    cdf = np.cumsum([counts.get(i, 0) for i in range(100)]) / max(1, sum(counts.values()))
    errors = dict(fitted.transform(rows).groupBy("_train").agg(F.sqrt(F.avg((F.col("_guess") - F.col(volume)) ** 2))).collect())
    rows.unpersist()
    return VolumeModel(features, flattened(fitted), (low, high), cdf.tolist(), errors.get(True), errors.get(False))


def random_coefficients(u: np.ndarray, system: str, volume: np.ndarray) -> np.ndarray:
    """Cells from uniform numbers, a row of six each: coefficients of the axes in proportion to them, cross terms to cosines, scaled to the reciprocal volumes."""
    axes = {"cubic": 1, "tetragonal": 2, "hexagonal": 2, "rhombohedral": 1}.get(system, 3)
    x = np.maximum(u[:, :axes], 1e-3)
    if system == "rhombohedral":
        x = np.stack([x[:, 0], 1.9 * x[:, 0] * (u[:, 3] - 0.4)], 1)
    elif system == "monoclinic":
        x = np.column_stack([x, 1.9 * np.sqrt(x[:, 0] * x[:, 2]) * u[:, 3]])
    elif system == "triclinic":
        x = np.column_stack([x, *(1.9 * np.sqrt(x[:, i] * x[:, j]) * u[:, k] for i, j, k in ((1, 2, 3), (0, 2, 4), (0, 1, 5)))])
    x = indexing.physical(x, system, 0.0, np.inf)
    own = np.maximum(indexing.reciprocal_volume(x, system), 1e-12)
    return x * ((volume / own) ** (2 / 3))[:, None]


def volume_candidates(model: VolumeModel, predicted: bool = True, seed: int = 0) -> Generator:
    """A generator for indexing.generate: random cells with a reciprocal volume that one of the trees predicts (drawn by hash), or else any within the model's limits."""

    def make(patterns: DataFrame, refs: np.ndarray, system: str, n: int) -> DataFrame:
        sent, width = patterns.sparkSession.sparkContext.broadcast(model.forest), len(model.features)

        def run(batches):
            for pdf in batches:
                for patterns, q, first in _taken(pdf, width):
                    u = indexing.draws(seed, 2, np.repeat(patterns, n), np.tile(np.arange(n), len(patterns)), 7)
                    if predicted:
                        volumes = walk(sent.value, first)
                        volumes = np.take_along_axis(volumes, (u[:, 6] * volumes.shape[1]).astype(int).reshape(-1, n), 1).ravel()
                    else:
                        volumes = model.limits[0] + (model.limits[1] - model.limits[0]) * u[:, 6]
                    yield _emitted(patterns, q, indexing.physical(random_coefficients(u, system, np.maximum(volumes, 1e-12)), system))

        return patterns.select("pattern_id", "q").mapInPandas(run, indexing.COLUMNS)

    return make
