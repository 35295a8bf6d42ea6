"""Toxicity: a logistic model over hashed words and word parts, regularised by counterfactuals.

For each labelled sentence with identity terms, the same sentence with these
terms swapped within their group is made; the fit penalises the squared
difference of both scores, so that a neutral mention of a group doesn't move
the score.

Fitting: counts by label give the features whose presence tells the
labels apart (a bounded number); the weights follow by gradient descent, each
step one Spark aggregation over the labelled rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import tokens
from .shared import BASE, kept, mixed, powers, slices

#: Groups within which terms are swapped, each term for the next of its group. Fixed values.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives"),
    ("old", "young"),
    ("disabled", "healthy"),
)
BITS, GRAM, FEATURES, ROWS = 20, 5, 2048, 10_000
STEPS, RATE, RIDGE, FAIRNESS = 30, 1.0, 1e-4, 1.0


def swapped(text: str, groups=IDENTITY_GROUPS) -> str:
    """The text with every identity term replaced by the next one of its group."""
    following = {a: g[(i + 1) % len(g)] for g in groups for i, a in enumerate(g)}
    return re.sub(r"[A-Za-z]+", lambda m: following.get(m[0].lower(), m[0]), text)


def buckets(column) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and of each GRAM bytes within a word, also repeated ones."""
    words = tokens(column)
    n = len(words.data)
    up, down = powers(BASE, n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    size = words.end - words.start
    count = np.maximum(size - GRAM + 1, 0)
    at = np.repeat(words.start - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count) + np.arange(count.sum()) if len(size) else np.zeros(0, np.int64)
    grams = mixed((prefix[at + GRAM] - prefix[at]) * down[at] + np.uint64(1))
    doc = np.concatenate([words.doc, np.repeat(words.doc, count)]).astype(np.int64)
    return doc, (np.concatenate([words.hash, grams]) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(doc: np.ndarray, bucket: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, in order, and how many each has."""
    key = np.unique(doc << BITS | bucket)
    return key & ((1 << BITS) - 1), np.bincount(key >> BITS, minlength=rows)


def presence(column) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*buckets(column), len(column))


def _ints(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _features(groups):
    """Buckets of each text, and of these and of its swapped form those that the other lacks."""

    def run(batches):
        for part in slices(batches):
            texts, k = part.column("text"), 1 << BITS
            a, n = presence(texts)
            b, m = presence(pa.array([swapped(t or "", groups) for t in texts.to_pylist()], pa.string()))
            rows = np.arange(part.num_rows)
            x, y = np.repeat(rows, n) * k + a, np.repeat(rows, m) * k + b
            columns = [part.column("toxic"), _ints(a, n)]
            for only in (np.setdiff1d(x, y), np.setdiff1d(y, x)):
                columns.append(_ints(only % k, np.bincount(only // k, minlength=part.num_rows)))
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "own", "gone", "come"])

    return run


def _totals(batches):
    """Rows and toxic rows of each bucket, summed within the task."""
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        own = batch.column("own")
        toxic = np.repeat(np.asarray(batch.column("toxic")), np.diff(own.offsets.to_numpy()))
        f = own.flatten().to_numpy()
        total += np.stack([np.bincount(f, minlength=1 << BITS), np.bincount(f[toxic == 1], minlength=1 << BITS)])
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], ["f", "n", "a"])


class ToxicityModel:
    """Weight of each bucket (0 for most), and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, column) -> np.ndarray:
        doc, bucket = buckets(column)
        use = self.weights[bucket] != 0
        bucket, n = distinct(doc[use], bucket[use], len(column))
        sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket], dtype=float)])
        upto = np.concatenate([[0], np.cumsum(n)])
        return 1 / (1 + np.exp(-np.clip(self.bias + sums[upto[1:]] - sums[upto[:-1]], -30, 30)))


def _dense(lists_, place: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(lists_), k))
    row = np.repeat(np.arange(len(lists_)), np.diff(lists_.offsets.to_numpy()))
    col = place[lists_.flatten().to_numpy()]
    out[row[col >= 0], col[col >= 0]] = 1
    return out


def _gradient(place, weights: np.ndarray, bias: float, fairness: float):
    def run(batches):
        k = len(weights)
        total = np.zeros(k + 2)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x, gone, come = (_dense(part.column(c), place.value, k) for c in ("own", "gone", "come"))
                y = np.asarray(part.column("toxic"), float)
                off = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - y
                moved = gone - come
                total[:k] += off @ x + fairness * (moved @ weights) @ moved
                total[k] += off.sum()
                total[k + 1] += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["g"])

    return run


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows: int = ROWS, features: int = FEATURES, steps: int = STEPS, fairness: float = FAIRNESS, groups=IDENTITY_GROUPS) -> ToxicityModel:
    """Learns from the texts of docs that labels has a 0/1 label for, at most `rows` of each class: those with the least hashes of their key.

    `rows` (10,000) and `features` (2048) bound what is fitted; as the chosen
    keys are so few, they are sent to the scan of docs, and no text is
    shuffled. With rows of one class only, or none, the model gives every text
    that class (0 without rows).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).distinct()
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("key"), "key").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    table = kept(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("toxic", "text").mapInArrow(_features(groups), "toxic int, own array<int>, gone array<int>, come array<int>"))
    counts = table.select("toxic", "own").mapInArrow(_totals, "f int, n long, a long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    n, pos = table.agg(F.count("*"), F.sum("toxic")).first()
    if not n or pos in (0, n):
        return ToxicityModel(np.zeros(1 << BITS), 30.0 if pos else -30.0)
    rate = pos / n
    # z: by how many standard deviations the texts with the word differ in their label from all texts.
    counts = counts.withColumn("z", F.abs(F.col("a") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1))
    top = counts.where("z > 3").orderBy(F.desc("z"), "f").limit(features).collect()
    place = np.full(1 << BITS, -1, np.int64)
    place[[r["f"] for r in top]] = np.arange(len(top))
    sent = docs.sparkSession.sparkContext.broadcast(place)
    w, bias, past = np.zeros(len(top)), float(np.log(rate / (1 - rate))), np.full(len(top) + 1, 1e-12)
    for _ in range(steps):  # Adagrad; each gradient is summed by Spark over all rows of the table
        grads = table.mapInArrow(_gradient(sent, w, bias, fairness), "g array<double>")
        g = np.array([r["s"] for r in grads.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()])
        g = g[:-1] / g[-1]
        g[:-1] += RIDGE * w
        past += g * g
        move = RATE * g / np.sqrt(past)
        w, bias = w - move[:-1], bias - float(move[-1])
    weights = np.zeros(1 << BITS)
    weights[place >= 0] = w[place[place >= 0]]
    return ToxicityModel(weights, bias)


def _scored(model, text: str, n_keep: int):
    def run(batches):
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_keep)), pa.array(model.value.score(part.column(text)))], [*(f"k{i}" for i in range(n_keep)), "score"])

    return run


def predict(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    A null or empty text has the score of the bias alone. All rows stay;
    columns by these two names are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted")]
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    columns = [F.col(c).alias(k) for c, k in names.items()]
    if text not in names:
        columns.append(F.col(text).alias("text"))
    schema = ", ".join([*(f"{k} {df.schema[c].dataType.simpleString()}" for c, k in names.items()), "score double"])
    sent = df.sparkSession.sparkContext.broadcast(model)
    found = df.select(*columns).mapInArrow(_scored(sent, names.get(text, "text"), len(keep)), schema)
    return found.select(*[F.col(k).alias(c) for c, k in names.items()], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
