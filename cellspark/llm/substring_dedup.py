"""Substring dedup: Rabin-Karp hashes of token windows, counted in Spark.

A window of `width` words goes if the same words already start a window
earlier (in a smaller doc_id, or before it in the same document).

1. Documents whose whole word sequence another one has are set apart: all but
   the first are removed whole, and only the first goes on.
2. To shuffle few hashes, each run of windows is first judged by its anchors:
   of every `width - ANCHOR + 1` consecutive short windows the one with the
   least hash. Equal windows hold equal anchors, so a window without an anchor
   that occurs twice can't repeat, and is not shuffled.
3. Windows around anchors that occur twice are hashed (by two hashes of 64 and
   32 bits) and ordered by start; all but the first of equal ones go.
4. Removed windows of a document merge into maximal intervals of words.

In 2 and 3 a task first settles what repeats within its own rows, and deals
out one row for each hash and some PART rows. So a passage that very many
documents have comes as few rows from each task, and no task gets all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BASE, STEP, kept, longs, looked_up, mixed, numbered, slices, spaced

#: Words of an anchor; rows that a task settles at once.
ANCHOR, PART = 6, 1 << 20
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(hashes: np.ndarray, at: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Indices of hashes that are the least of some `span` consecutive ones of a document (the first, of equal ones)."""
    n = len(hashes)
    if n < span:
        return np.zeros(0, np.int64)
    best = np.arange(n - span + 1)
    low = hashes[: n - span + 1].copy()
    for j in range(1, span):
        x = hashes[j : n - span + 1 + j]
        less = x < low
        low[less] = x[less]
        best = np.where(less, np.arange(n - span + 1) + j, best)
    whole = (doc[at[: n - span + 1]] == doc[at[span - 1 :]])
    return np.unique(best[whole])


def _facts(batches):
    for part in slices(batches):
        words = spaced(part.column("text"))
        data, ends = words.joined()
        shas = [hashlib.sha256(data[ends[i] : ends[i + 1]]).hexdigest() for i in range(part.num_rows)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), longs(words.count), longs(words.whole()), longs(words.whole(SECOND)), pa.array(shas)], ["doc_id", "n_words", "whole_a", "whole_b", "sha"])


def _dealt(found):
    """Rows (key, more, doc_id, at, known) of the hashes (key and more), ids and starts found, settled by some PART at a time.

    The first of equal hashes keeps the hash as key. The others are known to
    repeat; their keys are random, for they need no comparing. known is 2 for
    these, 1 for a first one that repeats here, and 0 for a single one.
    """
    held, n = [], 0

    def settle():
        h, more, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, doc, more, h))
        h, more, doc, at = h[order], more[order], doc[order], at[order]
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (more[1:] == more[:-1])])
        known = np.where(same, 2, np.append(same[1:], False)).astype(np.int8)
        key = np.where(same, mixed(doc.view(np.uint64) * STEP + at.astype(np.uint64) + mixed(h)), h)
        return pa.RecordBatch.from_arrays([longs(key), pa.array(more), pa.array(doc), pa.array(at.astype(np.int32)), pa.array(known)], ["key", "more", "doc_id", "at", "known"])

    for rows in found:
        if len(rows[0]):
            held.append(rows)
            n += len(rows[0])
        if n >= PART:
            yield settle()
            held, n = [], 0
    if held:
        yield settle()


def _anchors(span: int):
    def found(batches):
        for part in slices(batches):
            words = spaced(part.column("text"))
            h, at = words.windows(ANCHOR)
            chosen = anchors(h, at, words.doc, span)
            doc = words.doc[at[chosen]]
            yield h[chosen], np.zeros(len(chosen), np.int32), part.column("doc_id").to_numpy()[doc], at[chosen] - words.first[doc]

    return lambda batches: _dealt(found(batches))


def _windows(width: int, span: int):
    """Windows that hold an anchor which occurs twice."""

    def found(batches):
        for part in slices(batches):
            words = spaced(part.column("text"))
            marks = part.column("at")
            doc = np.repeat(np.arange(part.num_rows), np.diff(marks.offsets.to_numpy()))
            near = np.zeros(len(words.hash) + 1, np.int64)  # starts from which a window holds the anchor
            p = words.first[doc] + marks.flatten().to_numpy()
            np.add.at(near, np.maximum(p - span + 1, words.first[doc]), 1)
            np.add.at(near, p + 1, -1)
            h, at = words.windows(width)
            take = np.cumsum(near)[at] > 0
            more = (words.windows(width, BASE)[0][take] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            at, h = at[take], h[take]
            yield h, more, part.column("doc_id").to_numpy()[words.doc[at]], at - words.first[words.doc[at]]

    return lambda batches: _dealt(found(batches))


def _cut(width: int):
    def run(batches):
        for part in slices(batches):
            words = spaced(part.column("text"))
            marks = part.column("at")
            doc = np.repeat(np.arange(part.num_rows), np.diff(marks.offsets.to_numpy()))
            start = words.first[doc] + marks.flatten().to_numpy()
            cover = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + width, -1)
            gone = np.cumsum(cover)[:-1] > 0
            data, ends = words.joined(~gone)
            texts = [bytes(data[ends[i] : ends[i + 1]]) for i in range(part.num_rows)]
            begins, stops = gone.copy(), gone.copy()
            begins[1:] &= ~gone[:-1] | (words.doc[1:] != words.doc[:-1])
            stops[:-1] &= ~gone[1:] | (words.doc[1:] != words.doc[:-1])
            begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            runs = words.doc[begins]
            spans = pa.StructArray.from_arrays([pa.array((x - words.first[runs]).astype(np.int32)) for x in (begins, stops)], ["start", "end"])
            upto = np.concatenate([[0], np.cumsum(np.bincount(runs, minlength=part.num_rows))]).astype(np.int32)
            removed = np.bincount(words.doc[gone], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), longs(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(upto), spans)],
                ["doc_id", "n_removed", "kept_sha256", "kept_text", "removed"],
            )

    return run


ROWS = "key long, more int, doc_id long, at int, known byte"


def repeated_windows(docs: DataFrame, width: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts of each document, documents that aren't whole copies, starts of removed windows of these by document)."""
    span = width - ANCHOR + 1
    facts = kept(docs.mapInArrow(_facts, "doc_id long, n_words long, whole_a long, whole_b long, sha string"))
    long = facts.where(F.col("n_words") >= width)
    firsts = long.groupBy("whole_a", "whole_b").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    copies = kept(looked_up(long, firsts, ["whole_a", "whole_b"], "doc_id", "inner").where("doc_id > first").select("doc_id", F.lit(True).alias("copy")))
    facts = facts.join(copies, "doc_id", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    own = docs.where("text IS NOT NULL").join(copies, "doc_id", "left_anti")
    key = Window.partitionBy("key", "more")
    found = own.mapInArrow(_anchors(span), ROWS).withColumn("_n", F.count("*").over(key))
    marks = found.where("known > 0 OR _n > 1").groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    found = own.join(marks, "doc_id").mapInArrow(_windows(width, span), ROWS).withColumn("_n", F.row_number().over(key.orderBy("doc_id", "at")))
    return facts, own, found.where("known = 2 OR _n > 1").groupBy("doc_id").agg(F.collect_list("at").alias("at"))


def dedup_substrings(df: DataFrame, width: int = 20) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, kept_sha256, kept_text, removed intervals of words.

    Words are runs of non-white-space, unchanged. A document that is null,
    empty or shorter than `width` keeps all its words; n_words counts before
    removal; kept_text (words joined by one space) is null where nothing is
    removed; `removed` is empty then, and covers all words for a whole copy.
    Of rows with one doc_id the one with the least text comes first, rows
    without one come after all others. Other columns of df are ignored.
    """
    rows, unique = numbered(df.select("doc_id", "text"))
    facts, own, later = repeated_windows(rows.select(F.col("_row").alias("doc_id"), "text"), width)
    cut = own.join(later, "doc_id").mapInArrow(_cut(width), "doc_id long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:int,end:int>>")
    empty = hashlib.sha256(b"").hexdigest()
    spans = "array<struct<start:int,end:int>>"
    out = facts.join(cut, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), "").otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(F.col("copy"), F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).cast(spans)).otherwise(F.coalesce("removed", F.array().cast(spans))).alias("removed"),
    )
    if unique:
        return out.withColumn("doc_id", F.col("doc_id").cast(df.schema["doc_id"].dataType))
    return out.withColumnRenamed("doc_id", "_row").join(rows.select("_row", "doc_id"), "_row").select("doc_id", *out.columns[1:])
