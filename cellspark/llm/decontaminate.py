"""Benchmark decontamination by spaced seeds.

Each mask hashes the tokens at its fixed positions of a window and ignores the
others, so that a hit survives substitutions there. Hashes of the benchmark
are joined with those of all documents inside the scan; around each hit the
two texts are compared token by token on the diagonal of the hit.

A benchmark of up to BLOCK_BYTES of text is sent to all tasks, and one pass
over the documents finds its leaks. A larger one is joined with them by
shuffle: seeds of both sides, each with the tokens around it, meet by hash, and
what doesn't agree around the seed is dropped where it meets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, STEP, Words, kept, longs, mixed, numbered, powers, slices, utf8

#: Positions that count: weight 6. Of any SPAN to WINDOW tokens with as many changes as allowed, one mask at least fits somewhere (tests go through all).
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 5, 6), (0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
#: Tokens of the shortest item that counts.
SPAN = 8
#: A leak: WINDOW consecutive tokens (or a whole shorter item) of which one in TOLERANCE at most differs.
WINDOW, TOLERANCE = 13, 6
BLOCK_BYTES = 16 << 20
FILTER_BITS = 22
#: Hits of seeds that a task handles at once, however many items have a seed.
HITS = 1 << 18

TOKEN = np.zeros(256, bool)
TOKEN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def tokens(column) -> Words:
    """Tokens: runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    data, offsets = utf8(column)
    return Words(LOWER[data], offsets, TOKEN[data])


def seeds(words: Words, mask: tuple[int, ...], tag: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words.hash) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, _ = powers(STEP, len(mask) + 1)
    h = np.full(n, tag, np.uint64)
    for k, o in enumerate(mask):
        h += words.hash[o : o + n] * up[k + 1]
    at = np.flatnonzero(words.doc[:n] == words.doc[mask[-1] :])
    return mixed(h[at]), at


def masks(shortest: int) -> list[tuple[tuple[int, ...], int, int]]:
    """(mask, least and greatest tokens of the items that it is for): an item of fewer than SPAN tokens has one seed, all its tokens."""
    return [(m, SPAN, 1 << 62) for m in MASKS] + [(tuple(range(n)), n, n) for n in range(shortest, SPAN)]


def item_seeds(words: Words, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for i, (mask, least, most) in enumerate(masks(shortest)):
        h, at = seeds(words, mask, i)
        fits = (words.count[words.doc[at]] >= least) & (words.count[words.doc[at]] <= most)
        found.append((h[fits], at[fits]))
    h, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, at


class Index:
    """Seeds of benchmark items, sorted by hash."""

    def __init__(self, ids: list, texts: list[str], shortest: int = SPAN):
        words = tokens(pa.array(texts, pa.string()))
        self.ids, self.hash, self.first, self.shortest = ids, words.hash, words.first, shortest
        h, at = item_seeds(words, shortest)
        order = np.argsort(h, kind="stable")
        self.seed, self.at = h[order], at[order]
        self.item = words.doc[self.at] if len(at) else self.at
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.seed >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, words: Words):
        """Distinct (diagonal, document, item) of seed hits, some HITS at a time: document start minus item start, and so on."""
        for i, (mask, _, _) in enumerate(masks(self.shortest)):
            h, at = seeds(words, mask, i)
            near = self.maybe[h >> np.uint64(64 - FILTER_BITS)]
            h, at = h[near], at[near]
            lo, hi = np.searchsorted(self.seed, h, "left"), np.searchsorted(self.seed, h, "right")
            upto = np.concatenate([[0], np.cumsum(hi - lo)])
            for begin in range(0, int(upto[-1]), HITS):
                k = np.arange(begin, min(begin + HITS, int(upto[-1])))
                which = np.searchsorted(upto, k, "right") - 1
                rows = lo[which] + k - upto[which]
                yield np.unique(np.stack([at[which] - self.at[rows], words.doc[at[which]], self.item[rows]], 1), axis=0)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int] | None:
    """(start, end, equal tokens) from the first to the last equal token in windows in which a and b, aligned, agree enough."""
    width, equal = min(WINDOW, len(a)), a == b
    upto = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(upto[width:] - upto[:-width] >= width - width // TOLERANCE)
    if not len(good):
        return None
    start, end = int(good[0]), int(good[-1]) + width
    start, end = start + int(equal[start:end].argmax()), end - int(equal[start:end][::-1].argmax())
    return start, end, int(upto[end] - upto[start])


def longest(words: Words, doc: int, diagonal: int, hashes: np.ndarray, a: int, b: int) -> tuple[int, int, int, int] | None:
    """(n_equal, -doc_start, item_start, n_overlap) of a document and the item hashes[a:b], aligned by a diagonal."""
    lo, hi = max(a, int(words.first[doc]) - diagonal), min(b, int(words.first[doc + 1]) - diagonal)
    if hi - lo < min(WINDOW, b - a) or not (found := overlap(words.hash[lo + diagonal : hi + diagonal], hashes[lo:hi])):
        return None
    start, end, equal = found
    return equal, -(lo + diagonal + start - int(words.first[doc])), lo + start - a, end - start


def _leaks(index, ids_type: pa.DataType, items_type: pa.DataType):
    def run(batches):
        ix = index.value
        for part in slices(batches):
            words = tokens(part.column("text"))
            ids, best = part.column("doc_id").to_pylist(), {}
            for hits in ix.hits(words):
                for diagonal, doc, item in hits.tolist():
                    if row := longest(words, doc, diagonal, ix.hash, int(ix.first[item]), int(ix.first[item + 1])):
                        best[doc, item] = max(best.get((doc, item), row), row)
            columns = [pa.array([ids[d] for d, _ in best], ids_type), pa.array([ix.ids[i] for _, i in best], items_type)]
            numbers = np.array(list(best.values()), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*columns, longs(-numbers[:, 1]), longs(numbers[:, 2]), longs(numbers[:, 3]), longs(numbers[:, 0])], LEAK)

    return run


LEAK = ["doc_id", "item_id", "doc_start", "item_start", "n_overlap", "n_equal"]
#: Tokens before a seed that a window with it can begin at, and tokens from its start that travel with it.
BEFORE, AFTER = WINDOW - min(m[-1] + 1 for m in MASKS), WINDOW


def _around(words: Words, at: np.ndarray) -> pa.Array:
    """BEFORE + AFTER token hashes around each seed, 0 where the text has no token."""
    place = at[:, None] + np.arange(-BEFORE, AFTER)[None, :]
    inside = (place >= words.first[words.doc[at]][:, None]) & (place < words.first[words.doc[at] + 1][:, None])
    out = np.where(inside, words.hash[np.clip(place, 0, max(0, len(words.hash) - 1))], np.uint64(0)) if len(at) else np.zeros((0, BEFORE + AFTER), np.uint64)
    return pa.FixedSizeListArray.from_arrays(longs(out.ravel()), BEFORE + AFTER).cast(pa.list_(pa.int64()))


def _seed_rows(shortest: int, maybe=None):
    """(h, row, at, around, n) of the seeds of items, or (with the broadcast filter `maybe`) of documents."""

    def run(batches):
        for part in slices(batches):
            words = tokens(part.column("text"))
            if maybe is None:
                h, at = item_seeds(words, shortest)
            else:
                h, at = (np.concatenate(x) for x in zip(*(seeds(words, mask, i) for i, (mask, _, _) in enumerate(masks(shortest))), strict=True))
                near = maybe.value[h >> np.uint64(64 - FILTER_BITS)]
                h, at = h[near], at[near]
            for lo in range(0, len(h), HITS):
                x, p = h[lo : lo + HITS], at[lo : lo + HITS]
                doc = words.doc[p]
                yield pa.RecordBatch.from_arrays([longs(x), part.column("row").take(pa.array(doc)), longs(p - words.first[doc]), _around(words, p), longs(words.count[doc])], ["h", "row", "at", "around", "n"])

    return run


def _agree(batches):
    """(row, item, diagonal) of the hits around which some window with the seed agrees enough."""
    for batch in batches:
        x, y = (batch.column(c).flatten().to_numpy().reshape(-1, BEFORE + AFTER) for c in ("around", "other"))
        upto = np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum((x == y) & (x != 0), 1)], 1)
        n, good = np.minimum(batch.column("n").to_numpy(), WINDOW), np.zeros(len(x), bool)
        for w in np.unique(n):
            for s in range(min(BEFORE, WINDOW - int(w)), BEFORE + 1):
                good |= (n == w) & (upto[:, s + w] - upto[:, s] >= w - w // TOLERANCE)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in (batch.column("row"), batch.column("item"), batch.column("diagonal"))], ["row", "item", "diagonal"])


def _measured(batches):
    """The passage of each (row, item, diagonal), from both texts."""
    for part in slices(batches):
        words, items = tokens(part.column("text")), tokens(part.column("own"))
        found = []
        for k, diagonal in enumerate(part.column("diagonal").to_pylist()):
            a, b = int(items.first[k]), int(items.first[k + 1])
            found.append(longest(words, k, diagonal + int(words.first[k]) - a, items.hash, a, b) or (0, 0, 0, 0))
        numbers = np.array(found, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([part.column("row"), part.column("item"), *(longs(numbers[:, i]) for i in range(4))], ["row", "item", "n_equal", "back", "item_start", "n_overlap"])


def _joined(docs: DataFrame, items: DataFrame, shortest: int) -> DataFrame:
    """(row, item, doc_start, ...) of docs (row, text) and items (row, text), by a join of seeds."""
    seed = "h long, row long, at long, around array<long>, n long"
    own = kept(items.mapInArrow(_seed_rows(shortest), seed))
    maybe = np.zeros(1 << FILTER_BITS, bool)
    marks = own.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int").alias("b")).distinct().toArrow()  # FILTER_BITS bound them
    maybe[np.asarray(marks["b"])] = True
    rows = docs.mapInArrow(_seed_rows(shortest, docs.sparkSession.sparkContext.broadcast(maybe)), seed).drop("n")
    other = own.select("h", F.col("row").alias("item"), F.col("at").alias("start"), F.col("around").alias("other"), "n")
    met = rows.join(other, "h").select("row", "item", (F.col("at") - F.col("start")).alias("diagonal"), "around", "other", "n")
    found = met.mapInArrow(_agree, "row long, item long, diagonal long").distinct()
    texts = found.join(docs, "row").join(items.select(F.col("row").alias("item"), F.col("text").alias("own")), "item")
    best = texts.select("row", "item", "diagonal", "text", "own").mapInArrow(_measured, "row long, item long, n_equal long, back long, item_start long, n_overlap long")
    best = best.where("n_equal > 0").groupBy("row", "item").agg(F.max(F.struct("n_equal", "back", "item_start", "n_overlap")).alias("x"))
    return best.select("row", "item", (-F.col("x.back")).alias("doc_start"), "x.item_start", "x.n_overlap", "x.n_equal")


def leaks(df: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shortest: int = SPAN) -> DataFrame:
    """One row per document and benchmark item that it holds a passage of.

    n_overlap tokens from doc_start and item_start on (token indices), of which
    n_equal are equal; of several such passages the one with most equal tokens,
    then the first. Null or empty texts have none. Items of fewer than SPAN
    tokens stand in clean texts too, so they count only where `shortest` is
    lower: then items of shortest to SPAN - 1 tokens leak where all their tokens
    stand in a row. Repeated documents or items give repeated rows; a null id
    stays null in the row of its document, and items with a null id are left
    out. Ids may be of any type. Other columns are ignored.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    given = df.where("text IS NOT NULL").select("doc_id", "text")
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((given, "doc_id"), (items, "item_id"))]
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if 2 * total <= block_bytes:
        rows = items.orderBy("item_id", "text").toArrow()
        sent = df.sparkSession.sparkContext.broadcast(Index(rows["item_id"].to_pylist(), rows["text"].to_pylist(), shortest))
        ids = given.limit(0).toArrow().schema.field("doc_id").type
        return given.mapInArrow(_leaks(sent, ids, rows["item_id"].type), f"doc_id {kinds[0]}, item_id {kinds[1]}, " + ", ".join(f"{c} long" for c in LEAK[2:]))
    docs, own = (kept(x.withColumn("row", F.monotonically_increasing_id())) for x in (given, items))
    found = _joined(docs.select("row", "text"), own.select("row", "text"), shortest)
    return found.join(docs.select("row", "doc_id"), "row").join(own.select(F.col("row").alias("item"), "item_id"), "item").select(*LEAK)


def without_leaks(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of df, whole, that hold no passage of the benchmark; rows with null or repeated ids are judged each by itself."""
    name = "_row" + "_" * max(map(len, df.columns))
    rows, _ = numbered(df, name=name)
    found = leaks(rows.select(F.col(name).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name)).distinct()
    return rows.join(found, name, "left_anti").select(*df.columns)
