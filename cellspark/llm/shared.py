"""What several operators share: the shared folder, Arrow text batches and word hashes.

Texts reach Python as Arrow columns. Their UTF-8 bytes are read in place with
numpy, a quarter of a megabyte at a time, so that memory doesn't grow with the batch.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK = 1 << 18
#: Tasks that the rows of one key are dealt out to.
SALTS = 16
#: Bits of a sieve for each of its ids, bits that an id sets, and the most 64-bit words of a sieve, which all tasks get.
BITS, MARKS, WORDS = 16, 4, 1 << 19
#: Odd multipliers of the polynomial hashes, modulo 2**64.
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see. Only a session whose tasks run in this very process (a master of local) goes without it: there it is set to a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has some `size` bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, modulo 2**64."""
    up, down = _powers.get(int(base), (np.zeros(0, np.uint64),) * 2)
    if len(up) < n:
        n = max(n, CHUNK + 64)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, inverse))
        _powers[int(base)] = up, down
    return up[:n], down[:n]


class Words:
    """Words of a chunk of texts: `start` and `end` in bytes, `doc` (row of the chunk) and a 64-bit `hash` of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n = len(data)
        begins, ends = inside.copy(), inside.copy()
        if n:
            first = offsets[:-1][offsets[:-1] < n]
            begins[1:] &= ~inside[:-1]
            begins[first] = inside[first]
            ends[:-1] &= ~inside[1:]
            last = offsets[1:][offsets[1:] > 0] - 1
            ends[last] = inside[last]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        up, down = powers(BASE, n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        self.hash = mixed((prefix[self.end] - prefix[self.start]) * down[self.start])
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1) if len(self.doc) else np.zeros(len(offsets) - 1, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def windows(self, k: int, base: np.uint64 = STEP) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of each k consecutive words of one document, and their first words."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = powers(base, n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=prefix[1:])
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return mixed((prefix[at + k] - prefix[at]) * down[at]), at

    def whole(self, base: np.uint64 = STEP) -> np.ndarray:
        """A hash of the whole word sequence of each text; 0 where it has no word."""
        n = len(self.hash)
        up, down = powers(base, n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=prefix[1:])
        a, b = self.first[:-1], self.first[1:]
        out = mixed((prefix[b] - prefix[a]) * down[a] + self.count.astype(np.uint64))
        return np.where(self.count > 0, out, np.uint64(0))


    def joined(self, take: np.ndarray | None = None) -> tuple[memoryview, np.ndarray]:
        """Bytes and offsets of the texts with (of these words, the taken ones) one blank between words."""
        take = np.ones(len(self.start), bool) if take is None else take
        start, end, doc = self.start[take], self.end[take], self.doc[take]
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[start] += 1
        edge[end] -= 1
        use = np.cumsum(edge[:-1], dtype=np.int8) > 0
        data = self.data.copy()
        follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1 if len(doc) else np.zeros(0, np.int64)
        data[start[follows] - 1] = 0x20  # what stands before a word is white space
        use[start[follows] - 1] = True
        upto = np.concatenate([[0], np.cumsum(use)])
        return memoryview(data[use].tobytes()), upto[self.offsets]


def numbered(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "_row") -> tuple[DataFrame, bool]:
    """(df with the column `name`: a different long for each row, in the order of key (then of text; rows without a key come last).

    It is the key itself where that is a whole number, never null and never
    repeated. Else the rows are sorted by ranges and written to the shared
    folder with their numbers.
    """
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        return df.withColumn(name, F.col(key).cast("long")), True
    order = [F.col(key).asc_nulls_last(), F.col(text)]
    return kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())), False


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], by: str, how: str = "left", used: DataFrame | None = None) -> DataFrame:
    """rows joined with a table of one row for each `on`. Rows of one `on` are dealt out to SALTS tasks by the column `by`, so that no task gets all rows of a frequent one. `used`: rows with the same `on` and `by`, where the table's rows are large: these then go only to tasks that have such rows."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    if used is None:
        many = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    else:
        many = table.join(used.select(*on, salt.alias("_salt")).distinct(), on)
    return rows.withColumn("_salt", salt).join(many, [*on, "_salt"], how).drop("_salt")


def _sifted(rows: DataFrame, ids: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose `on` may be one of ids: all that are and a few others; the rest). A Bloom filter: each id sets MARKS bits of one of its words. Beyond WORDS * 64 / BITS ids it isn't larger, but lets more others through."""
    words = min(WORDS, 1 << (ids.count() * BITS // 64).bit_length())
    far = "_" * max(map(len, rows.columns))  # longer than any column
    word, marks, bits = f"w{far}", f"m{far}", f"b{far}"
    h = F.xxhash64(on)
    each = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 32 + 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(MARKS)]
    own = {word: h.bitwiseAND(F.lit(words - 1).cast("long")), marks: functools.reduce(Column.bitwiseOR, each)}
    table = ids.select(*[c.alias(n) for n, c in own.items()]).groupBy(word).agg(F.bit_or(marks).alias(bits))
    told = rows.withColumns(own).join(F.broadcast(table), word, "left")
    within = F.coalesce(F.col(bits).bitwiseAND(F.col(marks)) == F.col(marks), F.lit(False))
    return told.where(within).select(*rows.columns), told.where(~within).select(*rows.columns)


def among(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """A semi join of large rows with few ids: those that can't match stay where they are, the others are joined exactly."""
    ids = kept(ids.select(on))
    return _sifted(rows, ids, on)[0].join(ids, on, "left_semi")


def others(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """An anti join of large rows with few ids, as among()."""
    ids = kept(ids.select(on))
    may, not_ = _sifted(rows, ids, on)
    return not_.union(may.join(ids, on, "left_anti").select(*rows.columns))


def spaced(column, lower: bool = False) -> Words:
    """Words as runs of bytes that are not white space (20 and 09 to 0D, hexadecimal); lower turns A-Z into a-z."""
    data, offsets = utf8(column)
    return Words(LOWER[data] if lower else data, offsets, ~SEPARATOR[data])


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of int64 lists, counts[i] of the values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), longs(values))
