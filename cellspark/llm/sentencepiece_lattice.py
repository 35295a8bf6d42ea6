"""SentencePiece encoding and decoding over a relational lattice.

1. The distinct units of all texts (see pieces.py), with their counts.
2. Lattice: every substring of a unit, up to the longest piece, is a row; an
   equi-join with the piece table keeps the edges; edges are grouped by unit
   and a higher-order aggregate folds them by end position, carrying the best
   scores; a second one goes back along the edges that have them: the Viterbi
   cut of each unit, its ids. A unit of more than PART characters (an unbroken
   run) is exploded and grouped in parts, and folded part by part.
3. The ids of the most frequent units, HEAD at most and of HEAD_BYTES in all, are sent
   to the tasks that cut the texts again and put ids in place of units. Units
   beyond that bound are joined by shuffle, as rows of their documents.

Explode, join, grouping and fold of step 2 keep the partitioning by unit, so
the lattice adds no shuffle to that of step 1.

Python tells units by a 64-bit hash: of u different units in a task some
u * HELD / 2^64 pairs, and of all U units U * HEAD / 2^64, would be taken for
one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PieceTable, hashes, load, strings
from .shared import kept, slices

#: Units whose ids are sent to all tasks, and bytes of these ids, at most. Different units that a task holds as strings.
HEAD, HEAD_BYTES, HELD = 1 << 22, 1 << 27, 1 << 17
#: Characters of a unit that are folded at once; no piece has more.
PART = 256
#: What `before` says of a whole unit of more characters.
WHOLE = -1
#: An edge is one long: its end (in the part), its length, and 1 + id, or UNKNOWN + code point where no piece has the character.
UNKNOWN = 1 << 23
#: How ids travel, of vocabularies of 2**16 pieces at most and of larger ones.
ID, WIDE = np.dtype("<u2"), np.dtype("<u4")


def parts(unit: str, longest: int) -> list[tuple[str, int]]:
    """(slice, before) of the parts of a long unit: the characters of each, and how many of these stand before it (as far as its first pieces reach)."""
    begin = [max(0, p + 1 - longest) for p in range(0, len(unit), PART)]
    return [(unit[b : PART * (i + 1)], PART * i - b) for i, b in enumerate(begin)]


def _distinct(path: str):
    """(unit, before, n) of the units, each about once for some HELD different ones: before is 0.

    A unit of more than PART characters has a before of WHOLE, and its parts are
    further rows, with n = 0.
    """

    def run(batches):
        table = load(path)
        seen, found, counts, names = np.zeros(0, np.uint64), [], [], []

        def flush():
            h, which = np.unique(np.concatenate(found), return_inverse=True)  # in the order of `names` sorted by hash
            n = np.bincount(which, np.concatenate(counts)).astype(np.int64)
            order = np.argsort(np.concatenate([x for x, _ in names]))
            units, n = np.array([u for _, own in names for u in own], object)[order].tolist(), n[: len(h)].tolist()
            before = [0] * len(units)
            for i in [i for i, u in enumerate(units) if len(u) > PART]:
                before[i] = WHOLE
                for piece, k in parts(units[i], table.longest):
                    units.append(piece)
                    before.append(k)
                    n.append(0)
            return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(before, pa.int32()), pa.array(n, pa.int64())], ["unit", "before", "n"])

        for part in slices(batches):
            points, start, _, h = table.units(part.column("text").to_pylist())
            each, first, n = np.unique(h, return_index=True, return_counts=True)
            if not len(each):
                continue
            at = np.minimum(np.searchsorted(seen, each), max(0, len(seen) - 1))
            new = seen[at] != each if len(seen) else np.ones(len(each), bool)
            found.append(each)
            counts.append(n)
            names.append((each[new], strings(points, start, first[new])))
            seen = np.sort(np.concatenate([seen, each[new]]), kind="stable")  # two sorted runs: a merge
            if len(seen) > HELD:
                yield flush()
                seen, found, counts, names = np.zeros(0, np.uint64), [], [], []
        if found:
            yield flush()

    return run


def piece_rows(spark: SparkSession, table: PieceTable) -> DataFrame:
    """(piece, id, score): the model's vocabulary, a fixed small table."""
    rows = pa.table({"piece": list(table.pieces), "id": pa.array([i for i, _ in table.pieces.values()], pa.int32()), "score": [s for _, s in table.pieces.values()]})
    return spark.createDataFrame(rows)


def edges(units: DataFrame, pieces: DataFrame, longest: int, unknown: float) -> DataFrame:
    """unit, before, n and an edge of the lattice in each row: a piece that ends after the first `before` characters, or a character that no piece has. A whole long unit has one row, without an edge."""
    size, start = F.col("size"), F.col("start")
    many = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("unit"), F.lit(longest))))
    rows = units.withColumn("size", F.explode(F.when(F.col("before") == WHOLE, F.array(F.lit(0))).otherwise(many)))
    first = F.greatest(F.lit(0), F.col("before") + 1 - size)
    rows = rows.where(F.length("unit") - size >= first).withColumn("start", F.explode(F.when(size == 0, F.array(F.lit(0))).otherwise(F.sequence(first, F.length("unit") - size))))
    rows = rows.withColumn("piece", F.substr("unit", start + 1, size))
    found = rows.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR size < 2")
    what = F.coalesce(F.col("id") + 1, F.ascii("piece") + UNKNOWN).cast("long")
    edge = F.shiftleft((start + size).cast("long"), 32) + F.shiftleft(size.cast("long"), 24) + what
    return found.select("unit", "before", "n", F.when(size > 0, F.struct(edge.alias("edge"), F.coalesce("score", F.lit(unknown)).alias("score"))).alias("edge"))


def _end(x: Column) -> Column:
    return F.shiftright(x["edge"], 32).cast("int")


def _start(x: Column) -> Column:
    return (F.shiftright(x["edge"], 32) - F.shiftright(x["edge"], 24).bitwiseAND(F.lit(255))).cast("int")


def _what(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")


def _cut(lattice: Column, reach: int) -> Column:
    """The best cut: array of edges, of a lattice that is array<struct<part, edges in order>>.

    Forward, each part is folded into the best scores of its positions; from
    part to part only the last `reach` ones (of the longest piece) go on.
    Backward, the edge that has the best score of its end is taken, the longest
    of equal ones. Positions are counted within parts, so a unit costs in
    proportion to its length, however long it is.
    """

    def forward(acc: Column, x: Column) -> Column:
        here = F.coalesce(F.get(acc["done"], _start(x)), acc["top"]) + x["score"]  # top is the score of the position behind those done
        same = _end(x) == F.size(acc["done"])
        done = F.when(same, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["top"])))
        return F.struct(F.greatest(here, F.when(same, acc["top"])).alias("top"), done.alias("done"))  # greatest skips null

    def next_part(acc: Column, p: Column) -> Column:
        begin = F.struct(F.element_at(acc["last"], -1).alias("top"), F.slice(acc["last"], 1, F.size(acc["last"]) - 1).alias("done"))
        best = F.aggregate(p["edges"], begin, forward, lambda a: F.concat(a["done"], F.array(a["top"])))
        # the fold stands in two fields: as a lambda's argument it is evaluated once
        return F.get(F.transform(F.array(best), lambda b: F.struct(F.slice(b, F.greatest(F.lit(1), F.size(b) - reach + 1), F.lit(reach)).alias("last"), F.concat(acc["all"], F.array(b)).alias("all"))), 0)

    none = F.array().cast("array<array<double>>")
    scores = F.aggregate(lattice, F.struct(F.array(F.lit(0.0)).alias("last"), none.alias("all")), next_part, lambda acc: acc["all"])

    def backward(acc: Column, x: Column, best: Column) -> Column:
        fits = (_end(x) == acc["at"]) & (F.get(best, _start(x)) + x["score"] == F.get(best, acc["at"]))
        return F.when(fits, F.struct(_start(x).alias("at"), F.concat(acc["cut"], F.array(x["edge"])).alias("cut"))).otherwise(acc)

    def part_before(acc: Column, p: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), F.array().cast("array<bigint>").alias("cut"))
        own = F.aggregate(F.reverse(p["edges"]), begin, lambda a, x: backward(a, x, p["best"]))
        moved = F.when(p["part"] > 1, F.lit(PART)).otherwise(F.lit(PART + 1 - reach))  # from positions in this part to those in the one before
        return F.get(F.transform(F.array(own), lambda o: F.struct((o["at"] + moved).alias("at"), F.concat(acc["cuts"], F.array(o["cut"])).alias("cuts"))), 0)

    both = F.reverse(F.zip_with(lattice, scores, lambda p, b: F.struct(p["part"].alias("part"), p["edges"].alias("edges"), b.alias("best"))))
    start = lambda w: F.struct((F.size(F.get(w, 0)["best"]) - 1).alias("at"), F.array().cast("array<array<bigint>>").alias("cuts"))
    cut = F.transform(F.array(both), lambda w: F.aggregate(w, start(w), part_before, lambda acc: F.flatten(acc["cuts"])))
    return F.reverse(F.get(cut, 0))


def _ids(cut: Column, table: PieceTable) -> Column:
    """The ids of a cut; those of the UTF-8 bytes of a character that no piece has."""

    def utf8(c: Column) -> Column:
        tail = lambda k: F.shiftright(c, 6 * k).bitwiseAND(F.lit(63)) + 128
        two, three, four = (F.array(F.shiftright(c, 6 * k) + head, *[tail(j) for j in range(k - 1, -1, -1)]) for k, head in ((1, 192), (2, 224), (3, 240)))
        return F.when(c < 128, F.array(c)).when(c < 2048, two).when(c < 65536, three).otherwise(four)

    byte_ids = F.split(F.lit(",".join(str(table.bytes.get(b, table.unknown)) for b in range(256))), ",").cast("array<int>")
    lost = lambda x: F.transform(utf8(_what(x) - UNKNOWN), lambda b: F.get(byte_ids, b)) if table.bytes else F.array(F.lit(table.unknown))
    plain = F.transform(cut, lambda x: _what(x) - 1)
    mixed = F.flatten(F.transform(cut, lambda x: F.when(_what(x) >= UNKNOWN, lost(x)).otherwise(F.array(_what(x) - 1))))
    return F.when(F.exists(cut, lambda x: _what(x) >= UNKNOWN), mixed).otherwise(plain)


def unit_ids(seen: DataFrame, table: PieceTable) -> DataFrame:
    """(unit, n, ids) of the units that _distinct found, by the lattice. Units of more than PART characters are put together from the lattices of their parts."""
    if table.longest > min(255, PART):
        raise ValueError(f"a piece has {table.longest} characters")
    lattice = lambda part, edges: F.array(F.struct(part.alias("part"), edges.alias("edges")))
    grouped = edges(seen, piece_rows(seen.sparkSession, table), table.longest, table.unknown_score).groupBy("unit", "before").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("edge")).alias("edges"))
    cut = F.when(F.col("before") == 0, _cut(lattice(F.lit(0), F.col("edges")), table.longest))
    of_parts = F.when((F.col("before") > 0) | (F.length("unit") == PART), F.col("edges"))
    done = kept(grouped.select("unit", "before", "n", cut.alias("cut"), of_parts.alias("edges")).select("unit", "before", "n", _ids(F.col("cut"), table).alias("ids"), "edges"))
    origin = lambda p: F.greatest(F.lit(0), p * PART + 1 - table.longest)
    each = F.transform(F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / PART).cast("int")), lambda p: F.struct(p.alias("part"), F.substr(F.col("whole"), origin(p) + 1, (p + 1) * PART - origin(p)).alias("unit"), (p * PART - origin(p)).alias("before")))
    long = done.where(F.col("before") == WHOLE).select(F.col("unit").alias("whole"), "n").withColumn("key", F.sha2("whole", 256))
    whole = long.select("key", F.inline(each)).join(done.where("edges IS NOT NULL").select("unit", "before", "edges"), ["unit", "before"])
    whole = whole.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "edges"))).alias("lattice"))
    whole = long.join(whole, "key").select(F.col("whole").alias("unit"), "n", _cut(F.col("lattice"), table.longest).alias("cut")).select("unit", "n", _ids(F.col("cut"), table).alias("ids"))
    return done.where("before = 0 AND n > 0").select("unit", "n", "ids").unionByName(whole)


class _Head:
    """ids of frequent units: hashes in order, and their ids one after another."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes)
        self.hash, self.size, self.start, self.ids = hashes[order], np.diff(offsets)[order].astype(np.int32), offsets[:-1][order].astype(np.int32), ids
        self.begin = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each of h is among the hashes, or -1."""
        shift = np.uint64(64 - max(1, len(self.hash).bit_length()))
        if self.begin is None:  # where each leading part of a hash begins; made in the process that looks up
            counts = np.zeros((1 << (64 - int(shift))) + 1, np.int32)
            np.add.at(counts, (self.hash >> shift) + np.uint64(1), 1)
            self.begin = np.cumsum(counts, dtype=np.int32)
        at = self.begin[h >> shift]
        out, left = np.full(len(h), -1, np.int32), np.arange(len(h))
        while len(left):
            left, at = left[at < len(self.hash)], at[at < len(self.hash)]
            met = self.hash[at]
            out[left[met == h[left]]] = at[met == h[left]]
            more = met < h[left]
            left, at = left[more], at[more] + 1
        return out


def _packed(kind: np.dtype):
    """(hash of the unit, its ids as bytes of a kind), which take little room on the driver."""

    def run(batches):
        for batch in batches:
            yield from pack(batch)

    def pack(batch):
        units, ids = batch.column("unit").to_pylist(), batch.column("ids")
        if not units:
            return
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        h = hashes(points, np.concatenate([[0], ends[:-1]]).astype(np.int64))
        offsets = ids.offsets.to_numpy()
        values = ids.values.to_numpy()[offsets[0] : offsets[-1]].astype(kind)
        offsets = ((offsets - offsets[0]) * kind.itemsize).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(offsets), pa.py_buffer(values)])], ["h", "ids"])

    return run


def _head(units: DataFrame, kind: np.dtype) -> _Head:
    """The rows (unit, ids) as they are sent to all tasks."""
    table = units.select("unit", "ids").mapInArrow(_packed(kind), "h long, ids binary").toArrow()
    if not table.num_rows:
        return _Head(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, kind))
    h, ids = table["h"].to_numpy().view(np.uint64), table["ids"].combine_chunks()
    del table
    _, offsets, data = ids.buffers()
    offsets = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // kind.itemsize
    return _Head(h, offsets, np.frombuffer(data, kind))


def _array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


class _Parts:
    """What each id stands for, as bytes: one after another, with where each begins and its length."""

    def __init__(self, table: PieceTable):
        each = [n.replace("\u2581", " ").encode() for n in table.names]
        for byte, i in table.bytes.items():
            each[i] = bytes([byte])
        self.data = np.frombuffer(b"".join(each), np.uint8)
        self.size = np.fromiter(map(len, each), np.int64, len(each))
        self.begin = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of lists of ids, without the blank that encoding puts first."""
        size = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(self.begin[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        ends = upto[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def _encoded(path: str, head, n_keep: int, verify: bool):
    """ids of each text, -1 where a unit isn't in the head; and these units, in order; with verify, whether the ids give the text back."""

    def run(batches):
        table, x = load(path), head.value
        parts = _Parts(table)
        for part in slices(batches):
            points, start, doc, h = table.units(part.column("text").to_pylist())
            at = x.find(h)
            lost, size, source = np.flatnonzero(at < 0), np.ones(len(h), np.int64), np.full(len(h), len(x.ids))
            if len(lost) < len(h):
                size, source = np.where(at < 0, 1, x.size[at]), np.where(at < 0, len(x.ids), x.start[at])
            first = np.concatenate([[0], np.cumsum(size)])
            ids = np.append(x.ids.astype(np.int32), np.int32(-1)) if len(x.ids) < first[-1] else None
            which = np.repeat(source - first[:-1], size) + np.arange(first[-1])
            ids = ids[which] if ids is not None else np.where(which < len(x.ids), x.ids[np.minimum(which, len(x.ids) - 1)].astype(np.int32), np.int32(-1))
            totals = np.bincount(doc, size, part.num_rows).astype(np.int64)
            holes = np.bincount(doc[lost], minlength=part.num_rows)
            columns = [*(part.column(i) for i in range(n_keep)), _array(pa.array(ids), totals), _array(pa.array(strings(points, start, lost), pa.string()), holes)]
            names = [*(f"k{i}" for i in range(n_keep)), "ids", "holes"]
            if verify:
                columns.append(pa.array([a == (b or "") for a, b in zip(parts.texts(ids, totals), part.column("text").to_pylist(), strict=True)], pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _filled(n_keep: int):
    """ids with each -1 replaced by the next list of `fill`."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, out, n = part.column("ids").to_pylist(), [], []
                for own, fill in zip(ids, part.column("fill").to_pylist(), strict=True):
                    if fill:
                        rest = iter(fill)
                        own = [y for x in own for y in ([x] if x >= 0 else next(rest))]
                    out += own
                    n.append(len(own))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_keep)), _array(pa.array(out, pa.int32()), np.array(n))], [*(f"k{i}" for i in range(n_keep)), "ids"])

    return run


def _frequent(units: DataFrame, head: int, head_bytes: int, width: int) -> tuple[bool, DataFrame]:
    """(are these all of the units?, those whose ids are sent to all tasks). Where the `head` most frequent have more than head_bytes of ids, of these the short ones alone, each of its share of the bytes at most."""
    size = F.size("ids") * width
    n, total = units.agg(F.count("*"), F.sum(size)).first()
    if n <= head and (total or 0) <= head_bytes:
        return True, units
    top = kept(units.orderBy(F.desc("n"), "unit").limit(head)) if n > head else units
    if n > head and (top.agg(F.sum(size)).first()[0] or 0) <= head_bytes:
        return False, top
    return False, kept(top.where(size <= head_bytes // max(1, min(n, head))))


def encode(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, head: int = HEAD, verify: bool = False, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """df (or its columns `keep`) with ids: the best cut of each whole text, in order, without special tokens.

    Of equally good cuts that with the longest last piece counts. Characters
    without a piece become the pieces of their UTF-8 bytes. A null or empty
    text has no ids. All rows stay, repeated ones too; a column ids is
    replaced. With verify there is a column round_trip too: do the ids, decoded,
    give the text back? The vocabulary file must be at model_path on every
    machine.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "round_trip")[: 1 + verify]]
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    kinds = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for c, k in names.items())
    table = load(model_path)
    rows = df.select(*[F.col(c).alias(k) for c, k in names.items()], F.col(text).alias("text"))
    seen = rows.select("text").mapInArrow(_distinct(model_path), "unit string, before int, n long").groupBy("unit", "before").agg(F.sum("n").alias("n"))
    units = unit_ids(seen, table)
    kind = ID if len(table.names) <= 1 << 16 else WIDE
    whole, frequent = _frequent(units, head, head_bytes, kind.itemsize)
    sent = df.sparkSession.sparkContext.broadcast(_head(frequent, kind))
    results = [*[F.col(k).alias(c) for c, k in names.items()], "ids", *["round_trip"] * verify]
    if whole:
        return rows.mapInArrow(_encoded(model_path, sent, len(keep), verify), f"{kinds}ids array<int>, holes array<string>" + ", round_trip boolean" * verify).select(*results)
    n = len(keep)
    rows = rows.select(*names.values(), F.sha2(F.coalesce("text", F.lit("")), 256).alias(f"k{n}"), "text")
    kinds += f"k{n} string, "
    out = kept(rows.mapInArrow(_encoded(model_path, sent, n + 1, False), f"{kinds}ids array<int>, holes array<string>").withColumn("row", F.monotonically_increasing_id()))
    holes = out.where(F.size("holes") > 0).select("row", F.posexplode("holes").alias("i", "unit"))
    rest = units.join(frequent.select("unit"), "unit", "left_anti").select("unit", F.col("ids").alias("own"))
    fill = holes.join(rest, "unit").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "own"))), lambda x: x["own"]).alias("fill"))
    out = out.drop("holes").join(fill, "row", "left").drop("row").mapInArrow(_filled(n + 1), f"{kinds}ids array<int>")
    if verify:
        out = decode(out, model_path).withColumn("round_trip", F.sha2("decoded", 256) == F.col(f"k{n}"))
    return out.select(*results)


def _decoded(path: str, ids: str, n_keep: int):
    def run(batches):
        parts = _Parts(load(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(ids)
                texts = parts.texts(column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_keep)), pa.array(texts, pa.string())], [*(f"k{i}" for i in range(n_keep)), "decoded"])

    return run


def decode(df: DataFrame, model_path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with decoded: the text of the ids, without the blank that encoding puts first.

    No ids, or null, give an empty text; bytes that are no UTF-8 become U+FFFD.
    A column decoded is replaced. Decoding an encoded text gives it back unless
    it holds U+2581, which stands for a blank.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    columns = [F.col(c).alias(k) for c, k in names.items()] + [F.coalesce(ids, F.array().cast("array<int>")).alias("ids")]
    schema = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for c, k in names.items()) + "decoded string"
    out = df.select(*columns).mapInArrow(_decoded(model_path, "ids", len(keep)), schema)
    return out.select(*[F.col(k).alias(c) for c, k in names.items()], "decoded")
