"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search answers queries.

Equal vectors are one point of the graph. The graph starts from small blocks
of points that lie near each other along random directions: a rough guess. In
each round of NN-descent every point meets the neighbours of its neighbours: a
point sends its vector to its neighbours and to those whose neighbour it is; at
each meeting place all pairs are compared and better neighbours sent back. One
round is two joins and two groupings, of a bounded number of rows a point:
reverse neighbours beyond LINKS are left to later rounds (all forward ones
count), which is the sampling of NN-descent. Rounds go on until at most one
link in SETTLED is new.

A query walks the graph in rounds of joins: the best BEAM points known are
opened, their neighbours measured, until no unopened point is among them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, looked_up

LINKS, TREES, BLOCK, SETTLED, BEAM, ENTRIES = 32, 4, 256, 50, 160, 16
#: Members that meet at one point at once; those of a hub, which more points have among their nearest, meet in parts, others each round.
MEETING = 512


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of rows that take part: vectors not null, finite and not zero."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))


def usual_length(rows: DataFrame) -> int:
    """The length that most vectors have (the greatest, of equally frequent ones); 0 without rows."""
    row = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 0


def _matrix(column) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.reshape(len(column), -1)


def _nearest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances of the k nearest rows of y to each of x, in some order."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    k = min(k, len(y))
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return at, np.maximum(np.take_along_axis(d, at, 1), 0)


def _blocks(links: int, block: int):
    """Neighbours within blocks of rows that follow each other."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solve(table):
            ids, x = table.column("id").combine_chunks().to_numpy(), _matrix(table.column("v").combine_chunks())
            at, d = _nearest(x, x, links + 1)
            own = np.repeat(np.arange(len(ids)), at.shape[1])
            a, b, d = ids[own], ids[at.ravel()], d.ravel()
            use = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[use]), pa.array(b[use]), pa.array(d[use].astype(np.float32))], ["id", "other", "d"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * block:
                table = pa.Table.from_batches(held)
                yield solve(table.slice(0, block))
                held = table.slice(block).to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows > 1:
            half = table.num_rows // 2 if table.num_rows > block else table.num_rows
            yield solve(table.slice(0, half))
            if half < table.num_rows:
                yield solve(table.slice(half))

    return run


def _top(pairs: DataFrame, links: int) -> DataFrame:
    """(id, near) with the `links` nearest others of each id: array<struct<d, other>>."""
    best = pairs.groupBy("id", "other").agg(F.min("d").alias("d"))
    return best.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, links).alias("near"))


def _meet(links: int):
    """At each meeting place: for each member the nearest other members."""

    def run(batches):
        for batch in batches:
            members = batch.column("members")
            offsets, flat = members.offsets.to_numpy(), members.values
            ids, far = flat.field("id").to_numpy(), flat.field("far").to_numpy()
            x = _matrix(flat.field("v"))
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                if b - a < 2:
                    continue
                at, d = _nearest(x[a:b], x[a:b], links)
                row = np.repeat(np.arange(b - a), at.shape[1])
                at, d = at.ravel(), d.ravel()
                use = (d < far[a:b][row]) & (ids[a:b][row] != ids[a:b][at])
                out.append((ids[a:b][row[use]], ids[a:b][at[use]], d[use]))
            if out:
                a, b, d = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.float32))], ["id", "other", "d"])

    return run


def build_graph(points: DataFrame, links: int = LINKS, trees: int = TREES, block: int = BLOCK, settled: int = SETTLED) -> DataFrame:
    """(id, near): about the `links` nearest points of each of the points (id, v)."""
    n = points.count()
    if n < 2:
        return points.sparkSession.createDataFrame([], "id long, near array<struct<d:float,other:long>>")
    size = points.select(F.max(F.size("v"))).first()[0] or 0
    given, pairs = "id long, other long, d float", None
    parts = max(1, math.ceil(n / (4 * block)))
    for tree in range(trees):
        way = np.random.default_rng(tree).normal(size=size).tolist()
        along = F.aggregate(F.zip_with("v", F.split(F.lit(",".join(map(repr, way))), ",").cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        near = points.withColumn("p", along).repartitionByRange(parts, "p").sortWithinPartitions("p").select("id", "v").mapInArrow(_blocks(links, block), given)
        pairs = near if pairs is None else pairs.union(near)
    graph = kept(_top(pairs, links))
    links_, new = n * min(links, n - 1), n * links
    round_ = 0
    while new * settled > links_:  # a new link is a nearer one, so this ends
        round_ += 1
        forward = graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"))
        order = Window.partitionBy("id").orderBy(F.xxhash64("id", "other"), "other")
        back = forward.select(F.col("other").alias("id"), F.col("id").alias("other")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= links).drop("r")
        each = forward.union(back).distinct().withColumnRenamed("other", "place")
        hubs = kept(each.groupBy("place").count().where(F.col("count") > MEETING).select("place", F.ceil(F.col("count") / MEETING).cast("int").alias("parts")))
        part = F.pmod(F.xxhash64("id", F.lit(round_)), F.coalesce("parts", F.lit(1))).cast("int")
        each = looked_up(each, hubs, ["place"], "id").select("id", "place", part.alias("part"))
        places = each.groupBy("id").agg(F.collect_list(F.struct("place", "part")).alias("places"))
        far = graph.select("id", F.when(F.size("near") < links, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"]).cast("float").alias("far"))
        sent = points.join(far, "id").join(places, "id").select(F.explode("places").alias("place"), F.struct("id", "far", "v").alias("m"))
        found = sent.groupBy("place.place", "place.part").agg(F.collect_list("m").alias("members")).select("members").mapInArrow(_meet(links), given)
        old = graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"), F.col("e.d").cast("float").alias("d"))
        now = kept(_top(old.union(found), links))
        each = now.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"))
        new = each.join(old.select("id", "other"), ["id", "other"], "left_anti").count()
        graph = now
    return graph


def _squared(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def search(points: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, entries: int = ENTRIES) -> DataFrame:
    """(qid, id, d): up to `beam` points that greedy search finds for each of the queries (qid, v), with squared distances."""
    sent = queries.select("qid", F.col("v").alias("q"))
    first = points.select("id").orderBy(F.xxhash64("id"), "id").limit(entries).agg(F.collect_list("id").alias("ids"))
    start = sent.select("qid").crossJoin(F.broadcast(first)).select("qid", F.explode("ids").alias("id"))  # of a fixed number of points
    start = start.union(graph.join(queries.select("qid", F.col("qid").alias("id")), "id").select("qid", F.explode("near").alias("e")).select("qid", F.col("e.other").alias("id"))).distinct()

    def measured(rows: DataFrame) -> DataFrame:
        return rows.join(points, "id").join(sent, "qid").select("qid", "id", _squared("v", "q").alias("d"), F.lit(False).alias("open"))

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("qid").orderBy("d", "id")
        return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam).drop("r")

    now = kept(best(measured(start)))
    while True:  # each step opens points that were not open
        closed = now.where(~F.col("open"))
        if closed.isEmpty():
            break
        reached = closed.join(graph, "id").select("qid", F.explode("near").alias("e")).select("qid", F.col("e.other").alias("id")).distinct()
        new = measured(reached.join(now, ["qid", "id"], "left_anti"))
        now = kept(best(now.withColumn("open", F.lit(True)).union(new)))
    return now.select("qid", "id", "d")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", **build) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, which is a row of vectors too.

    score is the Euclidean distance in double precision; ties go to the smaller
    id, and no query finds itself. Rows whose key or vector is null, or whose
    vector is zero, holds a null or non-finite component or hasn't the length that
    most have, take no part. Equal vectors are one point of the graph, of
    which the k + 1 smallest ids can be found; rows with one id and one vector
    count once. Other columns are ignored.
    """
    rows = valid(vectors, key, vector)
    length = usual_length(rows)
    rows = rows.where(F.size("v") == length).distinct()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    for by in (["v", "salt"], ["v"]):  # a vector that very many rows have is cut down in parts first
        salted = salted.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    groups = kept(salted.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids"))
    points = groups.select("id", "v")
    graph = build_graph(points, **build)
    asked = valid(queries, key, vector).distinct().join(points.select(F.col("id").alias("qid"), "v"), "v").select(F.col("id").alias("query_id"), "qid", "v")
    asked = kept(asked)
    found = search(points, graph, asked.select("qid", "v").distinct())
    own = asked.select("qid").distinct().select("qid", F.col("qid").alias("id"), F.lit(0.0).alias("d"))
    near = found.where("qid <> id").union(own)
    order = Window.partitionBy("qid").orderBy("d", "id")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).join(groups.select("id", "ids"), "id").select("qid", "d", F.explode("ids").alias("vec_id"))
    each = near.join(asked.select("query_id", "qid"), "qid").where("query_id <> vec_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d").alias("score"))
