"""MinHash near-dedup: an inverted join over signature coordinates.

1. Documents with the same set of shingles are one class; its least doc_id
   stands for it. Only classes are compared, and of these only such as have
   enough of their first SCREEN values in common with others.
2. A signature has COORDINATES minimum hashes; each (coordinate, value) that
   two classes have in common is a posting list. Linked classes collide in
   enough lists: matches() takes as many as a pair of just the asked similarity
   misses with a chance of MISS at most (86 for 85 percent, 77 for 80), and
   SCREEN_MISS for the screen (14 and 11); a more similar pair misses less.
3. Prefix: lists are ordered from short to long, and a class is posted only in
   its first COORDINATES - matches + 1; a pair with enough collisions meets in
   one of them. Long lists (a line that very many documents have) are skipped
   so.
4. Each list is merged with its most central class, its head: collisions of
   head and member are counted over the whole signatures, pairs above the match
   threshold confirmed on full shingle sets. What that links is one component.
5. A list whose members are all in one component is skipped. Members of the
   others are dealt out in blocks of BLOCK shingles; a task counts the
   collisions of the pairs of two blocks, confirms those above the threshold on
   the sets that came along, and gives one link for any two components. So a
   long list is spread over many tasks, and pairs are never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import among, kept, lists, longs, looked_up, mixed, numbered, others, slices, spaced

SHINGLE, COORDINATES, SCREEN = 5, 128, 32
#: Shingles of a block of documents that are compared with those of another block at once.
BLOCK = 1 << 18
#: What a document counts in a block besides its shingles, so that a block of short ones has a bound too: BLOCK / OWN documents.
OWN = 32
#: Greatest chance that a pair of just the asked similarity has too few lists, or values of the screen, in common.
MISS, SCREEN_MISS = 2e-7, 2e-8
_random = np.random.default_rng(7)
MASKS, FACTORS = _random.integers(0, 1 << 63, COORDINATES, np.uint64) << np.uint64(1), _random.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def matches(percent: int, coordinates: int, miss: float) -> int:
    """The most coordinates m such that a pair of similarity percent has fewer than m in common with a chance of miss at most."""
    p, below, m = percent / 100, 0.0, 0
    while m < coordinates and (below := below + math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)) <= miss:
        m += 1
    if not m or not 0 < percent <= 100:
        raise ValueError(f"{coordinates} coordinates can't tell a similarity of {percent} percent")
    return m


def shingles(column, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, in order, and how many each has."""
    words = spaced(column, lower=True)
    h, at = words.windows(k)
    doc, rows = words.doc[at], len(words.count)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    h, doc = np.concatenate([h, words.whole()[short]]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=rows)


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """COORDINATES minimum hashes of each text that has a shingle: a row each."""
    first = np.concatenate([[0], np.cumsum(counts[counts > 0])[:-1]])
    out = np.zeros((int((counts > 0).sum()), COORDINATES), np.int32)
    for j in range(COORDINATES if len(h) else 0):
        out[:, j] = (mixed(np.minimum.reduceat((h ^ MASKS[j]) * FACTORS[j], first)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _facts(batches):
    for part in slices(batches):
        h, counts = shingles(part.column("text"))
        upto = np.concatenate([[0], np.cumsum(counts)])
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (h, mixed(h ^ MASKS[0]))]
        a, b = (s[upto[1:]] - s[upto[:-1]] for s in sums)
        sig = signatures(h, counts)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), longs(counts), longs(a), longs(b), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, COORDINATES, 0))]).astype(np.int32)), pa.array(sig.ravel()))], ["doc_id", "n_shingles", "set_a", "set_b", "sig"])


def _sets(batches):
    for part in slices(batches):
        h, counts = shingles(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(h, counts)], ["id", "items"])


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items) of the documents `ids`."""
    return kept(among(docs, ids, "doc_id").mapInArrow(_sets, "id long, items array<long>"))


def alike(common, n, m, percent: int):
    """100 * intersection >= percent * union, of sets of n and m elements."""
    return 100 * common >= percent * (n + m - common)


def _posts(classes: DataFrame, values: str) -> DataFrame:
    """id and v, the key of each (coordinate, value) list that it is posted in."""
    return classes.select("id", F.posexplode(values).alias("j", "x")).select("id", (F.shiftleft(F.col("j").cast("long"), 32) + F.col("x").bitwiseAND(F.lit(0xFFFFFFFF))).alias("v"))


def _shared(posts: DataFrame) -> DataFrame:
    return posts.groupBy("v").agg(F.count("*").alias("len")).where("len > 1")


def _able(heads: DataFrame, percent: int) -> DataFrame:
    """The classes with enough values of their screen in common with others: id."""
    posts = _posts(heads, "screen")
    hits = posts.join(_shared(posts), "v", "left_semi").groupBy("id").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= matches(percent, SCREEN, SCREEN_MISS)).select("id")


def _prefixes(able: DataFrame, percent: int) -> DataFrame:
    """Classes that can have a partner: id, centre (how common its values are) and prefix, array of list keys, short lists first."""
    least, posts = matches(percent, COORDINATES, MISS), _posts(able, "sig")
    own = posts.join(_shared(posts), "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("len", "v"))).alias("lists"))
    room = F.size("lists") - least + 1  # lists of one class come before these and give no candidates
    return own.where(F.size("lists") >= least).select("id", F.aggregate("lists", F.lit(0.0), lambda s, x: s + F.log1p(x["len"])).alias("centre"), F.transform(F.slice("lists", 1, room), lambda x: x["v"]).alias("prefix"))


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets x has in common with each of y."""
    sizes = np.array([len(s) for s in (*x, *y)])
    _, which, n = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    row, out = np.repeat(np.arange(len(sizes)), sizes), np.zeros((len(x), len(y)), np.int64)
    place = np.cumsum(n > 1) - 1  # what one set alone has is in common with none
    use = n[which] > 1
    row, which = row[use], place[which[use]]
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    for lo in range(0, int(which[-1]) + 1 if len(which) else 0, 2048):
        a, b = np.searchsorted(which, (lo, lo + 2048))
        table = np.zeros((len(sizes), 2048), np.float32)
        table[row[a:b], which[a:b] - lo] = 1
        out += (table[: len(x)] @ table[len(x) :].T).astype(np.int64)
    return out


def _linked(percent: int):
    """One confirmed link (a, b) for any two components that members of two blocks link."""
    least = matches(percent, COORDINATES, MISS)

    def run(batches):
        for batch in batches:
            members = batch.column("members")
            upto, flat = members.offsets.to_numpy(), members.values
            ids, own, side = (flat.field(c).to_numpy() for c in ("id", "component", "block"))
            sig = flat.field("sig").values.to_numpy().reshape(-1, COORDINATES)
            items = flat.field("items")
            ends, values = items.offsets.to_numpy(), items.values.to_numpy()
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            for g in range(batch.num_rows):
                at = np.arange(upto[g], upto[g + 1])
                x, y = at[side[at] == i[g]], at[side[at] == j[g]]
                found = [np.zeros((2, 0), np.int64)]
                for lo in range(0, len(x) if len(y) else 0, 64):
                    hits = (sig[x[lo : lo + 64], None, :] == sig[None, y, :]).sum(2)
                    found.append(np.stack(np.nonzero((hits >= least) & (own[x[lo : lo + 64], None] != own[None, y]))) + [[lo], [0]])
                p, q = np.concatenate(found, 1)
                if not len(p):
                    continue
                (x, p), (y, q) = ((z[u], w) for z, (u, w) in ((x, np.unique(p, return_inverse=True)), (y, np.unique(q, return_inverse=True))))
                n, m = (ends[z + 1] - ends[z] for z in (x, y))
                common = _common(*([values[ends[k] : ends[k + 1]] for k in z] for z in (x, y)))[p, q]
                yes = alike(common, n[p], m[q], percent)
                a, b = x[p[yes]], y[q[yes]]
                pairs = np.sort(np.stack([own[a], own[b]], 1), 1)
                one = np.unique(pairs, axis=0, return_index=True)[1] if len(pairs) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[one]]), pa.array(ids[b[one]])], ["a", "b"])

    return run


def _rest(docs: DataFrame, classes: DataFrame, star: DataFrame, group: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between components of members of one star (a: its head, b: a member)."""
    own = star.join(group.withColumnsRenamed({"node": "b"}), "b", "left").withColumn("component", F.coalesce("component", "b"))
    many = own.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("a")
    own = kept(looked_up(own, many, ["a"], "b", "inner"))
    sets = shingle_sets(docs, own.select(F.col("b").alias("doc_id")).distinct())
    facts = sets.join(classes.select("id", "n", "sig"), "id").withColumnsRenamed({"id": "b"})
    sizes = own.join(facts.select("b", "n"), "b").groupBy("a").agg(F.ceil(F.sum(F.col("n") + OWN) / block).cast("int").alias("blocks"))
    dealt = looked_up(own, sizes, ["a"], "b", "inner").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    pair = F.struct(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("a", "b", "component", "block", pair.alias("p")).select("a", "p.*", "b", "component", "block")
    member = F.struct(F.col("b").alias("id"), "component", "block", "sig", "items")
    groups = dealt.join(facts, "b").groupBy("a", "i", "j").agg(F.collect_list(member).alias("members"))
    return groups.select("i", "j", "members").mapInArrow(_linked(percent), "a long, b long")


def links(docs: DataFrame, heads: DataFrame, facts: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Confirmed edges (a, b) between ids that give the components of all links. heads: id and screen of each class; facts: of all documents."""
    classes = kept(among(facts.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig"), _able(heads, percent), "id"))
    own = kept(_prefixes(classes, percent))
    posts = own.select("id", "centre", F.explode("prefix").alias("v"))
    heads = posts.groupBy("v").agg(F.max(F.struct("centre", "id")).alias("head"), F.count("*").alias("len")).where("len > 1").select("v", F.col("head.id").alias("a"))
    star = kept(posts.join(heads, "v").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct())
    sig = classes.select("id", "sig")
    both = looked_up(star.join(sig.toDF("b", "y"), "b"), sig.toDF("a", "x"), ["a"], "b", "inner", star)
    hits = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = kept(both.where(hits >= matches(percent, COORDINATES, MISS)).select("a", "b"))
    sets = shingle_sets(docs, near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    both = looked_up(near.join(sets.toDF("b", "y"), "b"), sets.toDF("a", "x"), ["a"], "b", "inner", near).withColumn("common", F.size(F.array_intersect("x", "y")))
    linked = kept(both.where(alike(F.col("common"), F.size("x"), F.size("y"), percent)).select("a", "b"))
    return linked.union(_rest(docs, classes, star, components(linked), percent, block))


def near_duplicates(df: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (is it that one?).

    Words are lower-cased (A-Z) runs of non-white-space; a text with fewer
    words than a shingle is one shingle; a text that is null, empty or blank
    has none, is linked with nothing and kept. percent is 43 or more: lower ones
    the signatures can't tell (ValueError). A link of just that similarity is
    missed with a chance of MISS + SCREEN_MISS at most; sets are compared by
    64-bit hashes. Of rows with one doc_id the one with the least text comes
    first, rows without one come after all others (a component of such rows
    alone has no component_id); one row a component is kept. Other columns are
    ignored.
    """
    rows, own = numbered(df.select("doc_id", "text"))
    found = classified(rows.select(F.col("_row").alias("doc_id"), "text"), percent, block)
    kept_ = (F.col("row") == F.col("component")).alias("kept")
    if own:
        return found.select(F.col("row").cast(df.schema["doc_id"].dataType).alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept_)
    names = rows.select(F.col("_row").alias("row"), "doc_id")
    found = found.join(names, "row").select("row", "doc_id", "n_shingles", "component")
    return looked_up(found, names.toDF("component", "component_id"), ["component"], "row").select("doc_id", "n_shingles", "component_id", kept_)


def without_near_duplicates(df: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """The rows of df that near_duplicates() keeps, whole, in all columns."""
    name = "_row" + "_" * max(map(len, df.columns))
    rows, _ = numbered(df, name=name)
    found = classified(rows.select(F.col(name).alias("doc_id"), "text"), percent, block)
    return others(rows, found.where("row <> component").select(F.col("row").alias(name)), name).select(*df.columns)


def classified(docs: DataFrame, percent: int, block: int) -> DataFrame:
    """row, n_shingles and component (the least row reachable by links) of docs (doc_id, text), whose ids are different whole numbers."""
    facts = kept(docs.mapInArrow(_facts, "doc_id long, n_shingles long, set_a long, set_b long, sig array<int>"))
    same = ["n_shingles", "set_a", "set_b"]
    copies = facts.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    member = looked_up(facts.drop("sig"), copies, same, "doc_id").withColumn("id", F.coalesce("id", "doc_id"))
    member = kept(member.select("doc_id", "id", "n_shingles"))
    screens = facts.where("n_shingles > 0").select(F.col("doc_id").alias("id"), F.slice("sig", 1, SCREEN).alias("screen"))
    heads = kept(others(screens, member.where("doc_id <> id").select(F.col("doc_id").alias("id")), "id"))
    group = kept(components(links(docs, heads, facts, percent, block)))
    named = looked_up(member, group.withColumnsRenamed({"node": "id"}), ["id"], "doc_id")
    return named.select(F.col("doc_id").alias("row"), "n_shingles", F.coalesce("component", "id").alias("component"))
