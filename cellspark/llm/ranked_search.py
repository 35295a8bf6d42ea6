"""Ranked lexical search by the best position algorithm.

Two passes over the documents. The first counts, in Spark, what the weights
need: documents, terms, and the documents that hold each term of the queries.
In the second each task cuts its documents into blocks of bounded size and
builds, for each term of the queries, an impact list: the block's documents
that hold it, greatest impact first. A query reads its lists down in step. Each
document that comes up is scored at once by direct access to all lists, and its
positions there are marked as seen. A list's best position is the end of its
unbroken run of seen positions; what stands right after it bounds what an
unseen document can have from that list. That bound is tighter than the one
from the position read last. A query stops as soon as the sum of its bounds is
strictly below its kth score so far, which goes on from block to block. Each
task gives at most k rows a query, and Spark ranks these.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import tokens
from .shared import kept, longs, numbered, slices

#: Bytes of query texts that are sent to the tasks at once; more take a further pass over the documents.
QUERY_BYTES = 16 << 20
#: A block: as many postings or documents.
POSTINGS, DOCS = 1 << 21, 1 << 16
#: Positions of each list that are read at first, doubled each time up to the second number.
READ = (32, 2048)


class Queries(NamedTuple):
    """`ids`: a long for each query; `vocabulary`: hashes of all their terms, sorted; `terms`: of each query, (terms of the vocabulary, how often each)."""

    ids: np.ndarray
    vocabulary: np.ndarray
    terms: list[tuple[np.ndarray, np.ndarray]]


def queries(ids: list[int], texts: list[str]) -> Queries:
    words = tokens(pa.array(texts, pa.string()))
    vocabulary, which = np.unique(words.hash, return_inverse=True)
    terms = []
    for i in range(len(ids)):
        own = Counter(which[words.first[i] : words.first[i + 1]].tolist())
        terms.append((np.array(list(own), np.int64), np.array(list(own.values()), np.int64)))
    return Queries(np.array(ids, np.int64), vocabulary, terms)


def postings(column, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term of the vocabulary, how often), by document and term, and the terms of each document."""
    words = tokens(column)
    at = np.searchsorted(vocabulary, words.hash)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == words.hash if len(vocabulary) else np.zeros(len(at), bool)
    key, tf = np.unique(words.doc[hit] * max(1, len(vocabulary)) + at[hit], return_counts=True)
    return *np.divmod(key, max(1, len(vocabulary))), tf, words.count


def _counted(sent):
    """(term, docs, terms) of a task's documents: how many hold each term; at -1, how many hold any, and all their terms."""

    def run(batches):
        vocabulary = sent.value.vocabulary
        df, docs, terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for part in slices(batches):
            _, term, _, count = postings(part.column("text"), vocabulary)
            df += np.bincount(term, minlength=len(vocabulary))
            docs, terms = docs + int((count > 0).sum()), terms + int(count.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([longs(np.append(at, -1)), longs(np.append(df[at], docs)), longs(np.append(np.zeros_like(at), terms))], ["term", "docs", "terms"])

    return run


class Block:
    """Impact lists of some documents: `row` and `n`, number of terms, of each; postings by document and term."""

    def __init__(self, row: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, vocabulary: int, docs: int, terms: int):
        m = 100 - 75 + (75 * n * docs) // max(terms, 1)
        self.row, self.term = row, term
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(row)))])
        order = np.lexsort((row[doc], -self.impact, term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_first = np.searchsorted(term[order], np.arange(vocabulary + 1))
        self.place = np.empty(len(doc), np.int64)
        self.place[order] = np.arange(len(doc))

    def best(self, terms: np.ndarray, factor: np.ndarray, k: int, top: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(score, row) of the k best of `top` and of this block's documents, greatest score first, then least row. factor: what an impact in each term's list counts."""
        score, row = top
        use = (factor > 0) & (self.list_first[terms + 1] > self.list_first[terms])
        terms, factor = terms[use], factor[use]
        lo, hi = self.list_first[terms], self.list_first[terms + 1]
        weight = np.zeros(len(self.list_first), np.int64)  # of each term in this query
        weight[terms] = factor
        seen, known = np.zeros(len(self.list_doc), bool), np.zeros(len(self.row), bool)
        best, read, step = lo.copy(), lo.copy(), READ[0]
        while True:
            open_ = best < hi
            bound = int((factor[open_] * self.list_impact[best[open_]]).sum())
            if bound == 0 or len(score) == k and bound < score[-1]:
                return score, row
            upto = np.minimum(np.maximum(read, best) + step, hi)
            docs = np.unique(np.concatenate([self.list_doc[a:b] for a, b in zip(np.maximum(read, best), upto, strict=True)]))
            read, step = upto, min(2 * step, READ[1])
            docs = docs[~known[docs]]
            if len(docs):
                known[docs] = True
                n = self.first[docs + 1] - self.first[docs]
                ends = np.cumsum(n)
                at = np.arange(ends[-1]) + np.repeat(self.first[docs] - ends + n, n)  # all postings of these documents
                w = weight[self.term[at]]
                seen[self.place[at[w > 0]]] = True
                sums = np.add.reduceat(w * self.impact[at], ends - n)
                good = sums >= (score[-1] if len(score) == k else 1)
                score, row = np.concatenate([score, sums[good]]), np.concatenate([row, self.row[docs[good]]])
                order = np.lexsort((row, -score))[:k]
                score, row = score[order], row[order]
            for j in np.flatnonzero(open_):
                rest = seen[best[j] : hi[j]]
                unseen = int(rest.argmin())
                best[j] = hi[j] if rest[unseen] else best[j] + unseen


def _searched(sent, weights, docs: int, terms: int, k: int):
    def run(batches):
        asked, w = sent.value, weights.value
        factors = [w[t] * n for t, n in asked.terms]
        tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked.ids)
        held, n_docs, n_postings = [], 0, 0

        def close():
            if n_postings:
                base = np.cumsum([0, *(len(x[0]) for x in held)])
                row, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                doc = np.concatenate([x[2] + b for x, b in zip(held, base, strict=False)])
                block = Block(row, n, doc, *(np.concatenate([x[i] for x in held]) for i in (3, 4)), len(w), docs, terms)
                for i, (t, _) in enumerate(asked.terms):
                    tops[i] = block.best(t, factors[i], k, tops[i])

        for part in slices(batches):
            doc, term, tf, count = postings(part.column("text"), asked.vocabulary)
            held.append((np.asarray(part.column("row")), count, doc, term, tf))
            n_docs, n_postings = n_docs + part.num_rows, n_postings + len(doc)
            if n_docs >= DOCS or n_postings >= POSTINGS:
                close()
                held, n_docs, n_postings = [], 0, 0
        close()
        ids = np.repeat(asked.ids, [len(s) for s, _ in tops])
        yield pa.RecordBatch.from_arrays([longs(ids), *(longs(np.concatenate([np.zeros(0, np.int64), *(t[i] for t in tops)])) for i in (0, 1))], ["item", "score", "row"])

    return run


def search(df: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 (all, if fewer) for each item, ranked from 1; equal scores by ascending doc_id.

    Terms are runs of ASCII digits and letters (A-Z lower-cased) and characters
    beyond ASCII, told apart by 64-bit hashes. A document of n terms that holds
    a term tf times adds w * ((1000000000 * tf) div (1000 * tf + 8 * m)) for
    each time the item has the term, where m = 25 + (75 * n * N) div L and
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); N documents have a term, L
    terms in all, df documents this one.

    A null or empty text, or one without a term, has no rows and isn't counted
    in N. Repeated documents are ranked each by itself, repeated items answered
    each by itself; of equal scores documents without an id come last, and of
    one id the least text comes first. With no items or no documents there are
    no rows. Other columns are ignored. Items of up to query_bytes of text are
    sent to the tasks at once; more are dealt into as many groups by hash, one
    after the other, each with its two passes over all documents.
    """
    spark = df.sparkSession
    docs, plain_docs = numbered(df.select("doc_id", "text"), name="row")
    asked, plain_items = numbered(items.select("item_id", "text"), "item_id", name="item")
    given = docs.where("text IS NOT NULL").select("row", "text")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-2 * size // query_bytes)) if size > query_bytes else 1
    found = None
    for g in range(groups):
        rows = asked.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item"), F.lit(groups)) == g)).select("item", "text").toArrow()
        own = queries(rows["item"].to_pylist(), rows["text"].to_pylist())
        sent = spark.sparkContext.broadcast(own)
        counts = given.mapInArrow(_counted(sent), "term long, docs long, terms long").groupBy("term").agg(F.sum("docs"), F.sum("terms")).collect()
        total = {r[0]: r[1:] for r in counts}
        n, length = total.pop(-1, (0, 0))
        held = np.zeros(len(own.vocabulary), np.int64)
        held[list(total)] = [x[0] for x in total.values()]
        weights = np.floor(1000 * np.log((2 * n + 2) / (2 * held + 1))).astype(np.int64)
        tops = given.mapInArrow(_searched(sent, spark.sparkContext.broadcast(weights), n, length, k), "item long, score long, row long")
        if groups > 1:
            tops = kept(tops)
        found = tops if found is None else found.union(tops)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("doc_id", F.col("row").cast(df.schema["doc_id"].dataType)) if plain_docs else ranked.join(docs.select("row", "doc_id"), "row")
    ranked = ranked.withColumn("item_id", F.col("item").cast(items.schema["item_id"].dataType)) if plain_items else ranked.join(asked.select("item", "item_id"), "item")
    return ranked.select("item_id", "rank", "doc_id", "score")
