"""Token counts: Viterbi that only counts.

An Aho-Corasick automaton finds all pieces in a unit; dynamic programming
carries, for each position, the best score and the number of pieces of the cut
that has it. Ties are decided as the tokenizer does: of equally good cuts the
one whose last piece is longest. A character that no piece of its own covers
costs the least score less 10 and counts as one token for each UTF-8 byte.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import PieceTable, load, strings
from .shared import slices

#: Counts of so many units are remembered in a task.
REMEMBERED = 1 << 20


class CountOnlyViterbi:
    def __init__(self, table: PieceTable):
        import ahocorasick

        self.table = table
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in table.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def count(self, unit: str) -> int:
        n = len(unit)
        ends: list[list] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(unit):
            ends[end].append(found)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        byte_tokens, unknown = bool(self.table.bytes), self.table.unknown_score
        for e, found in enumerate(ends):
            top, own, single = None, 0, False
            for size, score in sorted(found, reverse=True):  # long ones first: they start first
                s = best[e + 1 - size] + score
                single |= size == 1
                if top is None or s > top:
                    top, own = s, count[e + 1 - size] + 1
            if not single and (top is None or best[e] + unknown > top):
                top, own = best[e] + unknown, count[e] + (len(unit[e].encode("utf-8", "surrogatepass")) if byte_tokens else 1)
            best[e + 1], count[e + 1] = top, own
        return count[n]


@lru_cache(2)
def _viterbi(path: str) -> CountOnlyViterbi:
    return CountOnlyViterbi(load(path))


def _counted(path: str, text: str, n_keep: int):
    def run(batches):
        viterbi, known = _viterbi(path), {}
        for part in slices(batches, text):
            points, start, doc, h = viterbi.table.units(part.column(text).to_pylist())
            each, first, which = np.unique(h, return_index=True, return_inverse=True)
            keys = each.tolist()
            if len(known) > REMEMBERED:
                known.clear()
            new = [i for i, k in enumerate(keys) if k not in known]
            for i, unit in zip(new, strings(points, start, first[new]), strict=True):
                known[keys[i]] = viterbi.count(unit)
            counts = np.array([known[k] for k in keys], np.int64)
            totals = np.zeros(part.num_rows, np.int64)
            if len(doc):
                np.add.at(totals, doc, counts[which])
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_keep)), pa.array(totals)], [*(f"k{i}" for i in range(n_keep)), "n_tokens"])

    return run


def count_tokens(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with n_tokens, the tokens of each whole text in the model's unigram cut.

    A null or empty text has 0. All rows stay; a column n_tokens is replaced.
    Placeholder scores of a model (-1e8 and below) are read as its least other
    score less 1 (see pieces.py), and sums are exact doubles. Units that a task
    has counted are known again by a 64-bit hash: of u different units in a
    task some u^2 / 2^65 pairs would be taken for one.
    The vocabulary file must be at model_path on every machine.
    """
    from pyspark.sql import functions as F

    keep = [c for c in (df.columns if keep is None else keep) if c != "n_tokens"]
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    columns = [F.col(c).alias(k) for c, k in names.items()]
    if text not in names:
        columns.append(F.col(text).alias("text"))
    schema = ", ".join([*(f"{k} {df.schema[c].dataType.simpleString()}" for c, k in names.items()), "n_tokens long"])
    found = df.select(*columns).mapInArrow(_counted(model_path, names.get(text, "text"), len(keep)), schema)
    return found.select(*[F.col(k).alias(c) for c, k in names.items()], "n_tokens")
