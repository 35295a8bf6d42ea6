"""Periodic runs of words, by recompression.

The words of a chunk of texts become a run-length grammar: levels that in turn
put one symbol for each block of equal symbols and one for each pair of
different ones, a left and a right symbol by a bit of their names. What two
places have in common compresses alike except at its ends, so how far two
places agree (their longest common extension) is found by going up the levels
while both are at the begin of equal symbols, and down again where they differ:
a few steps a level, for all places asked at once, without a suffix array.

A run of period q and at least 4q words has, for one multiple i of 3q at least,
the same word at i and i + q. These places, some n log n of them, are the
candidates; extensions to both sides give the exact run around each.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASE, STEP, longs, mixed, slices, spaced

#: A run: LEAST words at least, and TIMES its period.
LEAST, TIMES = 6, 4
#: Candidates that a task handles at once.
PLACES = 1 << 20
#: Levels after which the few symbols still left are compared one by one.
MOST_LEVELS = 64


class Level(NamedTuple):
    """Symbols of one level. `parent`: the symbol of the next level that holds each; `first`: whether it begins there; `rest`: symbols from each to the end of its block (1 for pairs); `child`: the first symbol of the level below that each holds."""

    symbol: np.ndarray
    parent: np.ndarray | None
    first: np.ndarray | None
    rest: np.ndarray | None
    child: np.ndarray | None


def _blocks(s: np.ndarray, tag: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of equal symbols start, and their names."""
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(starts, append=len(s)).astype(np.uint64)
    return starts, np.where(n > 1, mixed(s[starts] * BASE + n * STEP + tag), s[starts])


def _pairs(s: np.ndarray, tag: np.uint64, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the symbols start once each left symbol before a right one is one with it, and their names; those in `apart` stay alone."""
    right = mixed(s ^ tag) >> np.uint64(63) == 1
    heads = np.flatnonzero(~right[:-1] & right[1:] & ~apart[:-1] & ~apart[1:])
    starts = np.ones(len(s), bool)
    starts[heads + 1] = False
    names = s.copy()
    names[heads] = mixed(s[heads] * BASE + s[heads + 1] * STEP + tag)
    return np.flatnonzero(starts), names[starts]


def grammar(s: np.ndarray, ends: np.ndarray) -> list[Level]:
    """Levels of a sequence of symbols; those at `ends` occur once each and stay alone, so that nothing reaches over them."""
    levels, child, turn = [], None, 0
    apart = np.zeros(len(s), bool)
    apart[ends] = True
    while len(s) > 2 * len(ends) and turn < MOST_LEVELS:
        tag = mixed(np.array([turn + 1], np.uint64) * STEP)
        starts, names = _pairs(s, tag, apart) if turn % 2 else _blocks(s, tag)
        turn += 1
        if len(starts) == len(s):
            continue
        first = np.zeros(len(s), bool)
        first[starts] = True
        parent = np.cumsum(first) - 1
        rest = np.ones(len(s), np.int64) if turn % 2 == 0 else np.append(starts[1:], len(s))[parent] - np.arange(len(s))
        levels.append(Level(s, parent, first, rest, child))
        s, apart, child = names, apart[starts], starts
    return [*levels, Level(s, None, None, None, child)]


def mirrored(levels: list[Level]) -> list[Level]:
    """The levels of the reversed sequence."""
    out = []
    for k, level in enumerate(levels):
        child = None if level.child is None else len(levels[k - 1].symbol) - np.append(level.child[1:], len(levels[k - 1].symbol))[::-1]
        if level.parent is None:
            out.append(Level(level.symbol[::-1], None, None, None, child))
            continue
        m = len(level.symbol)
        last = np.append(level.first[1:], True)
        blocks = (level.rest > 1).any()
        rest = np.arange(m) - levels[k + 1].child[level.parent] + 1 if blocks else level.rest
        out.append(Level(level.symbol[::-1], len(levels[k + 1].symbol) - 1 - level.parent[::-1], last[::-1], rest[::-1], child))
    return out


def extension(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols of the sequence agree from x and from y on, for each pair of different places."""
    x, begin, y = x.copy(), x, y.copy()
    alive, parted = np.arange(len(x)), []

    def split(level: Level, who: np.ndarray) -> np.ndarray:
        same = level.symbol[x[who]] == level.symbol[y[who]]
        gone.append(who[~same])
        return who[same]

    for level in levels:
        gone: list[np.ndarray] = []
        alive = split(level, alive)
        if level.parent is None:
            while len(alive):
                x[alive] += 1
                y[alive] += 1
                alive = split(level, alive)
        else:
            out = alive[~(level.first[x[alive]] & level.first[y[alive]])]
            step = np.minimum(level.rest[x[out]], level.rest[y[out]])
            x[out] += step
            y[out] += step
            off = np.zeros(len(x), bool)
            off[out] = True
            alive = np.concatenate([alive[~off[alive]], split(level, out)])
            x[alive], y[alive] = level.parent[x[alive]], level.parent[y[alive]]
        parted.append(np.concatenate(gone))
    down = np.zeros(0, np.int64)
    for k in range(len(levels) - 1, 0, -1):
        down = np.concatenate([down, parted[k]])
        below = levels[k - 1]
        x[down], y[down] = levels[k].child[x[down]], levels[k].child[y[down]]
        on = down[below.symbol[x[down]] == below.symbol[y[down]]]
        step = np.minimum(below.rest[x[on]], below.rest[y[on]])
        x[on] += step
        y[on] += step
    return x - begin


def _candidates(count: np.ndarray):
    """(text, period, place) of the grid of each text of count words, some PLACES at a time; places are words of the text."""
    most = np.where(count >= LEAST, count // TIMES, 0)
    upto = np.concatenate([[0], np.cumsum(most)])
    for lo in range(0, int(upto[-1]), PLACES):
        k = np.arange(lo, min(lo + PLACES, int(upto[-1])))
        text = np.searchsorted(upto, k, "right") - 1
        q = k - upto[text] + 1
        stride = (TIMES - 1) * q
        n = -(-(count[text] - q) // stride)
        ends = np.concatenate([[0], np.cumsum(n)])
        for a in range(0, int(ends[-1]), PLACES):
            j = np.arange(a, min(a + PLACES, int(ends[-1])))
            at = np.searchsorted(ends, j, "right") - 1
            yield text[at], q[at], (j - ends[at]) * stride[at]


def runs(symbols: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), in that order, of all runs in the texts of count[i] symbols each, which stand one after the other."""
    n, d = len(symbols), len(count)
    first = np.concatenate([[0], np.cumsum(count)])
    home = first[:-1] + np.arange(d) + 1  # a mark of its own stands before each text and after the last
    s = np.empty(n + d + 1, np.uint64)
    marks = np.append(home - 1, n + d)
    words = np.ones(len(s), bool)
    words[marks] = False
    s[words] = symbols
    s[marks] = mixed(~np.arange(d + 1, dtype=np.uint64))
    found, forth, back = [np.zeros((0, 4), np.int64)], None, None
    for text, q, at in _candidates(count):
        x = home[text] + at
        hit = s[x] == s[x + q]
        text, q, x = text[hit], q[hit], x[hit]
        if not len(x):
            continue
        if forth is None:
            forth = grammar(s, marks)
            back = mirrored(forth)
        right = extension(forth, x, x + q)
        left = extension(back, len(s) - x, len(s) - x - q)
        length = left + right + q
        long = length >= np.maximum(LEAST, TIMES * q)
        found.append(np.unique(np.stack([text, x - left - home[text], length, q], 1)[long], axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    least = np.ones(len(every), bool)  # of equal stretches, which multiples of the period give too, the least period
    least[1:] = (every[1:, :3] != every[:-1, :3]).any(1)
    every = every[least]
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


def _found(n_keep: int):
    def run(batches):
        for part in slices(batches):
            words = spaced(part.column("text"))
            every = runs(words.hash, words.count)
            edge = np.zeros(len(words.hash) + 1, np.int64)
            begin = words.first[every[:, 0]] + every[:, 1]
            np.add.at(edge, begin + every[:, 3], 1)
            np.add.at(edge, begin + every[:, 2], -1)
            data, ends = words.joined(np.cumsum(edge[:-1]) == 0)
            offsets = np.searchsorted(every[:, 0], np.arange(part.num_rows + 1))
            each = pa.StructArray.from_arrays([longs(every[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
            rows = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), each)
            text = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_keep)), longs(words.count), rows, text], [*(f"k{i}" for i in range(n_keep)), "n_words", "runs", "collapsed"])

    return run


def find_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    r"""df (or its columns `keep`) with n_words, runs and collapsed of each whole text.

    Words are runs of characters other than blank and \x09 to \x0D. runs is
    array<struct<start, length, period>> by start, then by period: each stretch
    of at least LEAST words and TIMES its smallest period that can't be made
    longer with that period. collapsed is the text without the words that a run
    holds after its first period, one blank between words. A null text counts
    as empty: no words, no runs, an empty collapsed text. All rows stay, repeated ones
    too; columns of these names are replaced. Work and memory of a text grow as
    n log n. Words and symbols are told apart by 64-bit hashes: in a text of n
    words some n^2 / 2^62 pairs of symbols would be taken for equal.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("n_words", "runs", "collapsed")]
    schema = ", ".join([*(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"])
    given = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    return given.mapInArrow(_found(len(keep)), schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "runs", "collapsed")
