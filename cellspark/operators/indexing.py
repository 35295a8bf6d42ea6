"""Indexing patterns in any lattice: each stage maps a table of candidates, a row a pattern and candidate.

A candidate row is (pattern_id, candidate_id, q, xnn, m20): the observed peaks,
the coefficients of the reciprocal cell and the figure of merit. Rows are
independent of each other but in spread_dense, so the stages follow each other
in one pass without a shuffle; the numeric work is done a batch of rows at once.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellspark.functions import extinction
from cellspark.functions.cell import FREE
from cellspark.operators import reduction
from cellspark.operators.search import MULTIPLICITY, reference_grid

SYSTEM = {"c": "cubic", "h": "hexagonal", "t": "tetragonal", "o": "orthorhombic", "m": "monoclinic", "a": "triclinic"}
#: Refinement steps and peaks that a random subsample keeps, by lattice system. Fixed values.
STEPS = {"cubic": (5, 2), "tetragonal": (30, 3), "hexagonal": (30, 3), "rhombohedral": (30, 3), "orthorhombic": (50, 6), "monoclinic": (60, 6), "triclinic": (60, 8)}
#: Multiples of the free axes that a cell may be off by. Fixed values.
MULTIPLES = {"cubic": (0.5, 1.0, 2.0), "tetragonal": (1 / 3, 0.5, 1.0, 2.0, 3.0), "hexagonal": (1 / 3, 0.5, 1.0, 2.0, 3.0), "rhombohedral": (0.5, 1.0, 2.0), "orthorhombic": (0.5, 1.0, 2.0), "monoclinic": (0.5, 1.0, 2.0), "triclinic": (0.5, 1.0, 2.0)}
COLUMNS = "pattern_id long, candidate_id int, q array<double>, xnn array<double>, m20 double"


def system_of(lattice: str) -> str:
    return "rhombohedral" if lattice == "hR" else SYSTEM[lattice[0]]


def reference_terms(spark: SparkSession, lattice: str, n: int = 200) -> np.ndarray:
    return references(spark, lattice, n)[1]


def references(spark: SparkSession, lattice: str, n: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(hkl, terms) of the n first reflections of a lattice (fewer, where so many differ): a fixed small table without the sentinel, made once a process."""
    make_references(spark, [lattice], n)
    return _REFERENCES[lattice, n]


_REFERENCES: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}


def make_references(spark: SparkSession, lattices: list[str], n: int = 200) -> None:
    """The references of those lattices that have none yet, in one job."""
    missing = [lattice for lattice in lattices if (lattice, n) not in _REFERENCES]
    if not missing:
        return
    rows: dict[str, list] = {lattice: [] for lattice in missing}
    for r in reference_grid(spark, {lattice: system_of(lattice) for lattice in missing}).collect():
        size = reduce(operator.add, map(operator.mul, r["terms"], weights(system_of(r["lattice"]))))  # as SQL sums; sum() would round otherwise
        rows[r["lattice"]].append((size, r["terms"], tuple(r["m"])))
    for lattice, own in rows.items():
        first = sorted(own)[:n]
        _REFERENCES[lattice, n] = np.array([m for _, _, m in first], int), np.array([terms for _, terms, _ in first], float)


def weights(system: str) -> list[float]:
    """What the terms count in the order of the references."""
    cross = {"monoclinic": 3, "triclinic": 3, "rhombohedral": 1}.get(system, len(FREE[system]))
    return [1.0 if i < cross else 0.1 for i in range(len(FREE[system]))]


def draws(seed: int, step: int, pattern: np.ndarray, candidate: np.ndarray, n: int) -> np.ndarray:
    """n uniform numbers for each row, from its ids alone: the same on any partitioning."""
    with np.errstate(over="ignore"):
        x = pattern.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + candidate.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed * 1_000_003 + step)
        x = x[:, None] * np.uint64(0xD6E8FEB86659FD93) + np.arange(1, n + 1, dtype=np.uint64)[None] * np.uint64(0x165667B19E3779F9)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(float) / (1 << 53)


def nearest(q: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of the reference nearest to each peak, row by row; of equally near ones the smaller value, of equal values the first."""
    d = np.abs(ref[:, None, :] - q[:, :, None])
    at = d.argmin(2)
    least = np.take_along_axis(d, at[:, :, None], 2)
    same = d == least
    if np.count_nonzero(same) > at.size:
        for i, j in zip(*np.nonzero(np.count_nonzero(same, axis=2) > 1), strict=True):
            tied = np.flatnonzero(same[i, j])
            at[i, j] = tied[ref[i, tied].argmin()]
    return at, np.take_along_axis(ref, at, 1)


def merit(q: np.ndarray, calc: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Figure of merit of rows of peaks, calculated peaks and references: 0 without a reference below the last calculated peak, infinite without an error."""
    below = ref < calc[:, -1:]
    return figure(q, calc, np.count_nonzero(below, axis=1), np.where(below, ref, -np.inf).max(1))


def figure(q: np.ndarray, calc: np.ndarray, count: np.ndarray, top: np.ndarray) -> np.ndarray:
    """merit(), where `count` references are below the last calculated peak, the greatest of them `top`."""
    error = reduce(np.add, np.moveaxis(np.abs(calc - q), 1, 0)) / q.shape[1]  # in the order of the peaks, as SQL sums
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count == 0, 0.0, np.where(error > 0, top / (2 * np.maximum(count, 1)) / error, np.inf))


def finite(*arrays: np.ndarray) -> np.ndarray:
    """Rows that are finite in all arrays."""
    return np.logical_and.reduce([np.isfinite(a).all(1) for a in arrays])


def calculated(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """q2 of all references of each cell, summed in the order of the coefficients whatever the batch."""
    x, refs = np.ascontiguousarray(x.T), refs.T[:, :, None]
    return np.ascontiguousarray(summed(refs, x).T)


def total(a: np.ndarray) -> np.ndarray:
    """Sum of the rows of a, one after the other whatever their length."""
    out = a[0].copy()
    for row in a[1:]:
        out += row
    return out


def summed(terms: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of terms (coefficients, references, cells or one) times x (coefficients, cells), in the order of the coefficients."""
    out = terms[0] * x[0]
    for t, c in zip(terms[1:], x[1:], strict=True):
        out += t * c
    return out


def assign(q: np.ndarray, x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest reference of each peak, its q2, figure of merit) of the cells x.

    Each row is judged by itself. A row with a value that isn't finite, among
    its peaks, in its cell or among its references, has merit 0, index 0 and no q2 (NaN).
    """
    n, m = q.shape
    at, calc, out = np.zeros((n, m), int), np.full((n, m), np.nan), np.zeros(n)
    for k, ref in _references_of(q, x, refs):
        order, wide = in_order(ref)
        place, calc[k], out[k] = placed(q[k], wide, len(refs))
        at[k] = of(order, place)
    return at, calc, out


def merits(q: np.ndarray, x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """What assign() says of the figure of merit: takes half the time."""
    out = np.zeros(len(q))
    for k, ref in _references_of(q, x, refs):
        peaks, wide = np.ascontiguousarray(q[k].T), walled(ref)
        place = np.zeros(peaks.shape, int)
        settle(wide, peaks, place, np.arange(peaks.size))
        out[k] = valued(wide, peaks, place)[0]
    return out


def walled(ref: np.ndarray) -> np.ndarray:
    """Rows in ascending order with -inf before them and inf after them."""
    wide = np.empty((len(ref), ref.shape[1] + 2))
    wide[:, 0], wide[:, 1:-1], wide[:, -1] = -np.inf, ref, np.inf
    wide[:, 1:-1].sort(axis=1)
    return wide


def settle(wide: np.ndarray, q: np.ndarray, place: np.ndarray, some: np.ndarray) -> None:
    """Puts into place (peaks, cells), at the positions `some` of it, how many values of the cell's row of wide (see walled) are below the peak, by halving."""
    flat, end, v = wide.ravel(), wide.shape[1] - 1, q.ravel().take(some)
    start, at = some % q.shape[1] * (end + 1), np.zeros(len(some), int)
    step = 1 << (end - 1).bit_length() >> 1
    while step:
        at += step * (flat.take(start + np.minimum(at + step, end)) < v)
        step //= 2
    place.reshape(-1)[some] = at


def valued(wide: np.ndarray, q: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(figure of merit, the value after each peak) of rows of values (see walled) and peaks (peaks, cells) with their places."""
    flat, start = wide.ravel(), np.arange(len(wide)) * wide.shape[1]
    at = start + place
    low, high = flat.take(at), flat.take(at + 1)
    calc = np.where(q - low <= high - q, low, high)
    last = place[-1] - (calc[-1] == low[-1])
    same = np.flatnonzero((flat.take(start + last) == calc[-1]) & (last > 0))
    if len(same):
        last[same] = (wide[same, 1:-1] < calc[-1, same, None]).sum(1)
    error = total(np.abs(calc - q)) / len(q)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(last == 0, 0.0, np.where(error > 0, flat.take(start + last) / (2 * np.maximum(last, 1)) / error, np.inf)), high


def _references_of(q: np.ndarray, x: np.ndarray, refs: np.ndarray):
    """(rows, their references), some rows at once, of those that are finite."""
    fine = np.flatnonzero(finite(q, x))
    for lo in range(0, len(fine), ASSIGNED):
        k = fine[lo : lo + ASSIGNED]
        ref = calculated(x[k], refs)
        whole = finite(ref)
        yield (k, ref) if whole.all() else (k[whole], ref[whole])


def placed(q: np.ndarray, wide: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in order of the nearest of the n references of each peak, its q2, figure of merit); of equally near references the smaller, of equal ones the first."""
    place = below(wide, q)
    low, high = of(wide, place), of(wide, place + 1)
    lower = (place > 0) & (q - low <= high - q)
    calc = np.where(lower, low, high)
    place -= lower
    same = np.flatnonzero((wide[:, 2 : n + 1] == wide[:, 1:n]).any(1))
    if len(same):
        place[same] = below(wide[same], calc[same])
    return place, calc, figure(q, calc, place[:, -1], of(wide, place[:, -1:])[:, 0])


#: Cells whose references are put in order at once.
ASSIGNED = 256


def in_order(ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bordered values in order) of the references of each row; of equal values the first comes first."""
    order = np.argsort(ref, axis=1)
    values = of(ref, order)
    same = np.flatnonzero((values[:, 1:] == values[:, :-1]).any(1))
    order[same] = np.argsort(ref[same], axis=1, kind="stable")
    return order, bordered(values)


def bordered(values: np.ndarray) -> np.ndarray:
    """Rows of ascending values with -inf before them and inf after them, up to a power of two and one."""
    n = values.shape[1]
    wide = np.full((len(values), (1 << n.bit_length()) + 1), np.inf)
    wide[:, 0], wide[:, 1 : n + 1] = -np.inf, values
    return wide


def of(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The elements of each row at its indices."""
    return table.ravel().take(index + (np.arange(len(table)) * table.shape[1])[:, None])


def below(wide: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many references are below each value, by halving (see in_order)."""
    flat, start = wide.ravel(), (np.arange(len(wide)) * wide.shape[1])[:, None]
    at, step = np.broadcast_to(start, v.shape).copy(), (wide.shape[1] - 1) // 2
    while step:
        at += step * (flat.take(at + step) < v)
        step //= 2
    return at - start


def masked_merits(q: np.ndarray, x: np.ndarray, refs: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The merit of each row under each mask of the references: (rows, masks). The references of a row are sorted once, for all masks."""
    out = np.zeros((len(q), len(masks)))
    fine = np.flatnonzero(finite(q, x))
    r, kind = len(refs), np.min_scalar_type(len(refs) + 1)
    left = masks.T.astype(kind)
    for lo in range(0, len(fine), MASKED):
        k = fine[lo : lo + MASKED]
        p, row = q[k], np.arange(len(k))
        order, wide = in_order(calculated(x[k], refs))
        kept = left[order.T]  # references in order, rows, masks
        place, index = below(wide, p), np.arange(r + 2, dtype=kind)
        # for each place the number and the last one of the references left up to there, and the first one left after it (counted from the end)
        count, before, after = (np.zeros((r + 1, *kept.shape[1:]), kind) for _ in range(3))
        one = np.empty(kept.shape[1:], kind)
        for i in range(r):
            np.add(count[i], kept[i], out=count[i + 1])
            np.maximum(before[i], np.multiply(kept[i], index[i + 1], out=one), out=before[i + 1])
        for i in range(r - 1, -1, -1):
            np.maximum(after[i + 1], np.multiply(kept[i], index[r - i], out=one), out=after[i])
        own = row[:, None]
        lower, upper = before[place, own], r + 1 - after[place, own]  # rows, peaks, masks
        flat, start = wide.ravel(), (row * wide.shape[1])[:, None, None]
        low, high = flat.take(start + lower), flat.take(start + upper)  # -inf and inf where none is left
        down = p[:, :, None] - low <= high - p[:, :, None]
        calc = np.where(down, low, high)
        last = calc[:, -1]
        under = below(wide, last)
        n = count[under, own, np.arange(len(masks))].astype(int)
        top = flat.take(start[:, 0] + before[under, own, np.arange(len(masks))])
        out[k] = np.where(masks.any(1), figure(p[:, :, None], calc, n, top), 0.0)
    return out


#: Cells that are judged under all masks at once.
MASKED = 256


def masked_nearest(q: np.ndarray, x: np.ndarray, refs: np.ndarray, masks: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The q2 of the reference nearest to each peak, of those that the mask leaves that `which` names for the row; NaN in rows that aren't finite."""
    calc = np.full(q.shape, np.nan)
    for lo in range(0, len(q), ASSIGNED):
        rows = slice(lo, lo + ASSIGNED)
        left, ref = masks[which[rows]], calculated(x[rows], refs)
        fine = finite(q[rows], x[rows]) & (np.isfinite(ref) | ~left).all(1)
        ref = np.sort(np.where(left, ref, np.inf)[fine], axis=1)
        calc[np.flatnonzero(fine) + lo] = placed(q[rows][fine], bordered(ref), len(refs))[1]
    return calc


def solve(terms: np.ndarray, q: np.ndarray, weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weighted least squares of q = terms * x for each row; x itself where the terms have no full rank."""
    return least_squares(np.ascontiguousarray(terms.transpose(2, 1, 0)), np.ascontiguousarray(q.T), np.ascontiguousarray(weight.T), x)


def least_squares(terms: np.ndarray, q: np.ndarray, weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    """solve() of terms (coefficients, peaks, rows) and of q and weights (peaks, rows): normal equations, eliminated for all rows at once. Each row is solved by itself."""
    n = len(terms)
    weighted = terms * weight
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        h = [[total(weighted[i] * terms[j]) for j in range(i + 1)] for i in range(n)]
        g = [total(w * q) for w in weighted]
        scale = reduce(np.add, [h[i][i] for i in range(n)])
        by = np.where(scale > 0, scale, 1)
        h, g, pivots = [[v / by for v in row] for row in h], [v / by for v in g], []
        for i in range(n):  # h = l * pivots * l transposed; l takes the place of h
            rests = [h[i][j] for j in range(i)]
            for j in range(i):
                for k in range(j):
                    rests[j] = rests[j] - rests[k] * h[j][k]
                h[i][j] = rests[j] / pivots[j]
            pivots.append(reduce(np.subtract, [rests[j] * h[i][j] for j in range(i)], h[i][i]))
            g[i] = reduce(np.subtract, [h[i][j] * g[j] for j in range(i)], g[i])
        good = (scale > 0) & (np.abs(reduce(np.multiply, pivots)) > 1e-12)
        for i in reversed(range(n)):
            g[i] = reduce(np.subtract, [h[j][i] * g[j] for j in range(i + 1, n)], g[i] / pivots[i])
    return np.where(good[:, None], np.stack(g, 1), x)


#: Of the reciprocal metric of a triclinic cell, over the lengths of its axes.
LEAST_EIGENVALUE = 1e-3


def physical(x: np.ndarray, system: str, least: float = 1e-6, most: float = 0.25) -> np.ndarray:
    """x made a cell: diagonal coefficients within least and most, cross terms drawn back until the reciprocal metric is positive; a row that isn't finite becomes a cube of 5 angstrom. Each row is judged by itself."""
    x = x.copy()
    axes = {"rhombohedral": 1}.get(system, min(3, x.shape[1]))
    x[~np.isfinite(x).all(1)] = np.where(np.arange(x.shape[1]) < axes, 1 / 25, 0.0)
    x[:, :axes] = np.clip(x[:, :axes], least, most)
    if system == "rhombohedral":
        x[:, 1] = np.clip(x[:, 1], -0.98 * x[:, 0], 1.96 * x[:, 0])
    if system == "monoclinic":
        room = 1.98 * np.sqrt(x[:, 0] * x[:, 2])
        x[:, 3] = np.clip(x[:, 3], -room, room)
    if system == "triclinic":
        edge = np.sqrt(x[:, :3])
        u, v, w = x[:, 5] / (2 * edge[:, 0] * edge[:, 1]), x[:, 4] / (2 * edge[:, 0] * edge[:, 2]), x[:, 3] / (2 * edge[:, 1] * edge[:, 2])
        minor = 1 - np.maximum.reduce([u * u, v * v, w * w])
        bad = np.flatnonzero((minor <= 0) | (1 + 2 * u * v * w - u * u - v * v - w * w <= 3 * LEAST_EIGENVALUE))
        if len(bad):
            g = reciprocal_metric(x[bad])
            r = g / (edge[bad, :, None] * edge[bad, None, :])  # ones on the diagonal
            lowest = np.linalg.eigvalsh(r)[:, 0]
            x[bad, 3:] *= np.minimum(1, (1 - LEAST_EIGENVALUE) / np.maximum(1 - lowest, 1e-9))[:, None]
    return x


def reciprocal_metric(x: np.ndarray) -> np.ndarray:
    """Gram matrices of the reciprocal cell, of triclinic coefficients."""
    return np.stack([np.stack([x[:, 0], x[:, 5] / 2, x[:, 4] / 2], 1), np.stack([x[:, 5] / 2, x[:, 1], x[:, 3] / 2], 1), np.stack([x[:, 4] / 2, x[:, 3] / 2, x[:, 2]], 1)], 1)


def dealt(df: DataFrame, key: str = "pattern_id") -> DataFrame:
    """df by pattern (or another key), over as many tasks as a shuffle has: few bytes are much work here, so partitions must not be merged by size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


#: Batches of candidates to batches.
Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: (rows, q, xnn) to the new xnn and m20.
Step = Callable[[pd.DataFrame, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows; a null element is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def rows_of(x: np.ndarray) -> pa.ListArray:
    """A list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)), pa.array(np.ascontiguousarray(x, float).ravel()))


def _parts(batch: pa.RecordBatch):
    """The rows of the batch by their number of peaks, some thousands at once."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("q")), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = batch if len(at) == len(sizes) else batch.take(pa.array(at))
        for lo in range(0, len(at), 16384):
            yield size, rows.slice(lo, 16384)


def _stepped(part: pa.RecordBatch, steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, xnn, m20) of rows with equally many peaks, after the steps."""
    ids = pd.DataFrame({c: part.column(c).to_numpy(zero_copy_only=False) for c in ("pattern_id", "candidate_id")})
    q, x, m = matrix(part.column("q")), matrix(part.column("xnn")), part.column("m20").to_numpy(zero_copy_only=False)
    for step in steps:
        x, m = step(ids, q, x)
    return q, x, m


def _told(part: pa.RecordBatch, xnn, m20, **more) -> pa.RecordBatch:
    """part with a new xnn and m20, and more columns."""
    columns = {c: part.column(c) for c in ("pattern_id", "candidate_id", "q")} | {"xnn": xnn, "m20": m20 if isinstance(m20, pa.Array) else pa.array(m20, pa.float64())} | more
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("pattern_id").cast("long").alias("pattern_id"), F.col("candidate_id").cast("int").alias("candidate_id"), "q", "xnn", F.col("m20").cast("double").alias("m20"))


def stepping(*steps: Step) -> Pass:
    """The steps one after the other."""

    def run(batches):
        for batch in batches:
            for size, part in _parts(batch):
                if not size:
                    yield _told(part, part.column("xnn"), np.zeros(part.num_rows))
                    continue
                _, x, m = _stepped(part, steps)
                yield _told(part, rows_of(x), m)

    return run


def _batches(df: DataFrame, *steps: Step) -> DataFrame:
    """df with the xnn and m20 that the steps give, one after the other, in one pass."""
    return _typed(df).mapInArrow(stepping(*steps), COLUMNS)


def passed(cands: DataFrame, *steps: Step) -> DataFrame:
    """cands after all of the steps (refining, refining_indexed, standardising, correcting), in one pass: one Python process a task, whatever their number."""
    return _batches(cands, *steps)


def score(cands: DataFrame, refs: np.ndarray) -> DataFrame:
    """cands with m20 of their xnn."""
    return _batches(cands, lambda rows, q, x: (x, merits(q, x, refs)))


#: Refinement workers: (draws a subsample, draws powers of the weights).
WORKERS = {"deterministic": (False, False), "random_subsampling": (True, False), "random_power": (False, True), "random_subsampling_power": (True, True)}


def refining(refs: np.ndarray, system: str, worker: str = "random_subsampling", steps: int = 1, keep: int = 6, power: tuple[float, float] = (0.0, 2.0), seed: int = 0) -> Step:
    """Steps of a worker: weights (a subsample of `keep` peaks, powers of q2, or neither), least squares, repair, assignment; a step stays where the merit grew."""
    subsample, powers = WORKERS[worker]

    def step(rows: pd.DataFrame, q: np.ndarray, x: np.ndarray):
        pattern, candidate = rows["pattern_id"].to_numpy(), rows["candidate_id"].to_numpy()
        best = physical(x, system)
        at, calc, merit = assign(q, best, refs)
        if subsample and not powers and keep < q.shape[1] and steps > FEW_STEPS:
            fine = np.flatnonzero(finite(q))  # the others keep their merit of 0
            for lo, hi in itertools.pairwise([*(k for k in LISTED if k < steps), steps]):
                for k, lists in listed(q[fine], best[fine], refs, system):
                    own = fine[k]
                    best[own], at[own], calc[own], merit[own] = subsampled(lists, (pattern[own], candidate[own]), q[own], best[own], at[own], calc[own], merit[own], refs, system, range(lo, hi), keep, seed)
            return best, merit
        live = np.arange(len(q))
        for k in range(steps):
            ids, peaks = (pattern[live], candidate[live]), q[live]
            exponent = 1.0
            if powers and not subsample:
                exponent = power[0] + (power[1] - power[0]) * draws(seed, 2 * k + 1, *ids, q.shape[1])
            weight = 1 / (peaks**exponent * (np.abs(peaks - calc[live]) + 1e-10))
            if subsample and keep < q.shape[1]:
                out = np.argsort(draws(seed, 2 * k, *ids, q.shape[1]), axis=1)[:, keep:]
                low = np.take_along_axis(weight * peaks ** (1 + power[1]), out, 1) if powers else 0.0
                np.put_along_axis(weight, out, low, 1)
            new = physical(solve(refs[at[live]], peaks, weight, best[live]), system)
            grew = merits(peaks, new, refs) > merit[live]
            up = live[grew]
            best[up] = new[grew]
            at[up], calc[up], merit[up] = assign(q[up], best[up], refs)
            if not (subsample or powers):
                live = up  # a row that stayed would stay again
            if not len(live):
                break
        return best, merit

    return step


#: Up to so many steps of refinement all references are tried in each. Beyond, those near the peaks are listed before these steps.
FEW_STEPS, LISTED = 8, (0, 2, 10)
#: How many references a list may have, how far beyond the greatest peak it reaches, and for how many cells lists are made at once.
WIDTHS, REACH, LISTED_FROM = (16, 32, 48, 80), 1.3, 16384


class Lists:
    """The references of some cells that may be near a peak: the least ones, in the order of their numbers, and where the others begin.

    The others can't come nearer than least_ratio() says, however a cell has
    changed since; cells for which that doesn't do are tried with all references.
    """

    def __init__(self, index: np.ndarray | None, beyond: np.ndarray, x: np.ndarray, refs: np.ndarray, system: str):
        self.index, self.beyond, self.ratio = index, beyond, least_ratio(x, system)
        self.terms = refs.T[:, :, None] if index is None else np.ascontiguousarray(refs.T[:, index.T])
        self.refs = refs

    def judged(self, q: np.ndarray, x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(merits, rows that need all references, values in order, places as below() tells them) of cells and of peaks (peaks, cells), whose places were so before."""
        wide = walled(summed(self.terms, np.ascontiguousarray(x.T)).T)
        flat, start = wide.ravel(), np.arange(len(wide)) * wide.shape[1]
        at = start + place
        moved = np.flatnonzero((flat.take(at) >= q) | (flat.take(at + 1) < q))
        if len(moved):
            place = place.copy()
            settle(wide, q, place, moved)
        merit, high = valued(wide, q, place)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = ~(high.max(0) < self.beyond * self.ratio(x))
        return merit, far, wide, place

    def assigned(self, rows: np.ndarray, q: np.ndarray, x: np.ndarray, wide: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the reference nearest to each peak, its q2) of some of the cells, of what judged() says of them."""
        low, high = of(wide, place), of(wide, place + 1)
        lower = (place > 0) & (q - low <= high - q)
        calc, place = np.where(lower, low, high), place - lower
        ref = summed(self.terms if self.index is None else self.terms[:, :, rows], np.ascontiguousarray(x.T)).T
        order = np.argsort(ref, axis=1)
        same = np.flatnonzero((wide[:, 2:-1] == wide[:, 1:-2]).any(1))
        if len(same):
            order[same] = np.argsort(ref[same], axis=1, kind="stable")
            place[same] = below(bordered(wide[same, 1:-1]), calc[same])
        at = of(order, place)
        return (at if self.index is None else of(self.index[rows], at)), calc


def least_ratio(old: np.ndarray, system: str) -> Callable[[np.ndarray], np.ndarray]:
    """By what any q2 of the cells has been multiplied since they were `old`, at least (a little less, for rounding)."""
    if system == "triclinic":
        a, b, c = old.T[:3]
        with np.errstate(divide="ignore", invalid="ignore"):
            l11 = np.sqrt(a)
            l21, l31 = old[:, 5] / 2 / l11, old[:, 4] / 2 / l11
            l22 = np.sqrt(b - l21 * l21)
            l32 = (old[:, 3] / 2 - l31 * l21) / l22
            l33 = np.sqrt(c - l31 * l31 - l32 * l32)
            w11, w22, w33 = 1 / l11, 1 / l22, 1 / l33
            w21, w32 = -l21 * w11 * w22, -l32 * w22 * w33
            w31 = -(l31 * w11 + l32 * w21) * w33

        def ratio(x):
            d = (x - old).T
            d23, d13, d12 = d[3] / 2, d[4] / 2, d[5] / 2
            v1, v2, v3 = w21 * d[0] + w22 * d12, w21 * d12 + w22 * d[1], w21 * d13 + w22 * d23
            u1, u2, u3 = w31 * d[0] + w32 * d12 + w33 * d13, w31 * d12 + w32 * d[1] + w33 * d23, w31 * d13 + w32 * d23 + w33 * d[2]
            s11, s12, s13 = w11 * w11 * d[0], w11 * v1, w11 * u1
            s22, s23, s33 = w21 * v1 + w22 * v2, w21 * u1 + w22 * u2, w31 * u1 + w32 * u2 + w33 * u3
            return 1 - 1e-6 - np.sqrt(s11 * s11 + s22 * s22 + s33 * s33 + 2 * (s12 * s12 + s13 * s13 + s23 * s23))

    elif system == "monoclinic":

        def ratio(x):
            det = old[:, 0] * old[:, 2] - old[:, 3] * old[:, 3] / 4
            trace = (old[:, 0] * x[:, 2] + old[:, 2] * x[:, 0] - old[:, 3] * x[:, 3] / 2) / det
            of = (x[:, 0] * x[:, 2] - x[:, 3] * x[:, 3] / 4) / det
            return np.minimum((trace - np.sqrt(np.maximum(trace * trace - 4 * of, 0))) / 2, x[:, 1] / old[:, 1]) - 1e-6

    elif system == "rhombohedral":

        def ratio(x):
            return np.minimum((x[:, 0] + x[:, 1]) / (old[:, 0] + old[:, 1]), (x[:, 0] - x[:, 1] / 2) / (old[:, 0] - old[:, 1] / 2)) - 1e-6

    else:

        def ratio(x):
            return (x / old).min(1) - 1e-6

    return ratio


def listed(q: np.ndarray, x: np.ndarray, refs: np.ndarray, system: str):
    """(rows, their Lists), rows with lists of about one length at once."""
    for lo in range(0, len(x), LISTED_FROM):
        rows = slice(lo, lo + LISTED_FROM)
        ref = calculated(x[rows], refs)
        width = np.searchsorted(WIDTHS, (ref < REACH * q[rows].max(1)[:, None]).sum(1) + 1)
        whole = []
        for i in np.unique(width):
            at = np.flatnonzero(width == i)
            size = WIDTHS[i] if i < len(WIDTHS) else len(refs)
            if size < len(refs):
                own = ref[at]
                beyond = np.partition(own, size, axis=1)[:, size]
                near = own < beyond[:, None]
                fits = near.sum(1) == size  # else some are equal to where the others begin
                if fits.any():
                    k = at[fits]
                    yield lo + k, Lists(np.nonzero(near[fits])[1].reshape(-1, size), beyond[fits], x[lo + k], refs, system)
                at = at[~fits]
            whole.append(at)
        k = lo + np.concatenate(whole)
        if len(k):
            yield k, Lists(None, np.full(len(k), np.inf), x[k], refs, system)


def subsampled(lists: Lists, ids, q, best, at, calc, merit, refs, system: str, steps: range, keep: int, seed: int):
    """(cells, references, their q2, merits) after steps of random subsampling, with lists of the references near the peaks."""
    q, best, at, calc, merit, peaks = np.ascontiguousarray(q), best.copy(), at.copy(), calc.copy(), merit.copy(), np.ascontiguousarray(q.T)
    place = lists.judged(peaks, best, np.zeros(peaks.shape, int))[3]
    columns = np.ascontiguousarray(refs.T)
    for k in steps:
        u = draws(seed, 2 * k, *ids, q.shape[1])
        kept = np.flatnonzero(u <= np.partition(u, keep - 1, axis=1)[:, keep - 1 : keep]).reshape(-1, keep).T
        some = q.ravel().take(kept)
        weight = 1 / (some * (np.abs(some - calc.ravel().take(kept)) + 1e-10))
        new = physical(least_squares(columns.take(at.ravel().take(kept), axis=1), some, weight, best), system)
        m, far, wide, places = lists.judged(peaks, new, place)
        far = np.flatnonzero(far)
        if len(far):
            m[far] = merits(q[far], new[far], refs)
        grew = m > merit
        again = far[grew[far]]
        if len(again):
            best[again] = new[again]
            at[again], calc[again], merit[again] = assign(q[again], new[again], refs)
            grew[again] = False
        up = np.flatnonzero(grew)
        best[up], merit[up], place[:, up] = new[up], m[up], places[:, up]
        at[up], calc[up] = lists.assigned(up, q[up], new[up], wide[up], places[:, up].T)
    return best, at, calc, merit


def refine_step(cands: DataFrame, refs: np.ndarray, system: str, *args, **options) -> DataFrame:
    """cands after steps of a worker (see refining)."""
    return _batches(cands, refining(refs, system, *args, **options))


def explained(q: np.ndarray, calc: np.ndarray, volume: np.ndarray, lattice: str) -> np.ndarray:
    """Probability that each peak is explained, against a chance hit (see search.peak_probability)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 / (1 + 8 * np.pi * q * np.abs(np.sqrt(q) - np.sqrt(np.maximum(calc, 0))) / (volume[:, None] * MULTIPLICITY[lattice]))


def refining_indexed(refs: np.ndarray, lattice: str, over: float = 0.95) -> Step:
    """One more refinement, on those peaks alone that are explained with a probability of `over`; kept where the merit grew."""
    system = system_of(lattice)

    def step(rows: pd.DataFrame, q: np.ndarray, x: np.ndarray):
        at, calc, merit = assign(q, x, refs)
        p = explained(q, calc, reciprocal_volume(x, system), lattice)
        weight = np.where(p > over, 1 / (q * (np.abs(q - calc) + 1e-10)), 0.0)
        new = physical(solve(refs[at], q, weight, x), system)
        m = merits(q, new, refs)
        up = m > merit
        return np.where(up[:, None], new, x), np.where(up, m, merit)

    return step


def refine_indexed(cands: DataFrame, refs: np.ndarray, lattice: str, over: float = 0.95) -> DataFrame:
    """cands refined on their explained peaks (see refining_indexed)."""
    return _batches(cands, refining_indexed(refs, lattice, over))


def whole_xnn(x: np.ndarray, system: str) -> np.ndarray:
    """The six coefficients of partial ones."""
    z = np.zeros(len(x))
    columns = {
        "cubic": lambda: (x[:, 0],) * 3 + (z,) * 3,
        "tetragonal": lambda: (x[:, 0], x[:, 0], x[:, 1], z, z, z),
        "hexagonal": lambda: (x[:, 0], x[:, 0], x[:, 1], z, z, x[:, 0]),
        "rhombohedral": lambda: (x[:, 0],) * 3 + (x[:, 1],) * 3,
        "orthorhombic": lambda: (x[:, 0], x[:, 1], x[:, 2], z, z, z),
        "monoclinic": lambda: (x[:, 0], x[:, 1], x[:, 2], z, x[:, 3], z),
        "triclinic": lambda: tuple(x.T),
    }
    return np.stack(columns[system](), 1)


def reciprocal_volume(x: np.ndarray, system: str) -> np.ndarray:
    return np.sqrt(np.maximum(np.linalg.det(reciprocal_metric(whole_xnn(x, system))), 0))


def multiples(system: str) -> np.ndarray:
    """Factors of the coefficients, a row for each choice of MULTIPLES of the free axes; the unchanged cell first. Cross terms take the factors of both axes."""
    free = {"cubic": 1, "tetragonal": 2, "hexagonal": 2, "rhombohedral": 1}.get(system, 3)
    grid = sorted(itertools.product(MULTIPLES[system], repeat=free), key=lambda f: (set(f) != {1.0}, f))
    f = 1 / np.array(grid)
    if system == "rhombohedral":
        return np.repeat(f**2, 2, 1)
    if system == "monoclinic":
        return np.stack([*(f**2).T, f[:, 0] * f[:, 2]], 1)
    if system == "triclinic":
        return np.stack([*(f**2).T, f[:, 1] * f[:, 2], f[:, 0] * f[:, 2], f[:, 0] * f[:, 1]], 1)
    return f**2


def correcting(refs: np.ndarray, system: str) -> Step:
    """Each cell gives way to that one of its multiples which has the greatest merit; of equal ones the first of multiples()."""
    factors = multiples(system)

    def step(rows: pd.DataFrame, q: np.ndarray, x: np.ndarray):
        best, merit = x.copy(), np.full(len(x), -1.0)
        for f in factors:
            m = merits(q, x * f, refs)
            up = m > merit
            best[up], merit[up] = (x * f)[up], m[up]
        return best, merit

    return step


def correct_multiples(cands: DataFrame, refs: np.ndarray, system: str) -> DataFrame:
    """cands corrected for multiples (see correcting)."""
    return _batches(cands, correcting(refs, system))


def terms_of(hkl: np.ndarray, system: str) -> np.ndarray:
    """What multiplies the free coefficients, for rows of h, k, l: hkl_terms for small fixed tables."""
    h, k, l = np.asarray(hkl, float).T  # noqa: E741
    columns = {
        "cubic": [h * h + k * k + l * l],
        "tetragonal": [h * h + k * k, l * l],
        "hexagonal": [h * h + h * k + k * k, l * l],
        "rhombohedral": [h * h + k * k + l * l, h * k + h * l + k * l],
        "orthorhombic": [h * h, k * k, l * l],
        "monoclinic": [h * h, k * k, l * l, h * l],
        "triclinic": [h * h, k * k, l * l, k * l, h * l, h * k],
    }
    return np.stack(columns[system], 1)


def group_masks(lattice: str, terms: np.ndarray, reach: int = 6) -> tuple[list[extinction.Group], np.ndarray]:
    """(groups of the lattice, which references each leaves: a row of booleans a group).

    A reference stands for all reflections with its terms: it stays if the group
    leaves one of them.
    """
    system, span = system_of(lattice), range(-reach, reach + 1)
    hkl = np.array(list(itertools.product(span, span, span)))
    row = {tuple(t): i for i, t in enumerate(terms.tolist())}
    where = np.array([row.get(tuple(t), -1) for t in terms_of(hkl, system).tolist()])
    hkl, where = hkl[where >= 0], where[where >= 0]
    groups = extinction.groups(lattice)
    masks = np.zeros((len(groups), len(terms)), bool)
    for mask, group in zip(masks, groups, strict=True):
        mask[where[extinction.allowed(group, hkl, lattice)]] = True
    return groups, masks


def absence_groups(cands: DataFrame, lattice: str, n: int = 200, steps: tuple[Step, ...] = ()) -> DataFrame:
    """cands, after the steps in the same pass, with extinction_group and group_m20: that group of the lattice under which the merit is greatest; of equal ones the first."""
    _, terms = references(cands.sparkSession, lattice, n)
    groups, masks = group_masks(lattice, terms)
    names = pa.array([group.name for group in groups])

    def run(batches):
        for batch in batches:
            for size, part in _parts(batch):
                if not size:
                    zero = np.zeros(part.num_rows)
                    yield _told(part, part.column("xnn"), zero if steps else part.column("m20"), extinction_group=names.take(pa.array(zero.astype(int))), group_m20=pa.array(zero))
                    continue
                q, x, m20 = _stepped(part, steps)
                m = masked_merits(q, x, terms, masks)
                best = m.argmax(1)
                yield _told(part, rows_of(x), m20, extinction_group=names.take(pa.array(best)), group_m20=pa.array(m[np.arange(len(m)), best]))

    return _typed(cands).mapInArrow(run, f"{COLUMNS}, extinction_group string, group_m20 double")


def first_lines(q: np.ndarray, n: int) -> list[np.ndarray]:
    """The n first different values of each row, rounded to twelve places."""
    q = np.sort(np.round(q, 12), 1)
    new = np.concatenate([np.ones((len(q), 1), bool), q[:, 1:] > q[:, :-1]], 1)
    new &= np.cumsum(new, 1) <= n
    return np.split(q[new], np.cumsum(new.sum(1))[:-1])


def peaks_of_cells(df: DataFrame, key: str, xnn: str, lattice: str, n: int = 20, n_refs: int = 200) -> DataFrame:
    """(pattern_id, q, xnn): the n first different lines of each cell, rounded to twelve places. df: rows of a key (whole number) and of coefficients."""
    refs = reference_terms(df.sparkSession, lattice, n_refs)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                q = calculated(np.stack(pdf["xnn"].to_numpy()).astype(float), refs)
                yield pdf.assign(q=first_lines(q, n))[["pattern_id", "q", "xnn"]]

    return dealt(df, key).select(F.col(key).cast("long").alias("pattern_id"), F.col(xnn).alias("xnn")).mapInPandas(run, "pattern_id long, q array<double>, xnn array<double>")


def near_cells(patterns: DataFrame, system: str, n: int, share: float, seed: int = 0) -> DataFrame:
    """Candidates for a test of convergence: n cells of each pattern (pattern_id, q, xnn), whose coefficients are off by up to `share` of the least of an axis. The rows are gathered."""

    def step(rows: pd.DataFrame, q: np.ndarray, x: np.ndarray):
        u = draws(seed, 0, rows["pattern_id"].to_numpy(), rows["candidate_id"].to_numpy(), x.shape[1])
        least = x[:, : {"rhombohedral": 1}.get(system, min(3, x.shape[1]))].min(1, keepdims=True)
        return physical(x + share * (2 * u - 1) * least, system), np.zeros(len(x))

    return _batches(dealt(patterns).sortWithinPartitions("pattern_id").withColumn("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("m20", F.lit(0.0)), step)


def standardising(refs: np.ndarray, system: str) -> Step:
    """Triclinic cells in their reduced cell, monoclinic ones with the least cross term; a cell that can't be reduced stays."""

    def step(rows: pd.DataFrame, q: np.ndarray, x: np.ndarray):
        new = x.copy()
        if system == "triclinic":
            g = reciprocal_metric(x)
            fine = np.linalg.eigvalsh(g)[:, 0] > 0
            m = reduction.reduced(g[fine])
            r = np.einsum("nic,ncd,njd->nij", m, g[fine], m)
            new[fine] = np.stack([r[:, 0, 0], r[:, 1, 1], r[:, 2, 2], 2 * r[:, 1, 2], 2 * r[:, 0, 2], 2 * r[:, 0, 1]], 1)
        elif system == "monoclinic":
            for _ in range(50):  # the longer of a* and c* moves by the shorter
                a, c, d = new[:, 0], new[:, 2], new[:, 3]
                n = np.rint(d / (2 * np.minimum(a, c)))
                moved = np.where(a <= c, c + n * n * a - n * d, a + n * n * c - n * d)
                better = n != 0
                if not better.any():
                    break
                low = np.minimum(a, c)
                new[:, 3] = np.where(better, d - 2 * n * low, d)
                new[:, 2], new[:, 0] = np.where(better & (a <= c), moved, c), np.where(better & (a > c), moved, a)
        a = merits(q, new, refs)
        back = ~(np.isfinite(new).all(1)) | ~(a > 0)
        new[back] = x[back]
        return new, np.where(back, merits(q, x, refs), a)

    return step


def standardise_candidates(cands: DataFrame, refs: np.ndarray, system: str) -> DataFrame:
    """cands in their standard cell (see standardising); other systems' cells have but one."""
    return _batches(cands, standardising(refs, system)) if system in ("monoclinic", "triclinic") else cands


def template_candidates(patterns: DataFrame, templates: np.ndarray, refs: np.ndarray, system: str, top: int, numbered: bool = False) -> DataFrame:
    """(pattern_id, candidate_id, q, xnn, m20): the `top` templates of each pattern by merit.

    A template says which reference each of the first peaks is. Its cell comes
    from five rounds of least squares, between which the references are put in
    the order of their calculated q2. templates: a fixed small table (rows of
    indices into refs); candidate_id is the row, or, if `numbered`, its place
    among those of the pattern.
    """
    width, parameters, many = templates.shape[1], refs.shape[1], len(templates)

    def best(ids: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        terms, near = np.tile(refs[templates], (len(q), 1, 1)), np.repeat(q[:, :width], many, 0)
        x = np.full((len(near), parameters), np.nan)
        live = np.arange(len(near))
        for _ in range(5):
            x[live] = solve(terms, near[live], 1 / near[live] ** 2, x[live])
            order = np.argsort(np.einsum("npi,ni->np", terms, np.nan_to_num(x[live])), axis=1, kind="stable")
            moved = np.flatnonzero((order != np.arange(width)).any(1))  # a cell whose references are in order stays
            live, terms = live[moved], np.take_along_axis(terms[moved], order[moved, :, None], 1)
        fine = np.isfinite(x).all(1)
        x = physical(x, system)
        merit = np.where(fine, merits(np.repeat(q, many, 0), x, refs), -1.0).reshape(-1, many)
        at = np.argsort(-merit, axis=1, kind="stable")[:, :top]
        if numbered:
            at = np.sort(np.where(np.take_along_axis(merit, at, 1) < 0, many, at), 1)
        kept = (at < many) & (np.take_along_axis(merit, np.minimum(at, many - 1), 1) >= 0)
        row, place = np.nonzero(kept)
        which = at[kept]
        return pd.DataFrame({"pattern_id": ids[row], "candidate_id": (place if numbered else which).astype(np.int32), "q": list(q[row]), "xnn": list(x[row * many + which]), "m20": merit[row, which]})

    def run(batches):
        for pdf in batches:
            sizes = pdf["q"].map(len).to_numpy()
            for size in np.unique(sizes[sizes >= width]):
                part = pdf[sizes == size]
                for lo in range(0, len(part), max(1, 2048 // many)):
                    some = part.iloc[lo : lo + max(1, 2048 // many)]
                    yield best(some["pattern_id"].to_numpy(), np.stack(some["q"].to_numpy()).astype(float))

    return patterns.select("pattern_id", "q").mapInPandas(run, COLUMNS)


def draw_templates(refs: np.ndarray, width: int, n: int, seed: int = 0, low: int = 12) -> np.ndarray:
    """n different templates of `width` among the first references, each in ascending order, drawn by hash."""
    u = draws(seed, 0, np.arange(4 * n), np.zeros(4 * n), low + width)
    rows = np.sort(np.argsort(u[:, : min(low + width, len(refs))], axis=1)[:, :width], axis=1)
    _, first = np.unique(rows, axis=0, return_index=True)
    return rows[np.sort(first)[:n]]


def random_candidates(patterns: DataFrame, system: str, n: int, seed: int = 0) -> DataFrame:
    """(pattern_id, candidate_id, q, xnn, m20): n random cells of each pattern, whose axes go with its first peak. m20 is 0."""
    size = len(FREE[system])

    def step(rows: pd.DataFrame, q: np.ndarray, x: np.ndarray):
        u = draws(seed, 0, rows["pattern_id"].to_numpy(), rows["candidate_id"].to_numpy(), size)
        x = q[:, :1] * np.exp(3 * (u - 0.5))
        if size > 3 or system == "rhombohedral":
            x[:, min(3, size - 1) :] = (u[:, min(3, size - 1) :] - 0.5) * x[:, :1]
        return physical(x, system), np.zeros(len(x))

    rows = patterns.select("pattern_id", "q").withColumn("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"xnn": F.array(F.lit(0.0)), "m20": F.lit(0.0)})
    return _batches(rows, step)


#: Generators by name: (patterns, refs, system, n) to candidates, numbered from 0 in each pattern. More can be added.
GENERATORS: dict[str, Callable[[DataFrame, np.ndarray, str, int], DataFrame]] = {
    "templates": lambda patterns, refs, system, n: template_candidates(patterns, draw_templates(refs, len(FREE[system]) + 1, 8 * n), refs, system, n, numbered=True),
    "random": lambda patterns, refs, system, n: random_candidates(patterns, system, n),
}


def generate(patterns: DataFrame, refs: np.ndarray, system: str, quotas: dict[str, int], generators: dict | None = None) -> DataFrame:
    """Candidates of all generators of quotas, as many a pattern as it says; candidate_id goes on from one to the next, `generator` names it. `generators` adds to GENERATORS, such as those of fitted models (see cellspark.operators.models)."""
    out, at = None, 0
    patterns = dealt(patterns)
    for name, n in quotas.items():
        made = (GENERATORS | (generators or {}))[name](patterns, refs, system, n)
        made = made.withColumn("candidate_id", (F.col("candidate_id") + at).cast("int")).withColumn("generator", F.lit(name))
        out, at = made if out is None else out.unionByName(made), at + n
    return out


def _distances(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances of the given rows to all rows."""
    return ((x[rows][:, None, :] - x[None]) ** 2).sum(2)


def spread(x: np.ndarray, ids: tuple[np.ndarray, np.ndarray], system: str, radius: float, most: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """The cells x, of which no more than `most` (itself included) lie within radius of any, where there is room: of each dense spot only the excess moves.

    A round goes through the spots, densest first, that hold more than `most`
    cells not yet moved; the excess, chosen by hash, moves to a point at the
    distance of radius from cells with fewer neighbours, chosen in proportion to
    their room, or, where there is none, at twice that distance from those with
    the fewest.
    """
    x, limit, pattern, candidate = x.copy(), radius * radius, *ids
    near = np.zeros(len(x), int)
    for k in range(rounds):
        for lo in range(0, len(x), 256):
            rows = np.arange(lo, min(lo + 256, len(x)))
            near[rows] = (_distances(x, rows) < limit).sum(1)
        if near.max(initial=0) <= most:
            break
        moved = np.zeros(len(x), bool)
        for at in np.argsort(-near, kind="stable"):
            if near[at] <= most:
                break
            members = np.flatnonzero((_distances(x, np.array([at]))[0] < limit) & ~moved)
            if len(members) <= most:
                continue
            order = draws(seed, 3 * k, pattern[members], candidate[members], 1)[:, 0]
            moved[members[np.argsort(order, kind="stable")[most:]]] = True
        gone = np.flatnonzero(moved)
        room = np.maximum(most - near, 0)
        if room.any():
            upto = np.cumsum(room)
            to, far = np.searchsorted(upto, draws(seed, 3 * k + 1, pattern[gone], candidate[gone], 1)[:, 0] * upto[-1], "right"), 1.0
        else:
            to, far = np.argsort(near, kind="stable")[np.arange(len(gone)) % len(x)], 2.0
        step = draws(seed, 3 * k + 2, pattern[gone], candidate[gone], x.shape[1]) * 2 - 1
        x[gone] = physical(x[to] + far * radius * step / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-12), system)
    return x


def spread_many(x: np.ndarray, ids: tuple[np.ndarray, np.ndarray], system: str, radius: float, most: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """spread() of many patterns with equally many cells at once, and the same cells: x (patterns, cells, coefficients), ids (patterns, cells)."""
    x, limit = x.copy(), radius * radius
    todo = np.arange(len(x))
    for k in range(rounds):
        own, pattern, candidate = x[todo], *(i[todo] for i in ids)
        close = ((own[:, :, None] - own[:, None]) ** 2).sum(3) < limit
        near = close.sum(2)
        dense = near.max(1, initial=0) > most
        if not dense.any():
            break
        todo, own, pattern, candidate, close, near = (a[dense] for a in (todo, own, pattern, candidate, close, near))
        n, size, width = own.shape
        row = np.arange(n)
        drawn = np.argsort(draws(seed, 3 * k, pattern.ravel(), candidate.ravel(), 1).reshape(n, size), axis=1, kind="stable")
        close = np.take_along_axis(close, drawn[:, None, :], 2)  # neighbours in the order in which they stay
        spots, moved = np.argsort(-near, axis=1, kind="stable"), np.zeros((n, size), bool)
        for spot in spots.T:
            members = close[row, spot] & ~moved
            moved |= members & (np.cumsum(members, 1) > most) & (near[row, spot] > most)[:, None]
        back = np.zeros_like(moved)
        np.put_along_axis(back, drawn, moved, 1)
        p, at = np.nonzero(back)
        ids_of = pattern[p, at], candidate[p, at]
        upto = np.cumsum(np.maximum(most - near, 0), 1)
        some = upto[p, -1] > 0
        drawn_to = (upto[p] <= (draws(seed, 3 * k + 1, *ids_of, 1)[:, 0] * upto[p, -1])[:, None]).sum(1)
        emptiest = np.argsort(near, axis=1, kind="stable")[p, (np.cumsum(back, 1)[p, at] - 1) % size]
        to, far = np.where(some, drawn_to, emptiest), np.where(some, 1.0, 2.0)[:, None]
        step = draws(seed, 3 * k + 2, *ids_of, width) * 2 - 1
        x[todo[p], at] = physical(own[p, to] + far * radius * step / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-12), system)
    return x


def gathered(cands: DataFrame) -> DataFrame:
    """cands dealt over tasks, the rows of a pattern one after the other."""
    return dealt(_typed(cands)).sortWithinPartitions("pattern_id", "candidate_id")


def _whole_patterns(batches):
    """Batches of rows, those of a pattern one after the other, cut anew so that no pattern lies in two."""
    held, last = [], None
    for batch in batches:
        ids = pc.fill_null(batch.column("pattern_id"), -(1 << 63)).to_numpy()
        if not len(ids):
            continue
        cut = int(np.flatnonzero(ids != ids[-1]).max(initial=-1)) + 1
        if held and (cut or ids[0] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
        last = ids[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: Cells of a pattern up to which patterns are spread many at once, and differences held then.
FEW, SPREAD_HELD = 256, 1 << 20


def spread_dense(cands: DataFrame, system: str, radius: float, most: int, rounds: int = 20, seed: int = 0) -> DataFrame:
    """cands of which no more than `most` of a pattern lie within radius of each other, where there is room (see spread). Rows whose cell isn't finite stay as they are.

    Patterns are dealt over tasks and follow each other there; those with
    equally many cells are spread at once. A pattern's candidates meet in one
    task: as many as its generators' quotas.
    """
    return gathered(cands).mapInArrow(spreading(system, radius, most, rounds, seed), COLUMNS)


def spreading(system: str, radius: float, most: int, rounds: int = 20, seed: int = 0) -> Pass:
    """What spread_dense does with gathered rows."""

    def run(batches):
        for batch in _whole_patterns(batches):
            x = matrix(batch.column("xnn"))
            ids = [pc.fill_null(batch.column(c), 0 if c == "candidate_id" else -(1 << 63)).to_numpy() for c in ("pattern_id", "candidate_id")]
            fine = np.flatnonzero(finite(x))
            _, first, sizes = np.unique(ids[0][fine], return_index=True, return_counts=True)
            for size in np.unique(sizes):
                starts = first[sizes == size]
                step = max(1, SPREAD_HELD // (size * size * x.shape[1]))
                for lo in range(0, len(starts), step):
                    rows = fine[starts[lo : lo + step, None] + np.arange(size)]
                    if size > FEW:
                        x[rows[0]] = spread(x[rows[0]], tuple(i[rows[0]] for i in ids), system, radius, most, rounds, seed)
                    else:
                        x[rows] = spread_many(x[rows], tuple(i[rows] for i in ids), system, radius, most, rounds, seed)
            yield _told(batch, rows_of(x), batch.column("m20"))

    return run


#: Of how many candidates of a pattern how many may lie within which distance before they are spread, and the distance at which two count as one in the end. Fixed values, by lattice system.
SPREAD = {
    "cubic": (120, 64, 0.000026, 0.002),
    "tetragonal": (2000, 52, 0.000213, 0.0001),
    "hexagonal": (2000, 52, 0.000213, 0.0001),
    "rhombohedral": (2000, 52, 0.000213, 0.0001),
    "orthorhombic": (4000, 46, 0.000338, 0.0001),
    "monoclinic": (6000, 42, 0.000547, 0.0001),
    "triclinic": (6000, 23, 0.000679, 0.0001),
}
#: Share of the candidates, best first, for which the many groups of a primitive orthorhombic lattice are tried. Fixed value.
TRIED = {"oP": 0.1}
FOUND = "pattern_id long, candidate_id int, xnn array<double>, m20 double, m_info double, n_indexed int, extinction_group string"


def crowd(system: str, n: int) -> tuple[int, float]:
    """(how many of n candidates of a pattern may lie within a distance, the distance): the share that SPREAD allows, one at least."""
    of, most, radius, _ = SPREAD[system]
    return max(1, -(-n * most // of)), radius


def thinned(x: np.ndarray, score: np.ndarray, radius: float) -> np.ndarray:
    """Which rows stay when the densest neighbourhood gives way to its best row until none has two; of equal ones the first."""
    left = np.ones(len(x), bool)
    near = np.concatenate([_distances(x, np.arange(lo, min(lo + 256, len(x)))) < radius * radius for lo in range(0, len(x), 256)] or [np.zeros((0, 0), bool)])
    while True:
        n = (near & left[None]).sum(1) * left
        at = int(n.argmax()) if len(n) else 0
        if not len(n) or n[at] <= 1:
            return left
        group = np.flatnonzero(near[at] & left)
        left[group] = False
        left[group[score[group].argmax()]] = True


def thinned_many(x: np.ndarray, score: np.ndarray, radius: float) -> np.ndarray:
    """thinned() of many patterns with equally many cells at once: x (patterns, cells, coefficients), score (patterns, cells)."""
    left = np.ones(score.shape, bool)
    near = ((x[:, :, None] - x[:, None]) ** 2).sum(3) < radius * radius
    todo = np.arange(len(x))
    while len(todo):
        n = (near & left[todo][:, None]).sum(2) * left[todo]
        at = n.argmax(1)
        dense = n[np.arange(len(n)), at] > 1
        todo, near, at = todo[dense], near[dense], at[dense]
        row = np.arange(len(todo))
        group = near[row, at] & left[todo]
        left[todo] &= ~group
        left[todo, np.where(group, score[todo], -np.inf).argmax(1)] = True
    return left


def finish(cands: DataFrame, lattice: str, top: int, n_refs: int = 200, block: int = 1000) -> DataFrame:
    """(pattern_id, candidate_id, xnn, m20, m_info, n_indexed, extinction_group): the last stages for the candidates of one lattice.

    Each is judged under the extinction groups of the lattice (of a primitive
    orthorhombic one the best tenth only) and takes the best merit; its
    explained peaks are counted; of candidates nearer to each other than the
    lattice's distance the best stays, in blocks by reciprocal volume; `top`
    stay, by merit, then by candidate_id. Rows whose cell isn't finite go. A
    pattern's candidates meet in one task: as many as its generators' quotas.
    """
    return finished(gathered(cands), lattice, top, n_refs=n_refs, block=block)


def finished(rows: DataFrame, lattice: str, top: int, *passes: Pass, n_refs: int = 200, block: int = 1000) -> DataFrame:
    """finish() of gathered rows, in one pass with those that are to go ahead. Many patterns are finished at once."""
    system = system_of(lattice)
    _, terms = references(rows.sparkSession, lattice, n_refs)
    groups, masks = group_masks(lattice, terms)
    names, radius = pa.array([group.name for group in groups]), SPREAD[system][3]

    def run(batches):
        batches = _whole_patterns(batches)
        for go in passes:
            batches = go(batches)
        for batch in _whole_patterns(batches):
            sizes = pc.fill_null(pc.list_value_length(batch.column("q")), 0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                part = batch if len(at) == len(sizes) else batch.take(pa.array(at))
                yield from ended(part, matrix(part.column("q")), matrix(part.column("xnn")))

    def ended(part: pa.RecordBatch, q: np.ndarray, x: np.ndarray):
        ids, number = (pc.fill_null(part.column(c), null).to_numpy() for c, null in (("pattern_id", -(1 << 63)), ("candidate_id", (1 << 31) - 1)))
        at = np.lexsort((number, ids))
        at = at[finite(x[at])]
        if not len(at):
            return
        q, x, m, ids = q[at], x[at], part.column("m20").to_numpy(zero_copy_only=False)[at].astype(float), ids[at]
        _, first, own, count = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)

        def ranks(rows: np.ndarray) -> np.ndarray:
            """The place of each of the rows among those of its pattern, best first."""
            order = np.lexsort((-m[rows], own[rows]))
            out, ordered = np.empty(len(rows), int), own[rows][order]
            out[order] = np.arange(len(rows)) - np.searchsorted(ordered, ordered)
            return out

        tried = np.flatnonzero(ranks(np.arange(len(m))) < (count * TRIED.get(lattice, 1.0)).astype(int)[own])
        each, which = masked_merits(q[tried], x[tried], terms, masks), np.zeros(len(m), int)
        which[tried] = each.argmax(1)
        m[tried] = each[np.arange(len(tried)), which[tried]]
        volume = reciprocal_volume(x, system)
        p = explained(q, masked_nearest(q, x, terms, masks, which), volume, lattice)
        with np.errstate(divide="ignore"):
            info = -np.log2(-np.expm1(np.log(p).sum(1)))
        stays = np.zeros(len(m), bool)
        for size in np.unique(count):
            starts, step = first[count == size], max(1, SPREAD_HELD // (size * size * x.shape[1]))
            for lo in range(0, len(starts), step):
                rows = starts[lo : lo + step, None] + np.arange(size)
                rows = np.take_along_axis(rows, np.argsort(volume[rows], axis=1, kind="stable"), 1)
                if size <= min(FEW, block):
                    stays[rows[thinned_many(x[rows], m[rows], radius)]] = True
                    continue
                for cut in range(0, size, block):
                    some = rows[0, cut : cut + block]
                    stays[some[thinned(x[some], m[some], radius)]] = True
        left = np.flatnonzero(stays)
        place = ranks(left)
        order = np.lexsort((place, own[left]))
        best = left[order[place[order] < top]]
        kept = part.take(pa.array(at[best]))
        columns = [kept.column("pattern_id"), kept.column("candidate_id"), rows_of(x[best]), pa.array(m[best]), pa.array(info[best]), pa.array((p[best] > 0.95).sum(1).astype(np.int32)), names.take(pa.array(which[best]))]
        yield pa.RecordBatch.from_arrays(columns, ["pattern_id", "candidate_id", "xnn", "m20", "m_info", "n_indexed", "extinction_group"])

    return rows.select("pattern_id", "candidate_id", "q", "xnn", "m20").mapInArrow(run, FOUND)


def search_lattice(patterns: DataFrame, lattice: str, quotas: dict[str, int], n_refs: int = 200, top: int = 20, steps: dict[str, tuple[int, int]] | None = None, generators: dict | None = None) -> DataFrame:
    """FOUND columns: the best `top` cells of each pattern in one lattice, all stages in one lineage.

    Candidates are generated, spread out where they are dense, refined by random
    subsampling, refined on their explained peaks, put into their standard cell,
    corrected for multiples and finished (see finish).
    """
    system, refs = system_of(lattice), reference_terms(patterns.sparkSession, lattice, n_refs)
    n, keep = (steps or STEPS)[system]
    most, radius = crowd(system, sum(quotas.values()))
    rows = gathered(generate(patterns, refs, system, quotas, generators))
    return finished(rows, lattice, top, spreading(system, radius, most), stepping(*stages(refs, lattice, n, keep)), n_refs=n_refs)


def stages(refs: np.ndarray, lattice: str, steps: int, keep: int, seed: int = 0) -> list[Step]:
    """All stages between generation and finish."""
    system = system_of(lattice)
    standard = [standardising(refs, system)] if system in ("monoclinic", "triclinic") else []
    return [refining(refs, system, "random_subsampling", steps, keep, seed=seed), refining_indexed(refs, lattice), refining(refs, system, "deterministic", 3), *standard, correcting(refs, system)]


def refined(cands: DataFrame, refs: np.ndarray, lattice: str, steps: int, keep: int, seed: int = 0) -> DataFrame:
    """cands after all stages between generation and finish, in one pass over them."""
    return _batches(cands, *stages(refs, lattice, steps, keep, seed))


def index_patterns(patterns: DataFrame, lattices: list[str], quotas: dict[str, int], n_refs: int = 200, top: int = 20, steps: dict[str, tuple[int, int]] | None = None, generators: dict | None = None) -> DataFrame:
    """FOUND columns, `lattice` and `rank`: the best `top` cells of each pattern over all of the lattices, by merit, then lattice and candidate.

    patterns: (pattern_id, q array, ascending). A pattern with no peak or with a
    peak that isn't finite has no rows.
    """
    fine = patterns.where((F.size("q") > 0) & F.forall("q", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    make_references(patterns.sparkSession, lattices, n_refs)
    each = [search_lattice(fine, lattice, quotas, n_refs, top, steps, generators).withColumn("lattice", F.lit(lattice)) for lattice in lattices]
    order = Window.partitionBy("pattern_id").orderBy(F.desc("m20"), "lattice", "candidate_id")
    return reduce(DataFrame.unionByName, each).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
