"""Reduced triclinic cells: Selling's steps over a batch of cells at once."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.functions.cell import NAMES

#: The seven vectors among which a reduced basis lies: a, b, c, d = -(a + b + c) and the sums of a with b, b with c, c with a.
SEVEN = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 1, 0, 0], [0, 1, 1, 0], [1, 0, 1, 0]])


def metric(cell: np.ndarray) -> np.ndarray:
    """Gram matrices of cells (a, b, c, alpha, beta, gamma)."""
    x, cos = cell[:, :3], np.cos(cell[:, 3:])
    g = x[:, :, None] * x[:, None, :]
    for k, (i, j) in enumerate(((1, 2), (0, 2), (0, 1))):
        g[:, i, j] *= cos[:, k]
        g[:, j, i] *= cos[:, k]
    return g


def cell_of(g: np.ndarray) -> np.ndarray:
    x = np.sqrt(np.einsum("nii->ni", g))
    cos = np.stack([g[:, 1, 2] / (x[:, 1] * x[:, 2]), g[:, 0, 2] / (x[:, 0] * x[:, 2]), g[:, 0, 1] / (x[:, 0] * x[:, 1])], 1)
    return np.concatenate([x, np.arccos(np.clip(cos, -1, 1))], 1)


def reduced(g: np.ndarray, steps: int = 200) -> np.ndarray:
    """Integer matrices whose rows are the reduced axes in terms of the old ones.

    Four vectors with the sum zero, of which no two have an acute angle: while
    two have one, the first turns round and is added to the other two. The axes
    are the three shortest of SEVEN that span the lattice, all angles between
    them acute or all obtuse.
    """
    n = len(g)
    m = np.tile(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, -1, -1]]), (n, 1, 1))
    pairs = np.array(list(itertools.combinations(range(4), 2)))
    tiny = 1e-9 * np.einsum("nii->n", g)
    for _ in range(steps):
        dots = np.einsum("nic,ncd,njd->nij", m, g, m)[:, pairs[:, 0], pairs[:, 1]]
        worst = dots.argmax(1)
        bad = np.flatnonzero(dots[np.arange(n), worst] > tiny)
        if not len(bad):
            break
        i, j = pairs[worst[bad]].T
        turned = m[bad, i]
        others = np.ones((len(bad), 4), bool)
        others[np.arange(len(bad)), i] = others[np.arange(len(bad)), j] = False
        m[bad] += others[:, :, None] * turned[:, None, :]
        m[bad, i] = -turned
    dots = np.einsum("nic,ncd,njd->nij", m, g, m)[:, pairs[:, 0], pairs[:, 1]]
    done = dots.max(1) <= tiny
    seven = np.einsum("vi,nic->nvc", SEVEN, m)
    length = np.einsum("nvc,ncd,nvd->nv", seven, g, seven)
    order = np.argsort(np.round(length, 9), axis=1, kind="stable")
    triples = np.array(list(itertools.combinations(range(7), 3)))
    basis = np.take_along_axis(seven, order[:, :, None], 1)[:, triples]  # n, triple, axis, coefficient
    spans = np.abs(np.rint(np.linalg.det(basis.astype(float)))) == 1
    size = np.where(spans, np.sqrt(np.take_along_axis(length, order, 1))[:, triples].sum(2), np.inf)
    out = basis[np.arange(n), size.argmin(1)]
    dots = np.einsum("nic,ncd,njd->nij", out, g, out)
    bc, ac, ab = dots[:, 1, 2], dots[:, 0, 2], dots[:, 0, 1]
    acute = bc * ac * ab > 0
    # signs of a and b (against c) that make all three products positive, or none
    want = np.where(acute, 1, -1)
    sign = np.ones((n, 3), int)
    sign[:, 1] = np.where(np.where(np.abs(bc) > tiny, np.sign(bc), want) == want, 1, -1)
    sign[:, 0] = np.where(np.where(np.abs(ac) > tiny, np.sign(ac), want) == want, 1, -1)
    free = (np.abs(ac) <= tiny) & (sign[:, 0] * sign[:, 1] * np.sign(ab) * want < 0)
    sign[free, 0] *= -1
    free = (np.abs(bc) <= tiny) & (sign[:, 0] * sign[:, 1] * np.sign(ab) * want < 0)
    sign[free, 1] *= -1
    return out * sign[:, :, None] * done[:, None, None]


def reduce_triclinic(df: DataFrame, key: str) -> DataFrame:
    """(key, a, ..., gamma, axes) of the reduced cells: shortest axes first, angles all acute or all obtuse.

    axes: the nine integers of the matrix that gives the new axes, and new hkl,
    from the old. Null where the cell isn't physical. df has the six columns of
    a cell in angstrom and radians.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            cell = pdf[list(NAMES)].to_numpy(float)
            with np.errstate(invalid="ignore"):
                g = metric(cell)
                fine = np.isfinite(cell).all(1) & (cell[:, :3] > 0).all(1)
                fine[fine] = np.linalg.det(g[fine]) > 1e-9 * np.prod(cell[fine, :3], axis=1) ** 2
            out = pd.DataFrame({key: pdf[key]})
            values, axes = np.full(cell.shape, np.nan), [None] * len(pdf)
            if fine.any():
                m = reduced(g[fine])
                fine[fine] = m.any((1, 2))
                m = m[m.any((1, 2))]
                values[fine] = cell_of(np.einsum("nic,ncd,njd->nij", m, g[fine], m))
                for i, row in zip(np.flatnonzero(fine), m.reshape(-1, 9).tolist(), strict=True):
                    axes[i] = row
            for i, name in enumerate(NAMES):
                out[name] = pd.Series(values[:, i]).astype(object).where(fine, None).to_numpy() if not fine.all() else values[:, i]
            out["axes"] = axes
            yield out

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in NAMES) + ", axes array<int>"
    return df.select(key, *[F.col(n).cast("double").alias(n) for n in NAMES]).mapInPandas(run, schema)
