"""Copies of entries, donors of lost rows, ordinals, order statistics and nearest references, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import augmentation as aug
from cellspark.operators import candidates, curation, patterns, peaks, reduction, stats


@pytest.fixture(scope="module")
def cells(spark):
    r = np.random.default_rng(7)
    rows = []
    for i in range(300):
        g = i % 3
        z = r.normal(size=3)
        a, b, c = sorted((6 + 0.8 * z[0] * (g + 1) / 2, 9 + 0.5 * z[0] + 0.3 * z[1], 14 + 0.4 * z[2]))
        rows.append((i, g, float(a), float(b), float(c)))
    return spark.createDataFrame(rows, "id long, g int, a double, b double, c double")


def test_moments_of_copies(spark, cells):
    """The changes have the covariance of the group, times the square of the share; draws don't depend on partitions."""
    names = ["a", "b", "c"]
    spread = aug.group_spread(cells, "g", names)
    own = {g: np.array([[r[n] for n in names] for r in cells.where(F.col("g") == g).collect()]) for g in (0, 1, 2)}
    for g, m in spread.items():
        assert np.allclose(m @ m.T, np.cov(own[g].T), rtol=0.05, atol=0.01)
    for method in ("covariance", "principal"):
        told = []
        for n in (1, 6):
            out = aug.augment_entries(cells.repartition(n), "id", "g", names, "orthorhombic", method, 20, share=0.2).collect()
            told.append(sorted((r["id"], r["copy"], tuple(r["cell"])) for r in out))
        assert [x[:2] for x in told[0]] == [x[:2] for x in told[1]] and len(told[0]) == 6000
        assert np.allclose([x[2] for x in told[0]], [x[2] for x in told[1]], rtol=1e-9)  # sums of the covariance in another order
        truth = {r["id"]: (r["g"], np.array([r[n] for n in names])) for r in cells.collect()}
        for g in (0, 1, 2):
            d = np.array([np.array(c) - truth[i][1] for i, _, c in told[0] if truth[i][0] == g])
            want = 0.04 * np.cov(own[g].T) / (3 if method == "principal" else 1)
            assert np.allclose(np.cov(d.T), want, atol=0.35 * np.abs(want).max())
            assert np.abs(d.mean(0)).max() < 0.05
    assert all(list(c) == sorted(c) for _, _, c in told[0])


def test_odd_copies(spark):
    rows = [(1, "x", 5.0, 6.0, 7.0, 1.8), (2, "x", None, 6.0, 7.0, 1.8), (3, "x", float("nan"), 6.0, 7.0, 1.8), (4, None, 5.5, 6.1, 7.2, 1.7), (5, "alone", 5.0, 6.0, 9.0, 1.9), (6, "x", 300.0, 310.0, 320.0, 1.8)]
    df = spark.createDataFrame(rows, "id int, g string, a double, b double, c double, beta double").withColumn("q", F.lit("clash"))
    for method in aug.METHODS:
        out = aug.augment_entries(df, "id", "g", ["a", "b", "c", "beta"], "monoclinic", method, F.when(F.col("id") == 4, 0).otherwise(2), share=0.01, n_peaks=12).collect()
        assert {r["id"] for r in out} <= {1, 5, 6} and {1, 5} <= {r["id"] for r in out} or method != "scale"
        for r in out:
            a, b, c, beta = r["cell"]
            assert a <= c and beta >= math.pi / 2 and 2.25 <= min(a, b, c) and max(a, b, c) <= 250 and len(r["q"]) == 12 and list(r["q"]) == sorted(r["q"])
    with pytest.raises(ValueError):
        aug.augment_entries(df, "id", "g", ["a", "b", "c", "beta"], "monoclinic", "other", 1)
    assert aug.augment_entries(df.limit(0), "id", "g", ["a", "b", "c", "beta"], "monoclinic", "covariance", 1).count() == 0


def test_donors(spark):
    rows = [(i, i % 4 if i % 4 else None, None if i % 5 == 0 else float(i), float("nan") if i % 7 == 0 else 2.0 * i, "s") for i in range(200)] + [(500, 9, None, 1.0, "s")]
    df = spark.createDataFrame(rows, "id long, g int, a double, b double, s string")
    outs = [sorted(map(tuple, candidates.with_donors(df.repartition(n), ["g"], "id", ["a", "b"]).collect()), key=str) for n in (1, 7, 31)]
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == 201
    sound = {(g, a, b) for _, g, a, b, _ in rows if a is not None and b == b}
    for i, g, a, b, _ in outs[0]:
        assert (g, a, b) in sound or i == 500 and a is None and b == 1.0
    assert sorted(map(tuple, candidates.with_donors(df.where("id % 5 <> 0 AND id % 7 <> 0"), ["g"], "id", ["a", "b"]).collect()), key=str) == sorted((r for r in rows if r[0] % 5 and r[0] % 7), key=str)


def test_ordinals(spark):
    rows = [(i * 7919 % 1000, f"k{i % 10}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "x int, k string, i int")
    for n, ranges in ((1, 64), (9, 5), (3, 1)):
        got = {r["i"]: r["place"] for r in curation.ordinals(df.repartition(n), ["k", "x"], "place", ranges).collect()}
        want = {i: p + 1 for p, (_, _, i) in enumerate(sorted(((k, x, i) for x, k, i in rows)))}
        assert got == want
    assert curation.ordinals(df.limit(0), ["k"], "place").count() == 0
    assert "SinglePartition" not in str(df) and [r["place"] for r in curation.ordinals(spark.createDataFrame([(None,), ("a",)], "k string"), ["k"], "place").orderBy("k").collect()] == [1, 2]


@pytest.mark.parametrize("sent", [4096, 1])
def test_order_statistics(spark, monkeypatch, sent):
    monkeypatch.setattr(stats, "SENT_GROUPS", sent)
    r = np.random.default_rng(3)
    rows = [(int(g) if g else None, float(v)) for g, v in zip(r.integers(0, 4, 3000), np.where(r.random(3000) < 0.4, 5.0, np.round(r.normal(5, 2, 3000), 2)), strict=True)] + [(1, None), (2, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(x["g"], x["fraction"]): x["value"] for x in stats.order_quantile(df, "v", fractions, ["g"]).collect()}
    for g in (None, 1, 2, 3):
        v = sorted(b for a, b in rows if a == g and b is not None)
        assert all(got[g, f] == v[min(int(f * len(v)), len(v) - 1)] for f in fractions)
    v = sorted(b for _, b in rows if b is not None)
    assert {x["fraction"]: x["value"] for x in stats.order_quantile(df, "v", fractions).collect()} == {f: v[min(int(f * len(v)), len(v) - 1)] for f in fractions}
    assert stats.order_quantile(df.limit(0), "v", [0.5]).count() == 0


def test_nearest_by_halving(spark):
    r = np.random.default_rng(9)
    rows = []
    for i in range(200):
        refs = sorted(set(np.round(r.uniform(0, 1, r.integers(0, 40)), 2).tolist()))
        rows.append((i, float(np.round(r.uniform(-0.1, 1.1), 2)), refs))
    rows += [(900, None, [1.0]), (901, 0.5, []), (902, 0.5, [0.4, 0.6])]
    df = spark.createDataFrame(rows, "id long, q double, refs array<double>")
    out = df.select("*", peaks.nearest(F.col("q"), F.col("refs")).alias("n"), peaks.k_nearest(F.col("q"), F.col("refs"), 4).alias("k"), patterns.nearest_source_peak(F.array("q"), F.col("refs")).alias("s"))
    for x in out.collect():
        if x["q"] is None:
            assert x["n"] is None and x["k"] is None
            continue
        want = sorted((abs(v - x["q"]), i, v) for i, v in enumerate(x["refs"]))
        assert ([tuple(z) for z in x["k"]]) == want[:4]
        assert (tuple(x["n"]) if x["n"] else None) == (want[0] if want else None)
        assert x["s"] == [want[0][2] if want else None]
    repeated = spark.createDataFrame([(0.5, [0.1, 0.4, 0.4, 0.4, 0.9])], "q double, refs array<double>")
    assert repeated.select(peaks.nearest(F.col("q"), F.col("refs"))["i"]).first()[0] == 1


def test_unfinished_reduction():
    g = reduction.metric(np.array([[5.0, 6.0, 7.0, 1.2, 1.1, 0.9], [5.0, 6.0, 7.0, 1.6, 1.7, 1.8]]))
    skewed = np.array([[1, 0, 0], [40, 1, 0], [900, 30, 1]])
    h = np.einsum("ic,ncd,jd->nij", skewed, g, skewed)
    assert not reduction.reduced(h, steps=2).any() and (np.abs(np.linalg.det(reduction.reduced(h))) > 0.5).all()
