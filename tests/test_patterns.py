"""Peaks, triplets and draws on small inputs with known results."""

import math

import numpy as np
import pytest

from cellspark.operators import patterns as op


def test_fit_peaks(spark):
    x = np.linspace(0, 0.2, 2001)
    true = [(100.0, 0.05, 0.0008), (40.0, 0.0712, 0.0012), (60.0, 0.15, 0.001)]
    y = sum(a * np.exp(-(((x - c) / s) ** 2) / 2) for a, c, s in true)
    rows = [(1, x.tolist(), y.tolist(), [0.0505, 0.0709, 0.1497]), (2, x.tolist(), (0 * y).tolist(), [0.1]), (3, x.tolist(), y.tolist(), [])]
    df = spark.createDataFrame(rows, "id int, x array<double>, y array<double>, p array<double>")
    out = {(r["id"], r["peak"]): r for r in op.fit_peaks(df, "id", "x", "y", "p").collect()}
    assert len(out) == 4
    for (a, c, s), p in zip(true, rows[0][3], strict=True):
        r = out[1, p]
        assert (r["centre"], r["breadth"], r["amplitude"]) == (pytest.approx(c, abs=1e-5), pytest.approx(s, rel=0.01), pytest.approx(a, rel=0.01))
    line = op.breadth_line(op.fit_peaks(df, "id", "x", "y", "p").where("id = 1"), ["id"]).first()
    want = np.polyfit([c for _, c, _ in true], [s for *_, s in true], 1)
    assert line["slope"] == pytest.approx(want[0], rel=0.05) and line["intercept"] == pytest.approx(want[1], rel=0.05)


def test_pick_peaks(spark):
    df = spark.createDataFrame([(1, [0, 5, 1, 7, 2, 9, 0, 1, 0])], "id int, y array<int>")
    got = df.select(op.pick_peaks(df["y"], 0.0, 1.0, 2, 2, (0,), (0.5,), {1: 0.25}).alias("p"), op.pick_secondary(df["y"], 0.0, 1.0, 2, (0, 2)).alias("s")).first()
    assert got["p"] == [0.5, 3.75] and got["s"] == [1.5, 5.5]


def test_pairs_and_triplets(spark):
    """Two peaks whose reflections stand at 60 degrees (or 120), and one pair at a right angle."""
    rows, r = [], np.random.default_rng(2)
    for f in range(400):
        angle = math.radians(60 if f % 2 else 120) + r.normal(0, 0.003)
        rows += [(f, 0, 1.0, 1.0, 0.0), (f, 1, 4.0, 2 * math.cos(angle), 2 * math.sin(angle)), (f, 2, 9.0, 3 * math.cos(1.55), 3 * math.sin(1.55)), (f, 3, 50.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "frame int, n int, q double, x double, y double")
    pairs = op.pair_observations(df, "frame", ["n"], "q", ["x", "y"], [1.0, 4.0, 9.0], [0.1, 0.1, 0.1])
    assert pairs.count() == 1200 and {(p["p0"], p["p1"]) for p in pairs.collect()} == {(0, 1), (0, 2), (1, 2)}
    got = {(t["p0"], t["p1"]): t for t in op.pick_triplets(pairs, [1.0, 4.0, 9.0]).collect() if t["weight"] > 60}
    assert got[0, 1]["angle"] == pytest.approx(math.pi / 3, abs=0.005) and got[0, 1]["q2_diff"] == pytest.approx(3.0, abs=0.05)
    assert got[0, 2]["angle"] == math.pi / 2 and got[0, 2]["q2_diff"] == pytest.approx(10.0)


def test_draws(spark):
    df = spark.createDataFrame([(i, [[10.0 + 0.1 * j + 0.01 * k for k in range(3)] for j in range(5)]) for i in range(200)], "id int, p array<array<double>>")
    out = [op.resample_predictions(df.repartition(n), "id", "p", 12).collect() for n in (1, 7)]
    a, b = ({(r["id"], r["candidate_id"]): tuple(r["values"]) for r in o} for o in out)
    assert a == b and len(a) == 2400
    drawn = np.array([v for (_, c), v in a.items() if c >= 5])
    assert np.allclose(drawn.mean(0), [10.2, 10.21, 10.22], atol=0.03) and drawn.std(0) == pytest.approx([0.158] * 3, rel=0.15)
    few = op.resample_predictions(df, "id", "p", 3).where("id = 1").collect()
    assert all(list(r["values"]) in df.first()["p"] for r in few) and len({tuple(r["values"]) for r in few}) == 3
    cells = spark.createDataFrame([(1, 5.0, 6.0, 7.0, 3), (2, 3.0, 3.0, 3.0, 0), (3, 1.0, 5.0, 5.0, 2)], "id int, a double, b double, c double, n int")
    got = op.augment_cells(cells, "id", ["a", "b", "c"], cells["n"], 0.05).collect()
    assert sorted((r["id"], r["copy"]) for r in got) == [(1, 1), (1, 2), (1, 3)]
    assert all(2.25 <= r["a"] <= r["b"] <= r["c"] <= 250 and abs(r["b"] - 6) < 2 for r in got)


def test_principal_axes(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 2)) @ np.diag([3.0, 0.5]) @ np.array([[0.8, 0.6], [-0.6, 0.8]])
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in x] + [(1, 2.0, 2.0)], "g int, a double, b double")
    out = {(o["g"], o["component"]): o for o in op.principal_axes(df, ["a", "b"], ["g"]).collect()}
    assert out[0, 0]["variance"] == pytest.approx(9, rel=0.1) and out[0, 1]["variance"] == pytest.approx(0.25, rel=0.1)
    assert out[0, 0]["axis"] == pytest.approx([0.8, 0.6], abs=0.03)


def test_tune_mix(spark):
    """Only the second generator comes near the truth: its whole share is best."""
    rows = [(g, "far", 5.0 + i / 100) for g in range(5) for i in range(20)] + [(g, "near", 0.1 + i / 1000) for g in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, generator string, d double")
    assert op.tune_mix(df, ["g"], "generator", "d", [(0.5, 0.05), (1.0, 0.05)], [0.0, 0.5, 1.0], ("far", "near")).first()["share"] == 0.0
