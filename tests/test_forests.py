"""Forests as flat arrays against MLlib's own predictions, and the candidates made from them."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from cellspark.operators import forests, indexing
from cellspark.operators.models import assembled


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(2)
    x = r.uniform(0, 1, (400, 4))
    rows = [(i, *map(float, v), float(v[0] + 2 * v[1] * v[2]), float(v[3] - v[0]), float(v[0]), "left" if i % 3 else "right") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, f0 double, f1 double, f2 double, f3 double, t0 double, t1 double, ratio double, kind string")


FEATURES = ["f0", "f1", "f2", "f3"]


def test_walk_equals_mllib(spark, table):
    rows = assembled(FEATURES).transform(table)
    model = RandomForestRegressor(featuresCol="features", labelCol="t0", numTrees=30, maxDepth=7, seed=3).fit(rows)
    forest = forests.flattened(model)
    x = np.array([[r[f] for f in FEATURES] for r in table.orderBy("id").collect()])
    each = forests.walk(forest, x)
    assert each.shape == (400, 30)
    for k in (0, 7, 29):
        want = [r["prediction"] for r in model.trees[k].transform(rows).orderBy("id").collect()]
        assert each[:, k].tolist() == want
    want = [r["prediction"] for r in model.transform(rows).orderBy("id").collect()]
    assert np.allclose(each.mean(1), want, rtol=1e-12)
    stump = RandomForestRegressor(featuresCol="features", labelCol="t0", numTrees=2, maxDepth=0, seed=3).fit(rows)
    both = forests.merged([forests.flattened(stump), forest])
    assert (forests.walk(both, x)[:, 2:] == each).all() and len(set(forests.walk(both, x)[:, 0])) == 1


def test_forests_by_group_and_bin(spark, table):
    odd = table.union(spark.createDataFrame([(900, None, 0.1, 0.1, 0.1, 1.0, 1.0, 0.5, "left")], table.schema))
    model = forests.fit_cell_forests(odd, FEATURES, ["t0", "t1"], ratio="ratio", group="kind", weight="t0", bins=3, trees=4, depth=4, share=1.0)
    assert set(model.groups) == {"left", "right"} and len(model.edges) == 4 and all(len(f.root) == 12 for f in model.groups["left"])
    inside = [table.where((F.col("ratio") >= a) & (F.col("ratio") < b)).count() for a, b in zip(model.edges, model.edges[1:], strict=False)]
    assert max(inside) - min(inside) <= 2
    out = forests.predict_cells(odd.repartition(5), model, "id", "left").orderBy("id").collect()
    assert len(out) == 401 and out[-1]["trees"] is None and out[-1]["mean"] is None
    for r in out[:50]:
        t = np.array(r["trees"])
        assert t.shape == (2, 12) and np.allclose(r["mean"], t.mean(1)) and np.allclose(r["var"], t.var(1))
    truth = {r["id"]: r["t0"] for r in table.collect()}
    # the trees of each row's own bin are near; all bins together hold one that is
    assert np.mean([min(abs(np.array(r["trees"])[0] - truth[r["id"]])) < 0.3 for r in out[:400]]) > 0.95


def test_cells_to_coefficients():
    cells = {"cubic": [5.0], "tetragonal": [4.0, 6.0], "hexagonal": [4.9, 5.4], "rhombohedral": [6.0, 1.2], "orthorhombic": [4.0, 5.0, 6.0], "monoclinic": [5.0, 6.0, 7.0, 1.8], "triclinic": [5.0, 6.0, 7.0, 1.5, 1.7, 1.8]}
    for system, c in cells.items():
        x = forests.xnn_of_cells(np.array([c, c]), system)
        assert x.shape == (2, len(c))
        if system == "hexagonal":
            assert np.allclose(x[0], [4 / 3 / 4.9**2, 1 / 5.4**2])
        if system == "orthorhombic":
            assert np.allclose(x[0], [1 / 16, 1 / 25, 1 / 36])
    assert np.isnan(forests.xnn_of_cells(np.array([[5.0, 5, 5, 1.0, 2.5, 1.0]]), "triclinic")).all()
    for system in cells:
        u = np.random.default_rng(1).uniform(0, 1, (200, 6))
        x = forests.random_coefficients(u, system, np.full(200, 0.004))
        assert np.allclose(indexing.reciprocal_volume(x, system), 0.004, rtol=1e-6), system


def test_candidates_from_models(spark):
    r = np.random.default_rng(5)
    cells = np.sort(r.uniform(4, 12, (300, 3)), 1)
    rows = spark.createDataFrame([(i, (1 / c**2).tolist(), *map(float, c)) for i, c in enumerate(cells)], "id long, xnn array<double>, a double, b double, c double")
    q = indexing.peaks_of_cells(rows, "id", "xnn", "oP", 10)
    names = [f"q{i}" for i in range(10)]
    wide = rows.join(q.select(F.col("pattern_id").alias("id"), "q", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)]), "id").withColumns({"ratio": F.col("a") / F.col("c"), "volume": 1 / (F.col("a") * F.col("b") * F.col("c"))})
    model = forests.fit_cell_forests(wide, names, ["a", "b", "c"], ratio="ratio", bins=2, trees=10, depth=6, share=0.8)
    volume = forests.fit_volume_forest(wide, names, "volume", F.col("id") % 4 != 0, trees=10, depth=6, share=0.8)
    assert volume.cdf[-1] == 1 and volume.limits[0] < volume.limits[1] and volume.rms_train <= volume.rms_held < volume.limits[1]
    patterns = q.where("pattern_id < 20").select("pattern_id", "q").union(spark.createDataFrame([(99, [0.1])], "pattern_id long, q array<double>"))
    made = {"trees": forests.tree_candidates(model), "predicted_volume": forests.volume_candidates(volume), "random": forests.volume_candidates(volume, predicted=False)}
    refs = indexing.reference_terms(spark, "oP")
    told = []
    for n in (1, 7):
        out = indexing.generate(patterns.repartition(n), refs, "orthorhombic", {"trees": 30, "predicted_volume": 6, "random": 3}, made).collect()
        told.append(sorted((x["pattern_id"], x["candidate_id"], x["generator"], tuple(x["xnn"])) for x in out))
    assert told[0] == told[1] and len(told[0]) == 20 * 39
    for p in range(20):
        own = [x for x in told[0] if x[0] == p]
        assert [x[1] for x in own] == list(range(39))
        best = min(np.abs(1 / np.sqrt(np.array(x[3])) / cells[p] - 1).max() for x in own if x[2] == "trees")
        assert best < 0.5
        volumes = [indexing.reciprocal_volume(np.array([x[3]]), "orthorhombic")[0] for x in own if x[2] == "random"]
        assert all(volume.limits[0] * 0.99 <= v <= volume.limits[1] * 1.01 for v in volumes)
    found = indexing.index_patterns(patterns, ["oP"], {"trees": 20, "templates": 10}, top=2, generators=made)
    assert found.where("m20 > 10").select("pattern_id").distinct().count() >= 5
