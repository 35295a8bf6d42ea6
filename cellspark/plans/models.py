"""Queries that fit and apply models on the given tables."""

from pyspark.sql import functions as F

from cellspark.operators import models as op
from cellspark.operators.forests import predict_trees
from cellspark.plans.peaks import arrays
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view

QS = [f"q{i}" for i in range(10)]


def peaks_wide(spark, sf_dir):
    v = arrays(spark, sf_dir, "first_peaks").where(F.size("q2") == 10)
    return v.select("pattern_id", *[F.get("q2", F.lit(i)).alias(n) for i, n in enumerate(QS)])


@query()
def m1_m2_cell_forest(spark, sf_dir):
    """Every tree's prediction of the last peak from the first five."""
    v = peaks_wide(spark, sf_dir)
    model = op.fit_cell_forest(v, QS[:5], ["q9"], trees=5, depth=4)["q9"]
    return predict_trees(v, model).select("pattern_id", "trees", "trees_mean", "trees_var")


@query()
def m3_fit_volume_forest(spark, sf_dir):
    v = peaks_wide(spark, sf_dir).withColumn("volume", F.sqrt(F.col("q0") * F.col("q1") * F.col("q2")))
    return op.fit_cell_forest(v, QS, ["volume"], trees=5, depth=4)["volume"].transform(v).select("pattern_id", "volume", "volume_pred")


@query()
def m4_fit_template_score(spark, sf_dir):
    v = peaks_wide(spark, sf_dir)
    return op.fit_template_score(v, QS[:3], "q4", rounds=5).transform(v).select("pattern_id", F.col("prediction").alias("score"))


@query()
def m5_augmentation_test(spark, sf_dir):
    v = peaks_wide(spark, sf_dir).withColumn("made", (F.col("pattern_id") % 2).cast("double"))
    return op.augmentation_test(v, QS[:4], "made", trees=5)[1]


@query()
def m6_grid_search(spark, sf_dir):
    return op.grid_search(peaks_wide(spark, sf_dir), QS[:3], "q4", [2, 4], [3], folds=2)


P = WITH["predictions"]


@query(f"{P}, m AS (SELECT avg(y_pred) AS m, stddev_samp(y_pred) AS s FROM v WHERE train) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CASE grp WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS DOUBLE) AS label_index, round((y_pred - m) / s, 6) + 0e0 AS scaled FROM v, m WHERE NOT train")
def m7_encode_and_scale(spark, sf_dir):
    v = view(spark, sf_dir, "predictions")
    model = op.encode_and_scale(v.where("train"), "grp", ["y_pred"])
    return op.scaled(v.where("NOT train"), model).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "label_index", (F.round(F.get("scaled", F.lit(0)), 6) + 0.0).alias("scaled"))


@query()
def m8_fit_lattice_classifier(spark, sf_dir):
    v = peaks_wide(spark, sf_dir).withColumn("lattice", F.when(F.col("q0") < 0.004, "wide").otherwise("narrow"))
    return op.fit_lattice_classifier(v, QS[:3], "lattice", [4], steps=20).transform(v).select("pattern_id", "lattice", "prediction")
