"""Queries on distributions and evaluation."""

from pyspark.sql import functions as F

from cellspark.operators import stats as op
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view

E, P, R, Y, K = (WITH[x] for x in ("entries", "peaks", "reflections", "predictions", "classes"))


def r9(*names):
    return [F.round(n, 9).alias(n) for n in names]


@query(f"{P}, g AS (SELECT CAST(unnest(range(0, 40)) AS INT) AS bin), c AS (SELECT CAST(least(floor((q2 - 0.0e0) / (0.1e0 / 40)), 39) AS INT) AS bin, count(*) AS n FROM v WHERE q2 BETWEEN 0 AND 0.1e0 GROUP BY 1) SELECT g.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / ((SELECT sum(n) FROM c) * (0.1e0 / 40)), 9) AS density FROM g LEFT JOIN c USING (bin)")
def a2_histogram(spark, sf_dir):
    return op.histogram(view(spark, sf_dir, "peaks"), "q2", 0.0, 0.1, 40, density=True).select("bin", "n", F.round("density", 9).alias("density"))


@query(f"{R} SELECT CAST(least(floor((s1x + 25) / 2.5e0), 19) AS INT) AS bx, CAST(least(floor((s1y + 6) / 0.6e0), 19) AS INT) AS by, count(*) AS n FROM v WHERE s1x BETWEEN -25 AND 25 AND s1y BETWEEN -6 AND 6 GROUP BY ALL")
def a3_histogram2d(spark, sf_dir):
    return op.histogram2d(view(spark, sf_dir, "reflections"), "s1x", "s1y", (-25.0, -6.0), (25.0, 6.0), 20)


@query(f"{K}, c AS (SELECT event_id % 10 AS place, truth AS label, count(*) AS n FROM v GROUP BY ALL) SELECT place, label, round(n / sum(n) OVER (PARTITION BY place), 9) AS share FROM c")
def a4_position_frequencies(spark, sf_dir):
    v = view(spark, sf_dir, "classes").select((F.col("event_id") % 10).alias("place"), F.col("truth").alias("label"))
    return op.position_frequencies(v, "place", "label").select("place", "label", *r9("share"))


@query(f"{R}, b AS (SELECT CAST(least(floor((s1x + 25) / 1.25e0), 39) AS INT) AS bin, s1y FROM v WHERE s1x BETWEEN -25 AND 25) SELECT bin, round(greatest(avg(s1y), (SELECT avg(s1y) FROM b)), 6) AS mean FROM b GROUP BY bin")
def a5_binned_mean(spark, sf_dir):
    return op.binned_mean(view(spark, sf_dir, "reflections"), "s1x", "s1y", -25.0, 25.0, 40).select("bin", F.round("mean", 6).alias("mean"))


_Q = "{w}, q(fraction) AS (VALUES (0.25e0), (0.5e0), (0.75e0), (0.99e0)), r AS (SELECT grp, y_true, row_number() OVER (PARTITION BY grp ORDER BY y_true) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM v) SELECT grp, fraction, y_true AS value FROM r JOIN q ON i = floor(fraction * n)"


@query(_Q.format(w=Y))
def a6_order_quantile(spark, sf_dir):
    return op.order_quantile(view(spark, sf_dir, "predictions"), "y_true", [0.25, 0.5, 0.75, 0.99], ["grp"])


@query(f"{Y} SELECT grp, round(avg(y_true), 4) AS mean_y_true, round(stddev_pop(y_true), 4) AS std_y_true, round(avg(y_pred), 4) AS mean_y_pred, round(stddev_pop(y_pred), 4) AS std_y_pred FROM v GROUP BY grp")
def a7_moments(spark, sf_dir):
    out = op.moments(view(spark, sf_dir, "predictions"), ["y_true", "y_pred"], ["grp"])
    return out.select("grp", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query(f"{WITH['cells']}, g AS (SELECT entry_id % 5 AS grp, a, b, c FROM v) SELECT grp, i, j, round(c, 6) AS covariance FROM (SELECT grp, unnest(['a','a','a','b','b','c']) AS i, unnest(['a','b','c','b','c','c']) AS j, unnest([covar_samp(a,a), covar_samp(a,b), covar_samp(a,c), covar_samp(b,b), covar_samp(b,c), covar_samp(c,c)]) AS c FROM g GROUP BY grp) x")
def a8_covariance(spark, sf_dir):
    v = view(spark, sf_dir, "cells").withColumn("grp", F.col("entry_id") % 5)
    return op.covariance(v, ["a", "b", "c"], ["grp"]).select("grp", "i", "j", F.round("covariance", 6).alias("covariance"))


@query(f"{R}, d AS (SELECT DISTINCT frame_id, item FROM v), s AS (SELECT item, count(*) AS n FROM d GROUP BY 1), j AS (SELECT x.item AS i, y.item AS j, count(*) AS joint FROM d x JOIN d y ON x.frame_id = y.frame_id AND x.item < y.item GROUP BY ALL) SELECT i, j, joint, round(joint / (a.n * b.n / (SELECT count(DISTINCT frame_id) FROM d)), 9) AS lift FROM j JOIN s a ON a.item = i JOIN s b ON b.item = j")
def a10_pair_lift(spark, sf_dir):
    return op.pair_lift(view(spark, sf_dir, "reflections"), "frame_id", "item").select("i", "j", "joint", *r9("lift"))


@query(f"{E}, h AS (SELECT lattice, CAST(least(floor((volume - 900) / 10e0), 9) AS INT) AS bin, count(*) AS n FROM v WHERE volume BETWEEN 900 AND 1000 GROUP BY ALL), g AS (SELECT DISTINCT lattice FROM v), f AS (SELECT g.lattice, b.bin, coalesce(h.n, 0) / (sum(coalesce(h.n, 0)) OVER (PARTITION BY g.lattice) * 10e0) AS d FROM g CROSS JOIN (SELECT CAST(unnest(range(0, 10)) AS INT) AS bin) b LEFT JOIN h ON h.lattice = g.lattice AND h.bin = b.bin) SELECT x.lattice AS g, y.lattice AS h, round(sum(abs(x.d - y.d) * CASE WHEN x.bin IN (0, 9) THEN 5e0 ELSE 10e0 END), 9) AS distance FROM f x JOIN f y ON x.bin = y.bin AND x.lattice < y.lattice GROUP BY ALL")
def a11_distribution_distance(spark, sf_dir):
    return op.distribution_distance(view(spark, sf_dir, "entries"), "lattice", "volume", 900.0, 1000.0, 10).select("g", "h", *r9("distance"))


@query(f"""{Y}, q AS (SELECT y_true, row_number() OVER (ORDER BY y_true) - 1 AS i, count(*) OVER () AS n FROM v), e AS (SELECT max(CASE WHEN i = floor(0.01e0 * n) THEN y_true END) AS lo, max(CASE WHEN i = floor(0.99e0 * n) THEN y_true END) AS hi FROM q),
b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(least(floor((greatest(lo, least(hi, y_true)) - lo) / ((hi - lo) / 25)), 24) AS INT) AS bin FROM v, e), n AS (SELECT bin, count(*) AS n FROM b GROUP BY 1)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(least(sqrt((SELECT max(n) FROM n) / n.n), 10), 9) AS weight FROM b JOIN n USING (bin)""")
def a15_inverse_density_weights(spark, sf_dir):
    return op.inverse_density_weights(view(spark, sf_dir, "predictions"), "y_true").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *r9("weight"))


@query(f"{K}, c AS (SELECT truth, count(*) AS n FROM v GROUP BY 1) SELECT CASE WHEN truth = 'click' THEN 'found' ELSE 'not_found' END AS outcome, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def a23_outcome_counts(spark, sf_dir):
    return view(spark, sf_dir, "classes").groupBy(F.when(F.col("truth") == "click", "found").otherwise("not_found").alias("outcome")).agg(F.count("*").alias("n"))


@query(f"{K}, d AS (SELECT CAST(floor(prob * 20) AS INT) / 20e0 AS distance, avg(CASE WHEN truth = guess AND event_id % 7 <> 0 THEN 1e0 ELSE 0 END) AS share FROM v GROUP BY 1) SELECT n, min(distance) AS radius FROM d, (VALUES (1), (2), (5)) t(n) WHERE share < 1e0 / n GROUP BY n")
def a24_convergence_radius(spark, sf_dir):
    """The least radius at which the success share falls under 1/n."""
    v = view(spark, sf_dir, "classes").withColumn("distance", F.floor(F.col("prob") * 20).cast("int") / F.lit(20.0))
    share = v.groupBy("distance").agg(F.avg(((F.col("truth") == F.col("guess")) & (F.col("event_id") % 7 != 0)).cast("double")).alias("share"))
    return share.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5)))).where(F.col("share") < 1 / F.col("n").cast("double")).groupBy("n").agg(F.min("distance").alias("radius"))


@query(f"{Y} SELECT grp, round(sum(ln(sqrt(2 * pi()) * y_std) + 0.5e0 * pow((y_pred - y_true) / y_std, 2)), 3) AS nll FROM v GROUP BY grp")
def a26_nll(spark, sf_dir):
    return op.nll(view(spark, sf_dir, "predictions"), F.col("y_pred") - F.col("y_true"), F.col("y_std"), ["grp"]).select("grp", F.round("nll", 3).alias("nll"))


@query(f"{E}, h AS (SELECT lattice, CAST(least(floor((volume - 900) / 10e0), 9) AS INT) AS bin, count(*) AS n FROM v WHERE volume BETWEEN 900 AND 1000 GROUP BY ALL) SELECT lattice, bin, round(sum(n) OVER (PARTITION BY lattice ORDER BY bin) / sum(n) OVER (PARTITION BY lattice), 9) AS cdf FROM h")
def w8_running_cdf(spark, sf_dir):
    h = op.histogram(view(spark, sf_dir, "entries"), "volume", 900.0, 1000.0, 10, ["lattice"]).where("n > 0")
    return op.running_cdf(h, ["lattice"], "bin", "n").select("lattice", "bin", *r9("cdf"))


@query(f"{Y}, q AS (SELECT y_true, row_number() OVER (ORDER BY y_true) - 1 AS i, count(*) OVER () AS n FROM v), e AS (SELECT CAST(row_number() OVER (ORDER BY f) AS INT) AS k, y_true AS x FROM q JOIN (SELECT unnest(range(1, 10)) / 10e0 AS f) t ON i = floor(f * n)), a AS (SELECT 0 AS k, 0e0 AS x UNION ALL SELECT * FROM e UNION ALL SELECT 10, 1e9) SELECT CAST(k AS INT) AS bin, x AS lo, nx AS hi FROM (SELECT k, x, lead(x) OVER (ORDER BY k) AS nx FROM a) z WHERE nx IS NOT NULL")
def w14_equal_count_bins(spark, sf_dir):
    return op.equal_count_edges(view(spark, sf_dir, "predictions"), "y_true", 10, 0.0, 1e9)


_ERR = f"""{Y}, e AS (SELECT grp, train, abs(y_pred - y_true) AS e FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY grp, train ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY grp, train) AS n FROM e)
SELECT grp, train, any_value(n) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS mae, {', '.join(f"max(CASE WHEN i = floor({f}e0 * n) THEN e END) AS q{p}" for f, p in ((0.25, 25), (0.5, 50), (0.75, 75)))} FROM r GROUP BY grp, train"""


@query(_ERR)
def e1_regression_errors(spark, sf_dir):
    return op.errors(view(spark, sf_dir, "predictions"), "y_true", "y_pred", ["grp", "train"]).select("grp", "train", "n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), "q25", "q50", "q75")


@query(f"{Y}, b AS (SELECT CAST(least(floor((y_std - 500) / 40e0), 24) AS INT) AS bin, y_pred - y_true AS e, y_std AS s FROM v WHERE y_std BETWEEN 500 AND 1500) SELECT bin, count(*) AS n, round(avg(abs(e)), 4) AS mean_error, round(stddev_pop(abs(e)), 4) AS std_error, round(sqrt(avg(s * s)), 4) AS rmv, round(sqrt(avg(e * e)), 4) AS rmse, round(abs(sqrt(avg(s * s)) - sqrt(avg(e * e))) / sqrt(avg(s * s)), 6) AS difference FROM b GROUP BY bin")
def e2_uncertainty_calibration(spark, sf_dir):
    out = op.calibration(view(spark, sf_dir, "predictions"), "y_true", "y_pred", "y_std", 500.0, 1500.0)
    return out.select("bin", "n", *[F.round(c, 4).alias(c) for c in ("mean_error", "std_error", "rmv", "rmse")], F.round("difference", 6).alias("difference"))


@query(f"{Y}, q AS (SELECT *, (y_pred - y_true) * (y_pred - y_true) AS m FROM v), r AS (SELECT *, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM q), t AS (SELECT max(CASE WHEN i = floor(0.75e0 * n) THEN m END) AS t FROM r) SELECT grp, m > t AS large, count(*) AS n, round(avg(y_true), 4) AS mean_true FROM q, t GROUP BY ALL")
def e3_large_error_profile(spark, sf_dir):
    v = view(spark, sf_dir, "predictions").withColumn("m", (F.col("y_pred") - F.col("y_true")) * (F.col("y_pred") - F.col("y_true")))
    limit = op.order_quantile(v, "m", [0.75]).select(F.col("value").alias("t"))
    return v.crossJoin(F.broadcast(limit)).groupBy("grp", (F.col("m") > F.col("t")).alias("large")).agg(F.count("*").alias("n"), F.round(F.avg("y_true"), 4).alias("mean_true"))


@query(f"{K} SELECT event_id % 10 AS place, round(avg(CASE WHEN truth = guess THEN 1e0 ELSE 0 END), 9) AS accuracy FROM v GROUP BY 1")
def e4_label_accuracy(spark, sf_dir):
    return view(spark, sf_dir, "classes").groupBy((F.col("event_id") % 10).alias("place")).agg(F.round(F.avg((F.col("truth") == F.col("guess")).cast("double")), 9).alias("accuracy"))


@query(f"{K}, l AS (SELECT min(prob) AS lo, max(prob) AS hi FROM v), b AS (SELECT CAST(least(floor((prob - lo) / ((hi - lo) / 25)), 24) AS INT) AS bin, prob, CASE WHEN truth = guess THEN 1e0 ELSE 0 END AS ok FROM v, l), g AS (SELECT bin, count(*) AS n, avg(prob) AS p, avg(ok) AS a FROM b GROUP BY bin) SELECT round(sum(n * abs(p - a)) / sum(n), 9) AS ece FROM g")
def e5_expected_calibration_error(spark, sf_dir):
    return op.expected_calibration_error(view(spark, sf_dir, "classes"), "truth", "guess", "prob").select(*r9("ece"))


@query(f"{K}, t AS (SELECT truth AS label, count(*) AS support, sum(CASE WHEN truth = guess THEN 1 ELSE 0 END) AS hit FROM v GROUP BY 1), g AS (SELECT guess AS label, count(*) AS said FROM v GROUP BY 1) SELECT t.label, support, round(hit / said, 9) AS \"precision\", round(hit / support, 9) AS recall, round(2 * (hit / said) * (hit / support) / (hit / said + hit / support), 9) AS f1 FROM t JOIN g ON t.label = g.label")
def e6_class_report(spark, sf_dir):
    return op.class_report(view(spark, sf_dir, "classes"), "truth", "guess").select("label", "support", *r9("precision", "recall", "f1"))


@query(f"{K} SELECT truth, guess, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS percent FROM v GROUP BY truth, guess")
def e6_confusion(spark, sf_dir):
    from pyspark.sql import Window

    n = view(spark, sf_dir, "classes").groupBy("truth", "guess").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("truth")), 6))


@query(f"{K}, r AS (SELECT user_id, prob, abs(prob - 0.5e0) AS d, row_number() OVER (PARTITION BY user_id ORDER BY prob DESC, event_id) AS k FROM v) SELECT user_id, max(CASE WHEN k = 1 THEN prob END) AS top, round(min(d), 9) AS closest FROM r WHERE k <= 5 GROUP BY user_id")
def e9_best_of_top_k(spark, sf_dir):
    from cellspark.operators.curation import ranked

    r = ranked(view(spark, sf_dir, "classes"), ["user_id"], [F.col("prob").desc(), F.col("event_id")]).where("_rank <= 5")
    return r.groupBy("user_id").agg(F.max("prob").alias("top"), F.round(F.min(F.abs(F.col("prob") - 0.5)), 9).alias("closest"))


@query(f"{K}, q AS (SELECT prob, row_number() OVER (ORDER BY prob) - 1 AS i, count(*) OVER () AS n FROM v), l AS (SELECT min(prob) AS lo, max(CASE WHEN i = floor(0.99e0 * n) THEN prob END) AS hi FROM q) SELECT CAST(least(floor((prob - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin, round(avg(CASE WHEN truth = guess THEN 1e0 ELSE 0 END), 9) AS accuracy FROM v, l WHERE prob BETWEEN lo AND hi GROUP BY 1")
def e10_binned_accuracy(spark, sf_dir):
    v = view(spark, sf_dir, "classes")
    ends = v.agg(F.min("prob").alias("lo")).crossJoin(op.order_quantile(v, "prob", [0.99]).select(F.col("value").alias("hi")))
    b = v.crossJoin(F.broadcast(ends)).withColumn("bin", op.bin_of(F.col("prob"), F.col("lo"), F.col("hi"), 40)).where("bin IS NOT NULL")
    return b.groupBy("bin").agg(F.round(F.avg((F.col("truth") == F.col("guess")).cast("double")), 9).alias("accuracy"))


@query(f"{K} SELECT truth, CAST(sum(CASE WHEN guess = truth THEN 1 ELSE 0 END) AS BIGINT) AS found, CAST(sum(CASE WHEN guess <> truth AND event_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS incorrect FROM v GROUP BY truth")
def e11_success_report(spark, sf_dir):
    o = F.when(F.col("guess") == F.col("truth"), "found").when(F.col("event_id") % 2 == 0, "incorrect").otherwise("other")
    out = view(spark, sf_dir, "classes").withColumn("o", o).groupBy("truth").pivot("o", ["found", "incorrect"]).count()
    return out.select("truth", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "incorrect")])
