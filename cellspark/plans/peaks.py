"""Queries on peak lists, reflections and candidate cells."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellspark.functions import optics
from cellspark.operators import peaks as op
from cellspark.operators import search, stats
from cellspark.operators.curation import ranked, top_n
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view

P, R, C, V = WITH["peaks"], WITH["reflections"], WITH["cells"], "WITH v AS (SELECT vec_id, embedding, label FROM embeddings)"
_A, _FIRST = (f"{WITH[x]}, a AS (SELECT pattern_id, list(q2 ORDER BY peak_index) AS q2 FROM v GROUP BY pattern_id)" for x in ("peaks", "first_peaks"))


def arrays(spark, sf_dir, name="peaks"):
    v = view(spark, sf_dir, name).groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct("peak_index", "q2"))).alias("r"))
    return v.select("pattern_id", F.transform("r", lambda x: x["q2"]).alias("q2"))


@query(f"{_A} SELECT pattern_id, CAST(len(q2) AS INT) AS n FROM a WHERE len(q2) >= 10 AND len(list_filter(q2, lambda x: x <> 0)) >= 10")
def p2_enough_peaks(spark, sf_dir):
    return op.enough_peaks(arrays(spark, sf_dir), 10).select("pattern_id", F.size("q2").alias("n"))


@query(f"{P} SELECT pattern_id, peak_index, q2 FROM v WHERE peak_index < 4")
def p3_first_n(spark, sf_dir):
    return op.first_n(arrays(spark, sf_dir), 4, ["q2"]).select("pattern_id", F.posexplode("q2").alias("peak_index", "q2"))


@query("SELECT p_partkey, CAST(p_partkey % 4 AS INT) AS h, CAST(p_partkey % 3 AS INT) AS k, CAST(p_partkey % 5 AS INT) AS l, CAST(3 AS INT) AS n FROM part")
def p4_zip_hkl(spark, sf_dir):
    """Index columns to one nested column and back."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    cols = part.select("p_partkey", *[F.array_repeat((F.col("p_partkey") % m).cast("int"), 3).alias(x) for x, m in (("h", 4), ("k", 3), ("l", 5))])
    nested = cols.select("p_partkey", op.zip_hkl("h", "k", "l").alias("hkl"))
    back = nested.select("p_partkey", *op.unzip_hkl("hkl"))
    return back.select("p_partkey", *[F.get(x, F.lit(1)).alias(x) for x in "hkl"], F.size("h").alias("n"))


_REFS = [0.004 * i for i in range(1, 26)]
_REF_SQL = "list_transform(range(1, 26), lambda i: 0.004e0 * i)"


def _refs():
    return F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: 0.004 * i)


@query(f"{P}, j AS (SELECT pattern_id, peak_index, CAST(r.i - 1 AS INT) AS ref_index, abs(0.004e0 * r.i - q2) AS d FROM v, (SELECT unnest(range(1, 26)) AS i) r), k AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, peak_index ORDER BY d, ref_index) AS k FROM j) SELECT pattern_id, peak_index, ref_index, round(d, 9) AS d FROM k WHERE k = 1")
def j5_assign_nearest(spark, sf_dir):
    n = op.nearest(F.col("q2"), _refs())
    return view(spark, sf_dir, "peaks").withColumn("n", n).select("pattern_id", "peak_index", F.col("n.i").alias("ref_index"), F.round("n.d", 9).alias("d"))


@query(f"{P}, j AS (SELECT pattern_id, peak_index, CAST(r.i - 1 AS INT) AS ref_index, abs(0.004e0 * r.i - q2) AS d FROM v, (SELECT unnest(range(1, 26)) AS i) r), k AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, peak_index ORDER BY d, ref_index) AS k FROM j) SELECT pattern_id, peak_index, CAST(k - 1 AS INT) AS place, ref_index FROM k WHERE k <= 3")
def j6_assign_k_nearest(spark, sf_dir):
    v = view(spark, sf_dir, "peaks").select("pattern_id", "peak_index", F.posexplode(op.k_nearest(F.col("q2"), _refs(), 3)).alias("place", "n"))
    return v.select("pattern_id", "peak_index", "place", F.col("n.i").alias("ref_index"))


@query(f"""{C}, w AS (SELECT avg(1 / (a*a)) AS x, avg(1 / (b*b)) AS y, avg(1 / (c*c)) AS z FROM v), g AS (SELECT h, k, l, h*h*x + k*k*y + l*l*z AS s FROM w, (SELECT CAST(unnest(range(0, 7)) AS INT) AS h), (SELECT CAST(unnest(range(0, 7)) AS INT) AS k), (SELECT CAST(unnest(range(0, 7)) AS INT) AS l) WHERE h + k + l > 0),
r AS (SELECT CAST(row_number() OVER (ORDER BY s, h, k, l) - 1 AS INT) AS ref_index, h, k, l FROM g) SELECT * FROM r WHERE ref_index < 59 UNION ALL SELECT 59, 0, 0, 0""")
def j18_reference_hkl(spark, sf_dir):
    """Reflections of a primitive orthorhombic lattice in order of their mean q2 over the cells of the table."""
    mean = view(spark, sf_dir, "cells").agg(*[F.avg(1 / (F.col(n) * F.col(n))).alias(n) for n in "abc"]).first()
    return search.reference_hkl(spark, "oP", "orthorhombic", 60, list(mean)).select("ref_index", "h", "k", "l")


@query("WITH p AS (SELECT p_partkey, p_partkey % 3 * (p_partkey % 3) + p_partkey % 4 * (p_partkey % 4) AS s FROM part), f(s, i) AS (VALUES (1, 0), (2, 1), (4, 3), (5, 4), (8, 6)) SELECT p_partkey, CAST(coalesce(f.i, 29) AS INT) AS label FROM p LEFT JOIN f ON f.s = p.s")
def j7_label_peaks(spark, sf_dir):
    """Terms that no reference has, or two of them, get the sentinel; here 0, 9 and more than one for 3, 6."""
    refs = search.reference_hkl(spark, "cP", "cubic", 30, [1.0]).where("ref_index < 7 AND NOT array_contains(terms, 6)").select("ref_index", "terms")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array(((F.col("p_partkey") % 3) * (F.col("p_partkey") % 3) + (F.col("p_partkey") % 4) * (F.col("p_partkey") % 4)).cast("int")).alias("terms"))
    return op.label_peaks(part, refs, "terms", F.lit(29)).select("p_partkey", "label")


@query(f"{R}, u AS (SELECT frame_id FROM v GROUP BY 1 HAVING count(*) BETWEEN 3 AND 5), s AS (SELECT frame_id, item * 1000 + k3 AS id, s1x FROM v WHERE frame_id IN (SELECT frame_id FROM u)), n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY id, s1x) AS r FROM s) SELECT a.frame_id, a.id AS id1, b.id AS id2, round(abs(a.s1x - b.s1x), 6) AS difference FROM n a JOIN n b ON a.frame_id = b.frame_id AND a.r < b.r")
def j9_pairs_within_frame(spark, sf_dir):
    v = view(spark, sf_dir, "reflections").select("frame_id", (F.col("item") * 1000 + F.col("k3")).alias("id"), "s1x")
    pairs = op.pairs_within_frame(op.usable_frames(v, "frame_id", 3, 5), "frame_id", ["id", "s1x"], ["id", "s1x"])
    return pairs.select("frame_id", "id1", "id2", F.round(F.abs(F.col("s1x1") - F.col("s1x2")), 6).alias("difference"))


@query(f"{P}, c(x, y) AS (VALUES (0.01e0, 0.9e0), (0.03e0, 0.5e0), (0.06e0, 0.2e0), (0.08e0, 0.05e0)) SELECT pattern_id, peak_index, CASE WHEN q2 <= 0.01e0 THEN 0.9e0 WHEN q2 <= 0.03e0 THEN 0.5e0 WHEN q2 <= 0.06e0 THEN 0.2e0 ELSE 0.05e0 END AS y FROM v")
def j14_lookup_curve(spark, sf_dir):
    curve = spark.createDataFrame([(0, 0.01, 0.9), (0, 0.03, 0.5), (0, 0.06, 0.2), (0, 0.08, 0.05)], "g int, x double, y double")
    return op.lookup_curve(view(spark, sf_dir, "peaks").withColumn("g", F.lit(0)), curve, "q2", "x", "y", ["g"]).select("pattern_id", "peak_index", "y")


@query(f"{V} SELECT a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label WHERE sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) < 0.9e0")
def j15_neighbours(spark, sf_dir):
    return op.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 0.9, ["label"]).select("vec_id", "other")


@query(f"{R}, p(peak) AS (VALUES (-20e0), (-7.5e0), (3e0), (3.5e0), (18e0)), j AS (SELECT frame_id, k1, k2, k3, s1x, peak, abs(s1x - peak) AS d FROM v JOIN p ON abs(s1x - peak) <= 1.5e0), k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, k1, k2, k3, s1x ORDER BY d, peak) AS r FROM j) SELECT frame_id, k1, k2, k3, min(peak) AS peak FROM (SELECT frame_id, k1, k2, k3, arg_min(peak, d) AS peak FROM k WHERE r = 1 GROUP BY ALL) z GROUP BY ALL")
def j17_near_peak(spark, sf_dir):
    peaks = spark.createDataFrame([(x,) for x in (-20.0, -7.5, 3.0, 3.5, 18.0)], "peak double")
    key = ["frame_id", "k1", "k2", "k3"]
    return op.near_peak(view(spark, sf_dir, "reflections"), peaks, "s1x", "peak", 1.5, key).select(*key, "peak").distinct()


@query(f"{P}, l AS (SELECT *, q2 - lag(q2) OVER w AS a, lead(q2) OVER w - q2 AS b FROM v WINDOW w AS (PARTITION BY pattern_id ORDER BY peak_index)) SELECT pattern_id, peak_index, round(a, 9) AS before, round(b, 9) AS after, round(least(coalesce(a, b), coalesce(b, a)), 9) AS nearest FROM l")
def w7_neighbour_gaps(spark, sf_dir):
    w = Window.partitionBy("pattern_id").orderBy("peak_index")
    v = view(spark, sf_dir, "peaks").withColumn("a", F.col("q2") - F.lag("q2").over(w)).withColumn("b", F.lead("q2").over(w) - F.col("q2"))
    return v.select("pattern_id", "peak_index", F.round("a", 9).alias("before"), F.round("b", 9).alias("after"), F.round(F.least("a", "b"), 9).alias("nearest"))


@query(f"{P}, d AS (SELECT pattern_id, min(b.q2 - a.q2) AS m FROM v a JOIN v b USING (pattern_id) WHERE a.peak_index < b.peak_index GROUP BY 1) SELECT pattern_id, round(m, 9) AS separation FROM d WHERE m > 0.0005e0")
def a16_min_separation(spark, sf_dir):
    w = Window.partitionBy("pattern_id").orderBy("q2")
    gaps = view(spark, sf_dir, "peaks").withColumn("g", F.col("q2") - F.lag("q2").over(w))
    return gaps.groupBy("pattern_id").agg(F.min("g").alias("m")).where("m > 0.0005").select("pattern_id", F.round("m", 9).alias("separation"))


@query(f"{R}, p(peak) AS (VALUES (-20e0), (-7.5e0), (3e0), (18e0)) SELECT peak, median(s1x) AS median FROM v JOIN p ON abs(s1x - peak) <= 1.5e0 GROUP BY peak")
def a17_median_near(spark, sf_dir):
    peaks = spark.createDataFrame([(x,) for x in (-20.0, -7.5, 3.0, 18.0)], "peak double")
    return op.band_join(view(spark, sf_dir, "reflections"), peaks, "s1x", "peak", 1.5).groupBy("peak").agg(F.median("s1x").alias("median"))


_RQ = "{w}, q AS (SELECT *, CASE WHEN abs(cc) <= 1 THEN cc END AS c FROM (SELECT item, o, (z + oz) / sqrt((x+ox)*(x+ox) + (y+oy)*(y+oy) + (z+oz)*(z+oz)) AS cc FROM (SELECT item, s1x AS x, s1y AS y, s1z AS z FROM v) a, (VALUES (0, 0e0, 0e0, 0e0), (1, 0.5e0, 0e0, 0e0), (2, 0e0, -0.5e0, 1e0)) t(o, ox, oy, oz)))"


@query(f"{_RQ.format(w=R)}, s AS (SELECT o, item, stddev_pop(pow(2 * sin(acos(c) / 2) / 0.98e0, 2)) AS s FROM q GROUP BY ALL) SELECT CAST(o AS INT) AS \"offset\", round(sum(s), 7) AS spread FROM s GROUP BY o")
def a21_peak_spread(spark, sf_dir):
    s0 = [F.lit(0.0), F.lit(0.0), F.lit(1 / 0.98)]
    at = lambda x, y, z: optics.q2_of_beam(s0, [F.col("s1x") + x, F.col("s1y") + y, F.col("s1z") + z], 0.98)
    return op.peak_spread(view(spark, sf_dir, "reflections"), [(0, 0, 0), (0.5, 0, 0), (0, -0.5, 1)], at, "item").select("offset", F.round("spread", 7).alias("spread"))


@query(f"{P}, g AS (SELECT CAST(unnest(range(0, 101)) AS INT) AS g) SELECT pattern_id, g, round(sum((peak_index + 1) * exp(-0.5e0 * pow((0.001e0 * g - q2) / (0.00007e0 + 0.002e0 * q2), 2))), 6) AS y FROM v JOIN g ON abs(0.001e0 * g - q2) <= 5 * (0.00007e0 + 0.002e0 * q2) GROUP BY ALL")
def a27_profile(spark, sf_dir):
    v = view(spark, sf_dir, "peaks").withColumn("i", F.col("peak_index") + 1)
    return op.profile(v, ["pattern_id"], "q2", "i", (0.0, 0.1, 101), optics.breadth).select("pattern_id", "g", F.round("y", 6).alias("y"))


@query("SELECT user_id, round(value, 0) AS q2, CAST(sum(event_id % 10) AS BIGINT) AS intensity, CAST(max(event_id % 10 * 1000000000 + event_id) % 1000000000 AS BIGINT) AS strongest FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def a28_merge_equal_q2(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select("user_id", F.round("value", 0).alias("q2"), (F.col("event_id") % 10).alias("intensity"), F.col("event_id").alias("strongest"))
    return op.merge_equal_q2(v, ["user_id"], "q2", "intensity", "strongest")


_M20, _INFO = (f"""{x}, c AS (SELECT pattern_id, q2, list_transform(q2, lambda q: round(q / 0.004e0) * 0.004e0) AS qc FROM a)""" for x in (_FIRST, _A))


@query(f"{_M20}, m AS (SELECT pattern_id, qc[-1] AS top, list_sum(list_transform(list_zip(q2, qc), lambda z: abs(z[1] - z[2]))) / len(q2) AS e FROM c), b AS (SELECT *, len(list_filter({_REF_SQL}, lambda r: r < top)) AS n, list_max(list_filter({_REF_SQL}, lambda r: r < top)) AS g FROM m) SELECT pattern_id, round(CASE WHEN n > 0 AND e > 0 THEN g / (2 * n) / e ELSE 0 END, 6) AS m20 FROM b")
def a18_m20(spark, sf_dir):
    v = arrays(spark, sf_dir, "first_peaks").withColumn("qc", F.transform("q2", lambda q: F.round(q / 0.004) * 0.004))
    return v.select("pattern_id", F.round(search.m20(F.col("q2"), F.col("qc"), _refs()), 6).alias("m20"))


@query(f"{_INFO}, p AS (SELECT pattern_id, list_transform(list_zip(q2, qc), lambda z: 1 / (1 + 8 * pi() * z[1] * abs(sqrt(z[1]) - sqrt(z[2])) / (0.0001e0 * 32))) AS p FROM c) SELECT pattern_id, round(-log2(1 - exp(list_sum(list_transform(p, lambda x: ln(x))))), 6) AS m_info, CAST(len(list_filter(p, lambda x: x > 0.95e0)) AS INT) AS n_indexed FROM p")
def a19_m_info(spark, sf_dir):
    v = arrays(spark, sf_dir).withColumn("p", F.transform("q2", lambda q: search.peak_probability(q, F.round(q / 0.004) * 0.004, F.lit(0.0001), search.MULTIPLICITY["cP"])))
    m = search.m_info(F.col("p"))  # of many peaks just zero, whose sign round() would lose
    return v.select("pattern_id", F.when(m == 0, m).otherwise(F.round(m, 6)).alias("m_info"), search.n_indexed(F.col("p")).alias("n_indexed"))


@query(f"{P}, t AS (SELECT pattern_id, q2 AS y, peak_index + 1 AS a, (peak_index % 3) * (peak_index % 3) AS b, 0.001e0 + q2 / 10 AS s FROM v), h AS (SELECT pattern_id, sum(a*a/(s*s)) AS aa, sum(a*b/(s*s)) AS ab, sum(b*b/(s*s)) AS bb, sum(a*y/(s*s)) AS ay, sum(b*y/(s*s)) AS \"by\" FROM t GROUP BY 1) SELECT pattern_id, round((ay*bb - ab*\"by\") / (aa*bb - ab*ab), 9) AS x0, round((aa*\"by\" - ab*ay) / (aa*bb - ab*ab), 9) AS x1 FROM h WHERE abs(aa*bb - ab*ab) > 0")
def a22_weighted_lsq(spark, sf_dir):
    i = F.col("peak_index")
    out = search.weighted_lsq(view(spark, sf_dir, "peaks"), ["pattern_id"], F.col("q2"), [i + 1, (i % 3) * (i % 3)], 0.001 + F.col("q2") / 10)
    return out.select("pattern_id", F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"))


@query(f"{P}, r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY q2 DESC, peak_index) AS k FROM v) SELECT pattern_id, peak_index, q2 FROM r WHERE k <= 4")
def w1_top_n(spark, sf_dir):
    return top_n(view(spark, sf_dir, "peaks"), ["pattern_id"], [F.col("q2").desc(), F.col("peak_index")], 4).select("pattern_id", "peak_index", "q2")


@query(f"{P} SELECT pattern_id, peak_index, q2 FROM v ORDER BY q2 DESC, pattern_id, peak_index LIMIT 20")
def w2_rank_results(spark, sf_dir):
    return view(spark, sf_dir, "peaks").select("pattern_id", "peak_index", "q2").orderBy(F.desc("q2"), "pattern_id", "peak_index").limit(20)


@query(f"{P} SELECT pattern_id, peak_index, CASE WHEN peak_index % 3 = 0 THEN q2 * 2 WHEN peak_index % 3 = 1 THEN q2 ELSE q2 END AS score FROM v")
def w10_keep_improved(spark, sf_dir):
    old = view(spark, sf_dir, "peaks").select("pattern_id", "peak_index", F.col("q2").alias("score"))
    new = old.where("peak_index % 3 < 2").withColumn("score", F.col("score") * F.when(F.col("peak_index") % 3 == 0, 2).otherwise(0.5))
    return search.keep_improved(old, new, ["pattern_id", "peak_index"], "score")


@query(f"{P}, x AS (SELECT pattern_id, peak_index, f, (q2 * f) - floor(q2 * f * 100) / 100 AS s FROM v, (VALUES (1), (2), (4)) t(f)), r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id, peak_index ORDER BY s DESC, f) AS k FROM x) SELECT pattern_id, peak_index, f AS variant FROM r WHERE k = 1")
def w11_best_variant(spark, sf_dir):
    v = view(spark, sf_dir, "peaks").withColumn("variant", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).withColumn("s", F.col("q2") * F.col("variant") - F.floor(F.col("q2") * F.col("variant") * 100) / 100)
    return ranked(v, ["pattern_id", "peak_index"], [F.desc("s"), F.col("variant")]).where("_rank = 1").select("pattern_id", "peak_index", "variant")


@query(f"{P} SELECT pattern_id, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY sin(1000 * q2), peak_index) - 1 AS INT) AS place, peak_index FROM v")
def w12_sort_together(spark, sf_dir):
    v = view(spark, sf_dir, "peaks").groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct(F.sin(1000 * F.col("q2")).alias("s"), "peak_index"))).alias("r"))
    return v.select("pattern_id", F.posexplode("r").alias("place", "x")).select("pattern_id", "place", "x.peak_index")


@query(f"{P}, r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY q2, peak_index) AS k FROM v) SELECT pattern_id, round(avg(q2), 9) AS mean FROM r WHERE k <= 5 GROUP BY 1")
def w15_best_k_mean(spark, sf_dir):
    return ranked(view(spark, sf_dir, "peaks"), ["pattern_id"], [F.col("q2"), F.col("peak_index")]).where("_rank <= 5").groupBy("pattern_id").agg(F.round(F.avg("q2"), 9).alias("mean"))


@query(f"{P} SELECT pattern_id, q2, CAST(peak_index + CASE WHEN peak_index >= 3 THEN 1 ELSE 0 END - CASE WHEN peak_index > 1 THEN 1 ELSE 0 END AS INT) AS peak_index FROM v WHERE peak_index <> 1")
def w16_reindex_after_edit(spark, sf_dir):
    return op.reindex_after_edit(view(spark, sf_dir, "peaks"), "peak_index", [1], [3]).select("pattern_id", "q2", "peak_index")


@query(f"{P}, m AS (SELECT pattern_id, q2 FROM v WHERE peak_index < 6 AND peak_index <> 2 UNION ALL SELECT pattern_id, q2 + 0.0005e0 FROM v WHERE peak_index >= 8) SELECT pattern_id, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY q2) - 1 AS INT) AS place, round(q2, 9) AS q2 FROM m")
def w17_merge_peak_lists(spark, sf_dir):
    a = arrays(spark, sf_dir)
    merged = op.merge_peak_lists(F.slice("q2", 1, 6), F.transform(F.slice("q2", F.lit(9), F.size("q2")), lambda q: q + 0.0005), F.slice("q2", 3, 1))
    return a.select("pattern_id", F.posexplode(merged).alias("place", "q2")).select("pattern_id", "place", F.round("q2", 9).alias("q2"))


@query("""WITH y AS (SELECT user_id, CAST(least(floor(value / 5e0), 19) AS INT) AS x, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL), g AS (SELECT u.user_id, b.x, coalesce(y.n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT CAST(unnest(range(0, 20)) AS INT) AS x) b LEFT JOIN y ON y.user_id = u.user_id AND y.x = b.x),
t AS (SELECT *, sum(CASE WHEN n = p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY x) AS run FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY x) AS p FROM g)), r AS (SELECT user_id, run, min(x) AS s, max(x) AS e, any_value(n) AS n FROM t GROUP BY ALL), m AS (SELECT r.* FROM r JOIN g a ON a.user_id = r.user_id AND a.x = r.s - 1 JOIN g b ON b.user_id = r.user_id AND b.x = r.e + 1 WHERE a.n < r.n AND b.n < r.n),
pr AS (SELECT m.user_id, m.s, m.e, m.n, (SELECT min(g.n) FROM g WHERE g.user_id = m.user_id AND g.x < m.s AND g.x > coalesce((SELECT max(h.x) FROM g h WHERE h.user_id = m.user_id AND h.x < m.s AND h.n > m.n), -1)) AS lo, (SELECT min(g.n) FROM g WHERE g.user_id = m.user_id AND g.x > m.s AND g.x < coalesce((SELECT min(h.x) FROM g h WHERE h.user_id = m.user_id AND h.x > m.s AND h.n > m.n), 99)) AS hi FROM m)
SELECT user_id, CAST((s + e) // 2 AS INT) AS place, n AS height, n - greatest(lo, hi) AS prominence FROM pr WHERE n - greatest(lo, hi) >= 2""")
def w6_find_maxima(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/events.parquet")
    h = stats.histogram(v, "value", 0.0, 100.0, 20, ["user_id"]).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("y"))
    return h.select("user_id", F.explode(op.maxima(F.col("y"), 2)).alias("m")).select("user_id", F.col("m.i").alias("place"), F.col("m.height").alias("height"), F.col("m.prominence").alias("prominence"))


@query(f"{R} SELECT frame_id, k1, k2, k3 FROM v WHERE frame_id IN (SELECT frame_id FROM v GROUP BY 1 HAVING count(*) BETWEEN 3 AND 5)")
def r1_usable_frames(spark, sf_dir):
    return op.usable_frames(view(spark, sf_dir, "reflections"), "frame_id", 3, 5).select("frame_id", "k1", "k2", "k3")


_BIN = "CAST(least(floor((s1x + 25) / 2.5e0), 19) AS INT) AS bx, CAST(least(floor((s1y + 6) / 0.6e0), 19) AS INT) AS \"by\""
_MASK = f"""{R}, p AS (SELECT frame_id, k1, k2, k3, {_BIN} FROM v), c AS (SELECT bx, "by", count(*) AS n, CAST(least(floor((abs(bx - 10) + abs("by" - 10)) / 2e0), 9) AS INT) AS ring FROM p GROUP BY ALL), a AS (SELECT ring, greatest(avg(n), (SELECT avg(n) FROM c)) AS m FROM c WHERE ring IS NOT NULL GROUP BY 1), h AS (SELECT bx, "by" FROM c JOIN a USING (ring) WHERE n > 1.02e0 * m), k AS (SELECT DISTINCT bx + i AS bx, "by" + j AS "by" FROM h, (SELECT unnest([0]) AS i), (SELECT unnest([0]) AS j))"""
_BOX = ("s1x", "s1y", (-25.0, -6.0), (25.0, 6.0), 20)


def _mask(v):
    return op.detector_mask(v, *_BOX, F.abs(F.col("bx") - 10) + F.abs(F.col("by") - 10), 10, 1.02, 0)


@query(f'{_MASK} SELECT bx, "by" FROM k')
def r2_detector_mask(spark, sf_dir):
    return _mask(view(spark, sf_dir, "reflections")).select("bx", "by")


@query(f'{_MASK} SELECT frame_id, k1, k2, k3 FROM p ANTI JOIN k ON p.bx = k.bx AND p."by" = k."by"')
def r3_apply_mask(spark, sf_dir):
    v = view(spark, sf_dir, "reflections")
    return op.apply_mask(v, _mask(v), *_BOX).select("frame_id", "k1", "k2", "k3")


@query(f"{R}, s AS (SELECT frame_id, item, s1x FROM v WHERE frame_id IN (SELECT frame_id FROM v GROUP BY 1 HAVING count(*) BETWEEN 3 AND 5)), n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY item, s1x) AS r FROM s), d AS (SELECT abs(a.s1x - b.s1x) AS d FROM n a JOIN n b ON a.frame_id = b.frame_id AND a.r < b.r), h AS (SELECT CAST(least(floor(d / 2.5e0), 19) AS INT) AS bin, count(*) AS n FROM d WHERE d BETWEEN 0 AND 50 GROUP BY 1) SELECT b.bin, coalesce(h.n, 0) AS n FROM (SELECT CAST(unnest(range(0, 20)) AS INT) AS bin) b LEFT JOIN h USING (bin)")
def r6_difference_histogram(spark, sf_dir):
    v = op.usable_frames(view(spark, sf_dir, "reflections"), "frame_id", 3, 5)
    pairs = op.pairs_within_frame(v, "frame_id", ["item", "s1x"], ["s1x"]).select(F.abs(F.col("s1x1") - F.col("s1x2")).alias("d"))
    return stats.histogram(pairs, "d", 0.0, 50.0, 20)


_SUMS = [s for s in range(1, 80) if s % 8 != 7 and s not in (28, 60)]


@query(f"""{_FIRST}, s AS (SELECT {_SUMS}::DOUBLE[] AS s), c AS (SELECT pattern_id, q2 AS q, CAST(i AS INT) AS candidate_id, q2[1] / s[i + 1] AS x, s FROM a, s, (SELECT unnest(range(0, 12)) AS i) t WHERE len(q2) = 10),
e AS (SELECT *, list_transform(q, lambda z: s[list_min(list_transform(range(1, {len(_SUMS) + 1}), lambda k: {{'d': abs(s[k] * x - z), 'k': k}})).k]) AS t FROM c),
l AS (SELECT *, list_sum(list_transform(list_zip(q, t), lambda z: z[2] * z[1] / (z[1] * (abs(z[1] - z[2] * x) + 1e-10)))) / list_sum(list_transform(list_zip(q, t), lambda z: z[2] * z[2] / (z[1] * (abs(z[1] - z[2] * x) + 1e-10)))) AS y FROM e),
f AS (SELECT *, list_transform(q, lambda z: s[list_min(list_transform(range(1, {len(_SUMS) + 1}), lambda k: {{'d': abs(s[k] * y - z), 'k': k}})).k]) AS u FROM l),
m AS (SELECT pattern_id, candidate_id, x, y, len(list_filter(s, lambda r: r < t[10])) AS n0, list_max(list_filter(s, lambda r: r < t[10])) * x AS g0, list_sum(list_transform(list_zip(q, t), lambda z: abs(z[1] - z[2] * x))) / 10 AS e0,
  len(list_filter(s, lambda r: r < u[10])) AS n1, list_max(list_filter(s, lambda r: r < u[10])) * y AS g1, list_sum(list_transform(list_zip(q, u), lambda z: abs(z[1] - z[2] * y))) / 10 AS e1 FROM f),
w AS (SELECT pattern_id, candidate_id, x, y, CASE WHEN n0 = 0 THEN 0 WHEN e0 > 0 THEN g0 / (2 * n0) / e0 ELSE 'inf'::DOUBLE END AS m0, CASE WHEN n1 = 0 THEN 0 WHEN e1 > 0 THEN g1 / (2 * n1) / e1 ELSE 'inf'::DOUBLE END AS m1 FROM m),
b AS (SELECT pattern_id, candidate_id, CASE WHEN m1 > m0 THEN y ELSE x END AS x, greatest(m0, m1) AS m20 FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY m20 DESC, candidate_id) AS k FROM b)
SELECT pattern_id, candidate_id, round(x, 9) AS x, round(m20, 5) AS m20 FROM k WHERE k <= 5""")
def c8_cubic_search(spark, sf_dir):
    out = search.cubic_search(view(spark, sf_dir, "first_peaks"), _SUMS, top=5)
    return out.select("pattern_id", "candidate_id", F.round("x", 9).alias("x"), F.round("m20", 5).alias("m20"))
