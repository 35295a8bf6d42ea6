"""Peak picking and fitting, triplets, and draws from what is known."""

from pyspark.sql import functions as F

from cellspark.functions.cell import hkl_terms
from cellspark.operators import candidates, peaks, stats
from cellspark.operators import patterns as op
from cellspark.plans.peaks import arrays
from cellspark.plans.registry import ORACLE_SQL, query
from cellspark.plans.views import WITH, view

_W6 = ORACLE_SQL["w6_find_maxima"]


def histograms(spark, sf_dir):
    """(user_id, y): counts of the values of each user in twenty bins."""
    v = spark.read.parquet(f"{sf_dir}/events.parquet")
    h = stats.histogram(v, "value", 0.0, 100.0, 20, ["user_id"])
    return h.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("y"))


_PICKED = f"""m AS (SELECT user_id, place, row_number() OVER (PARTITION BY user_id ORDER BY place) - 1 AS k FROM ({_W6}) w),
p AS (SELECT user_id, (place + 0.5e0) * 5e0 AS p FROM m WHERE k < 20 AND k <> 1 UNION ALL SELECT user_id, 2.25e0 FROM (SELECT DISTINCT user_id FROM events) u)"""


def picked(spark, sf_dir):
    return histograms(spark, sf_dir).select("user_id", "y", op.pick_peaks(F.col("y"), 0.0, 5.0, 2, 20, (1,), (2.25,), {2: 0.5}).alias("peaks"))


@query(f"WITH {_PICKED}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p) - 1 AS place FROM p) SELECT user_id, CAST(place AS INT) AS place, round(p + CASE WHEN place = 2 THEN 0.5e0 ELSE 0e0 END, 9) AS peak FROM o")
def r4_pick_peaks(spark, sf_dir):
    return picked(spark, sf_dir).select("user_id", F.posexplode("peaks").alias("place", "peak")).select("user_id", "place", F.round("peak", 9).alias("peak"))


@query(f"WITH t AS (SELECT user_id, (place + 0.5e0) * 5e0 AS p FROM ({_W6}) w), e AS (SELECT DISTINCT user_id, value FROM events WHERE value IS NOT NULL), j AS (SELECT t.user_id, p, value, row_number() OVER (PARTITION BY t.user_id, p ORDER BY abs(value - p), value) AS k FROM t JOIN e ON e.user_id = t.user_id) SELECT user_id, p AS picked, value AS source FROM j WHERE k = 1")
def j8_nearest_source_peak(spark, sf_dir):
    """Maxima of each user's histogram mapped to that user's nearest value."""
    found = histograms(spark, sf_dir).select("user_id", F.transform(peaks.maxima(F.col("y"), 2), lambda m: (m["i"] + 0.5) * 5.0).alias("p"))
    true = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_set("value")).alias("t"))
    both = found.join(true, "user_id").select("user_id", F.arrays_zip(F.col("p").alias("p"), op.nearest_source_peak(F.col("p"), F.col("t")).alias("s")).alias("z"))
    return both.select("user_id", F.explode("z").alias("z")).select("user_id", F.col("z.p").alias("picked"), F.col("z.s").alias("source"))


@query()
def r5_fit_peaks(spark, sf_dir):
    """A Gaussian at each picked peak of each user's histogram."""
    x = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (i + 0.5) * 5.0)
    return op.fit_peaks(picked(spark, sf_dir).withColumn("x", x), "user_id", "x", "y", "peaks", 12.5)


_R6 = ORACLE_SQL["r6_difference_histogram"]


@query(f"""WITH g AS (SELECT bin AS x, n FROM ({_R6}) h), t AS (SELECT *, sum(CASE WHEN n = p THEN 0 ELSE 1 END) OVER (ORDER BY x) AS run FROM (SELECT *, lag(n) OVER (ORDER BY x) AS p FROM g)), r AS (SELECT run, min(x) AS s, max(x) AS e, any_value(n) AS n FROM t GROUP BY 1), m AS (SELECT r.* FROM r JOIN g a ON a.x = r.s - 1 JOIN g b ON b.x = r.e + 1 WHERE a.n < r.n AND b.n < r.n),
pr AS (SELECT m.*, (SELECT min(g.n) FROM g WHERE g.x < m.s AND g.x > coalesce((SELECT max(h.x) FROM g h WHERE h.x < m.s AND h.n > m.n), -1)) AS lo, (SELECT min(g.n) FROM g WHERE g.x > m.s AND g.x < coalesce((SELECT min(h.x) FROM g h WHERE h.x > m.s AND h.n > m.n), 99)) AS hi FROM m),
f AS (SELECT (CAST((s + e) // 2 AS INT) + 0.5e0) * 2.5e0 AS peak, row_number() OVER (ORDER BY s) - 1 AS k FROM pr WHERE n - greatest(lo, hi) >= 1) SELECT peak FROM f WHERE k IN (0, 2, 3)""")
def r7_pick_secondary(spark, sf_dir):
    v = peaks.usable_frames(view(spark, sf_dir, "reflections"), "frame_id", 3, 5)
    pairs = peaks.pairs_within_frame(v, "frame_id", ["item", "s1x"], ["s1x"]).select(F.abs(F.col("s1x1") - F.col("s1x2")).alias("d"))
    h = stats.histogram(pairs, "d", 0.0, 50.0, 20).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("y"))
    return h.select(F.explode(op.pick_secondary(F.col("y"), 0.0, 2.5, 1, (0, 2, 3))).alias("peak"))


_TRIPLETS, _BREADTHS = [-20.0, 0.0, 15.0], [3.0, 2.0, 4.0]
_NEAR = "list_min([" + ", ".join(f"{{'d': abs(s1x - ({p}e0)) / {b}e0, 'i': {i}}}" for i, (p, b) in enumerate(zip(_TRIPLETS, _BREADTHS, strict=True))) + "])"
_KEY = ["k1", "k2", "k3"]


def observed(spark, sf_dir):
    v = peaks.usable_frames(view(spark, sf_dir, "reflections"), "frame_id", 3, 6)
    return op.pair_observations(v, "frame_id", _KEY, "s1x", ["s1x", "s1y", "s1z"], _TRIPLETS, _BREADTHS)


@query(f"""{WITH['reflections']}, u AS (SELECT * FROM v WHERE frame_id IN (SELECT frame_id FROM v GROUP BY 1 HAVING count(*) BETWEEN 3 AND 6)), n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY k1, k2, k3, s1x, s1y, s1z) AS r, {_NEAR} AS m FROM u),
j AS (SELECT a.frame_id, a.m AS m, b.m AS o, (a.s1x - b.s1x) * (a.s1x - b.s1x) + (a.s1y - b.s1y) * (a.s1y - b.s1y) + (a.s1z - b.s1z) * (a.s1z - b.s1z) AS d, a.s1x * b.s1x + a.s1y * b.s1y + a.s1z * b.s1z AS t, sqrt(a.s1x * a.s1x + a.s1y * a.s1y + a.s1z * a.s1z) * sqrt(b.s1x * b.s1x + b.s1y * b.s1y + b.s1z * b.s1z) AS w FROM n a JOIN n b ON a.frame_id = b.frame_id AND a.r < b.r WHERE a.m.d < 1 AND b.m.d < 1)
SELECT frame_id, CAST(least(m.i, o.i) AS INT) AS p0, CAST(greatest(m.i, o.i) AS INT) AS p1, round(d, 6) AS q2_diff, round(acos(greatest(-1, least(1, t / w))), 6) AS angle FROM j WHERE acos(greatest(-1, least(1, t / w))) < 2.8e0""")
def r8_pair_observations(spark, sf_dir):
    return observed(spark, sf_dir).select("frame_id", "p0", "p1", F.round("q2_diff", 6).alias("q2_diff"), F.round("angle", 6).alias("angle"))


@query()
def r9_pick_triplets(spark, sf_dir):
    return op.pick_triplets(observed(spark, sf_dir), [1.0, 2.0, 3.0], 0.5)


_GRID = "SELECT CAST(row_number() OVER (ORDER BY h * h + k * k * 1.1e0 + l * l * 1.3e0, h, k, l) - 1 AS INT) AS ref_index, h, k, l FROM (SELECT CAST(x AS INT) AS h, CAST(y AS INT) AS k, CAST(z AS INT) AS l FROM (SELECT unnest(range(0, 4)) AS x) a, (SELECT unnest(range(0, 4)) AS y) b, (SELECT unnest(range(0, 4)) AS z) c) g WHERE h + k + l > 0"
_IMAGES = ", ".join(f"({m[0]}, {m[4]}, {m[8]})" for m in candidates.MIRRORS)


@query(f"""WITH r AS ({_GRID}), n AS (SELECT count(*) AS parts FROM part), d AS (SELECT a.ref_index AS i, b.ref_index AS j, (s * a.h - b.h) * (s * a.h - b.h) AS x, (t * a.k - b.k) * (t * a.k - b.k) AS y, (u * a.l - b.l) * (u * a.l - b.l) AS z FROM r a JOIN r b ON a.ref_index <= b.ref_index, (VALUES {_IMAGES}) m(s, t, u))
, t AS (SELECT DISTINCT i, j, ref_index AS k FROM d JOIN r ON r.h * r.h = x AND r.k * r.k = y AND r.l * r.l = z) SELECT p_partkey AS entry_id, i, j, k FROM part JOIN t ON t.i = p_partkey % 50""")
def j11_triplet_reference(spark, sf_dir):
    """The triplets of an orthorhombic lattice's references, for the first reference that each entry names."""
    grid = [(h, k, m) for h in range(4) for k in range(4) for m in range(4) if h + k + m]
    grid.sort(key=lambda v: (v[0] ** 2 + v[1] ** 2 * 1.1 + v[2] ** 2 * 1.3, v))
    refs = spark.createDataFrame([(i, *v) for i, v in enumerate(grid)], "ref_index int, h int, k int, l int")
    known = op.triplet_reference(refs, candidates.MIRRORS, lambda h, k, l: hkl_terms(h, k, l, F.lit("orthorhombic")).cast("array<int>"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("entry_id"), (F.col("p_partkey") % 50).cast("int").alias("i"))
    return part.join(F.broadcast(known), "i").select("entry_id", "i", "j", "k")


@query(f"{WITH['peaks']}, a AS (SELECT pattern_id, list(CAST(round(q2 / 0.004e0) AS INT) ORDER BY peak_index) AS l FROM v WHERE peak_index < 5 GROUP BY 1 HAVING count(*) = 5) SELECT pattern_id, unnest(l) AS label FROM (SELECT * FROM a ORDER BY md5('t9:' || pattern_id), pattern_id LIMIT 40) s")
def t9_draw_templates(spark, sf_dir):
    """The labels of the first five peaks of forty patterns."""
    a = arrays(spark, sf_dir).where(F.size("q2") >= 5).select("pattern_id", F.transform(F.slice("q2", 1, 5), lambda q: F.round(q / 0.004).cast("int")).alias("labels"))
    return op.draw_templates(a, "pattern_id", "labels", 40, "t9").select("pattern_id", F.explode("labels").alias("label"))


@query()
def t14_resample_predictions(spark, sf_dir):
    """Eight draws from five predictions of each entry's axes."""
    v = view(spark, sf_dir, "cells")
    given = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.array(*[F.col(n) * (1 + 0.01 * candidates.normal_at(9, F.col("entry_id"), i * 3 + j)) for j, n in enumerate("abc")]))
    return op.resample_predictions(v.select("entry_id", given.alias("p")), "entry_id", "p", 8)


@query()
def t17_augment_cells(spark, sf_dir):
    """As many copies of each entry as its rarity asks for."""
    w = candidates.rarity_weights(view(spark, sf_dir, "entries"), "lattice", "composition", 2.0, 4).select("entry_id", "n_copies")
    return op.augment_cells(view(spark, sf_dir, "cells").join(w, "entry_id"), "entry_id", ["a", "b", "c"], F.col("n_copies"), 0.05)


@query()
def a9_principal_axes(spark, sf_dir):
    v = view(spark, sf_dir, "cells").withColumn("bin", F.floor(F.col("a") / 4).cast("int"))
    return op.principal_axes(v, ["a", "b", "c"], ["bin"])


@query()
def c10_tune_mix(spark, sf_dir):
    """The share of one of two generators that covers the radii best."""
    v = view(spark, sf_dir, "cells").select((F.col("entry_id") % 30).alias("g"), F.when(F.col("entry_id") % 2 == 0, "trees").otherwise("templates").alias("generator"), "a")
    return op.tune_mix(v, ["g"], "generator", "a", [(5.0, 0.5), (8.0, 0.25), (12.0, 0.1)], [0.0, 0.25, 0.5, 0.75, 1.0], ("trees", "templates"))
