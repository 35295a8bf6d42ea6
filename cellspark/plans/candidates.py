"""Queries on validation, noise, generation and refinement of entries and candidates."""

from pyspark.sql import functions as F

from cellspark.functions import cell, symbols, symmetry
from cellspark.operators import augmentation
from cellspark.operators import candidates as op
from cellspark.operators import search
from cellspark.operators.curation import draw, ranked
from cellspark.plans.geometry import _LATTICE, _LSYSTEM, _SYSTEM
from cellspark.plans.peaks import _SUMS, arrays
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view

C, P, K, E = (WITH[x] for x in ("cells", "peaks", "classes", "entries"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'P 1 21/c 1' WHEN 1 THEN 'I a -3' WHEN 2 THEN 'Pa-3' WHEN 3 THEN p_name ELSE 'F d -3 c' END AS symbol FROM part")
def p6_normalise_symbol(spark, sf_dir):
    raw = F.element_at(F.array(F.lit("P2_1/c"), F.lit("x'I a -3'y"), F.lit("Pa3"), F.col("p_name"), F.lit("Fd3c")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", symbols.normalise_symbol(raw).alias("symbol"))


_RAW = "b AS (SELECT *, a AS a1, CASE WHEN entry_id % 2 = 0 THEN a ELSE b END AS b1, CASE WHEN entry_id % 3 = 0 THEN a WHEN entry_id % 19 = 0 THEN 0 ELSE c END AS c1, 90e0 AS al, 90e0 + entry_id % 2 AS be, CASE WHEN entry_id % 5 = 0 THEN 120e0 ELSE 90e0 END AS ga FROM v)"


@query(f"""{C}, {_RAW}, w AS (SELECT entry_id, sg, {_LATTICE} AS lat, {_LSYSTEM} AS sys, CASE WHEN entry_id % 11 = 0 THEN 'F' ELSE 'P' END AS sym, CASE WHEN entry_id % 7 = 0 THEN 'cubic' ELSE CASE WHEN sg BETWEEN 143 AND 167 THEN 'trigonal' ELSE {_SYSTEM} END END AS cs, a1 AS a, b1 AS b, c1 AS c, al, be, ga, CASE WHEN entry_id % 13 = 0 THEN NULL ELSE 40e0 + entry_id % 9 * 100 END AS atoms,
  a1*b1*c1*sqrt(1 - cos(radians(al))*cos(radians(al)) - cos(radians(be))*cos(radians(be)) - cos(radians(ga))*cos(radians(ga)) + 2*cos(radians(al))*cos(radians(be))*cos(radians(ga))) * CASE WHEN entry_id % 17 = 0 THEN 1.1e0 ELSE 1 END AS vol FROM b)
SELECT entry_id, CASE WHEN NOT (CASE cs WHEN 'cubic' THEN lat IN ('cF','cI','cP') WHEN 'monoclinic' THEN lat IN ('mC','mP') WHEN 'orthorhombic' THEN lat IN ('oC','oF','oI','oP') WHEN 'tetragonal' THEN lat IN ('tI','tP') WHEN 'triclinic' THEN lat = 'aP' ELSE lat IN ('hR','hP') END) THEN 'system'
  WHEN sys = 'monoclinic' AND sym = 'F' THEN 'f_monoclinic' WHEN sys = 'triclinic' AND sym <> 'P' THEN 'centred_triclinic'
  WHEN a = 0 OR b = 0 OR c = 0 OR vol = 0 THEN 'zero' WHEN entry_id % 17 = 0 THEN 'volume'
  WHEN NOT (CASE WHEN lat IN ('cF','cI','cP') THEN al = 90 AND be = 90 AND ga = 90 AND a = b AND b = c WHEN lat IN ('tI','tP') THEN al = 90 AND be = 90 AND ga = 90 AND (a = b OR a = c OR b = c) WHEN lat IN ('oC','oF','oI','oP') THEN al = 90 AND be = 90 AND ga = 90
    WHEN lat = 'hR' THEN (a = b AND b = c AND al = be AND be = ga) OR (a = b AND b <> c AND al = 90 AND be = 90 AND ga = 120) WHEN lat = 'hP' THEN a = b AND b <> c AND al = 90 AND be = 90 AND ga = 120 WHEN lat IN ('mC','mP') THEN al = 90 AND ga = 90 AND be <> 90 ELSE true END) THEN 'lattice'
  WHEN atoms IS NULL THEN 'formula' WHEN vol < 1.8e0 * atoms OR vol > 180e0 * atoms THEN 'atoms' END AS reason FROM w""")
def p7_validate_entries(spark, sf_dir):
    i = F.col("entry_id")
    v = symmetry.with_symmetry(view(spark, sf_dir, "cells"))
    b = v.select("entry_id", "sg", "lattice", "lattice_system", F.when(i % 7 == 0, "cubic").otherwise(F.col("crystal_system")).alias("crystal_system"), F.when(i % 11 == 0, "F").otherwise("P").alias("symbol"), "a", F.when(i % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(i % 3 == 0, F.col("a")).when(i % 19 == 0, 0.0).otherwise(F.col("c")).alias("c"), F.lit(90.0).alias("alpha"), (90.0 + i % 2).alias("beta"), F.when(i % 5 == 0, 120.0).otherwise(90.0).alias("gamma"), F.when(i % 13 != 0, 40.0 + i % 9 * 100).alias("atoms"))
    volume = cell.volume(F.col("a"), F.col("b"), F.col("c"), *[F.radians(n) for n in cell.ANGLES]) * F.when(i % 17 == 0, 1.1).otherwise(1.0)
    return op.validate_entries(b.withColumn("volume", F.coalesce(volume, F.lit(0.0)))).select("entry_id", "reason")


_D = "md5(concat_ws(':', '0', CAST(entry_id AS VARCHAR)))"


@query(f"""{C}, l AS (SELECT entry_id, entry_id % 7 AS g, CASE WHEN entry_id % 11 = 0 THEN NULL ELSE a END AS a, CASE WHEN entry_id % 11 = 0 THEN NULL ELSE b END AS b FROM v),
d AS (SELECT g, a, b FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {_D}, entry_id) AS r FROM l WHERE a IS NOT NULL) WHERE r <= {op.DONORS})
SELECT entry_id, a IS NOT NULL AS own, CASE WHEN a IS NULL THEN EXISTS (SELECT 1 FROM d WHERE d.g = l.g) ELSE true END AS from_donors FROM l""")
def p28_with_donors(spark, sf_dir):
    """Lost rows take both values of one sound row of their group: of those with the least hashes."""
    i = F.col("entry_id")
    v = view(spark, sf_dir, "cells").select("entry_id", (i % 7).alias("g"), *[F.when(i % 11 != 0, F.col(n)).alias(n) for n in "ab"])
    few = ranked(v.where("a IS NOT NULL"), ["g"], [draw(0, "entry_id"), i]).where(F.col("_rank") <= op.DONORS).select(F.col("g").alias("_g"), F.col("a").alias("_a"), F.col("b").alias("_b")).distinct()
    out = op.with_donors(v, ["g"], "entry_id", ["a", "b"])
    known = out.join(few, (F.col("g") == F.col("_g")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_semi").select("entry_id").withColumn("_known", F.lit(True))
    return out.join(known, "entry_id", "left").select("entry_id", (i % 11 != 0).alias("own"), ((i % 11 != 0) | F.coalesce("_known", F.lit(False))).alias("from_donors"))


@query()
def p28_repair_cells(spark, sf_dir):
    v = view(spark, sf_dir, "cells").select("entry_id", "a", "b")
    return op.repair_cells(v, "entry_id", ["a", "b"], {"a": 5.0, "b": 6.0}, {"a": 12.0, "b": 14.0})


@query()
def p29_add_q2_noise(spark, sf_dir):
    return op.add_q2_noise(arrays(spark, sf_dir), "pattern_id")


@query()
def p30_add_contaminants(spark, sf_dir):
    return op.add_contaminants(arrays(spark, sf_dir), "pattern_id", 2)


@query()
def p31_perturb_at_distances(spark, sf_dir):
    x = cell.xnn(cell.columns())[:3]
    v = view(spark, sf_dir, "cells").select("entry_id", F.array(*x).alias("xnn")).where("xnn[0] IS NOT NULL")
    return op.perturb_at_distances(v, "entry_id", "xnn", [0.001, 0.01], 3)


@query(f"{C} SELECT entry_id, f AS factor, round(f * f / (a * a), 9) AS x FROM v, (VALUES (0.5e0), (1e0), (2e0)) t(f)")
def j13_with_multiples(spark, sf_dir):
    v = view(spark, sf_dir, "cells").select("entry_id", (1 / (F.col("a") * F.col("a"))).alias("x"))
    return op.with_multiples(v, "x", [0.5, 1.0, 2.0]).select("entry_id", "factor", F.round("x", 9).alias("x"))


@query(f"{C}, t AS (SELECT entry_id % 50 AS g, min(a) AS t FROM v GROUP BY 1) SELECT entry_id FROM v JOIN t ON t.g = v.entry_id % 50 WHERE abs(a - t.t) <= 1.5e0")
def j16_near_truth(spark, sf_dir):
    v = view(spark, sf_dir, "cells").select("entry_id", (F.col("entry_id") % 50).alias("g"), "a")
    return op.near_truth(v, v.groupBy("g").agg(F.min("a").alias("a")), "g", "a", 1.5).select("entry_id")


_IMG = ", ".join(f"({i}, {m[0]}, {m[4]}, {m[8]})" for i, m in enumerate(op.MIRRORS))


@query(f"""{C}, h AS (SELECT entry_id, entry_id % 3 AS h0, entry_id % 4 AS k0, entry_id % 5 AS l0, 1 AS h1, entry_id % 2 AS k1, entry_id % 3 - 1 AS l1, 1/(a*a) AS x, 1/(b*b) AS y, 1/(c*c) AS z FROM v),
q AS (SELECT entry_id, i, x*(s*h0-h1)*(s*h0-h1) + y*(t*k0-k1)*(t*k0-k1) + z*(u*l0-l1)*(u*l0-l1) AS q FROM h, (VALUES {_IMG}) m(i, s, t, u)), r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY abs(0.1e0 - q), i) AS k FROM q) SELECT entry_id, round(q, 9) AS q2 FROM r WHERE k = 1""")
def j10_triplet_differences(spark, sf_dir):
    i, a = F.col("entry_id"), [1 / (F.col(n) * F.col(n)) for n in "abc"]
    q = op.triplet_difference(F.lit(0.1), [i % 3, i % 4, i % 5], [F.lit(1), i % 2, i % 3 - 1], a, op.MIRRORS)
    return view(spark, sf_dir, "cells").select("entry_id", F.round(q, 9).alias("q2"))


@query(f"""{C}, d AS (SELECT entry_id, abs(0.1e0 - 1/(a*a)) AS e, 1/(a*a) AS q FROM v) SELECT entry_id % 1000 AS g, round(-log2(1 - exp(-sum(-ln(1 / (1 + 8 * pi() * 0.1e0 * abs(sqrt(0.1e0) - sqrt(q)) / (0.01e0 * 7)))))), 6) AS m_triplet FROM d GROUP BY 1""")
def a20_m_triplet(spark, sf_dir):
    q = 1 / (F.col("a") * F.col("a"))
    v = view(spark, sf_dir, "cells").select((F.col("entry_id") % 1000).alias("g"), search.peak_probability(F.lit(0.1), q, F.lit(0.01), search.MULTIPLICITY["oP"]).alias("p"))
    return v.groupBy("g").agg(F.collect_list("p").alias("p")).select("g", F.round(search.m_info(F.col("p")), 6).alias("m_triplet"))


_GAPS = [0.0, 0.0005, 0.001, 0.002, 0.004, 0.02]


@query(f"""{P}, l AS (SELECT q2, peak_index % 3 <> 1 AS kept, least(q2 - lag(q2) OVER w, lead(q2) OVER w - q2) AS g, lead(peak_index % 3 <> 1) OVER w AS nx, lag(q2) OVER w AS p FROM v WINDOW w AS (PARTITION BY pattern_id ORDER BY q2)),
b AS (SELECT CAST(CASE WHEN g <= 0.0005e0 THEN 0 WHEN g <= 0.001e0 THEN 1 WHEN g <= 0.002e0 THEN 2 WHEN g <= 0.004e0 THEN 3 WHEN g <= 0.02e0 THEN 4 ELSE 5 END AS INT) AS gap_bin, CAST(least(floor(q2 / (0.1e0 / 5)), 4) AS INT) AS q_bin, CASE WHEN nx THEN 1e0 ELSE 0 END AS n FROM l WHERE kept AND p IS NOT NULL AND nx IS NOT NULL),
r AS (SELECT gap_bin, q_bin, avg(n) AS rate FROM b WHERE gap_bin < 5 GROUP BY ALL), g AS (SELECT i.i AS gap_bin, j.j AS q_bin, coalesce(rate, 0.5e0) AS rate FROM (SELECT CAST(unnest(range(0,5)) AS INT) AS i) i CROSS JOIN (SELECT CAST(unnest(range(0,5)) AS INT) AS j) j LEFT JOIN r ON r.gap_bin = i.i AND r.q_bin = j.j),
s AS (SELECT g.gap_bin, g.q_bin, g.rate, n.rate AS m FROM g, (VALUES (0,0),(0,1),(0,-1),(1,0),(-1,0)) o(x, y), g n WHERE n.gap_bin = greatest(0, least(g.gap_bin + x, 4)) AND n.q_bin = greatest(0, least(g.q_bin + y, 4)))
SELECT gap_bin, q_bin, round(any_value(rate), 9) AS rate, round(median(m), 9) AS smooth FROM s GROUP BY gap_bin, q_bin""")
def a13_keep_rate_grid(spark, sf_dir):
    v = view(spark, sf_dir, "peaks").withColumn("kept", F.col("peak_index") % 3 != 1)
    out = op.keep_rate_grid(v, "pattern_id", "q2", "kept", _GAPS, 0.1, 5)
    return out.select("gap_bin", "q_bin", F.round("rate", 9).alias("rate"), F.round("smooth", 9).alias("smooth"))


@query(f"{E}, n AS (SELECT lattice, composition, count(*) AS n FROM v GROUP BY ALL), w AS (SELECT *, 1 / ((sum(n) OVER (PARTITION BY lattice) / sum(n) OVER ()) * (n / sum(n) OVER (PARTITION BY lattice))) AS r FROM n), j AS (SELECT v.entry_id, w.r FROM v JOIN w ON v.lattice = w.lattice AND v.composition = w.composition) SELECT entry_id, CAST(least(7, round(3 * r / (SELECT median(r) FROM j))) AS INT) AS n_copies FROM j")
def a14_rarity_weights(spark, sf_dir):
    return op.rarity_weights(view(spark, sf_dir, "entries"), "lattice", "composition", 3.0, 7).select("entry_id", "n_copies")


@query(f"""{C}, c AS (SELECT entry_id % 30 AS g, CAST(sum(CASE WHEN a <= 5 THEN 1 ELSE 0 END) AS DOUBLE) * 0.1e0 - 1 AS e0, CAST(sum(CASE WHEN a <= 8 THEN 1 ELSE 0 END) AS DOUBLE) * 0.05e0 - 1 AS e1, CAST(sum(CASE WHEN a <= 12 THEN 1 ELSE 0 END) AS DOUBLE) * 0.01e0 - 1 AS e2 FROM v GROUP BY 1)
SELECT g, round(3 * (abs(e0) + abs(e1)) / 2 + 4 * (abs(e1) + abs(e2)) / 2 + CASE WHEN greatest(e0, e1, e2) >= 0 THEN 0 ELSE 100 END, 6) AS objective FROM c""")
def a25_coverage_objective(spark, sf_dir):
    v = view(spark, sf_dir, "cells").withColumn("g", F.col("entry_id") % 30)
    return op.coverage_objective(v, ["g"], "a", [(5.0, 0.1), (8.0, 0.05), (12.0, 0.01)]).select("g", F.round("objective", 6).alias("objective"))


@query(f"""{C}, c AS (SELECT s AS spread, entry_id % 30 AS g, CAST(sum(CASE WHEN a * s <= 5 THEN 1 ELSE 0 END) AS DOUBLE) * 0.1e0 - 1 AS e0, CAST(sum(CASE WHEN a * s <= 8 THEN 1 ELSE 0 END) AS DOUBLE) * 0.05e0 - 1 AS e1 FROM v, (VALUES (0.5e0), (1e0), (2e0)) t(s) GROUP BY ALL),
o AS (SELECT spread, avg(3 * (abs(e0) + abs(e1)) / 2 + CASE WHEN greatest(e0, e1) >= 0 THEN 0 ELSE 100 END) AS m FROM c GROUP BY 1) SELECT arg_min(spread, m) AS spread, round(min(m), 6) AS objective FROM o""")
def c9_tune_spread(spark, sf_dir):
    """The spread of a grid with the least mean objective."""
    v = view(spark, sf_dir, "cells").withColumn("g", F.col("entry_id") % 30)
    grid = op.with_multiples(v.withColumn("x", F.lit(1.0)), "x", [0.5, 1.0, 2.0]).withColumn("a", F.col("a") * F.col("factor"))
    o = op.coverage_objective(grid, ["factor", "g"], "a", [(5.0, 0.1), (8.0, 0.05)]).groupBy(F.col("factor").alias("spread")).agg(F.avg("objective").alias("m"))
    return o.agg(F.min_by("spread", "m").alias("spread"), F.round(F.min("m"), 6).alias("objective"))


_GREEDY = """WITH RECURSIVE p AS (SELECT user_id AS pattern_id, CAST(event_id % 4 AS INT) AS peak, CAST(event_id % 7 AS INT) AS label, max(value) AS p FROM events WHERE value IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY -p, peak, label) AS i FROM p),
f(pattern_id, i, t) AS (SELECT pattern_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(peak INT, label INT)[]) FROM o GROUP BY 1 UNION ALL
  SELECT f.pattern_id, o.i, CASE WHEN len(list_filter(f.t, lambda y: y.peak = o.peak OR y.label = o.label)) > 0 THEN f.t ELSE list_append(f.t, {'peak': o.peak, 'label': o.label}) END FROM f JOIN o ON o.pattern_id = f.pattern_id AND o.i = f.i + 1),
l AS (SELECT pattern_id, arg_max(t, i) AS t FROM f GROUP BY 1) SELECT pattern_id, x.peak AS peak, x.label AS label FROM (SELECT pattern_id, unnest(t) AS x FROM l) u"""


def _probabilities(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    return v.groupBy(F.col("user_id").alias("pattern_id"), (F.col("event_id") % 4).cast("int").alias("peak"), (F.col("event_id") % 7).cast("int").alias("label")).agg(F.max("value").alias("p"))


@query(_GREEDY)
def t8_greedy_assignments(spark, sf_dir):
    return op.greedy_assignments(_probabilities(spark, sf_dir), "pattern_id", "peak", "label", "p")


@query()
def t7_draw_assignments(spark, sf_dir):
    return op.draw_assignments(_probabilities(spark, sf_dir), "pattern_id", "peak", "label", "p")


@query()
def t13_random_cells(spark, sf_dir):
    v = view(spark, sf_dir, "entries").select("entry_id", "volume")
    return op.random_cells(v, "entry_id", 4, 3.0, 20.0, F.col("volume")).select("entry_id", "candidate_id", "cell")


@query()
def w5_dedup_radius(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding", F.get("embedding", F.lit(0)).cast("double").alias("o"), F.get("embedding", F.lit(1)).cast("double").alias("s"))
    return op.dedup_radius(v, ["label"], "vec_id", "embedding", "o", "s", 0.95).select("vec_id", "label")


@query()
def w9_thin_peaks(spark, sf_dir):
    return op.thin_peaks(arrays(spark, sf_dir), "pattern_id", "q2", 0.8, 0.001)


@query(f"""{WITH['first_peaks']}, a AS (SELECT pattern_id, list(q2 ORDER BY peak_index) AS q FROM v GROUP BY 1), s AS (SELECT {_SUMS}::DOUBLE[] AS s), c AS (SELECT pattern_id, q, f, q[1] * f * f AS x, s FROM a, s, (VALUES (0.5e0), (1e0), (2e0)) t(f) WHERE len(q) = 10),
n AS (SELECT *, list_transform(q, lambda z: s[list_min(list_transform(range(1, {len(_SUMS) + 1}), lambda k: {{'d': abs(s[k] * x - z), 'k': k}})).k] * x) AS c FROM c),
m AS (SELECT pattern_id, f, len(list_filter(s, lambda r: r * x < c[10])) AS n, list_max(list_filter(s, lambda r: r * x < c[10])) * x AS g, list_sum(list_transform(list_zip(q, c), lambda z: abs(z[1] - z[2]))) / 10 AS e FROM n),
w AS (SELECT pattern_id, f, CASE WHEN n = 0 THEN 0 WHEN e > 0 THEN g / (2 * n) / e ELSE 'inf'::DOUBLE END AS m FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY m DESC, f) AS k FROM w) SELECT pattern_id, f AS factor, round(m, 5) AS m20 FROM r WHERE k = 1""")
def c6_correct_multiples(spark, sf_dir):
    """The best of a cubic cell's multiples, by figure of merit."""
    s = F.split(F.lit(",".join(map(str, _SUMS))), ",").cast("array<double>")
    v = op.with_multiples(arrays(spark, sf_dir, "first_peaks").where(F.size("q2") == 10).withColumn("x", F.get("q2", F.lit(0))), "x", [0.5, 1.0, 2.0])
    v = v.withColumn("refs", F.transform(s, lambda r: r * F.col("x"))).withColumn("c", F.transform("q2", lambda q: F.array_min(F.transform("refs", lambda r, i: F.struct(F.abs(r - q).alias("d"), i.alias("i"), r.alias("r"))))["r"]))
    v = v.withColumn("m", search.m20(F.col("q2"), F.col("c"), F.col("refs")))
    return ranked(v, ["pattern_id"], [F.desc("m"), F.col("factor")]).where("_rank = 1").select("pattern_id", "factor", F.round("m", 5).alias("m20"))


@query(f"{C} SELECT entry_id, CAST(k AS INT) AS copy, true AS fits, 10 AS lines FROM v, (SELECT unnest([1, 2, 3]) AS k) t")
def t17_augment_entries(spark, sf_dir):
    """Three copies of each entry by the covariance of its group: axes in order, lengths within limits, ten lines that rise."""
    i = F.col("entry_id")
    axes = F.array_sort(F.array("a", "b", "c"))
    v = view(spark, sf_dir, "cells").select("entry_id", (i % 5).alias("g"), *[F.get(axes, F.lit(k)).alias(n) for k, n in enumerate("abc")])
    out = augmentation.augment_entries(v, "entry_id", "g", ["a", "b", "c"], "orthorhombic", "covariance", 3)
    rises = lambda x: F.forall(F.sequence(F.lit(1), F.size(x) - 1), lambda k: F.get(x, k - 1) <= F.get(x, k))
    return out.select("entry_id", "copy", (rises(F.col("cell")) & rises(F.col("q")) & (F.array_min("cell") >= 2.25)).alias("fits"), F.size("q").alias("lines"))
