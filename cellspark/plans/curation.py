"""Queries on entries: scans, filters, de-duplication, splits, samples."""

from pyspark.sql import functions as F

from cellspark.operators import curation as op
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view

E = WITH["entries"]
LATTICE = "ECONOMY"


def best():
    return [F.col("r_factor").asc_nulls_last(), F.col("entry_id")]


def _md5(seed, *ids):
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'CAST({i} AS VARCHAR)' for i in ids)}))"


@query("SELECT p_partkey, p_name FROM part")
def s1_scan_entries(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")


@query(f"{E} SELECT entry_id, r_factor <= 40 AS accepted FROM v")
def s8_split_accept_reject(spark, sf_dir):
    df = view(spark, sf_dir, "entries").withColumn("status", F.col("r_factor") <= 40)
    yes, no = op.split_accept_reject(df)
    return yes.select("entry_id", F.lit(True).alias("accepted")).union(no.select("entry_id", F.lit(False).alias("accepted")))


@query(f"{E} SELECT * FROM v WHERE lattice = '{LATTICE}'")
def p1_by_lattice(spark, sf_dir):
    return view(spark, sf_dir, "entries").where(F.col("lattice") == LATTICE)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_returnflag = 'R'")
def p5_rows_of(spark, sf_dir):
    v = view(spark, sf_dir, "predictions")
    return v.where(F.col("train") & (F.col("grp") == "R")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(f"{E} SELECT lattice, composition, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL")
def a1_count_by(spark, sf_dir):
    return view(spark, sf_dir, "entries").groupBy("lattice", "composition").agg(F.count("*").alias("n"))


@query(f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY lattice, composition ORDER BY r_factor NULLS LAST, entry_id) AS k FROM v) SELECT lattice, composition, entry_id, r_factor FROM r WHERE k = 1")
def w3_keep_best(spark, sf_dir):
    return op.keep_best(view(spark, sf_dir, "entries"), ["lattice", "composition"], best()).select("lattice", "composition", "entry_id", "r_factor")


_CLUSTERS = f"""WITH RECURSIVE e AS ({E[len('WITH v AS ('):-1]}),
g AS (SELECT *, dense_rank() OVER (ORDER BY lattice, composition) AS grp, row_number() OVER (PARTITION BY lattice, composition ORDER BY entry_id) AS i FROM e),
f(grp, i, pivots) AS (
  SELECT grp, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]) FROM g GROUP BY grp
  UNION ALL
  SELECT f.grp, g.i, CASE WHEN len(list_filter(f.pivots, lambda p: abs(g.volume - p) <= 1e-8 + 0.005e0 * abs(p))) > 0 THEN f.pivots ELSE list_append(f.pivots, g.volume) END
  FROM f JOIN g ON g.grp = f.grp AND g.i = f.i + 1),
p AS (SELECT g.*, list_filter(f.pivots, lambda p: abs(g.volume - p) <= 1e-8 + 0.005e0 * abs(p))[1] AS piv FROM g JOIN f ON f.grp = g.grp AND f.i = g.i),
k AS (SELECT *, row_number() OVER (PARTITION BY grp, piv ORDER BY r_factor NULLS LAST, entry_id) AS rk FROM p)"""


@query(f"{_CLUSTERS} SELECT entry_id, rk > 1 AS duplicate FROM k")
def w4_dedup_tolerance(spark, sf_dir):
    """Greedy clusters; the tolerance is 0.5 % because the volumes of the given table lie close."""
    return op.dedup_tolerance(view(spark, sf_dir, "entries"), ["lattice", "composition"], "volume", "entry_id", best()[:1], 0.005).select("entry_id", "duplicate")


@query(f"{_CLUSTERS} SELECT entry_id, lattice, composition, volume FROM k WHERE rk > 1")
def s12_write_duplicates(spark, sf_dir):
    found = op.dedup_tolerance(view(spark, sf_dir, "entries"), ["lattice", "composition"], "volume", "entry_id", best()[:1], 0.005)
    return found.where("duplicate").select("entry_id", "lattice", "composition", "volume")


@query(f"{E} SELECT l.entry_id, l.volume FROM v l WHERE l.source = 'cod' AND NOT EXISTS (SELECT 1 FROM v r WHERE r.source = 'csd' AND r.lattice = l.lattice AND r.composition = l.composition AND abs(r.volume - l.volume) <= 1e-8 + 0.0002e0 * abs(l.volume))")
def j4_anti_join_tolerance(spark, sf_dir):
    v = view(spark, sf_dir, "entries")
    return op.anti_join_tolerance(v.where("source = 'cod'"), v.where("source = 'csd'"), ["lattice", "composition"], "volume", 0.0002).select("entry_id", "volume")


@query(f"{E} SELECT v.entry_id, m.grp FROM v JOIN (SELECT symbol, min(composition) AS grp FROM v WHERE source = 'csd' GROUP BY symbol) m USING (symbol)")
def j3_with_model_group(spark, sf_dir):
    v = view(spark, sf_dir, "entries")
    groups = v.where("source = 'csd'").groupBy("symbol").agg(F.min("composition").alias("grp"))
    return v.join(groups, "symbol").select("entry_id", "grp")


@query(f"{E}, r AS (SELECT entry_id, row_number() OVER (PARTITION BY symbol ORDER BY {_md5(0, 'entry_id')}, entry_id) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM v) SELECT entry_id, k > floor(n * (1e0 - 0.8e0)) AS train FROM r")
def t1_stratified_split(spark, sf_dir):
    return op.stratified_split(view(spark, sf_dir, "entries"), ["symbol"], "entry_id").select("entry_id", "train")


@query(f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY composition ORDER BY {_md5(1, 'entry_id')}, entry_id) AS k, CAST(dense_rank() OVER (ORDER BY composition) AS INT) AS ordinal FROM v) SELECT entry_id, composition, ordinal FROM r WHERE k <= 7")
def t2_cap_per_group(spark, sf_dir):
    return op.cap_per_group(view(spark, sf_dir, "entries"), ["composition"], "entry_id", 7, 1).select("entry_id", "composition", "ordinal")


@query(f"""{E}, b AS (SELECT *, 0 AS origin FROM v WHERE source = 'cod' UNION ALL SELECT *, 1 FROM v WHERE source = 'csd' AND symbol IN (SELECT symbol FROM v WHERE source = 'cod')),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY origin, {_md5(2, 'entry_id')}, entry_id) AS k FROM b) SELECT entry_id, symbol, CAST(origin AS INT) AS origin FROM r WHERE k <= 15""")
def t3_sample_with_fallback(spark, sf_dir):
    v = view(spark, sf_dir, "entries")
    return op.sample_with_fallback(v.where("source = 'cod'"), v.where("source = 'csd'"), ["symbol"], "entry_id", 15, 2).select("entry_id", "symbol", "origin")


@query(f"{E} SELECT entry_id, {_md5(3, 'entry_id')} AS place FROM v")
def t4_shuffle(spark, sf_dir):
    return op.shuffle(view(spark, sf_dir, "entries"), "entry_id", 3).select("entry_id", op.draw(3, "entry_id").alias("place"))


@query(f"{E} SELECT entry_id, volume FROM v WHERE source = 'cod' UNION ALL SELECT entry_id, volume FROM v WHERE source = 'csd'")
def t12_union_all(spark, sf_dir):
    v = view(spark, sf_dir, "entries")
    return v.where("source = 'cod'").unionByName(v.where("source = 'csd'")).select("entry_id", "volume")


@query(f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_id) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM v) SELECT entry_id, symbol, CAST(unnest(range(0, CAST(floor((50 - k) / n) AS BIGINT) + 1)) AS INT) AS copy FROM r WHERE k <= 50")
def t15_repeat_to_n(spark, sf_dir):
    return op.repeat_to_n(view(spark, sf_dir, "entries"), ["symbol"], [F.col("entry_id")], 50).select("entry_id", "symbol", "copy")


@query(f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_md5(4, 'entry_id')}, entry_id) AS k FROM v) SELECT entry_id, source FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM v GROUP BY source))")
def t16_balance(spark, sf_dir):
    return op.balance(view(spark, sf_dir, "entries"), "source", "entry_id", 4).select("entry_id", "source")


@query(f"{E} SELECT entry_id FROM v")
def t18_round_robin(spark, sf_dir):
    return view(spark, sf_dir, "entries").repartition(8).select("entry_id")


@query(f"{E} SELECT lattice, r_factor, min(entry_id) AS entry_id FROM v GROUP BY lattice, r_factor")
def w13_distinct_rows_first(spark, sf_dir):
    return op.distinct_rows_first(view(spark, sf_dir, "entries"), ["lattice", "r_factor"], "entry_id")


P = WITH["peaks"]


@query(f"""{P}, u AS (SELECT *, (CAST('0x' || substr({_md5(5, 'pattern_id', 'peak_index')}, 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0 AS u FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY -ln(u) / (1 / q2), peak_index) AS k FROM u) SELECT pattern_id, peak_index FROM r WHERE k <= 6""")
def t5_weighted_subset(spark, sf_dir):
    return op.weighted_subset(view(spark, sf_dir, "peaks"), ["pattern_id"], "peak_index", 1 / F.col("q2"), 6, 5).select("pattern_id", "peak_index")


@query(f"{P}, r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY {_md5(6, 'pattern_id', 'peak_index')}, peak_index) AS k FROM v) SELECT pattern_id, peak_index FROM r WHERE k <= 6")
def t6_uniform_subset(spark, sf_dir):
    return op.uniform_subset(view(spark, sf_dir, "peaks"), ["pattern_id"], "peak_index", 6, 6).select("pattern_id", "peak_index")


@query(f"{E}, b AS (SELECT *, CAST(least(floor((volume - 900) / 5e0), 19) AS INT) AS bin FROM v WHERE volume BETWEEN 900 AND 1000), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_md5(7, 'entry_id')}, entry_id) AS k FROM b) SELECT entry_id, bin FROM r WHERE k <= 9")
def t10_sample_per_bin(spark, sf_dir):
    return op.sample_per_bin(view(spark, sf_dir, "entries"), "volume", 900.0, 1000.0, 20, "entry_id", 9, 7).select("entry_id", "bin")
