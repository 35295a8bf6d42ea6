"""Queries that write and read again, in the shared folder of the session."""

import tempfile
import uuid

from pyspark.sql import functions as F

from cellspark.functions import symmetry
from cellspark.operators import curation
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view
from cellspark.sources import io

E, P, C = WITH["entries"], WITH["peaks"], WITH["cells"]


def folder(spark) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, which a session may go without only where its tasks run in this very process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@query(f"{E} SELECT entry_id, source, volume FROM v")
def s2_scan_shards(spark, sf_dir):
    path, v = folder(spark), view(spark, sf_dir, "entries").select("entry_id", "source", "volume")
    v.where("source = 'cod'").write.parquet(f"{path}/cod")
    v.where("source = 'csd'").write.parquet(f"{path}/csd")
    return io.scan_shards(spark, [f"{path}/cod", f"{path}/csd"])


_CIF = """SELECT p_partkey, concat('data_x\n_chemical_formula_sum   ''C', p_size, ' H2''\n_symmetry_Int_Tables_number ', 1 + p_partkey % 230, '\n_cell_length_a  ', p_size, '.5(3)\n_cell_angle_alpha 90\n_cell_volume ', CASE WHEN p_partkey % 4 = 0 THEN '?' ELSE '120.25(11)' END,
  CASE WHEN p_partkey % 3 = 0 THEN '\n_space_group_name_H-M_alt "P 1 21/c 1"' WHEN p_partkey % 3 = 1 THEN '\n_symmetry_space_group_name_H-M  ''I a -3''\n_space_group_name_H-M_alt P1' ELSE '' END, '\n_refine_ls_R_factor_gt 0.0', p_size, '\n') AS value FROM part"""


@query("""SELECT p_partkey, concat('C', p_size, ' H2') AS chemical_formula, CAST(1 + p_partkey % 230 AS INT) AS spacegroup_number, p_size + 0.5e0 AS a, 90e0 AS alpha, CASE WHEN p_partkey % 4 <> 0 THEN 120.25e0 END AS volume,
 CASE p_partkey % 3 WHEN 0 THEN 'P 1 21/c 1' WHEN 1 THEN 'I a -3' END AS spacegroup_symbol_hm, CAST('0.0' || p_size AS DOUBLE) AS r_factor, CAST(NULL AS DOUBLE) AS beta FROM part""")
def s3_scan_cif(spark, sf_dir):
    text = spark.sql(_CIF.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return io.parse_cif(text).select("p_partkey", "chemical_formula", "spacegroup_number", "a", "alpha", "volume", "spacegroup_symbol_hm", "r_factor", "beta")


@query("SELECT round(pow(2 * sin(radians(value / 2)) / 1.5406e0, 2), 9) AS q2, count(*) AS n FROM (SELECT round(value, 1) AS value FROM events WHERE value IS NOT NULL AND event_id % 2 = 0) e GROUP BY ALL")
def s4_scan_peak_text(spark, sf_dir):
    path = folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.when(F.col("event_id") % 4 == 0, "[").otherwise("[np.float64("), F.round("value", 1).cast("string"), F.lit("), 0, 1]"))).otherwise(F.lit("# no peak"))
    events.select(line.alias("value")).write.text(path)
    return io.scan_peak_text(spark, path, 1.5406).groupBy(F.round("q2", 9).alias("q2")).agg(F.count("*").alias("n"))


@query(f"{P} SELECT pattern_id, CAST(count(*) AS INT) AS n, max(q2) AS last FROM v WHERE peak_index < 8 GROUP BY 1")
def s5_scan_peak_arrays(spark, sf_dir):
    path = folder(spark)
    v = view(spark, sf_dir, "peaks").groupBy("pattern_id").agg(F.array_sort(F.collect_list("q2")).alias("q2"))
    v.write.parquet(path)
    return io.scan_peak_arrays(spark, path, 8).select("pattern_id", F.size("q2").alias("n"), F.element_at("q2", -1).alias("last"))


@query(f"{E} SELECT DISTINCT symbol, upper(symbol) AS \"group\" FROM v WHERE symbol NOT LIKE 'small%'")
def s6_scan_group_spec(spark, sf_dir):
    path = folder(spark)
    spec = view(spark, sf_dir, "entries").select("symbol").distinct()
    spec.select(F.concat(F.lit(" "), "symbol").alias("hm symbol"), F.when(~F.col("symbol").startswith("small"), F.upper("symbol")).alias("group")).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(path)
    return io.scan_group_spec(spark, path)


_LETTER = "CASE " + " ".join(f"WHEN sg <= {last} THEN '{letter}'" for last, letter, *_ in symmetry.RANGES) + " END"


@query(f"{C} SELECT entry_id, {_LETTER} AS letter FROM v WHERE {_LETTER} = 'm'")
def s7_write_dataset(spark, sf_dir):
    """Written by lattice; the filter reads the partitions it needs only."""
    path = folder(spark)
    v = symmetry.with_symmetry(view(spark, sf_dir, "cells")).select("entry_id", F.substring("lattice", 1, 1).alias("letter"), F.col("lattice").alias("bravais_lattice"))
    io.write_dataset(v, path)
    return spark.read.parquet(path).where(F.col("bravais_lattice").isin("mC", "mP")).select("entry_id", "letter")


@query(f"{P} SELECT pattern_id, peak_index, q2 FROM v")
def s9_write_results_json(spark, sf_dir):
    path = folder(spark)
    io.write_results_json(view(spark, sf_dir, "peaks"), path)
    return spark.read.schema("pattern_id long, peak_index int, q2 double").json(path)


@query(f"{E} SELECT lattice, count(*) AS n, CAST(sum(entry_id) AS BIGINT) AS total FROM v GROUP BY 1")
def s10_write_metrics_csv(spark, sf_dir):
    path = folder(spark)
    io.write_metrics_csv(view(spark, sf_dir, "entries").groupBy("lattice").agg(F.count("*").alias("n"), F.sum("entry_id").alias("total")), path)
    return io.read_params(spark, path, "lattice string, n long, total long")


@query(f"{E} SELECT CAST(entry_id AS VARCHAR) AS identifier FROM v WHERE r_factor <= 10")
def s11_scan_identifiers(spark, sf_dir):
    path = folder(spark)
    yes, _ = curation.split_accept_reject(view(spark, sf_dir, "entries").withColumn("status", F.col("r_factor") <= 10))
    io.write_identifiers(yes, "entry_id", path)
    return io.scan_identifiers(spark, path)
