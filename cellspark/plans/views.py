"""Crystal-shaped views of the given tables: the same SQL text for Spark and for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENTRIES = """SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 3 = 0 THEN 'cod' ELSE 'csd' END AS source, p_type AS lattice, p_brand AS composition,
  p_retailprice AS volume, CAST(p_size AS DOUBLE) AS r_factor, p_name AS symbol FROM part"""
CELLS = """SELECT p_partkey AS entry_id, CAST(1 + p_partkey % 230 AS INT) AS sg, 4 + (p_partkey % 97) * 0.11e0 AS a, 5 + (p_partkey % 89) * 0.13e0 AS b, 6 + (p_partkey % 83) * 0.17e0 AS c,
  radians(90e0 + p_partkey % 11) AS alpha, radians(91e0 + p_partkey % 13) AS beta, radians(90e0 + p_partkey % 7) AS gamma FROM part"""
PEAKS = """SELECT pattern_id, peak_index, q2 FROM (
  SELECT pattern_id, q2, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY q2) - 1 AS INT) AS peak_index
  FROM (SELECT DISTINCT user_id AS pattern_id, round(value / 1000 + 0.002e0, 6) AS q2 FROM events WHERE value IS NOT NULL) d) r"""
#: What the search and the models take of a pattern.
FIRST_PEAKS = f"{PEAKS} WHERE peak_index < 10"
REFLECTIONS = """SELECT l_orderkey AS frame_id, l_partkey AS k1, l_suppkey AS k2, l_linenumber AS k3, l_suppkey % 20 AS item,
  l_quantity - 25 AS s1x, l_discount * 100 - 5 AS s1y, 100 + l_tax * 10 AS s1z FROM lineitem"""
PREDICTIONS = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS y_true, l_quantity * 2000 AS y_pred, 500 + l_discount * 10000 AS y_std,
  l_orderkey % 5 <> 0 AS train, l_returnflag AS grp FROM lineitem"""
CLASSES = """SELECT event_id, user_id, event_type AS truth, CASE WHEN event_id % 4 = 0 THEN 'click' ELSE event_type END AS guess, (event_id % 1000) / 1000e0 AS prob FROM events"""

_TABLE = {"entries": (ENTRIES, "part"), "cells": (CELLS, "part"), "peaks": (PEAKS, "events"), "first_peaks": (FIRST_PEAKS, "events"), "reflections": (REFLECTIONS, "lineitem"), "predictions": (PREDICTIONS, "lineitem"), "classes": (CLASSES, "events")}
#: WITH clause of each view, for the check.
WITH = {name: f"WITH v AS ({sql})" for name, (sql, _) in _TABLE.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, table = _TABLE[name]
    return spark.sql(sql.replace(f"FROM {table}", "FROM {given}"), given=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
