"""Sources and sinks. Every scan has an explicit schema or column list; nothing is read on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alternative tags of CIF fields; the first that is there counts. Fixed values.
CIF_TEXT = {
    "chemical_formula": ("_chemical_formula_sum", "_chemical_formula_structural"),
    "spacegroup_symbol_hm": ("_symmetry_space_group_name_H-M", "_space_group_name_H-M_alt", "_symmetry_space_group_name_h-m"),
    "spacegroup_symbol_hall": ("_symmetry_space_group_name_Hall", "_space_group_name_Hall"),
}
CIF_NUMBER = {
    "spacegroup_number": ("_space_group_IT_number", "_symmetry_Int_Tables_number"),
    "a": ("_cell_length_a",),
    "b": ("_cell_length_b",),
    "c": ("_cell_length_c",),
    "alpha": ("_cell_angle_alpha",),
    "beta": ("_cell_angle_beta",),
    "gamma": ("_cell_angle_gamma",),
    "volume": ("_cell_volume",),
    "r_factor": ("_refine_ls_R_factor_gt",),
}


def scan_entries(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def scan_shards(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Shards of one dataset (a directory, a glob or a list) as one frame; columns that a shard lacks are null."""
    return spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))


def cif_field(text: Column, tags: tuple[str, ...]) -> Column:
    """The value after the first tag that is there: quoted, or up to white space. `?` and `.` are null."""
    values = []
    for tag in tags:
        found = F.regexp_extract(text, rf"(?m)^\s*{tag.replace('-', '[-]')}\s+('([^'\n]*)'|\"([^\"\n]*)\"|(\S+))", 0)
        bare = F.regexp_replace(F.trim(F.regexp_replace(found, rf"^\s*{tag.replace('-', '[-]')}\s+", "")), "^['\"]|['\"]$", "")
        values.append(F.when((found != "") & ~bare.isin("?", "."), bare))
    return F.coalesce(*values)


def number(value: Column) -> Column:
    """A number without its standard uncertainty in brackets; null if it isn't one."""
    return F.regexp_replace(value, r"\([0-9]+\)$", "").try_cast("double")


def parse_cif(df: DataFrame, text: str = "value") -> DataFrame:
    """df with the fields of CIF_TEXT and CIF_NUMBER. Only plain tag-value lines are read, no loops."""
    fields = {k: cif_field(F.col(text), v) for k, v in CIF_TEXT.items()} | {k: number(cif_field(F.col(text), v)) for k, v in CIF_NUMBER.items()}
    return df.withColumns(fields).withColumn("spacegroup_number", F.col("spacegroup_number").cast("int"))


def scan_cif(spark: SparkSession, path: str) -> DataFrame:
    """(file, ...) of all files below a directory, one row each."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return parse_cif(files.select(F.col("_metadata.file_path").alias("file"), "value")).drop("value")


def scan_peak_text(spark: SparkSession, path: str, wavelength: float) -> DataFrame:
    """(file, q2) of peak lists as text: lines that start with [ hold 2 theta in degrees first."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").startswith("["))
    two_theta = F.regexp_extract("value", r"^\[(?:np\.float64\()?\s*([0-9.eE+-]+)", 1).try_cast("double")
    return lines.select("file", F.pow(2 * F.sin(two_theta * (math.pi / 360)) / wavelength, 2).alias("q2"))


def scan_peak_arrays(spark: SparkSession, path: str, n: int = 20, format: str = "parquet") -> DataFrame:
    """(pattern_id, q2 array) of array peak lists, the first n peaks."""
    rows = spark.read.schema("pattern_id long, q2 array<double>").format(format).load(path)
    return rows.withColumn("q2", F.slice("q2", 1, n))


def scan_group_spec(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, group) of a CSV table with the columns `hm symbol` and `group`; rows without a group are dropped, symbols trimmed."""
    rows = spark.read.option("header", "true").schema("symbol string, group string").option("enforceSchema", "true").csv(path)
    return rows.where("group IS NOT NULL").select(F.trim("symbol").alias("symbol"), F.trim("group").alias("group"))


def write_dataset(df: DataFrame, path: str, by: str = "bravais_lattice") -> None:
    """One partition of files for each lattice, so that a filter on it reads only these."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_accept_reject(df: DataFrame, path: str, status: str = "status") -> None:
    """Accepted rows and rejected rows (with their reason) below two folders."""
    from cellspark.operators.curation import split_accept_reject

    yes, no = split_accept_reject(df, status)
    yes.write.mode("overwrite").parquet(f"{path}/accepted")
    no.write.mode("overwrite").parquet(f"{path}/rejected")


def write_results_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_params(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def scan_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """One identifier a line; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("identifier")).where("identifier <> ''")


def write_identifiers(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)
