"""Entries of all systems in their standard setting."""

from pyspark.sql import functions as F

from cellspark.functions import cell
from cellspark.operators import standard as op
from cellspark.operators.indexing import dealt
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view

#: System, cell and symbols of the entries, by turns; SQL that Spark and the check both read.
ORTHORHOMBIC = ("P n m a", "P b c a", "I b a m", "C m c m", "B m a b", "A b m 2", "C c c a", "P 21 21 2", "I b c a", "F d d 2")
MONOCLINIC = {"P 1 21/n 1": "P 1 21/n 1", "C 1 2/c 1": "I 1 2/a 1", "A 1 m 1": "I 1 m 1", "I 1 c 1": "I 1 a 1", "P 1 21/a 1": "P 1 21/n 1", "P 1 c 1": "P 1 n 1", "P 1 21 1": "P 1 21 1"}
_CELLS = (
    ("cubic", "a, a AS b, a AS c, pi() / 2 AS alpha, pi() / 2 AS beta, pi() / 2 AS gamma", ("F m -3 m",)),
    ("tetragonal", "a, a AS b, c, pi() / 2 AS alpha, pi() / 2 AS beta, pi() / 2 AS gamma", ("P 42/n m c", "I 41/a")),
    ("hexagonal", "a, a AS b, c, pi() / 2 AS alpha, pi() / 2 AS beta, 2 * pi() / 3 AS gamma", ("P 63/m m c",)),
    ("rhombohedral", "a, a AS b, CASE WHEN entry_id % 2 = 0 THEN c ELSE a END AS c, CASE WHEN entry_id % 2 = 0 THEN pi() / 2 ELSE gamma - 0.3e0 END AS alpha, CASE WHEN entry_id % 2 = 0 THEN pi() / 2 ELSE gamma - 0.3e0 END AS beta, CASE WHEN entry_id % 2 = 0 THEN 2 * pi() / 3 ELSE gamma - 0.3e0 END AS gamma", ("R -3 c",)),
    ("orthorhombic", "a, b, c, pi() / 2 AS alpha, pi() / 2 AS beta, pi() / 2 AS gamma", ORTHORHOMBIC),
    ("monoclinic", "a, b, c, pi() / 2 AS alpha, beta, pi() / 2 AS gamma", tuple(MONOCLINIC)),
    ("triclinic", "a, b, c, alpha, beta, gamma", ("P -1",)),
)
_ENTRIES = " UNION ALL ".join(
    f"SELECT entry_id, '{name}' AS lattice_system, CASE CAST(floor(entry_id / 7) % {len(symbols)} AS INT) {' '.join(f'WHEN {k} THEN {s!r}' for k, s in enumerate(symbols))} END AS symbol, {cells} FROM v WHERE entry_id % 7 = {i}" for i, (name, cells, symbols) in enumerate(_CELLS)
)
_C = f"{WITH['cells']}, e AS ({_ENTRIES})"
_VOLUME = "a * b * c * sqrt(1 - cos(alpha) * cos(alpha) - cos(beta) * cos(beta) - cos(gamma) * cos(gamma) + 2 * cos(alpha) * cos(beta) * cos(gamma))"
_TAG = """CASE WHEN substr(symbol, 1, 1) IN ('P', 'I', 'F') THEN CASE WHEN a <= b AND b <= c THEN 'abc' WHEN a <= c AND c < b THEN 'acb' WHEN b < a AND a <= c THEN 'bac' WHEN b <= c AND c < a THEN 'bca' WHEN c < a AND a <= b THEN 'cab' ELSE 'cba' END
 WHEN substr(symbol, 1, 1) = 'C' THEN CASE WHEN a <= b THEN 'abc' ELSE 'bac' END WHEN substr(symbol, 1, 1) = 'B' THEN CASE WHEN a <= c THEN 'acb' ELSE 'cab' END ELSE CASE WHEN c <= b THEN 'cba' ELSE 'bca' END END"""
_AT = "split_part(symbol, ' ', 1 + position(substr(tag, {}, 1) IN 'abc'))"
_TO = "concat(" + ", ".join(f"substr('abc', position('{x}' IN tag), 1)" for x in "abc") + ")"
_SYMBOL = f"CASE WHEN symbol = 'I b c a' THEN symbol ELSE concat_ws(' ', translate(split_part(symbol, ' ', 1), 'ABC', upper(to_)), " + ", ".join(f"translate({_AT.format(i)}, 'abc', to_)" for i in (1, 2, 3)) + ") END"


def entries(spark, sf_dir):
    return spark.sql(f"WITH v AS (SELECT * FROM {{v}}) {_ENTRIES}", v=view(spark, sf_dir, "cells"))


@query(f"""{_C}, t AS (SELECT *, {_TAG} AS tag FROM e), o AS (SELECT *, {_TO} AS to_, {_VOLUME} AS v0 FROM t)
SELECT entry_id, lattice_system, round(CASE WHEN lattice_system = 'rhombohedral' AND entry_id % 2 = 0 THEN v0 / 3 ELSE v0 END, 6) AS new_volume,
  CASE lattice_system WHEN 'orthorhombic' THEN {_SYMBOL} WHEN 'monoclinic' THEN CASE symbol {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MONOCLINIC.items())} END ELSE symbol END AS new_symbol,
  CASE WHEN lattice_system = 'orthorhombic' THEN concat_ws(',', CAST(round(CASE substr(tag, 1, 1) WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END * 1000) AS BIGINT), CAST(round(CASE substr(tag, 2, 1) WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END * 1000) AS BIGINT), CAST(round(CASE substr(tag, 3, 1) WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END * 1000) AS BIGINT)) END AS axes_in_order FROM o""")
def p24_standardise_entries(spark, sf_dir):
    """Volume, symbol and orthorhombic axes of the standard setting, in all seven systems."""
    out = op.standardise_entries(entries(spark, sf_dir), "entry_id")
    listed = F.concat_ws(",", *[F.round(F.col(n) * 1000).cast("long") for n in op.NEW[:3]])
    return out.select("entry_id", "lattice_system", F.round("new_volume", 6).alias("new_volume"), "new_symbol", F.when(F.col("lattice_system") == "orthorhombic", listed).alias("axes_in_order"))


@query(f"{_C} SELECT entry_id, lattice_system, entry_id % 5 <> 0 AS ok FROM e")
def p25_reindex_ok(spark, sf_dir):
    """The change of axes of each standard setting keeps q2 of all reflections; one of a cell that is half a percent longer doesn't."""
    out = dealt(op.standardise_entries(entries(spark, sf_dir), "entry_id"), "entry_id")
    longer = F.when(F.col("entry_id") % 5 == 0, 1.005).otherwise(1.0)
    new = [F.col(n) * longer if i < 3 else F.col(n) for i, n in enumerate(op.NEW)]
    return out.select("entry_id", "lattice_system", op.reindex_ok(cell.columns(), new, F.col("axes")).alias("ok"))
