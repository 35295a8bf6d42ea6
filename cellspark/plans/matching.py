"""Planted matches: cells in another setting, a little or a factor off, or unrelated, in every lattice system."""

from pyspark.sql import functions as F

from cellspark.functions import cell
from cellspark.operators import matching as op
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view

C = WITH["cells"]
SYSTEMS = ("cubic", "tetragonal", "hexagonal", "rhombohedral", "orthorhombic", "monoclinic", "triclinic")
_SYSTEM = f"CASE entry_id // 4 % 7 {' '.join(f'WHEN {i} THEN {s!r}' for i, s in enumerate(SYSTEMS))} END"


def planted(spark, sf_dir):
    """entry_id, kind (0: another setting, 1: half a percent off, 2: one axis doubled, 3: 30 percent off), system, found and truth."""
    i, (a, b, c, al, be, ga) = F.col("entry_id"), cell.columns()
    v = view(spark, sf_dir, "cells").withColumn("kind", (i % 4).cast("int")).withColumn("system", F.element_at(F.array(*map(F.lit, SYSTEMS)), (F.floor(i / 4) % 7 + 1).cast("int")))
    k, whole = F.col("kind"), [10 + a, 11 + b, 13 + c, al, be, ga]
    skew = lambda x, y, cos: F.sqrt(x * x + y * y + 2 * x * y * cos)
    x, y, z = whole[:3]
    mono = cell.monoclinic_by(cell.SETTINGS[4], x, y, z, be)
    # a, a + b and c in place of a, b and c
    length = skew(x, y, F.cos(ga))
    tri = [x, length, z, F.acos((x * F.cos(be) + y * F.cos(al)) / length), be, F.acos((x + y * F.cos(ga)) / length)]
    values = {"cubic": ([x], [x]), "tetragonal": ([x, z], [x, z]), "hexagonal": ([x, z], [x, z]), "rhombohedral": ([x, al], [x, al]), "orthorhombic": ([x, y, z], [z, x, y]), "monoclinic": ([x, y, z, be], mono), "triclinic": (whole, tri)}
    truth, found = None, None
    for name, (true, other) in values.items():
        lengths = {"cubic": 1, "rhombohedral": 1, "tetragonal": 2, "hexagonal": 2}.get(name, 3)
        scaled = lambda s, n: [t * s if j < n else t for j, t in enumerate(true)]  # noqa: E731, B023
        moved = F.when(k == 0, F.array(*other)).when(k == 1, F.array(*scaled(1.005, lengths))).when(k == 2, F.array(*scaled(2.0, 1))).otherwise(F.array(*scaled(1.3, lengths)))
        is_ = F.col("system") == name
        truth = F.when(is_, F.array(*true)) if truth is None else truth.when(is_, F.array(*true))
        found = F.when(is_, moved) if found is None else found.when(is_, moved)
    return v.select("entry_id", "kind", "system", found.alias("found"), truth.alias("truth"))


@query(f"{C} SELECT entry_id, {_SYSTEM} AS system, entry_id % 4 < 2 AS correct, entry_id % 4 = 2 AS off FROM v")
def e7_match_cells(spark, sf_dir):
    """What was planted is told, whatever the setting."""
    return op.match_cells(planted(spark, sf_dir), ["entry_id"], "system", "found", "truth")


@query(f"""{C}, c AS (SELECT entry_id % 97 AS pattern_id, entry_id % 4 AS kind, {_SYSTEM} AS system, entry_id % 5 <> 0 AS own, (entry_id * 7919) % 1100 AS m20 FROM v),
f AS (SELECT pattern_id, bool_or(kind < 2 AND own) AS a, bool_or(kind < 2 AND NOT own) AS b, bool_or(kind = 2) AS c, bool_or(m20 > 1000) AS d FROM c WHERE (pattern_id % 3 = 0 OR kind >= 2) AND (pattern_id % 3 < 2 OR kind = 3) GROUP BY 1)
SELECT pattern_id, CASE WHEN a THEN 'found' WHEN b THEN 'incorrect_bl' WHEN c THEN 'off_by_two' WHEN d THEN 'explainer' ELSE 'not_found' END AS outcome FROM f""")
def e8_classify_outcome(spark, sf_dir):
    """Outcomes of patterns whose candidates are matched cells: a third of the patterns have no right one, another third nothing but unrelated ones."""
    i = F.col("entry_id")
    rows = planted(spark, sf_dir).withColumns({"pattern_id": i % 97, "lattice": F.when(i % 5 != 0, "own").otherwise("other"), "true_lattice": F.lit("own"), "m20": ((i * 7919) % 1100).cast("double")})
    p = F.col("pattern_id") % 3
    rows = rows.where(((p == 0) | (F.col("kind") >= 2)) & ((p < 2) | (F.col("kind") == 3)))
    return op.classify_outcome(op.match_cells(rows.select("pattern_id", "lattice", "true_lattice", "m20", "system", "found", "truth"), ["pattern_id", "lattice", "true_lattice", "m20"], "system", "found", "truth"), "pattern_id", "lattice", "true_lattice", "m20")
