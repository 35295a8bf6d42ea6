"""The steps of the candidate search: few passes, and the same cells as by the plain way."""

import numpy as np
import pytest

from cellspark.operators import indexing as ix
from cellspark.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c3_refine", "c4_refine_indexed", "c6_correct_multiples_of_axes", "c7_assign_absence_group", "j12_with_absence_groups"])
def test_one_python_pass_after_generation(spark, name):
    """Each pass is a Python process more in every running task: two generators, and one for all steps."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(kind) for kind in ("MapInPandas", "MapInArrow")) == 3


def test_spread_dense_has_no_python_call_a_pattern(spark):
    plan = QUERIES["t11_spread_dense"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan


def plain(q, x, refs):
    """(index, q2, merit) of one cell, peak by peak."""
    ref = [sum(a * b for a, b in zip(x, r, strict=True)) for r in refs]
    at = [min(range(len(ref)), key=lambda i: (abs(ref[i] - v), ref[i], i)) for v in q]
    calc = [ref[i] for i in at]
    under = [v for v in ref if v < calc[-1]]
    error = sum(abs(c - v) for c, v in zip(calc, q, strict=True)) / len(q)
    return at, calc, 0.0 if not under else max(under) / (2 * len(under)) / error if error else np.inf


def test_assignment_with_equal_references_and_exact_hits():
    rng = np.random.default_rng(5)
    for n in (1, 7, 63, 64, 200):
        refs = rng.integers(0, 5, (n, 3)).astype(float)  # many of them equal, in value too
        x = rng.choice([0.25, 0.5, 0.125], (600, 3))
        q = np.sort(rng.integers(0, 40, (600, 6)) / 8, 1)  # on references and just between two
        masks = rng.random((9, n)) < 0.5
        at, calc, m = ix.assign(q, x, refs)
        each = ix.masked_merits(q, x, refs, masks)
        assert (ix.merits(q, x, refs) == m).all()
        for i in range(0, 600, 29):
            want = plain(q[i], x[i], refs)
            assert at[i].tolist() == want[0] and calc[i].tolist() == want[1] and m[i] == want[2]
            assert each[i].tolist() == [plain(q[i], x[i], refs[mask])[2] if mask.any() else 0.0 for mask in masks]


def test_references_that_run_over():
    """Such a row has merit 0 and no say in others."""
    refs, q = np.array([[1.0, 0, 0], [0, 1, 0], [4, 0, 0], [0, 0, 9]]), np.array([[0.1, 0.2], [0.1, 0.2]])
    with np.errstate(over="ignore"):
        at, calc, m = ix.assign(q, np.array([[1e308, 1e308, 1e308], [0.1, 0.19, 0.3]]), refs)
    assert m[0] == 0 and np.isnan(calc[0]).all() and m[1] > 0


def test_many_patterns_are_spread_as_one_by_one():
    rng = np.random.default_rng(2)
    for system, width in (("orthorhombic", 3), ("cubic", 1), ("monoclinic", 4)):
        x = ix.physical(0.02 + 0.002 * rng.random((40 * 15, width)), system).reshape(40, 15, width)
        x[7] = x[7, 0]
        x[8, :, 0] = np.linspace(0.01, 0.2, 15)
        ids = np.repeat(np.arange(40), 15).reshape(40, 15), np.tile(np.arange(15), (40, 1))
        for most in (1, 3, 20):
            got = ix.spread_many(x, ids, system, 0.0007, most)
            want = np.stack([ix.spread(x[i], (ids[0][i], ids[1][i]), system, 0.0007, most) for i in range(40)])
            assert (got == want).all()
            assert most == 20 or (got != x).any()


def test_spread_dense_of_patterns_of_many_sizes(spark):
    """Patterns cut by Arrow batches, of different sizes, one with a bad row and one too large for the common way."""
    rng = np.random.default_rng(4)
    rows = [(p, c, [0.1], (0.02 + 0.001 * rng.random(3)).tolist(), 0.5) for p, n in enumerate([1, 24, 3, 300, 24, 24, 2, 24]) for c in range(n)]
    rows.append((4, 24, [0.1], [float("nan"), 0.02, 0.02], 0.5))
    df = spark.createDataFrame(rows, ix.COLUMNS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    outs = []
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            outs.append({(r["pattern_id"], r["candidate_id"]): r["xnn"] for r in ix.spread_dense(df, "orthorhombic", 0.0007, 2).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(outs[0]) == len(rows) and str(outs[0]) == str({k: outs[1][k] for k in outs[0]})
    for p, n in ((3, 300), (5, 24), (7, 24)):
        x = np.array([r[3] for r in rows if r[0] == p])
        want = ix.spread(x, (np.full(n, p), np.arange(n)), "orthorhombic", 0.0007, 2)
        assert [outs[0][p, c] for c in range(n)] == want.tolist()
    assert str(outs[0][4, 24]) == str(rows[-1][3])


def test_planted_volumes_that_are_halves(spark, tmp_path):
    """All entries up to 120,000 whose cell has a volume of just a half (a tetragonal one of 9.5 * 9.5 * 6), and some others."""
    import duckdb

    from cellspark.plans.catalog import ORACLE_SQL

    def millionths(k):
        a, b, c = 400 + 11 * (k % 97), 500 + 13 * (k % 89), 600 + 17 * (k % 83)
        return {0: a * a * a, 1: a * a * c, 4: a * b * c}.get(k % 7, 0)

    halves = [k for k in range(120_000) if millionths(k) % 1_000_000 == 500_000]
    assert 35358 in halves and len(halves) == 3
    spark.createDataFrame([(k,) for k in [*halves, 3, 12, 20]], "p_partkey long").createOrReplaceTempView("halves")
    part = spark.table("halves").selectExpr("p_partkey", "'' AS p_type", "'' AS p_brand", "0e0 AS p_retailprice", "1 AS p_size", "'' AS p_name")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = {r["entry_id"]: (r["lattice"], r["volume"]) for r in QUERIES["c8_planted_cells"](spark, str(tmp_path)).collect()}
    assert all(got[k][1] == (millionths(k) + 500_000) // 1_000_000 for k in halves)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == {e: (lattice, v) for e, lattice, v in con.execute(ORACLE_SQL["c8_planted_cells"]).fetchall()}
