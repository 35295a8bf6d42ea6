"""Every query of the catalogue against its SQL, on the smallest tables; partitions and plans."""

import math
import os

import pytest

from cellspark.plans import catalog
from cellspark.plans.views import view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(names, data):
    at = [names.index(n) for n in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    sql = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(sql.columns), sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_peaks_are_whole(spark, duck):
    """Beyond ten peaks a pattern; only what the search takes is cut."""
    want = duck.sql("SELECT user_id, count(DISTINCT round(value / 1000 + 0.002e0, 6)) FROM events WHERE value IS NOT NULL GROUP BY 1").fetchall()
    for name, n in (("peaks", 10**9), ("first_peaks", 10)):
        got = view(spark, SF, name).groupBy("pattern_id").count().collect()
        assert sorted(map(tuple, got)) == sorted((u, min(c, n)) for u, c in want)
    assert max(c for _, c in want) > 10


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["j4_anti_join_tolerance", "j15_neighbours", "j17_near_peak", "j9_pairs_within_frame", "w4_dedup_tolerance", "a17_median_near", "r6_difference_histogram"])
def test_no_bare_inequality_join(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_partitions_do_not_matter(spark):
    from cellspark.operators import candidates, curation

    v = view(spark, SF, "entries")
    out = []
    for n in (1, 7, 31):
        df = v.repartition(n)
        out.append(
            [
                sorted(map(tuple, curation.dedup_tolerance(df, ["lattice", "composition"], "volume", "entry_id", [], 0.005).select("entry_id", "duplicate").collect())),
                sorted(map(tuple, curation.cap_per_group(df, ["symbol"], "entry_id", 3).select("entry_id", "ordinal").collect())),
                sorted((r["entry_id"], tuple(r["cell"])) for r in candidates.random_cells(df, "entry_id", 2, 3.0, 20.0, df["volume"]).collect()),
            ]
        )
    assert out[0] == out[1] == out[2]
