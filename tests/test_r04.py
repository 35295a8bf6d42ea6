"""Findings of round 4: the whole search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellspark.operators import indexing as ix
from cellspark.operators.search import reference_hkl
from cellspark.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"
#: A cell of each system, as coefficients of its reciprocal cell.
CELLS = {"tP": [0.047, 0.114], "hP": [0.055, 0.034], "hR": [0.05, 0.031], "oP": [0.037, 0.022, 0.013], "mP": [0.031, 0.022, 0.014, 0.009], "aP": [0.031, 0.024, 0.017, 0.006, 0.009, 0.004]}


def test_search_spreads_the_candidates_of_its_quotas(spark):
    """the limits were for thousands of candidates, so that of 24 none ever moved, be they all the same."""
    assert ix.crowd("cubic", 120) == (64, 0.000026) and ix.crowd("triclinic", 6000) == (23, 0.000679)
    assert [ix.crowd(s, 24)[0] for s in ix.SPREAD] == [13, 1, 1, 1, 1, 1, 1]
    q = [0.0101, 0.0173, 0.0229, 0.0307, 0.0352, 0.0411, 0.0489, 0.0523, 0.0601, 0.0677]
    df = spark.createDataFrame([(1, q), (2, q[::-1])], "pattern_id long, q array<double>").withColumn("q", F.array_sort("q"))

    def same(patterns, refs, system, n):
        return patterns.withColumns({"candidate_id": F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "xnn": F.array(*[F.lit(v) for v in (0.01, 0.02, 0.03)]), "m20": F.lit(0.0)})

    rows = ix.search_lattice(df, "oP", {"same": 24}, steps={"orthorhombic": (0, 6)}, generators={"same": same}).collect()
    assert {r["pattern_id"] for r in rows} == {1, 2}
    for p in (1, 2):
        assert len(np.unique([r["xnn"] for r in rows if r["pattern_id"] == p], axis=0)) > 1


@pytest.mark.parametrize("query", ["c8_planted_cells", "c8_index_patterns"])
def test_search_has_no_python_call_a_pattern(spark, query):
    """the last stages took a call for each pattern and lattice, and another shuffle of all candidates."""
    plan = QUERIES[query](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    lattices = {"c8_planted_cells": 7, "c8_index_patterns": 14}[query]
    assert plan.count("RepartitionByExpression") == {"c8_planted_cells": 2, "c8_index_patterns": 3}[query] * lattices


@pytest.mark.parametrize("lattice", list(CELLS))
def test_lists_of_near_references_change_nothing(spark, monkeypatch, lattice):
    """Cells near the true one and far from it, refined with lists of the references near the peaks and with all references."""
    system, refs, r = ix.system_of(lattice), ix.reference_terms(spark, lattice), np.random.default_rng(0)
    q = np.tile(np.unique(np.round(refs @ np.array(CELLS[lattice]), 9))[:20], (300, 1)) * r.uniform(0.999, 1.001, (300, 20))
    x = np.array(CELLS[lattice]) * np.exp(r.normal(0, 1, (300, len(CELLS[lattice]))) * np.array([0.01, 0.2, 1.0])[np.arange(300) % 3, None])
    q[5, 3], x[7, 0] = np.nan, np.inf
    rows = pd.DataFrame({"pattern_id": np.arange(300) // 10, "candidate_id": np.arange(300) % 10})
    step = ix.refining(refs, system, "random_subsampling", 40, 8)
    got = step(rows, q, x)
    assert (got[1] == step(rows.iloc[:1], q[:1], x[:1])[1][0])[0]  # a row alone
    monkeypatch.setattr(ix, "FEW_STEPS", 40)
    want = step(rows, q, x)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and got[1][5] == 0


def test_many_patterns_are_thinned_as_one_by_one():
    r = np.random.default_rng(1)
    x, score = r.integers(0, 4, (50, 12, 2)) * 1.0, r.integers(0, 5, (50, 12)) * 1.0
    got = ix.thinned_many(x, score, 1.5)
    assert all((got[i] == ix.thinned(x[i], score[i], 1.5)).all() for i in range(50)) and not got.all()


@pytest.mark.parametrize("lattice", ["cF", "hR", "oC", "mC", "aP"])
def test_references_of_all_lattices_are_the_listed_ones(spark, lattice):
    system = ix.system_of(lattice)
    rows = reference_hkl(spark, lattice, system, 201, ix.weights(system)).orderBy("ref_index").collect()[:-1]
    hkl, terms = ix.references(spark, lattice, 200)
    assert [(r["h"], r["k"], r["l"]) for r in rows] == [tuple(v) for v in hkl.tolist()] and [list(map(float, r["terms"])) for r in rows] == terms.tolist()
