"""Cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from cellspark.functions import cell, formula, optics, symbols, symmetry
from cellspark.operators import candidates, curation, peaks, search, stats
from cellspark.sources import io


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def doubles(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_greedy_clusters(spark):
    rows = [(i, "g", v, float(r)) for i, (v, r) in enumerate(zip((100.0, 104.0, 109.0, 95.5, 200.0), (5, 3, 4, 1, 2), strict=True))]
    df = spark.createDataFrame(rows, "id int, g string, v double, r double")
    out = curation.dedup_tolerance(df, ["g"], "v", "id", [F.col("r")]).where("NOT duplicate").collect()
    assert sorted(r["v"] for r in out) == [95.5, 109.0, 200.0]


def test_tolerance_anti_join(spark):
    left = spark.createDataFrame([("g", 100.0), ("g", 106.0), ("g", 110.0), ("h", 104.0)], "g string, v double")
    right = spark.createDataFrame([("g", 104.0)], "g string, v double")
    assert sorted(map(tuple, curation.anti_join_tolerance(left, right, ["g"], "v").collect())) == [("g", 110.0), ("h", 104.0)]


def test_stratified_split(spark):
    df = spark.createDataFrame([(n, i) for n in (5, 10, 100) for i in range(n)], "g int, id int")
    out = {r["g"]: r["n"] for r in curation.stratified_split(df, ["g"], "id").groupBy("g").agg(F.count_if(~F.col("train")).alias("n")).collect()}
    assert out == {5: 0, 10: 1, 100: 19}


def test_order_quantile(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    assert stats.order_quantile(df, "v", [0.25]).first()["value"] == 3.0
    many = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    rows = [(r["g"], r["v"]) for r in many.collect()]
    for r in stats.order_quantile(many, "v", [0.0, 0.1, 0.5, 0.6, 0.999, 1.0], ["g"]).collect():
        own = sorted(v for g, v in rows if g == r["g"])
        assert r["value"] == own[min(len(own) - 1, math.floor(r["fraction"] * len(own)))]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2(C6 H6),Na1 Cl1", {"C": 12, "H": 12, "Na": 1, "Cl": 1}), ("(C2 D4)n", {"C": 2, "H": 4}), ("C H4,1-", {"C": 1, "H": 4}), ("3n(Si O2)", {"Si": 3, "O": 6}), ("(C2 H3)4n", {"C": 8, "H": 12}), ("Xx3 Fe2", {"Fe": 2})],
)
def test_formula(spark, text, want):
    assert value(spark, formula.parse_formula(F.lit(text))) == want


def test_formula_keys(spark):
    df = spark.createDataFrame([("C12 H12 Na2 Cl2",)], "f string").select(formula.parse_formula(F.col("f")).alias("m"))
    key, strict = formula.composition_keys(F.col("m"))
    assert tuple(df.select(key, strict).first()) == ("C6 Cl1 H6 Na1", "C6 Cl1 Na1 ")


def test_cells(spark):
    right = [F.lit(math.pi / 2)] * 3
    cubic = [F.lit(4.0)] * 3 + right
    assert value(spark, cell.q2_direct(F.lit(1), F.lit(1), F.lit(1), cubic)) == pytest.approx(0.1875)
    hexagonal = [F.lit(3.0), F.lit(3.0), F.lit(5.0), *right[:2], F.lit(2 * math.pi / 3)]
    assert value(spark, cell.q2_direct(F.lit(1), F.lit(0), F.lit(0), hexagonal)) == pytest.approx(4 / 27)
    a, alpha = cell.hex_to_rhomb(F.lit(3.0), F.lit(3.0))
    assert value(spark, a) == pytest.approx(2.0)
    assert value(spark, alpha) == pytest.approx(2 * math.asin(0.75))
    bad = [F.lit(5.0)] * 3 + [F.lit(0.1), F.lit(1.5), F.lit(3.0)]
    assert value(spark, cell.volume(*bad)) is None and value(spark, cell.xnn(bad)[0]) is None
    back = cell.cell_of_xnn(cell.xnn([F.lit(x) for x in (5.0, 6.0, 7.0, 1.4, 1.5, 1.6)]))
    assert [value(spark, v) for v in back] == pytest.approx([5.0, 6.0, 7.0, 1.4, 1.5, 1.6])


def test_monoclinic_settings_keep_volume(spark):
    args = [F.lit(x) for x in (6.76298, 13.80425, 6.82476, math.radians(111.07))]
    rows = value(spark, cell.monoclinic_settings(*args))
    volumes = {round(r["a"] * r["b"] * r["c"] * math.sin(r["beta"]), 6) for r in rows}
    assert len(rows) == 10 and len(volumes) == 1


def test_peaks(spark):
    n = value(spark, peaks.nearest(F.lit(2.0), doubles(1, 3)))
    assert n["i"] == 0
    assert value(spark, search.m20(doubles(1, 2), doubles(1.1, 2.1), doubles(1.1, 2.1, 3))) == pytest.approx(5.5)
    found = value(spark, peaks.maxima(doubles(0, 3, 1, 5, 0), 3.0))
    assert [(r["i"], r["prominence"]) for r in found] == [(3, 5.0)]
    flat = value(spark, peaks.maxima(doubles(0, 2, 2, 2, 1, 4, 4, 0, 9), 1.0))
    assert [(r["i"], r["prominence"]) for r in flat] == [(2, 1.0), (5, 4.0)]
    near = value(spark, peaks.maxima(doubles(0, 3, 1, 5, 0, 2, 0), 0.0, distance=3))
    assert [r["i"] for r in near] == [3]
    for angle, want in ((2.0, math.pi - 2), (-0.5, 0.5), (-2.0, math.pi - 2)):
        assert value(spark, optics.fold_angle(F.lit(angle))) == pytest.approx(want)


def test_labels(spark):
    refs = spark.createDataFrame([(0, [1]), (1, [2]), (2, [2])], "ref_index int, t array<int>")
    df = spark.createDataFrame([(0, [3]), (1, [1]), (2, [2])], "p int, t array<int>")
    assert {r["p"]: r["label"] for r in peaks.label_peaks(df, refs, "t", F.lit(9)).collect()} == {0: 9, 1: 0, 2: 9}


def test_least_squares(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 4.0)], "g int, t double, y double")
    assert search.weighted_lsq(df, ["g"], F.col("y"), [F.col("t")], F.lit(1.0)).first()["x0"] == pytest.approx(2.0)


def test_pair_lift(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "b")], "f int, i string")
    (row,) = stats.pair_lift(df, "f", "i").collect()
    assert row["joint"] == 2 and row["lift"] == pytest.approx(2 / (9 / 4))


def test_index_edit(spark):
    df = spark.createDataFrame([(i, i) for i in range(5)], "old int, i int")
    assert {r["old"]: r["i"] for r in peaks.reindex_after_edit(df, "i", [1], [3]).collect()} == {0: 0, 2: 1, 3: 3, 4: 4}


def test_symmetry(spark):
    rows = {r["sg"]: r for r in symmetry.space_groups(spark).collect()}
    assert len(rows) == 230
    assert [rows[n]["lattice"] for n in (1, 5, 14, 22, 62, 88, 146, 194, 196, 197, 230)] == ["aP", "mC", "mP", "oF", "oP", "tI", "hR", "hP", "cF", "cI", "cI"]
    assert rows[167]["lattice_system"] == "rhombohedral" and rows[150]["lattice_system"] == "hexagonal"
    assert value(spark, symbols.normalise_symbol(F.lit("'P2_1/c'"))) == "P 1 21/c 1"


def test_cif(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.cif").write_text("data_x\n_cell_length_a   4.15686(4)\n_chemical_formula_sum 'Cs1 Cl1'\n_cell_volume ?\n_space_group_IT_number 221\n")
    row = io.scan_cif(spark, str(tmp_path)).first()
    assert (row["a"], row["chemical_formula"], row["volume"], row["spacegroup_number"], row["b"]) == (4.15686, "Cs1 Cl1", None, 221, None)
    (tmp_path / "p.txt").write_text("# peaks\n[10.5, 0]\n[np.float64(20.0), 1]\n")
    got = sorted(r["q2"] for r in io.scan_peak_text(spark, str(tmp_path / "p.txt"), 1.5).collect())
    assert got == pytest.approx([(2 * math.sin(math.radians(t / 2)) / 1.5) ** 2 for t in (10.5, 20.0)])


def test_search_recovers_cell(spark):
    """A known cubic cell comes back from its peaks."""
    sums = [s for s in range(1, 80) if s % 8 != 7 and s not in (28, 60)]
    x = 1 / 4.15686**2
    df = spark.createDataFrame([(7, i, x * s) for i, s in enumerate(sums[:10])], "pattern_id long, peak_index int, q2 double")
    best = search.cubic_search(df, sums, top=1).first()
    assert 1 / math.sqrt(best["x"]) == pytest.approx(4.15686, rel=0.01)


def test_generators(spark):
    df = spark.createDataFrame([(i, [0.01 * j for j in range(1, 11)]) for i in range(20)], "id int, q2 array<double>")
    for r in candidates.add_q2_noise(df, "id").collect():
        assert r["q2"] == sorted(r["q2"]) and all(abs(a - 0.01 * j) < 0.002 for j, a in enumerate(r["q2"], 1))
    for r in candidates.add_contaminants(df, "id", 2).collect():
        assert len(r["q2"]) == 10 and r["q2"] == sorted(r["q2"]) and len({round(q, 9) for q in r["q2"]} - {round(0.01 * j, 9) for j in range(1, 11)}) in (1, 2)  # one may lie beyond the cut
    for r in candidates.perturb_at_distances(df.withColumnRenamed("q2", "x"), "id", "x", [0.5], 2).collect():
        assert math.dist(r["x"], [0.01 * j for j in range(1, 11)]) == pytest.approx(0.5)
    for r in candidates.thin_peaks(df, "id", "q2", 0.5, 0.015).collect():
        assert r["q2"][0] == 0.01 and all(b - a >= 0.015 for a, b in zip(r["q2"], r["q2"][1:]))
    rows = spark.createDataFrame([(i, [float(i // 3), 0.0], float(i)) for i in range(9)], "id int, v array<double>, s double")
    assert sorted(r["id"] for r in candidates.dedup_radius(rows.withColumn("g", F.lit(0)), ["g"], "id", "v", "s", "s", 0.5).collect()) == [2, 5, 8]
    taken = candidates.draw_assignments(spark.createDataFrame([(0, p, l, 1.0) for p in range(3) for l in range(3)], "k int, p int, l int, w double"), "k", "p", "l", "w").collect()
    assert sorted(r["p"] for r in taken) == sorted(r["l"] for r in taken) == [0, 1, 2]
