"""Searching cells in every lattice system, on patterns whose cell is known; reduction of triclinic cells."""

import math

import numpy as np
import pytest
from pyspark.sql.functions import lit as df_lit

from cellspark.operators import indexing as ix
from cellspark.operators import reduction

#: A cell of each system, as coefficients of its reciprocal cell.
TRUE = {"cP": [1 / 5.43**2], "tP": [1 / 4.59**2, 1 / 2.96**2], "hP": [4 / 3 / 4.91**2, 1 / 5.40**2], "hR": [0.05, 0.031], "oP": [1 / 5.2**2, 1 / 6.7**2, 1 / 8.9**2], "mP": [0.031, 0.022, 0.014, 0.009], "aP": [0.031, 0.024, 0.017, 0.006, 0.009, 0.004]}


def peaks_of(spark, lattice, n):
    refs = ix.reference_terms(spark, lattice, 200)
    return np.unique(np.round(refs @ np.array(TRUE[lattice]), 9))[:n]


def patterns(spark, lattice, n=20):
    q = peaks_of(spark, lattice, 10 if lattice[0] == "c" else n)
    return spark.createDataFrame([(1, q.tolist()), (2, (q * 1.3).tolist()), (3, [0.01])], "pattern_id long, q array<double>"), q


def candidates(df, x, seed=0):
    """Cells about 2 percent off the true one."""
    r = np.random.default_rng(seed)
    rows = [(p["pattern_id"], c, p["q"], (np.array(x) * (1.3 if p["pattern_id"] == 2 else 1) * (1 + r.uniform(-0.02, 0.02, len(x)))).tolist(), 0.0) for p in df.collect() if len(p["q"]) > 1 for c in range(30)]
    return df.sparkSession.createDataFrame(rows, ix.COLUMNS)


def plain_merit(q, x, refs):
    ref = sorted(float(v) for v in refs @ np.asarray(x))
    calc = [min(ref, key=lambda v: (abs(v - z), v)) for z in q]
    below = [v for v in ref if v < calc[-1]]
    error = sum(abs(a - b) for a, b in zip(calc, q, strict=True)) / len(q)
    return 0.0 if not below else max(below) / (2 * len(below)) / error if error else math.inf


@pytest.mark.parametrize("lattice", list(TRUE))
def test_refinement_recovers_cell(spark, lattice):
    df, q = patterns(spark, lattice)
    system, refs = ix.system_of(lattice), ix.reference_terms(spark, lattice, 200)
    start = candidates(df, TRUE[lattice])
    out = ix.refine_step(start, refs, system, "random_subsampling", *[(20, k) for _, k in [ix.STEPS[system]]][0])
    out = ix.refine_step(out, refs, system, "deterministic", 3).collect()
    assert len(out) == 60
    for p, factor in ((1, 1), (2, 1.3)):
        best = max((r for r in out if r["pattern_id"] == p), key=lambda r: r["m20"])
        assert np.allclose(np.array(best["xnn"]) / factor, TRUE[lattice], rtol=0.01), (best, TRUE[lattice])
        assert best["m20"] > 100
    for r in out[:20]:
        want = plain_merit(r["q"], r["xnn"], refs)
        assert r["m20"] == pytest.approx(want, rel=1e-6) or (r["m20"] > 1e6 and want > 1e6)


@pytest.mark.parametrize("worker", list(ix.WORKERS))
def test_workers(spark, worker):
    df, q = patterns(spark, "oP")
    refs = ix.reference_terms(spark, "oP", 200)
    start = ix.score(candidates(df, TRUE["oP"]), refs)
    out = [ix.refine_step(start.repartition(n), refs, "orthorhombic", worker, 10, 6, seed=3) for n in (1, 5)]
    a, b = ({(r["pattern_id"], r["candidate_id"]): (r["m20"], r["xnn"]) for r in o.collect()} for o in out)
    assert {k: pytest.approx(v[0], rel=1e-6) for k, v in a.items()} == {k: v[0] for k, v in b.items()}
    before = {(r["pattern_id"], r["candidate_id"]): r["m20"] for r in start.collect()}
    assert all(a[k][0] >= before[k] * (1 - 1e-9) for k in a) and sum(a[k][0] > before[k] for k in a) > 30


def test_exact_cell_is_kept(spark):
    q = [0.04 * s for s in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11)]
    refs = np.array([[s] for s in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12)], float)
    cands = spark.createDataFrame([(1, 0, q, [0.04], 0.0), (1, 1, q, [0.0401], 0.0)], ix.COLUMNS)
    got = {r["candidate_id"]: r for r in ix.refine_step(cands, refs, "cubic", "deterministic", 3).collect()}
    assert got[0]["m20"] == math.inf and got[0]["xnn"] == [0.04]
    assert got[1]["xnn"][0] == pytest.approx(0.04) and got[1]["m20"] > 1e6


@pytest.mark.parametrize("lattice", list(TRUE))
def test_multiples_are_corrected(spark, lattice):
    df, q = patterns(spark, lattice)
    system, refs = ix.system_of(lattice), ix.reference_terms(spark, lattice, 200)
    factors = ix.multiples(system)
    assert (factors[0] == 1).all() and factors.shape[1] == len(TRUE[lattice])
    f = factors[len(factors) // 2]
    cands = spark.createDataFrame([(1, 0, q.tolist(), (np.array(TRUE[lattice]) * f).tolist(), 0.0)], ix.COLUMNS)
    before = ix.score(cands, refs).first()["m20"]
    after = ix.correct_multiples(cands, refs, system).first()
    assert after["m20"] >= before and after["m20"] > 100


def test_spread_dense(spark):
    """Of a dense spot the excess moves, and only it; the likeliest cell keeps its share."""
    rows = [(1, c, [0.1, 0.2], [0.02, 0.02, 0.02], 0.0) for c in range(20)] + [(1, 20 + c, [0.1, 0.2], [0.02 + c / 100, 0.03, 0.04], 0.0) for c in range(1, 11)] + [(1, 40, [0.1, 0.2], [math.nan, 0.1, 0.1], 0.0)]
    df = spark.createDataFrame(rows, ix.COLUMNS)
    outs = [ix.spread_dense(df.repartition(n), "orthorhombic", 0.001, 3).collect() for n in (1, 7, 31)]
    out = sorted(outs[0], key=lambda r: r["candidate_id"])
    x = np.array([r["xnn"] for r in out if r["candidate_id"] != 40])
    near = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) < 0.001).sum(1)
    assert len(out) == 31 and near.max() <= 3
    assert sum((v == 0.02).all() for v in x[:20]) == 3 and all(list(v) == r[3] for v, r in zip(x[20:], rows[20:30], strict=True))
    told = [sorted((r["candidate_id"], str(r["xnn"])) for r in o) for o in outs]
    assert told[0] == told[1] == told[2]
    crowd = spark.createDataFrame([(1, c, [0.1], [0.02, 0.02, 0.02], 0.0) for c in range(50)], ix.COLUMNS)  # no room anywhere at first
    x = np.array([r["xnn"] for r in ix.spread_dense(crowd, "orthorhombic", 0.001, 3).collect()])
    assert (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) < 0.001).sum(1).max() <= 3


def test_bad_rows_stay_their_own(spark):
    """A cell or a peak that is NaN or infinite has merit 0, and no say in any other row."""
    refs = ix.reference_terms(spark, "oP", 200)
    x = np.array([[0.011, 0.023, 0.047], [0.012, 0.021, 0.033], [0.013, 0.027, 0.031]])
    q = np.sort(ix.calculated(x, refs), 1)[:, :20] * (1 + 1e-4)
    alone = np.concatenate([ix.assign(q[i : i + 1], x[i : i + 1], refs)[2] for i in range(3)])
    bad_x, bad_q = np.insert(x, 1, [[np.nan, 1, 1], [np.inf, 1, 1]], 0), np.insert(q, 1, q[:2], 0)
    bad_x, bad_q = np.append(bad_x, x[:1], 0), np.append(bad_q, [[np.nan, *q[0, 1:]]], 0)
    at, calc, m = ix.assign(bad_q, bad_x, refs)
    assert (alone > 100).all() and m.tolist() == [alone[0], 0, 0, alone[1], alone[2], 0] and np.isnan(calc[1]).all()
    assert (ix.masked_merits(bad_q, bad_x, refs, np.ones((1, len(refs)), bool))[:, 0] == m).all()
    lost = ix.physical(np.array([[np.nan, 1.0, 1.0], [0.02, 0.03, 0.04]]), "orthorhombic")
    assert lost.tolist() == [[0.04, 0.04, 0.04], [0.02, 0.03, 0.04]]
    rows = [(1, i, list(map(float, a)), list(map(float, b)), 0.0) for i, (a, b) in enumerate(zip(bad_q, bad_x, strict=True))]
    df = spark.createDataFrame(rows, ix.COLUMNS)
    for stage in (lambda d: ix.refine_step(d, refs, "orthorhombic", steps=5), lambda d: ix.refine_indexed(d, refs, "oP"), lambda d: ix.correct_multiples(d, refs, "orthorhombic"), lambda d: ix.finish(ix.score(d, refs), "oP", 9)):
        told = [sorted((r["candidate_id"], r["m20"], str(r["xnn"])) for r in stage(df.repartition(n)).collect()) for n in (1, 7, 31)]
        assert told[0] == told[1] == told[2]
        assert all(m == 0 for c, m, _ in told[0] if c == 5)


def test_ties_of_nearest():
    at, calc = ix.nearest(np.array([[2.0, 5.0, 3.0]]), np.array([[3.0, 1.0, 3.0, 6.0, 4.0]]))
    assert at.tolist() == [[1, 4, 0]] and calc.tolist() == [[1.0, 4.0, 3.0]]


def test_thinned_in_blocks(spark):
    x = np.array([[0.0], [0.05], [0.1], [1.0], [1.05], [3.0]])
    left = ix.thinned(x, np.array([1.0, 2, 3, 5, 4, 0]), 0.08)
    d = np.abs(x[left] - x[left].T)
    assert (d + np.eye(left.sum()) * 9 >= 0.08).all() and left[3] and left[5]
    assert ix.thinned(np.zeros((0, 2)), np.zeros(0), 1.0).tolist() == []


def test_whole_search(spark):
    """All stages in one lineage lead to the planted cell, or one with its lines, in each system; rows are ranked over the lattices."""
    for lattice in ("cP", "tP", "hP", "hR"):
        df, _ = patterns(spark, lattice)
        out = ix.index_patterns(df, [lattice, "cI"], {"templates": 60, "random": 20}, top=6).collect()
        for p in (1, 2):
            own = sorted((r for r in out if r["pattern_id"] == p), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) <= 6
            assert all(a["m20"] >= b["m20"] for a, b in zip(own, own[1:], strict=False))
            assert own[0]["lattice"] == lattice and own[0]["n_indexed"] >= 10 and own[0]["extinction_group"]
    near = {"oP": 0.01, "mP": 0.008, "aP": 0.008}
    for lattice, share in near.items():
        system, refs = ix.system_of(lattice), ix.reference_terms(spark, lattice)
        known = spark.createDataFrame([(1, TRUE[lattice])], "id long, x array<double>")
        starts = ix.near_cells(ix.peaks_of_cells(known, "id", "x", lattice), system, 40, share)
        generators = {"near": lambda patterns, refs, system, n: starts}
        best = ix.index_patterns(starts.select("pattern_id", "q").limit(1), [lattice], {"near": 40}, top=3, generators=generators).orderBy("rank").first()
        want = ix.reciprocal_volume(np.array([TRUE[lattice]]), system)[0]
        assert ix.reciprocal_volume(np.array([best["xnn"]]), system)[0] == pytest.approx(want, rel=0.01) and best["n_indexed"] == 20
    odd = spark.createDataFrame([(1, []), (2, [0.1, math.nan]), (3, None)], "pattern_id long, q array<double>")
    assert ix.index_patterns(odd, ["cP"], {"random": 3}).count() == 0


def test_reduction(spark):
    r = np.random.default_rng(5)
    cells = np.concatenate([r.uniform(4, 12, (200, 3)), np.radians(r.uniform(50, 130, (200, 3)))], 1)
    rows = [(i, *map(float, c)) for i, c in enumerate(cells)] + [(900, 5.0, 5.0, 5.0, 1.0, 2.5, 1.0), (901, 0.0, 5.0, 5.0, 1.5, 1.5, 1.5), (902, None, 5.0, 5.0, 1.5, 1.5, 1.5), (903, 4.0, 5.0, 6.0, math.pi / 2, math.pi / 2, math.pi / 2)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, alpha double, beta double, gamma double")
    got = {x["id"]: x for x in reduction.reduce_triclinic(df, "id").collect()}
    assert len(got) == len(rows) and all(got[i]["a"] is None and got[i]["axes"] is None for i in (900, 901, 902))
    assert [round(got[903][n], 9) for n in "abc"] == [4, 5, 6]
    seen = 0
    for i, c in enumerate(cells):
        g = reduction.metric(c[None])[0]
        if got[i]["a"] is None:
            assert np.linalg.det(g) <= 1e-9 * np.prod(c[:3]) ** 2
            continue
        seen += 1
        new = np.array([got[i][n] for n in ("a", "b", "c", "alpha", "beta", "gamma")])
        m = np.array(got[i]["axes"]).reshape(3, 3)
        assert abs(round(np.linalg.det(m))) == 1
        h = reduction.metric(new[None])[0]
        assert np.allclose(m @ g @ m.T, h, rtol=1e-6, atol=1e-6)
        assert np.linalg.det(h) == pytest.approx(np.linalg.det(g), rel=1e-6)
        assert new[0] <= new[1] + 1e-9 <= new[2] + 2e-9
        cos = np.cos(new[3:])
        assert (cos >= -1e-7).all() or (cos <= 1e-7).all()
        span = range(-2, 3)
        short = sorted(np.array(v) @ h @ np.array(v) for v in ((a, b, c) for a in span for b in span for c in span) if v != (0, 0, 0))
        assert new[0] ** 2 == pytest.approx(short[0], rel=1e-6)
    assert seen > 100


def test_absence_groups(spark):
    """Reflections of a group alone are best told by that group; all groups at once score as each by itself."""
    from cellspark.functions import extinction

    for lattice, x, names in (("oP", [0.0119, 0.0341, 0.0623], ("P 21 21 21", "P n a -", "P - - -")), ("tP", [0.0119, 0.0341], ("P 42/n - -", "P - b -")), ("cF", [0.0119], ("F d - -",)), ("hP", [0.0119, 0.0341], ("P 61 - -", "P - c c"))):
        x = np.array(x)
        _, terms = ix.references(spark, lattice, 200)
        groups, masks = ix.group_masks(lattice, terms)
        assert masks[0].all() and len(groups) == len({m.tobytes() for m in masks})
        for name in names:
            mask = masks[[g.name for g in groups].index(name)]
            q = np.unique(np.round(terms[mask] @ x, 9))[:20] * (1 + 1e-4 * np.sin(np.arange(20)))[: len(np.unique(np.round(terms[mask] @ x, 9))[:20])]
            each = ix.masked_merits(q[None], x[None], terms, masks)[0]
            assert each.tolist() == [ix.assign(q[None], x[None], terms[m])[2][0] for m in masks]
            row = ix.absence_groups(spark.createDataFrame([(1, 0, q.tolist(), x.tolist(), 0.0)], ix.COLUMNS), lattice).first()
            assert row["group_m20"] == each.max()
            chosen = terms[masks[[g.name for g in groups].index(row["extinction_group"])]] @ x
            assert all(np.abs(chosen - z).min() < 0.003 for z in q)


#: Symbols of all families and the numbers of their groups, typed from the published list.
KNOWN = {
    "P 1 2/m 1": 15, "P121/m1": 16, "P 1 n 1": 21, "P 21/n": 22, "I12/m1": 27, "I12/a1": 28, "P222": 43, "P2221": 44, "P2212": 45, "P22121": 46, "P2122": 47, "P21221": 48, "P21212": 49, "P 21 21 21": 50,
    "P21ma": 51, "Pmma": 51, "Pm21b": 52, "P21mn": 53, "Pma2": 54, "P2aa": 55, "P21ab": 56, "Pman": 57, "Pmc21": 58, "P21nm": 62, "P2na": 63, "Pb21m": 66, "Pb2n": 69, "Pbam": 70, "Pbc21": 74, "Pbca": 75, "Pbcn": 77, "Pbn21": 78, "Pc2m": 82, "Pc21b": 84,
    "Pca21": 86, "Pcc2": 90, "Pccn": 93, "Pcn2": 94, "Pn21m": 98, "P n m a": 99, "Pna21": 102, "Pnc2": 106, "Pnnm": 110, "Pnnn": 113, "Cmm2": 114, "C2221": 115, "Cmma": 116, "C2mb": 116, "Cmcm": 117, "C2cb": 118, "Cmca": 118, "Ccm21": 119, "Ccmb": 120, "Cccm": 121, "Ccca": 122,
    "B2mm": 123, "B2212": 124, "Bm21b": 125, "Bma2": 126, "B2cm": 126, "Bmab": 127, "Bb21m": 128, "Bb2b": 129, "Bbcm": 130, "Bbcb": 131, "A2122": 133, "A21ma": 134, "Ama2": 135, "A2aa": 136, "Abm2": 137, "Ac2a": 138, "Aba2": 139, "Acaa": 140, "I212121": 141, "Imma": 142, "I2cm": 143, "I2cb": 144, "Ibm2": 145, "Icma": 146, "Ibam": 147, "Icab": 148, "Fmm2": 149, "F2dd": 150, "Fdd2": 152, "Fddd": 153,
    "P4/mmm": 154, "P-4m2": 154, "P-421m": 155, "P42/m": 156, "P4222": 156, "P42212": 157, "P43": 158, "P4322": 158, "P43212": 159, "P42/mmc": 160, "P-421c": 161, "P4/mbm": 162, "P42/mbc": 163, "P-4c2": 164, "P4cc": 165, "P42/mnm": 166, "P4nc": 167, "P4/nmm": 168, "P42/n": 169, "P42/nmc": 170, "P4/nbm": 171, "P42/nbc": 172, "P42/ncm": 173, "P4/ncc": 174, "P42/nnm": 175, "P4/nnc": 176,
    "I-42m": 177, "I4122": 178, "I-42d": 179, "I4/mcm": 180, "I41cd": 181, "I41/a": 182, "I 41/a m d": 183, "I41/acd": 184, "P31m": 185, "P-6m2": 185, "P312": 185, "P3212": 186, "P32": 186, "P63/mmc": 187, "P31c": 187, "P-6c2": 188, "P3c1": 188, "R-3m": 189, "R3c": 190, "P6322": 195, "P64": 196, "P6222": 196, "P6522": 197, "P6/mcc": 198,
    "P-43m": 199, "P432": 199, "P213": 200, "P4232": 201, "P4332": 202, "Pm-3n": 203, "Pa-3": 204, "Pn-3m": 205, "Pn-3n": 206, "I213": 207, "I432": 207, "I4132": 208, "I-43d": 209, "Ia-3": 210, "Ia-3d": 211, "F m -3 m": 212, "F4132": 213, "Fm-3c": 214, "Fd-3m": 215, "Fd-3c": 216, "P-1": 217,
}


def test_extinction_groups_of_symbols(spark):
    from cellspark.functions import extinction

    rows = [(s, n) for s, n in KNOWN.items()] + [(" ".join(s), n) for s, n in KNOWN.items() if all(c.isalpha() for c in s)] + [("", None), (None, None), ("P 7", None), ("Q222", None), ("P2x2", None)]
    df = spark.createDataFrame(rows, "symbol string, want int").withColumn("extinction_group", df_lit("clash"))
    for r in extinction.with_extinction_group(df).collect():
        assert r["extinction_code"] == r["want"], r
    names = {g.code: g.name for g in extinction.all_groups()}
    assert names[75] == "P b c a" and names[144] == "I - c b" and names[131] == "B b (ac) b" and names[169] == "P 42/n - -" and len(names) == len(extinction.all_groups())
    assert [len(extinction.groups(x)) for x in ("cF", "cI", "cP", "hP", "hR", "tI", "tP", "oC", "oF", "oI", "oP", "mC", "mP", "aP")] == [5, 5, 7, 7, 2, 8, 23, 9, 5, 8, 71, 2, 8, 1]
