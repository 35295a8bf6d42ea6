"""Queries on cells, symmetry, formulas and diffraction geometry."""

import math

from pyspark.sql import functions as F

from cellspark.functions import cell, formula, optics, symmetry
from cellspark.operators.indexing import dealt
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view

C = WITH["cells"]
ABC = ("a", "b", "c", "alpha", "beta", "gamma")
_ROOT = "1 - cos(alpha)*cos(alpha) - cos(beta)*cos(beta) - cos(gamma)*cos(gamma) + 2*cos(alpha)*cos(beta)*cos(gamma)"
#: The reciprocal cell, with columns va, vb, vc (lengths), ca, cb, cg (cosines of angles) beside the cell.
_REC = f"""{C}, r AS (SELECT *, a*b*c*sqrt({_ROOT}) AS vol FROM v WHERE {_ROOT} > 0),
s AS (SELECT *, b*c*sin(alpha)/vol AS ra, a*c*sin(beta)/vol AS rb, a*b*sin(gamma)/vol AS rc,
  (cos(beta)*cos(gamma)-cos(alpha))/(sin(beta)*sin(gamma)) AS ca, (cos(alpha)*cos(gamma)-cos(beta))/(sin(alpha)*sin(gamma)) AS cb, (cos(alpha)*cos(beta)-cos(gamma))/(sin(alpha)*sin(beta)) AS cg FROM r)"""
_XNN = f"""{_REC}, x AS (SELECT *, ra*ra AS x0, rb*rb AS x1, rc*rc AS x2,
  CASE WHEN alpha = radians(90e0) AND (beta = radians(90e0) OR gamma = radians(90e0)) THEN 0 ELSE 2*rb*rc*ca END AS x3,
  CASE WHEN beta = radians(90e0) AND (alpha = radians(90e0) OR gamma = radians(90e0)) THEN 0 ELSE 2*ra*rc*cb END AS x4,
  CASE WHEN gamma = radians(90e0) AND (alpha = radians(90e0) OR beta = radians(90e0)) THEN 0 ELSE 2*ra*rb*cg END AS x5 FROM s)"""
_SYSTEM = "CASE " + " ".join(f"WHEN sg <= {last} THEN '{family}'" for last, _, family, _ in symmetry.RANGES) + " END"
_LATTICE = "CASE " + " ".join(f"WHEN sg IN {numbers} THEN '{name}'" for name, numbers in symmetry.CENTRED.items()) + " " + " ".join(f"WHEN sg <= {last} THEN '{letter}P'" for last, letter, *_ in symmetry.RANGES) + " END"
_LSYSTEM = f"CASE WHEN ({_LATTICE}) = 'hR' THEN 'rhombohedral' ELSE {_SYSTEM} END"


def cells(spark, sf_dir):
    return view(spark, sf_dir, "cells")


def _rounded(values, names, digits=6):
    return [F.round(v, digits).alias(n) for v, n in zip(values, names, strict=True)]


@query(f"{C} SELECT entry_id, {_LATTICE} AS lattice, {_SYSTEM} AS family, {_LSYSTEM} AS lattice_system FROM v")
def j1_with_symmetry(spark, sf_dir):
    return symmetry.with_symmetry(cells(spark, sf_dir)).select("entry_id", "lattice", "family", "lattice_system")


@query(f"{C}, l AS (SELECT entry_id, {_LATTICE} AS lattice, CASE entry_id % 4 WHEN 0 THEN 'cubic' WHEN 1 THEN 'monoclinic' WHEN 2 THEN 'trigonal' ELSE 'tetragonal' END AS s FROM v) SELECT entry_id, s, CASE s WHEN 'cubic' THEN lattice IN ('cF','cI','cP') WHEN 'monoclinic' THEN lattice IN ('mC','mP') WHEN 'trigonal' THEN lattice IN ('hR','hP') ELSE lattice IN ('tI','tP') END AS ok FROM l")
def p8_system_matches_lattice(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, ("cubic", "monoclinic", "trigonal", "tetragonal"))), (F.col("entry_id") % 4 + 1).cast("int"))
    return symmetry.with_symmetry(cells(spark, sf_dir)).select("entry_id", s.alias("s"), symmetry.system_matches_lattice(s, F.col("lattice")).alias("ok"))


@query(f"""{C}, d AS (SELECT entry_id, {_LATTICE} AS lattice, a, CASE WHEN entry_id % 2 = 0 THEN a ELSE b END AS b, CASE WHEN entry_id % 3 = 0 THEN a ELSE c END AS c,
  90 + entry_id % 2 AS al, 90 + entry_id % 3 AS be, CASE WHEN entry_id % 5 = 0 THEN 120 ELSE 90 + entry_id % 2 END AS ga FROM v)
SELECT entry_id, CASE WHEN lattice IN ('cF','cI','cP') THEN al = 90 AND be = 90 AND ga = 90 AND a = b AND b = c
  WHEN lattice IN ('tI','tP') THEN al = 90 AND be = 90 AND ga = 90 AND (a = b OR a = c OR b = c)
  WHEN lattice IN ('oC','oF','oI','oP') THEN al = 90 AND be = 90 AND ga = 90
  WHEN lattice = 'hR' THEN (a = b AND b = c AND al = be AND be = ga) OR (a = b AND b <> c AND al = 90 AND be = 90 AND ga = 120)
  WHEN lattice = 'hP' THEN a = b AND b <> c AND al = 90 AND be = 90 AND ga = 120
  WHEN lattice IN ('mC','mP') THEN al = 90 AND ga = 90 AND be <> 90 ELSE true END AS ok FROM d""")
def p9_cell_matches_lattice(spark, sf_dir):
    e = F.col("entry_id")
    v = symmetry.with_symmetry(cells(spark, sf_dir))
    values = [F.col("a"), F.when(e % 2 == 0, F.col("a")).otherwise(F.col("b")), F.when(e % 3 == 0, F.col("a")).otherwise(F.col("c")), 90 + e % 2, 90 + e % 3, F.when(e % 5 == 0, 120).otherwise(90 + e % 2)]
    return v.select("entry_id", cell.matches_lattice(F.col("lattice"), *values).alias("ok"))


@query(f"{C} SELECT entry_id, round(CASE WHEN {_ROOT} > 0 THEN a*b*c*sqrt({_ROOT}) END, 6) AS volume FROM v")
def p10_cell_volume(spark, sf_dir):
    return cells(spark, sf_dir).select("entry_id", F.round(cell.volume(*cell.columns()), 6).alias("volume"))


@query(f"{_REC} SELECT entry_id, round(ra, 9) AS ra, round(rb, 9) AS rb, round(rc, 9) AS rc, round(acos(ca), 9) AS ralpha, round(acos(cb), 9) AS rbeta, round(acos(cg), 9) AS rgamma FROM s")
def p11_reciprocal_cell(spark, sf_dir):
    return cells(spark, sf_dir).select("entry_id", *_rounded(cell.reciprocal(*cell.columns()), ("ra", "rb", "rc", "ralpha", "rbeta", "rgamma"), 9))


@query(f"{_XNN} SELECT entry_id, {', '.join(f'round(x{i}, 9) + 0e0 AS x{i}' for i in range(6))} FROM x")
def p12_xnn_from_cell(spark, sf_dir):
    return cells(spark, sf_dir).select("entry_id", *[(F.round(x, 9) + 0.0).alias(f"x{i}") for i, x in enumerate(cell.xnn(cell.columns()))])


@query(f"{C} SELECT entry_id, {', '.join(f'round({n}, 6) AS {n}' for n in ABC)} FROM v")
def p12_cell_from_xnn(spark, sf_dir):
    """There and back: the cell of a cell's coefficients is the cell."""
    v = cells(spark, sf_dir)
    x = v.select("entry_id", *[c.alias(f"x{i}") for i, c in enumerate(cell.xnn(cell.columns()))])
    return x.select("entry_id", *_rounded(cell.cell_of_xnn([F.col(f"x{i}") for i in range(6)]), ABC))


_PARTS = {"cubic": "a", "tetragonal": "a, c", "hexagonal": "a, c", "rhombohedral": "a, alpha", "orthorhombic": "a, b, c", "monoclinic": "a, b, c, beta", "triclinic": "a, b, c, alpha, beta, gamma"}
_HALF = f"{math.pi / 2!r}"
_FULLS = {"cubic": f"a, a, a, {_HALF}, {_HALF}, {_HALF}", "tetragonal": f"a, a, c, {_HALF}, {_HALF}, {_HALF}", "hexagonal": f"a, a, c, {_HALF}, {_HALF}, {2 * math.pi / 3!r}", "rhombohedral": "a, a, a, alpha, alpha, alpha", "orthorhombic": f"a, b, c, {_HALF}, {_HALF}, {_HALF}", "monoclinic": f"a, b, c, {_HALF}, beta, {_HALF}", "triclinic": "a, b, c, alpha, beta, gamma"}


@query(f"{C}, s AS (SELECT *, {_LSYSTEM} AS s FROM v) SELECT entry_id, list_transform(CASE s {' '.join(f"WHEN '{k}' THEN [{p}]" for k, p in _PARTS.items())} END, lambda x: round(x, 6)) AS cell FROM s")
def p13_partial_cell(spark, sf_dir):
    v = symmetry.with_symmetry(cells(spark, sf_dir))
    return v.select("entry_id", F.transform(cell.partial(F.col("lattice_system"), cell.columns()), lambda x: F.round(x, 6)).alias("cell"))


@query(f"{C}, s AS (SELECT *, {_LSYSTEM} AS s FROM v) SELECT entry_id, list_transform(CASE s {' '.join(f"WHEN '{k}' THEN [{p}]" for k, p in _FULLS.items())} END, lambda x: round(x, 6)) AS cell FROM s")
def p13_full_cell(spark, sf_dir):
    v = symmetry.with_symmetry(cells(spark, sf_dir))
    s = F.col("lattice_system")
    return v.select("entry_id", F.transform(cell.full(s, cell.partial(s, cell.columns())), lambda x: F.round(x, 6)).alias("cell"))


_HKL = "SELECT entry_id, CAST(entry_id % 4 AS INT) AS h, CAST(entry_id % 3 AS INT) - 1 AS k, CAST(entry_id % 5 AS INT) AS l"
_TERMS = {"cubic": "h*h+k*k+l*l", "tetragonal": "h*h+k*k, l*l", "hexagonal": "h*h+h*k+k*k, l*l", "rhombohedral": "h*h+k*k+l*l, h*k+h*l+k*l", "orthorhombic": "h*h, k*k, l*l", "monoclinic": "h*h, k*k, l*l, h*l", "triclinic": "h*h, k*k, l*l, k*l, h*l, h*k"}


def _hkl():
    e = F.col("entry_id")
    return [(e % 4).cast("int").alias("h"), ((e % 3).cast("int") - 1).alias("k"), (e % 5).cast("int").alias("l")]


@query(f"{C}, s AS ({_HKL}, {_LSYSTEM} AS s FROM v) SELECT entry_id, CASE s {' '.join(f"WHEN '{k}' THEN [{t}]" for k, t in _TERMS.items())} END AS terms FROM s")
def p14_hkl_terms(spark, sf_dir):
    v = symmetry.with_symmetry(cells(spark, sf_dir)).select("entry_id", "lattice_system", *_hkl())
    return v.select("entry_id", cell.hkl_terms(F.col("h"), F.col("k"), F.col("l"), F.col("lattice_system")).alias("terms"))


@query(f"{_XNN}, h AS ({_HKL}, x0, x1, x2, x3, x4, x5 FROM x) SELECT entry_id, round(x0*h*h + x1*k*k + x2*l*l + x3*k*l + x4*h*l + x5*h*k, 9) AS q2 FROM h")
def p15_q2_of(spark, sf_dir):
    v = dealt(cells(spark, sf_dir), "entry_id").select("*", *_hkl())
    x = F.array(*cell.xnn(cell.columns()))
    terms = cell.hkl_terms(F.col("h"), F.col("k"), F.col("l"), F.lit("triclinic"))
    q2 = F.array(F.round(cell.dot(terms.cast("array<double>"), x), 9))
    return v.select("entry_id", F.explode(F.filter(q2, lambda q: q.isNotNull())).alias("q2"))  # a filter of rows would make q2 twice


@query("SELECT event_id, round(pow(2 * sin(radians(value / 10) / 2) / 1.5406e0, 2), 9) AS q2, round((1 + pow(cos(radians(value / 10)), 2)) / (2 * sin(radians(value / 10))), 6) AS lp FROM events WHERE value > 1")
def p16_p32_two_theta(spark, sf_dir):
    angle = F.radians(F.col("value") / 10)
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 1").select("event_id", F.round(optics.q2_from_two_theta(angle, 1.5406), 9).alias("q2"), F.round(optics.lp_factor(angle), 6).alias("lp"))


_FORMULAS = "SELECT p_partkey, p_partkey AS i, CASE p_partkey % 4 WHEN 0 THEN concat('C', p_size, ' H', p_partkey % 20 + 1, ' O', p_partkey % 5) WHEN 1 THEN concat('2(C', p_size, ' D4),Na1 Cl1') WHEN 2 THEN concat('(C', p_size, ' H2)n,1-') ELSE concat(p_partkey % 3 + 2, 'n(Si', p_size, ' O H', p_partkey % 7, ')') END AS f FROM part"
_COUNTS = """c AS (SELECT i, CASE i % 4
  WHEN 0 THEN [{'e': 'C', 'n': CAST(s AS BIGINT)}, {'e': 'H', 'n': i % 20 + 1}, {'e': 'O', 'n': i % 5}]
  WHEN 1 THEN [{'e': 'C', 'n': 2 * s}, {'e': 'Cl', 'n': 1}, {'e': 'H', 'n': 8}, {'e': 'Na', 'n': 1}]
  WHEN 2 THEN [{'e': 'C', 'n': CAST(s AS BIGINT)}, {'e': 'H', 'n': 2}]
  ELSE [{'e': 'H', 'n': (i % 3 + 2) * (i % 7)}, {'e': 'O', 'n': i % 3 + 2}, {'e': 'Si', 'n': (i % 3 + 2) * s}] END AS m FROM (SELECT p_partkey AS i, p_size AS s FROM part) p)"""


def formulas(spark, sf_dir):
    return dealt(spark.sql(_FORMULAS.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet")), "p_partkey")


@query(f"WITH {_COUNTS} SELECT i AS p_partkey, array_to_string(list_transform(m, lambda x: x.e || ':' || x.n), ' ') AS counts, CAST(list_sum(list_transform(m, lambda x: x.n)) AS DOUBLE) AS atoms FROM c")
def p17_parse_formula(spark, sf_dir):
    f = formulas(spark, sf_dir)
    m = f.select("p_partkey", formula.parse_formula(F.col("f")).alias("m"))
    return m.select("p_partkey", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("long").cast("string"))), " ").alias("counts"), formula.n_atoms(F.col("m")).alias("atoms"))


@query(f"""WITH {_COUNTS}, p AS (SELECT i, list_filter(m, lambda x: x.n > 0) AS m FROM c),
d AS (SELECT i, m, CASE {' '.join(f"WHEN len(list_filter(m, lambda x: x.n % {2**k} <> 0)) = 0 THEN {2**k}" for k in range(8, 0, -1))} ELSE 1 END AS g FROM p),
h AS (SELECT i, list_transform(m, lambda x: {{'e': x.e, 'n': x.n // g}}) AS m FROM d),
t AS (SELECT i, m, list_filter(m, lambda x: x.e <> 'H') AS r FROM h)
SELECT i AS p_partkey, array_to_string(list_transform(m, lambda x: x.e || x.n), ' ') AS key, array_to_string(list_transform(list_filter(r, lambda x: x.n / list_sum(list_transform(r, lambda y: y.n)) > 0.05), lambda x: x.e || x.n || ' '), '') AS strict FROM t""")
def p18_composition_keys(spark, sf_dir):
    f = formulas(spark, sf_dir)
    key, strict = formula.composition_keys(F.col("m"))
    return f.select("p_partkey", formula.parse_formula(F.col("f")).alias("m")).select("p_partkey", key.alias("key"), strict.alias("strict"))


@query(f"""{_REC}, t AS (SELECT *, {_LSYSTEM} AS sys, CASE WHEN entry_id % 2 = 0 THEN 'P' ELSE 'C' END AS cen FROM s)
SELECT entry_id, CAST(CASE sys WHEN 'tetragonal' THEN CASE WHEN a < c THEN 0 ELSE 1 END WHEN 'hexagonal' THEN CASE WHEN a < c THEN 0 ELSE 1 END
  WHEN 'monoclinic' THEN CASE WHEN ra >= rb THEN CASE WHEN rb >= rc THEN 0 WHEN ra >= rc THEN 1 ELSE 2 END ELSE CASE WHEN rb <= rc THEN 3 WHEN ra >= rc THEN 4 ELSE 5 END END
  WHEN 'orthorhombic' THEN CASE WHEN cen = 'P' THEN 0 WHEN ra <= rc THEN CASE WHEN rb <= rc THEN 0 ELSE 1 END ELSE 2 END ELSE 0 END AS INT) AS split FROM t""")
def p19_split_label(spark, sf_dir):
    v = symmetry.with_symmetry(cells(spark, sf_dir))
    ra, rb, rc, *_ = cell.reciprocal(*cell.columns())
    direct = F.col("lattice_system").isin("tetragonal", "hexagonal")
    pick = lambda d, r: F.when(direct, d).otherwise(r)
    return v.where(ra.isNotNull()).select("entry_id", cell.split_label(F.col("lattice_system"), F.col("entry_id") % 2 == 1, pick(F.col("a"), ra), pick(F.col("b"), rb), pick(F.col("c"), rc)).cast("int").alias("split"))


_CEN = "CASE entry_id % 5 WHEN 0 THEN 'P' WHEN 1 THEN 'I' WHEN 2 THEN 'C' WHEN 3 THEN 'B' ELSE 'A' END"


@query(f"""{C}, o AS (SELECT *, {_CEN} AS cen FROM v),
p AS (SELECT *, CASE WHEN cen IN ('P', 'I') THEN CASE WHEN a <= b AND b <= c THEN 'abc' WHEN a <= c AND c < b THEN 'acb' WHEN b < a AND a <= c THEN 'bac' WHEN b <= c AND c < a THEN 'bca' WHEN c < a AND a <= b THEN 'cab' ELSE 'cba' END
  WHEN cen = 'C' THEN CASE WHEN a <= b THEN 'abc' ELSE 'bac' END WHEN cen = 'B' THEN CASE WHEN a <= c THEN 'acb' ELSE 'cab' END ELSE CASE WHEN c <= b THEN 'cba' ELSE 'bca' END END AS tag FROM o)
SELECT entry_id, tag, {', '.join(f"round(CASE substr(tag, {i}, 1) WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END, 6) AS n{i}" for i in (1, 2, 3))} FROM p""")
def p20_reindex_orthorhombic(spark, sf_dir):
    cen = F.element_at(F.array(*map(F.lit, "PICBA")), (F.col("entry_id") % 5 + 1).cast("int"))
    v = cells(spark, sf_dir).withColumn("tag", cell.orthorhombic_order(cen, F.col("a"), F.col("b"), F.col("c")))
    return v.select("entry_id", "tag", *_rounded(cell.permuted(F.col("tag"), cell.columns()[:3]), ("n1", "n2", "n3")))


_SYM = ("P 1 21/n 1", "C 1 2/c 1", "A 1 m 1", "I 1 c 1", "P 1 21/a 1", "P 1 c 1", "B 1 2 1")
_MAP = {"P 1 21/n 1": ("P 1 21/n 1", (1, 0, 0, 1)), "C 1 2/c 1": ("I 1 2/a 1", (0, 1, -1, -1)), "A 1 m 1": ("I 1 m 1", (-1, -1, 1, 0)), "I 1 c 1": ("I 1 a 1", (0, -1, 1, 0)), "P 1 21/a 1": ("P 1 21/n 1", (1, 0, 1, 1)), "P 1 c 1": ("P 1 n 1", (1, 1, -1, 0))}


def _case(i):
    return "CASE sym " + " ".join(f"WHEN '{s}' THEN {m[i]}" for s, (_, m) in _MAP.items()) + " END"


@query(f"""{C}, y AS (SELECT *, CASE entry_id % 7 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SYM))} END AS sym FROM v),
m AS (SELECT *, {_case(0)} AS p, {_case(1)} AS q, {_case(2)} AS r, {_case(3)} AS s, a*c*cos(beta) AS ac, CASE sym {' '.join(f"WHEN '{k}' THEN '{t}'" for k, (t, _) in _MAP.items())} END AS t FROM y),
n AS (SELECT *, sqrt(p*p*a*a + q*q*c*c + 2*p*q*ac) AS x, sqrt(r*r*a*a + s*s*c*c + 2*r*s*ac) AS z, p*r*a*a + q*s*c*c + (p*s + q*r)*ac AS inn FROM m),
o AS (SELECT *, acos(inn / (x*z)) AS be FROM n)
SELECT entry_id, t AS symbol, round(least(x, z), 6) AS na, CASE WHEN t IS NOT NULL THEN round(b, 6) END AS nb, round(greatest(x, z), 6) AS nc, round(greatest(be, pi() - be), 6) AS nbeta FROM o""")
def p21_reindex_monoclinic(spark, sf_dir):
    sym = F.element_at(F.array(*map(F.lit, _SYM)), (F.col("entry_id") % 7 + 1).cast("int"))
    *values, symbol = cell.standard_monoclinic(F.col("sym"), F.col("a"), F.col("b"), F.col("c"), F.col("beta"))
    return cells(spark, sf_dir).withColumn("sym", sym).select("entry_id", symbol.alias("symbol"), *_rounded(values, ("na", "nb", "nc", "nbeta")))


@query(f"{C} SELECT entry_id, round(sqrt(3*a*a + c*c) / 3, 6) AS ar, round(2 * asin(3 / (2 * sqrt(3 + (c/a)*(c/a)))), 6) AS alpha_r FROM v")
def p22_hex_to_rhomb(spark, sf_dir):
    return cells(spark, sf_dir).select("entry_id", *_rounded(cell.hex_to_rhomb(F.col("a"), F.col("c")), ("ar", "alpha_r")))


@query(f"""{C}, s AS (SELECT *, {_LSYSTEM} AS s, {_LATTICE} AS lat FROM v) SELECT entry_id, list_transform(CASE s WHEN 'orthorhombic' THEN CASE WHEN lat = 'oC' THEN [least(a,b), greatest(a,b), c] ELSE list_sort([a,b,c]) END
 WHEN 'monoclinic' THEN [least(a,c), b, greatest(a,c), greatest(beta, pi() - beta)] ELSE CASE s {' '.join(f"WHEN '{k}' THEN [{p}]" for k, p in _PARTS.items())} END END, lambda x: round(x, 6)) AS cell FROM s""")
def p26_reorder_cells(spark, sf_dir):
    v = symmetry.with_symmetry(cells(spark, sf_dir))
    s = F.col("lattice_system")
    return v.select("entry_id", F.transform(cell.reorder(s, F.col("lattice"), cell.partial(s, cell.columns())), lambda x: F.round(x, 6)).alias("cell"))


_SET = [(cell.times(p, m)) for m in cell.SETTINGS for p in (cell.MONOCLINIC["same"], cell.SWAP)]


@query(f"""{C}, t(setting, p, q, r, s) AS (VALUES {', '.join(f'({i}, {m[0]}, {m[6]}, {m[2]}, {m[8]})' for i, m in enumerate(_SET))}),
j AS (SELECT *, a*c*cos(beta) AS ac FROM v, t), n AS (SELECT *, sqrt(p*p*a*a + q*q*c*c + 2*p*q*ac) AS x, sqrt(r*r*a*a + s*s*c*c + 2*r*s*ac) AS z, p*r*a*a + q*s*c*c + (p*s + q*r)*ac AS inn FROM j)
SELECT entry_id, setting, round(x, 6) AS na, round(b, 6) AS nb, round(z, 6) AS nc, round(acos(inn / (x*z)), 6) AS nbeta FROM n""")
def p27_monoclinic_settings(spark, sf_dir):
    v = cells(spark, sf_dir).select("entry_id", F.explode(cell.monoclinic_settings(F.col("a"), F.col("b"), F.col("c"), F.col("beta"))).alias("s"))
    return v.select("entry_id", "s.setting", *_rounded([F.col(f"s.{n}") for n in ("a", "b", "c", "beta")], ("na", "nb", "nc", "nbeta")))


@query(f"{C} SELECT entry_id, [CAST(round(entry_id % 4) AS INT), CAST(-(entry_id % 5) AS INT), CAST(entry_id % 3 AS INT)] AS hkl FROM v")
def p33_transform_hkl(spark, sf_dir):
    """Reflections (h, k, l) by a 3x3 matrix, here one that swaps k and l and turns one round."""
    m = [1, 0, 0, 0, 0, 1, 0, -1, 0]
    v = cells(spark, sf_dir).select("entry_id", F.array((F.col("entry_id") % 4), (F.col("entry_id") % 3), (F.col("entry_id") % 5)).alias("hkl"))
    out = F.array(*[F.round(sum((F.get("hkl", F.lit(i)) * m[3 * i + j] for i in range(3)), F.lit(0))).cast("int") for j in range(3)])
    return v.select("entry_id", out.alias("hkl"))


P = WITH["peaks"]


@query(f"{P}, d AS (SELECT pattern_id, peak_index, (q2 + 0.01e0 - 0.003e0 * peak_index) / (2 * sqrt(q2 * 0.01e0)) AS c FROM v), a AS (SELECT *, acos(c) AS t FROM d WHERE abs(c) <= 1) SELECT pattern_id, peak_index, round(t, 6) AS angle, round(CASE WHEN t > pi() / 2 THEN pi() - t ELSE t END, 6) AS folded FROM a")
def p34_angle_from_q2(spark, sf_dir):
    v = view(spark, sf_dir, "peaks").withColumn("t", optics.angle_from_q2(F.col("q2"), F.lit(0.01), 0.003 * F.col("peak_index")))
    return v.where("t IS NOT NULL").select("pattern_id", "peak_index", F.round("t", 6).alias("angle"), F.round(optics.fold_angle(F.col("t")), 6).alias("folded"))


_R = WITH["reflections"]
_Q2 = "pow(2 * sin(acos({z} / sqrt({x}*{x} + {y}*{y} + {z}*{z})) / 2) / 0.98e0, 2)"


@query(f"{_R} SELECT frame_id, k1, k2, k3, round(s1x / sqrt(s1x*s1x + s1y*s1y + s1z*s1z) / 0.98e0, 9) AS sx, round(s1y / sqrt(s1x*s1x + s1y*s1y + s1z*s1z) / 0.98e0, 9) AS sy, round(s1z / sqrt(s1x*s1x + s1y*s1y + s1z*s1z) / 0.98e0 - 1 / 0.98e0, 9) AS sz, round({_Q2.format(x='s1x', y='s1y', z='s1z')}, 8) AS q2 FROM v")
def p35_scattering_vector(spark, sf_dir):
    s0, s1 = [F.lit(0.0), F.lit(0.0), F.lit(1 / 0.98)], [F.col(c) for c in ("s1x", "s1y", "s1z")]
    return view(spark, sf_dir, "reflections").select("frame_id", "k1", "k2", "k3", *_rounded(optics.scattering_vector(s0, s1, 0.98), ("sx", "sy", "sz"), 9), F.round(optics.q2_of_beam(s0, s1, 0.98), 8).alias("q2"))


@query(f"{_R}, m AS (SELECT frame_id, k1, k2, k3, s1x + 0.5e0 AS x, s1y - 0.25e0 AS y, s1z + 1e0 AS z FROM v) SELECT frame_id, k1, k2, k3, round({_Q2.format(x='x', y='y', z='z')}, 8) AS q2 FROM m")
def p36_shift_detector(spark, sf_dir):
    s0, moved = [F.lit(0.0), F.lit(0.0), F.lit(1 / 0.98)], [F.col(c) + d for c, d in (("s1x", 0.5), ("s1y", -0.25), ("s1z", 1.0))]
    return view(spark, sf_dir, "reflections").select("frame_id", "k1", "k2", "k3", F.round(optics.q2_of_beam(s0, moved, 0.98), 8).alias("q2"))


@query(f"{P}, g AS (SELECT CAST(unnest(range(0, 11)) AS INT) AS g) SELECT pattern_id, g, round(sum(exp(-0.5e0 * pow((0.01e0 * g - q2) / 0.004e0, 2))), 6) AS feature FROM v, g GROUP BY pattern_id, g")
def p37_kernel_features(spark, sf_dir):
    v = view(spark, sf_dir, "peaks").groupBy("pattern_id").agg(F.collect_list("q2").alias("q2"))
    return v.select("pattern_id", "q2", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("g")).select("pattern_id", "g", F.round(optics.kernel(F.col("q2"), 0.01 * F.col("g"), 0.004), 6).alias("feature"))


@query(f"{P}, g AS (SELECT CAST(unnest(range(0, 11)) AS INT) AS g) SELECT pattern_id, peak_index, g, round(0.1e0 / (abs(0.01e0 * g - q2) / 0.004e0 + 0.1e0), 9) AS feature FROM v, g")
def p38_inverse_distance_features(spark, sf_dir):
    v = view(spark, sf_dir, "peaks").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return v.select("pattern_id", "peak_index", "g", F.round(optics.inverse_distance(F.col("q2"), 0.01 * F.col("g"), 0.004, 0.1), 9).alias("feature"))


@query(f"{C}, s AS (SELECT least(a,b,c) AS lo, greatest(a,b,c) AS hi, a, b, c FROM v), x AS (SELECT unnest(list_transform(list_sort([{{'v': a, 'n': 'a'}}, {{'v': b, 'n': 'b'}}, {{'v': c, 'n': 'c'}}]), lambda z: z.n)) AS axis, CAST(generate_subscripts([1,2,3], 1) - 1 AS INT) AS place FROM v) SELECT place, axis, round(count(*) / (SELECT count(*) FROM v), 9) AS share FROM x GROUP BY ALL")
def a12_axis_order_share(spark, sf_dir):
    v = cells(spark, sf_dir)
    axes = F.array_sort(F.array(*[F.struct(F.col(n).alias("v"), F.lit(n).alias("n")) for n in "abc"]))
    x = v.select(F.posexplode(axes).alias("place", "x"))
    counts = x.groupBy("place", F.col("x.n").alias("axis")).agg(F.count("*").alias("n"))
    total = v.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("place", "axis", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query(f"{C} SELECT entry_id, round(least(a,b,c) / greatest(a,b,c), 9) AS ratio, CAST(least(CASE WHEN entry_id % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN (entry_id+1) % 4 <> 0 THEN 1 ELSE 0 END, CASE WHEN entry_id % 3 - 1 <> 0 THEN 1 ELSE 0 END + CASE WHEN (entry_id+1) % 3 - 1 <> 0 THEN 1 ELSE 0 END) AS INT) AS information FROM v")
def a29_extreme_ratio(spark, sf_dir):
    """Least over greatest axis; and over the axes the least number of reflections with a non-zero index."""
    e = F.col("entry_id")
    h, k = F.array(e % 4, (e + 1) % 4), F.array(e % 3 - 1, (e + 1) % 3 - 1)
    some = lambda x: F.size(F.filter(x, lambda i: i != 0))
    axes = F.array("a", "b", "c")
    return cells(spark, sf_dir).select("entry_id", F.round(F.array_min(axes) / F.array_max(axes), 9).alias("ratio"), F.least(some(h), some(k)).alias("information"))


