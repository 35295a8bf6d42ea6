"""Forests by ratio bin, their candidates and the search with them, on the cells of the entries."""

import math

from pyspark.sql import functions as F

from cellspark.operators import forests as op
from cellspark.operators import indexing
from cellspark.plans.registry import query
from cellspark.plans.views import WITH, view

LINES = [f"q{i}" for i in range(10)]
BINS, TREES, DEPTH, SHARE = 2, 10, 6, 0.5


def known(spark, sf_dir):
    """Orthorhombic cells of the entries, ordered, with their ten first lines and their reciprocal volume."""
    v = view(spark, sf_dir, "cells")
    axes = F.array_sort(F.array("a", "b", "c"))
    v = v.select("entry_id", *[F.get(axes, F.lit(i)).alias(n) for i, n in enumerate("abc")])
    v = v.withColumn("xnn", F.array(*[1 / (F.col(n) * F.col(n)) for n in "abc"]))
    q = indexing.peaks_of_cells(v, "entry_id", "xnn", "oP", len(LINES))
    wide = q.select(F.col("pattern_id").alias("entry_id"), "q", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(LINES)])
    return v.join(wide, "entry_id").withColumns({"ratio": F.col("a") / F.col("c"), "volume": 1 / (F.col("a") * F.col("b") * F.col("c"))})


def fitted(spark, sf_dir):
    return op.fit_cell_forests(known(spark, sf_dir), LINES, ["a", "b", "c"], ratio="ratio", weight="volume", bins=BINS, trees=TREES, depth=DEPTH, share=SHARE, key="entry_id")


@query()
def m2_trees_of_all_bins(spark, sf_dir):
    """Every tree of every ratio bin, in one pass."""
    return op.predict_cells(known(spark, sf_dir), fitted(spark, sf_dir), "entry_id")


def _forest_sql() -> str:
    """The forests of the shortest axis, grown a level at a time by the rule of op.fit_cell_forests, and what their nearest tree says of each cell."""
    chance = [sum(math.exp(-SHARE) * SHARE**j / math.factorial(j) for j in range(n + 1)) for n in range(64)]
    steps = [int(c * 2**32) for c in chance if c * 2**32 < 2**32 - 1]
    square = "CAST({0} AS DOUBLE) * CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE)"
    # a tree's number: bin, target (three, the shortest axis first), tree
    out = f"""{WITH["cells"]}, axes AS (SELECT entry_id, list_sort([a, b, c]) AS e FROM v),
cell AS (SELECT entry_id, e[1] AS a, e[1] / e[3] AS ratio, 1 / (e[1] * e[2] * e[3]) AS volume, 1 / (e[1] * e[1]) AS x, 1 / (e[2] * e[2]) AS y, 1 / (e[3] * e[3]) AS z FROM axes),
term AS (SELECT h*h AS h, k*k AS k, l*l AS l FROM range(7) r(h), range(7) s(k), range(7) t(l) WHERE h + k + l > 0 ORDER BY h*h + k*k + l*l, 1, 2, 3 LIMIT 200),
line AS MATERIALIZED (SELECT entry_id, f, q FROM (SELECT entry_id, q, row_number() OVER (PARTITION BY entry_id ORDER BY q) - 1 AS f FROM (SELECT DISTINCT entry_id, round(x * h + y * k + z * l, 12) AS q FROM cell, term) d) r WHERE f < {len(LINES)}),
edge AS (SELECT max(CASE WHEN i = floor(0.5e0 * n) THEN ratio END) AS edge FROM (SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS i, count(*) OVER () AS n FROM cell) r),
ends AS (SELECT max(CASE WHEN i = floor(0.01e0 * n) THEN volume END) AS lo, max(CASE WHEN i = floor(0.99e0 * n) THEN volume END) AS hi FROM (SELECT volume, row_number() OVER (ORDER BY volume) - 1 AS i, count(*) OVER () AS n FROM cell) r),
dense AS (SELECT entry_id, least(floor((greatest(lo, least(hi, volume)) - lo) / ((hi - lo) / 25)), 24) AS b FROM cell, ends), held AS (SELECT b, count(*) AS n FROM dense GROUP BY 1),
labelled AS MATERIALIZED (SELECT entry_id, a, CASE WHEN ratio >= edge THEN 1 ELSE 0 END AS bin, CAST(floor(least(sqrt((SELECT max(n) FROM held) / held.n), 10) * {op.WEIGHED} + 0.5e0) AS BIGINT) AS w,
  CAST(floor(a / (SELECT max(a) FROM cell) * {op.GRID} + 0.5e0) AS BIGINT) AS y FROM cell JOIN dense USING (entry_id) JOIN held USING (b), edge),
cut AS MATERIALIZED (SELECT DISTINCT bin, f, q AS cut FROM (SELECT bin, f, q, row_number() OVER (PARTITION BY bin, f ORDER BY q) - 1 AS i, count(*) OVER (PARTITION BY bin, f) AS n FROM line JOIN labelled USING (entry_id)) r
  WHERE i IN (SELECT floor(j / {op.CUTS + 1}e0 * n) FROM range(1, {op.CUTS + 1}) t(j))),
numbered AS MATERIALIZED (SELECT bin, f, cut, row_number() OVER (PARTITION BY bin, f ORDER BY cut) - 1 AS code FROM cut),
coded AS MATERIALIZED (SELECT entry_id, f, (SELECT count(*) FROM cut c WHERE c.bin = p.bin AND c.f = l.f AND c.cut < l.q) AS code FROM line l JOIN labelled p USING (entry_id)),
drawn AS (SELECT entry_id, bin, w, y, i, CAST('0x' || left(md5('0:' || entry_id || ':' || i), 8) AS BIGINT) AS u FROM labelled, range({TREES}) t(i)),
taken AS MATERIALIZED (SELECT entry_id, bin * {3 * TREES} + i AS tree, n, n * w AS w, n * w * y AS s FROM (SELECT *, {" + ".join(f"(u >= {x})::BIGINT" for x in steps)} AS n FROM drawn) d WHERE n > 0),
at0 AS MATERIALIZED (SELECT entry_id, k * {3 * TREES} + i AS tree, CAST(1 AS BIGINT) AS path FROM labelled, range({BINS}) b(k), range({TREES}) t(i)),
node0 AS MATERIALIZED (SELECT tree, CAST(1 AS BIGINT) AS path, CAST(sum(n) AS BIGINT) AS n, CAST(sum(w) AS DOUBLE) AS w, CAST(sum(s) AS DOUBLE) AS s FROM taken GROUP BY 1)"""
    for level in range(DEPTH):
        out += f""",
sum{level} AS (SELECT tree, path, f, code, sum(n) AS n, sum(w) AS w, sum(s) AS s FROM taken JOIN at{level} USING (entry_id, tree) JOIN coded USING (entry_id) WHERE path >= {2**level} GROUP BY ALL),
upto{level} AS (SELECT tree, path, f, code, sum(n) OVER p AS ln, sum(w) OVER p AS lw, sum(s) OVER p AS ls, sum(n) OVER q AS n, sum(w) OVER q AS w, sum(s) OVER q AS s FROM sum{level}
  WINDOW p AS (PARTITION BY tree, path, f ORDER BY code), q AS (PARTITION BY tree, path, f)),
tried{level} AS (SELECT tree, path, f FROM (SELECT tree, path, f, row_number() OVER (PARTITION BY tree, path ORDER BY md5('0:' || tree || ':' || path || ':' || f)) AS place FROM (SELECT DISTINCT tree, path, f FROM sum{level}) d) r WHERE place <= {math.ceil(len(LINES) / 3)}),
score{level} AS (SELECT *, {square.format("ls", "lw")} + {square.format("(s - ls)", "(w - lw)")} AS score FROM upto{level} JOIN tried{level} USING (tree, path, f) WHERE ln >= 2 AND n - ln >= 2),
split{level} AS MATERIALIZED (SELECT b.*, cut FROM (SELECT *, row_number() OVER (PARTITION BY tree, path ORDER BY score DESC, f, code) AS place FROM score{level}) b JOIN numbered c ON c.bin = b.tree // {3 * TREES} AND c.f = b.f AND c.code = b.code WHERE place = 1 AND score > {square.format("s", "w")}),
node{level + 1} AS (SELECT tree, 2 * path AS path, ln AS n, lw AS w, ls AS s FROM split{level} UNION ALL SELECT tree, 2 * path + 1, n - ln, w - lw, s - ls FROM split{level}),
at{level + 1} AS MATERIALIZED (SELECT a.entry_id, a.tree, CASE WHEN b.tree IS NULL THEN a.path WHEN q <= cut THEN 2 * a.path ELSE 2 * a.path + 1 END AS path FROM at{level} a LEFT JOIN split{level} b ON b.tree = a.tree AND b.path = a.path LEFT JOIN line l ON l.entry_id = a.entry_id AND l.f = b.f)"""
    nodes = " UNION ALL ".join(f"SELECT tree, path, CAST(s AS DOUBLE) / CAST(w AS DOUBLE) * ((SELECT max(a) FROM cell) / {op.GRID}) AS told FROM node{level}" for level in range(DEPTH + 1))
    return f"""{out}, node AS ({nodes})
SELECT entry_id, a, min(abs(told - a)) <= 0.15e0 * a AS near FROM at{DEPTH} JOIN node USING (tree, path) JOIN labelled USING (entry_id) GROUP BY entry_id, a"""


@query(_forest_sql())
def m1_forests_by_ratio(spark, sf_dir):
    """Whether one of the trees, of any bin, says the shortest axis within 15 percent: not so of all cells, as the lines of some hardly depend on it."""
    guess = op.predict_cells(known(spark, sf_dir), fitted(spark, sf_dir), "entry_id")
    least = F.array_min(F.transform(F.get("trees", F.lit(0)), lambda t: F.abs(t - F.col("a"))))
    return known(spark, sf_dir).select("entry_id", "a").join(guess, "entry_id").select("entry_id", "a", (least <= 0.15 * F.col("a")).alias("near"))


@query()
def c1_generate_from_models(spark, sf_dir):
    """Candidates of all four generators: trees, templates, predicted volume and random."""
    rows = known(spark, sf_dir)
    generators = {"trees": op.tree_candidates(fitted(spark, sf_dir))}
    volume = op.fit_volume_forest(rows, LINES, "volume", F.col("entry_id") % 5 != 0, trees=10, depth=6, share=0.5)
    generators |= {"predicted_volume": op.volume_candidates(volume), "random": op.volume_candidates(volume, predicted=False)}
    patterns = rows.select(F.col("entry_id").cast("long").alias("pattern_id"), "q")
    out = indexing.generate(patterns, indexing.reference_terms(spark, "oP"), "orthorhombic", {"trees": 25, "templates": 8, "predicted_volume": 8, "random": 4}, generators)
    return out.select("pattern_id", "candidate_id", "generator", "xnn")
