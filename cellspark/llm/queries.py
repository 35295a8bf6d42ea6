"""One query for each operator, over its whole table, and SQL where it can tell the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, fingerprints, language_id, minhash_dedup, periodic_runs, ranked_search, secret_scan, sentencepiece_lattice, substring_dedup, token_counts, toxicity, url_filter
from .shared import numbered

#: Where the vocabulary file of the tokenizer is, on every machine.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_of(key: str, parts: int):
    return F.crc32(F.col(key).cast("string")) % parts


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(part_of("doc_id", 4) == 2, F.lit(False)))
    model = language_id.fit(docs.where(part_of("doc_id", 4) != 2))
    return language_id.predict(docs, model, keep=["doc_id", "held_out"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), MODEL, keep=["doc_id"])


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), 20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), MODEL, keep=["doc_id"], verify=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "round_trip")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(part_of("doc_id", 5) == 0, F.lit(False)))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(part_of("doc_id", 5) != 0))
    return toxicity.predict(docs, model, keep=["doc_id", "held_out"])


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = fingerprints.fingerprint_documents(docs)
    own, edited, following = F.col("held"), F.col("edited_held"), F.col("next_held")
    return found.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint(own).alias("fingerprint"),
        fingerprints.fingerprint(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(own, edited).alias("near_edited"),
        fingerprints.resemblance(own, following).alias("near_next"),
        fingerprints.containment(own, edited).alias("contained_edited"),
        fingerprints.containment(own, following).alias("contained_next"),
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: of one document in ten (by crc32 of doc_id) the words from some place on repeat with a period, as the contract of op12 says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all("text", F.lit(fingerprints.WORD), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), fingerprints.bound(words, repeated)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents")), keep=["doc_id"])
    none = F.struct(*(F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")))
    best = F.aggregate("runs", none, lambda top, x: F.when(top["length"].isNull() | (x["length"] * top["period"] > top["length"] * x["period"]), x).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), F.concat(x["period"].cast("string"), F.lit("\n")))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "top.*", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), 10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_token_counts, op4_nearest_neighbours, op5_secret_scan, op6_substring_dedup, op7_near_duplicates, op8_sentencepiece, op9_decontaminate, op10_toxicity, op11_fingerprints, op12_periodic_runs, op13_ranked_search, pipeline)}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

def _sketch_sql(text: str) -> str:
    """The sketch of a text in SQL, as fingerprints.sketch makes it."""
    few = fingerprints.limit(fingerprints.SCALE)
    ends = "['', '', '', '']"
    padded = f"list_concat({ends}, coalesce({_WORDS.format(text)}, []), {ends})"
    hashes = f"(SELECT CASE WHEN len(p) > 8 THEN list_transform(range(1, len(p) - 3), lambda i: md5(array_to_string(list_slice(p, i, i + 4), ' '))[1:16]) ELSE [] END FROM (SELECT {padded} AS p))"
    return f"(SELECT CASE WHEN len(f) > 0 THEN f WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END FROM (SELECT h, list_sort(list_distinct(list_filter(h, lambda x: x < '{few}'))) AS f FROM (SELECT {hashes} AS h)))"


_NEAR = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
_PART = "CASE WHEN len({0}) = 0 THEN 1.0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len({0}) END"
#: crc32 of the decimal digits of doc_id: of each byte, then eight times a bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: list_concat([ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295::BIGINT)"
_TERMS = r"coalesce(regexp_extract_all(translate({}, " + _LOWER + r"), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"


ORACLE_SQL = {
    "op1_url_filter": f"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_LOWER}) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, host, path) AS k FROM p),
rules(verdict, rule, h, q) AS (VALUES {", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for v, t in RULES)}),
f AS (
  SELECT r.page_id, r.host, r.path, r.k, arg_max(rules.rule, length(rules.rule)) AS rule, arg_max(rules.verdict, length(rules.rule)) AS verdict
  FROM r JOIN rules ON ends_with('.' || r.host, '.' || rules.h) AND starts_with(r.path, rules.q) GROUP BY ALL)
SELECT r.page_id, r.host, r.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM r LEFT JOIN f ON r.page_id IS NOT DISTINCT FROM f.page_id AND r.host = f.host AND r.path = f.path AND r.k = f.k""",
    "op4_nearest_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
SELECT * FROM r WHERE rank <= 10""",
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
rest AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(rest.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest.t, '')) AS kept_sha256
FROM d LEFT JOIN rest ON d.doc_id = rest.doc_id""",
    "op7_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format(f"translate(text, {_LOWER})")}, []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
bi AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT bi.b, reach.root FROM reach JOIN bi ON bi.a = reach.node AND reach.root < bi.b),
g AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d JOIN g ON g.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
f AS (SELECT *, substr(t, 1, n - n // 3) || substr(nt, 1, n // 3) AS et FROM e),
s AS MATERIALIZED (SELECT doc_id, n, et, {_sketch_sql("t")} AS a, {_sketch_sql("et")} AS b FROM f),
x AS (SELECT *, coalesce(lead(a) OVER (ORDER BY doc_id DESC), first_value(a) OVER (ORDER BY doc_id DESC)) AS c FROM s)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       {_NEAR.format("a", "b")} AS near_edited, {_NEAR.format("a", "c")} AS near_next, {_PART.format("a", "b")} AS contained_edited, {_PART.format("a", "c")} AS contained_next
FROM x""",
    "op12_periodic_runs": f"""
WITH h AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w0, {_CRC} AS h FROM documents),
g AS (SELECT *, len(w0) AS n, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS MATERIALIZED (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w0 END AS w FROM p),
words AS MATERIALIZED (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
eq AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq),
long AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isle GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM long GROUP BY 1, 2, 3),
top AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY 1),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
rest AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN top ON top.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id AND best.k = 1 LEFT JOIN rest ON rest.doc_id = d.doc_id""",
    "op13_ranked_search": f"""
WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS t FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, c),
i AS (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM i JOIN tf ON i.term = tf.term JOIN w ON w.term = i.term, c GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""",
}
