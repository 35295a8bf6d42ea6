"""Every registered query of the subpackage on the smallest tables: its columns, its contract and, where there is one, its SQL."""

import os
import zlib

import pytest

from cellspark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")

COLUMNS = {
    "op1_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_token_counts": "doc_id bigint, n_tokens bigint",
    "op4_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op5_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op7_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, round_trip boolean",
    "op9_decontaminate": "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_overlap bigint, n_equal bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double",
    "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "pipeline": "doc_id bigint, lang string, source string, n_tokens bigint, ids array<int>",
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: (df, df.collect()) for name, df in ((n, f(spark, SF)) for n, f in queries.QUERIES.items())}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def part(key, parts):
    return zlib.crc32(str(key).encode()) % parts


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(results, name):
    df, rows = results[name]
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == COLUMNS[name] and rows


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_equals_sql(results, duck, name):
    df, rows = results[name]
    sql = duck.sql(queries.ORACLE_SQL[name])
    at = [sql.columns.index(c) for c in df.columns]
    tell = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted((tell(r) for r in rows), key=str) == sorted((tell(r[i] for i in at) for r in sql.fetchall()), key=str)


def test_whole_tables(results, duck):
    ids = sorted(r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall())
    for name in ("op2_language_id", "op3_token_counts", "op5_secret_scan", "op6_substring_dedup", "op7_near_duplicates", "op8_sentencepiece", "op10_toxicity", "op11_fingerprints", "op12_periodic_runs"):
        assert sorted(r["doc_id"] for r in results[name][1]) == ids, name


def test_held_out(results, duck):
    for name, parts, rest in (("op2_language_id", 4, 2), ("op10_toxicity", 5, 0)):
        for r in results[name][1]:
            assert r["held_out"] == (part(r["doc_id"], parts) == rest) and 0 <= r["score"] <= 1
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    held = [r for r in results["op2_language_id"][1] if r["held_out"] and r["doc_id"] in lang and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held) > 10
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in results["op10_toxicity"][1])
    toxic = dict(duck.sql("SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL").fetchall())
    held = [r for r in results["op10_toxicity"][1] if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_secrets_equal_plain_rules(results, duck):
    import hashlib

    from test_operators import plain_base

    text = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in results["op5_secret_scan"][1]:
        base = plain_base(text[r["doc_id"]] or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[2] == k for x in base) for k in ("assign", "access", "hex")]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("markov")] == [s for s in listed.split(",") if s]


def test_round_trips(results):
    assert all(r["round_trip"] for r in results["op8_sentencepiece"][1])
    counts = {r["doc_id"]: r["n_tokens"] for r in results["op3_token_counts"][1]}
    assert counts == {r["doc_id"]: r["n_tokens"] for r in results["op8_sentencepiece"][1]}
    assert all(r["n_tokens"] == len(r["ids"]) for r in results["pipeline"][1])
