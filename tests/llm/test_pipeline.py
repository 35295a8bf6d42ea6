"""The pipeline on a few documents whose fate is known, stage by stage."""

import corpus_pipeline
from test_operators import DOC, near_pair, plain_groups, prose

from cellspark.llm.queries import MODEL
from cellspark.llm.sentencepiece_lattice import decode


def test_pipeline(spark, tmp_path):
    item = prose(77, 30)
    rows = [(i, prose(i, 60 + i), "aa", f"s{i % 3}", None) for i in range(20)]
    rows += [(100 + i, prose(i, 60 + i).upper(), "aa", "copy", None) for i in range(5)]  # near copies of the first five
    rows += [(200, "123 456", "aa", "s", 7), (201, None, None, None, None), (202, "", "aa", "s", 0)]  # no letter
    rows += [(300, prose(500, 20) + " " + item + " " + prose(501, 20), "aa", "s", None)]  # a leak
    rows += [(400, prose(600, 50) + " password=abcdef123", "aa", "s", 1)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose(78, 25))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(range(20))
    assert kept == [clean | set(range(100, 105)) | {300, 400}, clean | {300, 400}, clean | {400}, clean | {400}, clean | {400}]
    secret = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "out3")).collect()}
    assert secret[400]["text"] == prose(600, 50) + " [secret]" and secret[400]["n_chars"] == len(secret[400]["text"])
    for r in decode(docs, MODEL).collect():
        assert r["decoded"] == secret[r["doc_id"]]["text"] and r["n_tokens"] == len(r["ids"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == clean | {400}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_80_percent(spark):
    rows = [(2 * i + j, t, "aa", "s", None) for i in range(20) for j, t in enumerate(near_pair(8000 + i, 0.80 + i % 5 / 100))]
    want = {i for i, (_, c) in plain_groups({r[0]: r[1] for r in rows}, 80).items() if c == i}
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOC), "").collect()}
    assert got == want and len(want) < 25


def test_large_rows_go_to_the_tasks_that_need_them(spark):
    """A table's row travels to one task for one row that looks it up, not to all that a frequent key would have."""
    from pyspark.sql import functions as F

    from cellspark.llm import shared

    rows = spark.createDataFrame([(1, 10), (2, 20), *((3, i) for i in range(400))], "a long, b long")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    table = spark.range(0, 50).select(F.col("id").alias("a"), (F.col("id") * 2).alias("x"))
    got = shared.looked_up(rows, table, ["a"], "b", "inner", rows)
    assert sorted((r["a"], r["b"], r["x"]) for r in got.collect()) == sorted((r["a"], r["b"], 2 * r["a"]) for r in rows.collect())
    many = table.join(rows.select("a", F.pmod(F.xxhash64("b"), F.lit(shared.SALTS)).alias("s")).distinct(), "a").mapInArrow(counted, "a long, x long, s long")
    many.write.format("noop").mode("overwrite").save()
    assert seen.value == 2 + shared.SALTS
    assert sorted(shared.looked_up(rows, table.where("a <> 2"), ["a"], "b").where("x IS NULL").select("a", "b").collect()) == [(2, 20)]


def test_semi_and_anti_joins_leave_most_rows_in_place(spark):
    """Rows that can't be among the ids aren't shuffled, whatever the size; the result is that of the plain joins, also if the sieve is too small."""
    from pyspark.sql import functions as F

    from cellspark.llm import shared

    rows = spark.range(0, 20000).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), F.repeat(F.lit("x"), 50).alias("text"))
    ids, words = spark.range(0, 20000, 40).select(F.col("id").alias("k")), shared.WORDS
    assert shared.others(rows, ids.limit(0), "k").count() == 20000 and shared.among(rows, ids.limit(0), "k").count() == 0
    may, rest = shared._sifted(rows, ids, "k")
    assert 500 <= may.count() < 800 and may.count() + rest.count() == 20000
    try:
        for shared.WORDS in (words, 1):
            assert sorted(r["k"] for r in shared.among(rows, ids, "k").collect()) == list(range(0, 20000, 40))
            left = shared.others(rows, ids, "k")
            assert left.columns == rows.columns and left.where("k IS NULL").count() == 1
            assert sorted(r["k"] for r in left.where("k IS NOT NULL").collect()) == [i for i in range(20000) if i % 40 and i != 7]
    finally:
        shared.WORDS = words


def test_texts_are_not_shuffled_for_a_few_copies(spark):
    """Without broadcast joins by size, as large inputs are: far less than all texts goes through shuffles."""
    rows = [(i, " ".join(prose(9000 + 50 * i + j, 60) for j in range(50)), "aa", "s", None) for i in range(100)]
    rows += [(100 + i, "more " + rows[i][1], "aa", "s", None) for i in range(4)]
    docs, before = spark.createDataFrame(rows, DOC), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    docs.write.format("noop").mode("overwrite").save()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        at = shuffled()
        docs.repartition(3).write.format("noop").mode("overwrite").save()
        texts = shuffled() - at
        at = shuffled()
        got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
        moved = shuffled() - at
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == set(range(100))
    assert moved < texts, (moved, texts)
