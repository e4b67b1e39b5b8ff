import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kgspark.functions import tables
from kgspark.operators import chunks, graph, search
from kgspark.sources import parsed
from kgspark.streaming import channel

from .test_streaming import source

NODE = "case_id string, id string, name string, entity_type string, aliases array<string>, ord long"


def test_search_by_index_is_search(spark, tmp_path):
    rng = random.Random(1)
    rows = [("c", f"n{k}", "".join(rng.choice("abAB é") for _ in range(rng.randrange(9))), rng.choice(["PERSON", "COURT"]), rng.choice([None, [], ["alias " + rng.choice("xyz") * 3]]), k) for k in range(400)]
    nodes = spark.createDataFrame(rows, NODE)
    search.build(nodes, f"file://{tmp_path}/p")
    for text in ("aba", "ABAB", "ers", "éa", "a", "", "  ", "xxx", "s zz", "nothing here", "b a b"):
        for top in (12, 1000):
            got, want = (f.select("id").collect() for f in (search.find(nodes, f"file://{tmp_path}/p", text, top), graph.search(nodes, text, top)))
            assert got == want


def test_a_rare_pattern_reads_few_files(spark, tmp_path):
    at = f"file://{tmp_path}/p"
    search.build(spark.range(3000).select(F.lit("c").alias("case_id"), F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit("X").alias("entity_type"), F.array().cast("array<string>").alias("aliases")), at)
    every = len(spark.read.parquet(at).inputFiles())
    few = lambda grams: int(search.postings(spark, at, grams)._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().filePartitionIterator().size())
    assert every >= 40 and few(["abc"]) == 1 and few(["abc", "bcd", "cde"]) <= 3


def test_parsed_documents_and_bad_lines(spark, tmp_path):
    at = f"file://{tmp_path}/d"
    doc = spark.createDataFrame([("a", "a.txt", [(1, "one\ntwo", None)]), ("b", "b.txt", [])], "document_id string, filename string, pages array<struct<page_number:int,raw_text:string,blocks:array<struct<block_id:string,block_type:string,raw_text:string>>>>")
    doc = doc.withColumn("file_type", F.lit("txt")).withColumn("sha256_hash", F.lit("0")).withColumn("processing_metadata", F.lit(None).cast("struct<processing_status:string,started_at:string>"))
    parsed.save(doc, at)
    parsed.save(doc.where("document_id = 'b'").withColumn("filename", F.lit("b2.txt")), at)
    bad = ['{"document_id": "x"', "nonsense", "{}", "[1]"]
    spark.createDataFrame([(t, 3) for t in bad], "value string, shard int").coalesce(1).write.mode("append").partitionBy("shard").text(at)
    got = {r.document_id: (r.filename, [(p.page_number, p.raw_text) for p in r.pages]) for r in parsed.load(spark, at).collect()}
    assert got == {"a": ("a.txt", [(1, "one\ntwo")]), "b": ("b2.txt", [])}
    assert parsed.load(spark, at, ["a", "gone"]).count() == 1 and parsed.load(spark, at, ["gone"]).count() == 0
    assert sorted((r.document_id, r.page_count) for r in parsed.listing(spark, at).collect()) == [("a", 1), ("b", 0)]
    rows = parsed.read(spark, at).where(F.col(parsed.BAD).isNotNull()).collect()
    assert len(rows) == 4 and {r[parsed.BAD] for r in rows} >= {'{"document_id": "x"', "nonsense"}


def test_what_a_model_has_seen_it_isn_t_asked_again(spark, tmp_path):
    cache = chunks.inference_cache(spark, f"file://{tmp_path}/c", "chars long")
    asked = []

    def ask(once):
        asked.append(sorted(r.text for r in once.collect()))
        return once.select("text_sha", F.length("text").cast("long").alias("chars"))

    rows = lambda *texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "chunk_id long, text string")
    first = chunks.infer_cached(rows("aa", "b", "aa"), "m1", ask, cache)
    assert sorted((r.chunk_id, r.chars) for r in first.collect()) == [(0, 2), (1, 1), (2, 2)]
    assert chunks.infer_cached(rows("b", "aa"), "m1", ask, cache).count() == 2 and asked == [["aa", "b"]]
    assert chunks.infer_cached(rows("b", "ccc"), "m1", ask, cache).count() == 2 and asked[1:] == [["ccc"]]
    assert chunks.infer_cached(rows("b"), "m2", ask, cache).count() == 1 and asked[2:] == [["b"]]


def test_the_table_function_says_what_it_needs(spark):
    tables.register(spark)
    pages = spark.createDataFrame([("d", 1, "On 2024-01-15 and January 5, 2024."), ("d", 2, "Dated 2023-05-15."), ("e", 1, None)], "document_id string, page_number int, raw_text string")
    call = lambda what: spark.sql(f"select * from extract_entities(table(select * from {{pages}}) partition by (document_id) order by (page_number), {what})", pages=pages)
    assert sorted((r.document_id, r.page_number, r.normalized_value) for r in call("'date'").collect()) == [("d", 1, "2024-01-05"), ("d", 1, "2024-01-15"), ("d", 2, "2023-05-15")]
    with pytest.raises(Exception, match="second argument"):
        call("'nothing'")
    with pytest.raises(Exception, match="no raw_text"):
        spark.sql("select * from extract_entities(table(select document_id, page_number from {pages}), 'date')", pages=pages)


def test_a_channel_that_dies_sends_nothing_twice(spark, tmp_path, monkeypatch):
    t = datetime(2026, 1, 1)
    parts = [[("1", "u", "x", t), ("2", "u", "x", t)], [("2", "u", "x", t), ("3", "u", "x", t)]]
    stream = source(spark, tmp_path, parts, "notification_id string, user_id string, title string, created_at timestamp", "n")
    inbox, calls = channel.InApp(spark, f"file://{tmp_path}/inbox"), []
    commit = inbox.table._commit_as

    def killed(version, content):
        calls.append(version)
        if len(calls) in (1, 3):  # before the first commit; after the second
            if len(calls) == 3:
                commit(version, content)
            raise RuntimeError("killed")
        commit(version, content)

    monkeypatch.setattr(inbox.table, "_commit_as", killed)
    for _ in range(4):
        try:
            channel.deliver(stream, inbox, f"{tmp_path}/check", once=True).awaitTermination()
        except Exception as e:  # noqa: BLE001
            assert "killed" in str(e)
    assert sorted(r.notification_id for r in inbox.sent().collect()) == ["1", "2", "3"]
    assert calls == [1, 1, 2] and inbox.table.manifest()["version"] == 2
