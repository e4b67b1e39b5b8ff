import pytest
from pyspark.sql import functions as F

from kgspark.operators import chunks, evaluate, graph, review
from kgspark.sources import files

NODE = "case_id string, id string, name string, entity_type string, aliases array<string>, ord long"
EDGE = "case_id string, id string, source_id string, target_id string, relationship_type string"


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame([("c", "a", "Ann", "PERSON", ["annie"], 1), ("c", "b", "Bob", "PERSON", [], 2), ("c", "k", "Case", "CASE", [], 3), ("x", "a", "Other", "PERSON", [], 4)], NODE)


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([("c", "e1", "a", "k", "PLAINTIFF_IN"), ("c", "e2", "b", "k", "DEFENDANT_IN"), ("c", "e3", "a", "b", "ASSOCIATED_WITH"), ("x", "e4", "a", "k", "PLAINTIFF_IN")], EDGE)


def test_reads_stay_within_a_case(nodes, edges):
    assert [r.id for r in graph.complete(edges, nodes).orderBy("id").collect()] == ["e1", "e2", "e3"]
    assert [r.id for r in graph.case_relationships(edges, nodes, "c").collect()] == ["e1", "e2"]
    near = graph.neighbours(edges, nodes.where("case_id = 'c' and id = 'k'"), 1)
    assert sorted((r.case_id, r.id) for r in near.collect()) == [("c", "a"), ("c", "b"), ("c", "k")]
    assert [r.id for r in graph.search(nodes, "ANNIE").collect()] == ["a"] and graph.search(nodes, " ").count() == 0


def test_upserts_are_idempotent_and_drop_dangling(spark, nodes, edges):
    new = edges.withColumn("version", F.lit(1))
    once = graph.upsert_edges(new.where("false"), new, nodes)
    assert sorted(r.id for r in once.collect()) == ["e1", "e2", "e3"]
    assert sorted(r.id for r in graph.upsert_edges(once, new, nodes).collect()) == ["e1", "e2", "e3"]
    assert {(r.case_id, r.relationship_type): (r.requested, r.written) for r in graph.upsert_counts(edges, nodes).collect()}[("x", "PLAINTIFF_IN")] == (1, 0)


def test_new_edges_deletes_and_merges(spark, nodes, edges):
    asked = spark.createDataFrame([("c", "a", "k", "PLAINTIFF_IN"), ("c", "a", "a", "OWNS"), ("c", "a", "zz", "OWNS"), ("c", "a", "k", "OVERRULES")], "case_id string, source_id string, target_id string, relationship_type string")
    assert sorted(r.outcome for r in graph.check_new_edges(asked, nodes).collect()) == ["INVALID_TRIPLET", "MISSING", "OK", "SELF_LOOP"]
    left, kept, detached = graph.delete_detach(nodes, edges, spark.createDataFrame([("c", "a"), ("c", "nobody")], "case_id string, id string"))
    assert left.count() == 3 and [r.id for r in kept.orderBy("id").collect()] == ["e2", "e4"] and [r.detached for r in detached.collect()] == [2]
    merged, moved = graph.merge(nodes, edges, spark.createDataFrame([("c", "a", "b")], "case_id string, primary_id string, secondary_id string"))
    assert {r.id: (r.source_id, r.target_id) for r in moved.where("case_id = 'c'").collect()} == {"e1": ("a", "k"), "e2": ("a", "k"), "e3": ("a", "b")}
    got = {(r.case_id, r.id): r for r in merged.collect()}
    assert got["c", "a"].aliases == ["Bob", "annie"] and got["c", "b"].merged_into == "a" and got["x", "a"].merged_into is None


def test_consistency(spark, nodes, edges):
    own = nodes.where("case_id = 'c'")
    rows = edges.where("case_id = 'c'").withColumn("is_valid", F.col("id") != "e2").withColumn("target_id", F.when(F.col("id") == "e1", "gone").otherwise(F.col("target_id")))
    got = graph.consistency(own, rows).first()
    assert (got.dangling_edges, got.invalid_triplets, got.orphan_nodes, got.consistency_score) == (1, 1, 0, 0.3333)
    assert graph.consistency(own, rows.where("false")).first().consistency_score == 1.0


def test_decision_bands(spark):
    answers = [("RESOLVED", "PERSON", None, 0.95, "ACCEPTED"), ("RESOLVED", "PERSON", None, 0.60, "REVIEW"), ("RESOLVED", "PERSON", None, 0.3, "REJECTED"), ("RESOLVED", "NOPE", None, 0.95, "REJECTED"), ("RESOLVED", None, "CITES", 0.95, "REJECTED"), ("UNCERTAIN", "NOPE", None, 0.95, "REJECTED")]
    rows = spark.createDataFrame([(i, d, e, r, c, None, None, True) for i, (d, e, r, c, _) in enumerate(answers)], "i int, decision string, entity_type string, relation_type string, confidence double, source_type string, target_type string, has_candidates boolean")
    got = review.decide(review.check_answers(rows)).orderBy("i").collect()
    assert [r.band for r in got] == [a[4] for a in answers]
    assert [r.final_confidence for r in got] == [0.95, 0.6, 0.3, 0.0, 0.0, 0.95]
    assert got[4].ontology_error == "TRIPLET_VIOLATION" and got[5].ontology_error is None


@pytest.mark.parametrize(("raw", "decision", "confidence", "well"), [('{"decision": "resolved", "confidence": 1.7}', "RESOLVED", 1.0, True), ('{"decision": "?", "confidence": -1}', "UNCERTAIN", 0.0, True), ("{broken", "UNCERTAIN", 0.0, False), ("", "UNCERTAIN", 0.0, False), (None, "UNCERTAIN", 0.0, False)])
def test_parse_response(spark, raw, decision, confidence, well):
    p = spark.createDataFrame([(raw,)], "t string").select(review.parse_response(F.col("t")).alias("p")).first().p
    assert (p.decision, p.confidence, p.well_formed) == (decision, confidence, well)


ROW = "document_id string, category string, pos long, page int, text string, norm string"


def test_greedy_matches_and_empty_denominators(spark):
    pred = spark.createDataFrame([("d", "x", 1, 1, "acme", ""), ("d", "x", 2, 1, "acme corp", ""), ("d", "x", 3, 1, "zeta", ""), ("d", "y", 1, 1, "only", "")], ROW)
    gold = spark.createDataFrame([("d", "x", 1, 1, "acme corp", ""), ("d", "x", 2, 1, "acme", ""), ("d", "z", 1, 1, "missing", "")], ROW)
    counts = evaluate.by_category(evaluate.matched_pairs(pred, gold, "entity"))
    got = {r.category: (r.tp, r.fp, r.fn) for r in counts.collect()}
    assert got == {"x": (2, 1, 0), "y": (0, 1, 0), "z": (0, 0, 1), "OVERALL": (2, 2, 1)}
    one = {r.category: (r.precision, r.recall, r.f1) for r in evaluate.scores(counts, "one").collect()}
    assert one["y"] == (0.0, 1.0, 0.0) and one["z"] == (1.0, 0.0, 0.0)
    zero = {r.category: (r.precision, r.recall, r.f1) for r in evaluate.scores(counts, "null").collect()}
    assert zero["x"] == (0.6667, 1.0, 0.8) and zero["z"] == (0.0, 0.0, 0.0)
    nothing = spark.createDataFrame([("n", 0, 0, 0)], "category string, tp long, fp long, fn long")
    assert evaluate.scores(nothing, "null").first()[4:] == (None, None, None)
    assert evaluate.scores(nothing, "one").first()[4:] == (1.0, 1.0, 1.0) and evaluate.scores(nothing, "zero").first()[4:] == (0.0, 0.0, 0.0)


def test_an_empty_prediction_matches_anything(spark):
    pred = spark.createDataFrame([("d", "x", 1, 1, None, None)], ROW)
    gold = spark.createDataFrame([("d", "x", 1, 1, "acme", None)], ROW)
    assert evaluate.matched_pairs(pred, gold, "model").first()[2:] == (1, 0, 0)


def test_chunks(spark):
    rows = [("d", 1, k, f"b{k}", "x" * n, "s0" if k == 0 else None) for k, n in enumerate([700, 700, 200, 1600, 10])] + [("d", 1, 9, "b9", "  ", None)]
    got = chunks.pack(spark.createDataFrame(rows, "document_id string, page_number int, idx int, block_id string, text string, section_id string")).orderBy("chunk_id").collect()
    assert [(r.block_ids, r.start_char_offset, r.section_id) for r in got] == [(["b0", "b1"], 1, "s0"), (["b2"], 1403, "s0"), (["b3"], 1604, "s0"), (["b4"], 3205, "s0")]


def test_files(spark):
    rows = [("a.txt", b"%PDF-1.7"), ("b.bin", b"\x89PNG\r\n\x1a\n.."), ("c.tif", b"??"), ("d.xyz", b"??"), ("e.pdf", b""), ("f", None)]
    got = {r.filename: (r.file_type, r.error) for r in files.validate(spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in rows], "filename string, content binary")).collect()}
    assert got == {"a.txt": ("pdf", None), "b.bin": ("png", None), "c.tif": ("tiff", None), "d.xyz": ("unknown", "Unknown file type."), "e.pdf": ("pdf", "File is empty."), "f": ("unknown", "File does not exist.")}


def test_sections(spark):
    rows = [("d", 1, 0, "b0", False, "intro"), ("d", 1, 1, "b1", True, "One"), ("d", 2, 2, "b2", False, "text"), ("e", 1, 0, "b0", True, "Top")]
    got = files.sections(spark.createDataFrame(rows, "document_id string, page_number int, idx int, block_id string, is_heading boolean, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [("d", "sec_001", "Document Body", 1, 1, 1), ("d", "sec_002", "One", 1, 2, 2), ("e", "sec_001", "Top", 1, 1, 1)]
