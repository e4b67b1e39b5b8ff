from kgspark.operators import chunks


def _found(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, pos long, entity_type string, text string, start int, end int")


def test_ends_meet_entities_over_the_bounds_of_stretches(spark):
    w = chunks.STRETCH
    found = _found(spark, [("k", 1, "PERSON", "ann", w - 1, w + 2), ("k", 2, "COURT", "bench", 2 * w, 2 * w + 5), ("other", 3, "CASE", "ann", w + 3, w + 6), ("k", 4, "CASE", "ann", 9 * w, 9 * w + 3)])
    mentions = spark.createDataFrame(
        [("near", "k", "CASE", "Ann ", w + 3, w + 6), ("exact", "k", "CASE", "ANN", w - 1, w + 2), ("below", "k", "CASE", "bench", 2 * w - 5, 2 * w), ("far", "k", "CASE", "bench", 2 * w - 6, 2 * w), ("nowhere", "k", "COURT", "ann", None, None), ("blank", "k", "CASE", " ", w, w)],
        "mention_key string, chunk_id string, label string, text string, start int, end int",
    )
    got = {r.mention_key: (r.how, r.entity_type, r.entity_pos) for r in chunks.endpoints(mentions, found).collect()}
    assert got == {"near": ("near", "PERSON", 1), "exact": ("exact", "PERSON", 1), "below": ("near", "COURT", 2), "far": ("made", "CASE", None), "nowhere": ("made", "COURT", None)}


def test_relations_meet_entities_once_and_nothing_else(spark):
    found = _found(spark, [("k", 1, "PERSON", "ann", 0, 3), ("k", 2, "CASE", "doe", 8, 11)])
    end = "struct<label: string, text: string, start: int, end: int>"
    rows = [("r1", "k", "plaintiff_in", 0.9, ("x", "Ann", 2, 5), ("case", "doe", 8, 11)), ("r2", "k", "plaintiff_in", 0.9, ("nobody", "else", 50, 54), ("case", "doe", 8, 11)), ("r3", "k", "plaintiff_in", 0.3, ("x", "Ann", 0, 3), ("case", "doe", 8, 11))]
    out = chunks.relations(spark.createDataFrame(rows, f"rel_id string, chunk_id string, relation string, score double, head {end}, tail {end}"), found)
    assert [(r.rel_id, r.source_type, r.source_pos, r.target_type, r.target_pos, r.is_valid) for r in out.collect()] == [("r1", "PERSON", 1, "CASE", 2, True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Entities lie once, and relations aren't looked up again by their ids.
    assert plan.count("Generate ") == 2 and "rel_id" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_summary_counts_relations_without_looking_them_up_again(spark):
    from kgspark.plans import models

    plan = models.c_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and not [x for x in joins if "rel_id" in x]
