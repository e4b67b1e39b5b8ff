from kgspark.operators import chunks, docket, evaluate, resolve
from kgspark.plans import catalog

AT = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def joins(spark, name):
    return plan(catalog.QUERIES[name](spark, AT)).count("Join ")


def test_relations_of_predictions_join_the_mentions_once_for_each_end(spark):
    assert joins(spark, "c_relations") <= 21


def test_an_import_looks_no_type_up(spark):
    assert "Join LeftAnti" not in plan(catalog.QUERIES["g_import_filter"](spark, AT))
    assert joins(spark, "g_import_filter") < 10


def test_a_reminder_has_its_time_before_documents_are_looked_up(spark):
    requests = spark.createDataFrame([(1, 2, 3, 4, "fixed_datetime", 1, None)], "request_id long, event_id long, matter_id long, document_id long, anchor string, days_before int, time_of_day string").selectExpr("*", "timestamp '2024-01-02 03:04:05' as fire_at")
    events = spark.createDataFrame([(2, 3, "UTC")], "event_id long, matter_id long, timezone string").selectExpr("*", "timestamp '2024-01-09 00:00:00' as starts_at")
    documents = spark.createDataFrame([(4, 2, 3)], "document_id long, event_id long, matter_id long")
    found = docket.check_new_reminder(requests, events, documents, docket.ts("2024-01-01 00:00:00")).select("request_id", "outcome")
    assert found.first().outcome == "OK"
    lines = plan(found).splitlines()
    looked_up = next(k for k, x in enumerate(lines) if "Join LeftOuter" in x)
    assert "AS fires_at" in lines[looked_up + 1]


def test_ends_that_meet_by_text_alone(spark):
    entities = spark.createDataFrame([("k", 1, "PERSON", "Ann Roe", 10, 17), ("k", 2, "PERSON", "Bob", 40, 43)], "chunk_id string, pos long, entity_type string, text string, start int, end int")
    mentions = spark.createDataFrame([("a", "k", "person", "ANN ROE", 12, 19), ("b", "k", "person", "Bob", 40, 43), ("c", "k", "nothing", "Eve", 1, 4)], "mention_key string, chunk_id string, label string, text string, start int, end int")
    assert {r.mention_key: (r.how, r.entity_pos) for r in chunks.endpoints(mentions, entities).collect()} == {"a": ("near", 1), "b": ("exact", 2), "c": ("none", None)}


def test_spellings_are_summed_in_order_and_not_held_in_a_table(spark):
    for name in ("r_canonical_name", "e_escalation", "v_entity_rules", "v_low_confidence", "v_worst_status"):
        lines = catalog.QUERIES[name](spark, AT)._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not [x for x in lines if "HashAggregate(" in x and "norm_key" in x], name


def test_an_entity_of_many_mentions_in_many_tasks(spark):
    rows = [("d", "PERSON", "ann", ("Ann", "ANN", "ann")[k % 7 % 3], 1.0 if k % 2 else None, k % 5, k) for k in range(3_000, 0, -1)]
    mentions = spark.createDataFrame(rows, "document_id string, entity_type string, normalized_value string, text string, confidence double, page_number int, pos long")
    got = resolve.canonical(mentions.repartition(6)).collect()
    assert [(r.canonical_name, r.aliases, r.n_mentions, r.avg_confidence, r.first_confidence, r.first_page, r.first_pos) for r in got] == [("Ann", ["ANN", "ann"], 3_000, 1.0, 1.0, 1, 1)]


def test_scores_fold_the_pairs_once(spark):
    for name in ("e_report", "e_rules_prf", "e_model_prf", "e_entity_prf", "e_relation_prf"):
        assert plan(catalog.QUERIES[name](spark, AT)).count("MapInArrow") == 1, name


def test_sums_over_all_stand_beside_a_category_of_that_name_and_without_any(spark):
    pairs = spark.createDataFrame([("a", 1, 2, 3), ("OVERALL", 1, 0, 0), ("a", 1, 1, 1)], "category string, tp long, fp long, fn long")
    assert sorted(map(tuple, evaluate.by_category(pairs).collect())) == [("OVERALL", 1, 0, 0), ("OVERALL", 3, 3, 4), ("a", 2, 3, 4)]
    assert list(map(tuple, evaluate.by_category(pairs.where("false")).collect())) == [("OVERALL", None, None, None)]


def test_edges_are_sorted_by_key_only_where_their_versions_are_together(spark):
    lines = catalog.QUERIES["g_upsert_edges"](spark, AT)._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(k for k, x in enumerate(lines) if "REPARTITION_BY_COL" in x)
    assert not [x for x in lines[dealt:] if "Sort [case_id" in x and "version" in x]
    assert [x for x in lines[:dealt] if "Sort [case_id" in x and "version" in x]
