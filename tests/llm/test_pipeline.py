import random

import numpy as np
import pytest

from kgspark.llm import pieces, quality
from kgspark.llm.shared import file_bytes, tokenizer_path

from .plain import contaminated
from .test_exact_dedup import lowered
from .test_simhash import alike

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randrange(1, 4)))
    bench = [(i, " ".join(word() + str(i) for _ in range(25))) for i in range(6)]
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randrange(30, 200))]
        good = i % 5 != 0
        text = " ".join(words) if good else "### ".join(words)
        if i % 17 == 3:
            text += " " + bench[i % 6][1]
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(300 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(1, 40, 3)]
    rows += [(400 + i, rows[i][1] + " " + rows[i][1].split()[0]) for i in range(2, 60, 3)]
    return [*rows, (500, None), (501, ""), (1, rows[1][1]), (None, rows[4][1] + " end")], labels, bench


def test_against_a_plain_version(spark, tmp_path):
    rows, labels, bench = corpus()
    at = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.ids, r.exact) for r in corpus_pipeline.run(spark, at).collect()))

    # a plain version of every stage
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    sizes = quality.Sizes(model.good, model.bad)
    left = [(i, t or "") for i, t in rows if quality.score(model, np.array([sizes.features((t or "").encode())]))[0] >= corpus_pipeline.LEAST_QUALITY]
    assert 60 < len(left) < len(rows) - 40
    key = lambda i: -1 if i is None else i
    best = {}
    for i, t in left:
        if lowered(t) not in best or key(best[lowered(t)][0]) < key(i):
            best[lowered(t)] = (i, t)
    left = sorted(best.values(), key=lambda x: (x[0] is None, x[0]))
    found = alike(left)
    left = [x for k, x in enumerate(left) if found[k] == k]
    left = [(i, t) for i, t in left if not any(contaminated(t, item) for _, item in bench)]
    library = pieces.vocabulary(file_bytes(tokenizer_path(pieces.MODEL))).library
    assert got == sorted((i is None, i or 0, library.encode(t), True) for i, t in left)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, at).count() == 0


def test_the_quality_stage_drops_what_the_classifier_rejects(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    want = quality.classify(docs, quality.fit(docs, labels)).where("predicted = 1")
    kept = corpus_pipeline.quality_stage(spark, docs, at)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in want.select("doc_id").collect())
