import random
import zlib

from kgspark.llm import quality

from .conftest import EDGES


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        good = i % 4 != 0
        kind = rng.randrange(3)
        text = " ".join(words) if good else "### ".join(words) if kind == 0 else "!! ".join(words).upper() if kind == 1 else " ".join(words[:2] * 60)
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy_and_contract(spark, docs):
    rows = corpus()
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    frame = docs([(i, t) for i, t, _ in rows])
    got = quality.classify(frame, quality.fit(frame, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.predicted == rows[r.doc_id][2] for r in own) / len(own) > 0.95
    # held-out labels play no part
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in quality.classify(frame, quality.fit(frame, flipped)).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_edges(spark, docs, edges):
    rows = corpus(200)
    labels = spark.createDataFrame([*[(i, q, 0) for i, _, q in rows], (None, 1, 0), (3, None, None), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs([(i, t) for i, t, _ in rows]), labels)
    got = quality.classify(edges, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    none = labels.where("false")
    assert quality.fit(edges, none) is None
    assert {r.score for r in quality.classify(edges, None).collect()} == {0.5}
    assert quality.classify(docs([]), model).count() == 0
