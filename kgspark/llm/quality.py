"""Quality classifier by compression.

Two zstandard dictionaries are trained, on texts labelled good and on texts labelled bad. A document is compressed in
blocks of a fixed size against either; the difference of the two sizes over its length says which class its text is like,
and the smaller size over its length how repetitive it is. A logistic calibration, fitted on labelled texts that neither
dictionary has seen, turns this into the probability of label 1.

Only labelled rows whose crc32(id as text) mod 3 isn't 1 are learnt from, a bounded sample of them: `per_class` rows a
class, those first by a hash of the id, of at most `longest` bytes each. Every document is scored, its whole text.

Null and empty texts get the score that the calibration gives to length 0. Null or conflicting labels aren't learnt from;
without both classes every score is 0.5. A null id counts as an empty text for the crc. Of several texts with one id the
largest is learnt from, so that a fit repeats itself; places of equal hash are ordered by id. Repeated rows are scored each.
Very long texts are compressed block by block. An empty table gives no rows, and no model. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep_rows, prepare, sliced, texts_of

#: Rows of a class that are learnt from, two thirds for its dictionary, and the longest text among them.
PER_CLASS, LONGEST = 3000, 32_768
#: Bytes of a dictionary and of a block; the compression level.
DICT_BYTES, BLOCK, LEVEL = 65_536, 2048, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


class Sizes:
    """Compressed sizes against the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by = []
        for data in (good, bad):
            kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            d = zstandard.ZstdCompressionDict(data, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, text: bytes) -> list[float]:
        if not text:
            return [0.0, 0.0, 0.0]
        good, bad = (sum(len(c.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in self.by)
        return [(bad - good) / len(text), min(good, bad) / len(text), float(np.log1p(len(text)))]


def _expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and products."""
    n = x.shape[1]
    return np.hstack([x, *[x[:, [i]] * x[:, [j]] for i in range(n) for j in range(i, n)]])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(model: Model | None, features: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(features), 0.5)
    z = (_expand(features) - model.centre) / model.scale
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + z @ np.array(model.weights[1:]), -30, 30)))


def train(good: list[bytes], bad: list[bytes]) -> Model | None:
    """The first two thirds of each class make its dictionary, the rest the calibration."""
    good, bad = [t for t in good if t], [t for t in bad if t]
    if len(good) < 3 or len(bad) < 3:
        return None

    def dictionary(texts: list[bytes]) -> bytes:
        pieces = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
        try:
            return zstandard.train_dictionary(DICT_BYTES, pieces, k=512, d=8).as_bytes()
        except zstandard.ZstdError:  # too little text to choose from: all of it
            return b"".join(pieces)[-DICT_BYTES:].rjust(8, b" ")

    a, b = -(-2 * len(good) // 3), -(-2 * len(bad) // 3)
    of_good, of_bad = dictionary(good[:a]), dictionary(bad[:b])
    sizes = Sizes(of_good, of_bad)
    rest = good[a:] + bad[b:]
    raw = _expand(np.array([sizes.features(t) for t in rest]))
    centre, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-9
    weights = _logistic((raw - centre) / scale, np.array([1.0] * (len(good) - a) + [0.0] * (len(bad) - b)))
    return Model(of_good, of_bad, tuple(weights), tuple(centre), tuple(scale))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, longest: int = LONGEST) -> Model | None:
    """A model from a bounded sample of the labelled rows that aren't held out."""
    agreed = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    agreed = agreed.where("least = most").select(F.col("doc_id").alias("label_id"), F.col("least").alias("label"), F.xxhash64(F.col("doc_id").cast("long")).alias("place"))
    picked = None
    for k in (0, 1):
        some = agreed.where(F.col("label") == k).orderBy("place", "label_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    plain = texts_of(docs, id_col, text_col).where(F.octet_length("text") <= longest)
    # At most 2 * per_class ids: the bound that makes this broadcast, and what is collected, safe.
    found = plain.join(F.broadcast(picked), plain["doc_id"] == F.col("label_id"))
    rows = found.groupBy("place", "label_id", "label").agg(F.max("text").alias("text")).orderBy("place", "label_id").collect()
    return train(*([r.text.encode() for r in rows if r.label == k] for k in (1, 0)))


def _scored(packed):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed.value)
        sizes = Sizes(model.good, model.bad) if model else None
        for b in sliced(rows):
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            found = np.array([sizes.features(t) for t in texts]).reshape(-1, 3) if sizes else np.zeros((len(texts), 3))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(score(model, found))], schema=schema)

    return run


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; nothing but the text is an input of a score."""
    spark = docs.sparkSession
    prepare(spark)
    packed = spark.sparkContext.broadcast(pickle.dumps(model))
    found = texts_of(docs, id_col, text_col).mapInArrow(_scored(packed), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose score is `least` or more; without a model all."""
    spark = docs.sparkSession
    prepare(spark)
    packed = spark.sparkContext.broadcast(pickle.dumps(model))

    def build():
        own = pickle.loads(packed.value)
        sizes = Sizes(own.good, own.bad) if own else None

        def keep(texts: list[str]) -> np.ndarray:
            if sizes is None:
                return np.ones(len(texts), bool)
            return score(own, np.array([sizes.features(t.encode()) for t in texts]).reshape(-1, 3)) >= least

        return keep

    return keep_rows(docs, text_col, build)
