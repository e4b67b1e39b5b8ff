"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Every source (a bounded run of rows of one input partition) sends each owner of a fingerprint range its sorted
   distinct fingerprints, as Golomb-Rice coded gaps.
2. An owner decodes what it got and answers each source with a bitmap: which of its fingerprints another source has too.
3. Rows whose fingerprint repeats, in their source or elsewhere, are suspects; only their texts are shuffled, grouped by
   the whole normalised text, so equality is decided on bytes. Copies collapse before the shuffle, so a text that a third
   of all rows hold costs each task one row.

Null and empty texts are equal. Texts that differ only in the case of A-Z are equal. A null id counts as the smallest.
Repeated rows (same id, same text): one of them stays. Very long texts are hashed whole and shuffled only if suspect. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, prepare, sliced, texts_of, written

#: Bits of a fingerprint in the exchange; a clash costs one needless byte comparison.
FP_BITS = 48
#: Rows of a source at most: what one task holds when bitmaps come back. Fingerprints of an owner, about: what it decodes.
SOURCE_ROWS, OWNED = 1 << 17, 1 << 22

ROWS = "doc_id long, rid long, fp long, sha binary, src long, owner int, blob binary"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct uint64 values below span, as a count, a Rice parameter, unary quotients and binary remainders."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(max(1, span // max(n, 1))).bit_length() - 1)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    low = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - k :] if k else np.zeros((n, 0), np.uint8)
    head = np.array([n, k, len(unary)], "<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    n, k, bits = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    first = (bits + 7) // 8
    body = np.frombuffer(blob, np.uint8, offset=24)
    ends = np.flatnonzero(np.unpackbits(body[:first], count=bits))
    high = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    wide = np.zeros((n, 64), np.uint8)
    if k:
        wide[:, 64 - k :] = np.unpackbits(body[first:], count=n * k).reshape(n, k)
    low = np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum((high << np.uint64(k)) + low, dtype=np.uint64)


def _owner_start(owners: int) -> np.ndarray:
    """First fingerprint of every owner's range, and the end of the last."""
    return np.array([(i << FP_BITS) // owners for i in range(owners + 1)], np.uint64)


def _digest(owners: int):
    """Rows with their fingerprints, and after each source's rows its coded lists for the owners."""
    starts = _owner_start(owners)
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("fp", pa.int64()), ("sha", pa.binary()), ("src", pa.int64()), ("owner", pa.int32()), ("blob", pa.binary())])

    def lists(fps: list[np.ndarray], src: int) -> Iterator[pa.RecordBatch]:
        own = np.unique(np.concatenate(fps))
        cut = np.searchsorted(own, starts)
        out = [(o, golomb_encode(own[cut[o] : cut[o + 1]] - starts[o], int(starts[o + 1] - starts[o]))) for o in range(owners) if cut[o] < cut[o + 1]]
        n = len(out)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 3 + [pa.nulls(n, pa.binary()), pa.array([src] * n, pa.int64()), pa.array([o for o, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, held, fps, rid = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in sliced(batches):
            norm = pc.ascii_lower(batch.column(1))
            shas = [hashlib.sha256(t).digest() for t in norm.cast(pa.large_binary()).to_pylist()]
            fp = (np.frombuffer(b"".join(s[:8] for s in shas), ">u8") >> np.uint64(64 - FP_BITS)).astype(np.uint64)
            n = len(shas)
            if held and held + n > SOURCE_ROWS:
                yield from lists(fps, (part << 20) + chunk)
                chunk, held, fps = chunk + 1, 0, []
            src = (part << 20) + chunk
            rids = (part << 40) + rid + np.arange(n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rids), pa.array(fp.astype(np.int64)), pa.array(shas, pa.binary()), pa.array([src] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
            fps.append(fp)
            held, rid = held + n, rid + n
        if held:
            yield from lists(fps, (part << 20) + chunk)

    return run


def _answer(lists: pa.Table) -> pa.Table:
    """An owner's answer: for each source, a bit for each of its fingerprints that another source has as well."""
    srcs, own = lists.column("src").to_pylist(), [golomb_decode(b) for b in lists.column("blob").to_pylist()]
    _, inverse, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    bits = np.split(count[inverse] > 1, np.cumsum([len(x) for x in own])[:-1])
    return pa.table({"src": pa.array(srcs, pa.int64()), "owner": lists.column("owner"), "bitmap": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _suspects(owners: int):
    starts = _owner_start(owners)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        fp = rows.column("fp").to_numpy().astype(np.uint64)
        own, inverse, count = np.unique(fp, return_inverse=True, return_counts=True)
        cut, hit = np.searchsorted(own, starts), count > 1
        for o, bitmap in zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist(), strict=True):
            n = cut[o + 1] - cut[o]
            hit[cut[o] : cut[o + 1]] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
        return pa.table({"doc_id": rows.column("doc_id"), "rid": rows.column("rid"), "sha": rows.column("sha"), "suspect": pa.array(hit[inverse])})

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, rid (row within this run), keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    prepare(spark)
    # As many owners as keep the share of each below a bound, whatever the number of rows.
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNED))
    plain = texts_of(docs, id_col, text_col)
    sent = written(plain.mapInArrow(_digest(owners), ROWS), "exact-rows")
    rows = sent.where("owner is null").select("doc_id", "rid", "fp", "sha", "src")
    answers = sent.where("owner is not null").select("src", "owner", "blob").groupBy("owner").applyInArrow(_answer, "src long, owner int, bitmap binary")
    marked = written(rows.groupBy("src").cogroup(answers.groupBy("src")).applyInArrow(_suspects(owners), "doc_id long, rid long, sha binary, suspect boolean"), "exact-suspects")
    suspects = marked.where("suspect")
    ids = suspects.select(F.col("doc_id").alias("suspect_id")).distinct()
    equal = (
        plain.join(ids.hint("merge"), plain["doc_id"].eqNullSafe(F.col("suspect_id")), "left_semi")
        .groupBy(F.translate("text", UPPER, LOWER).alias("norm"))
        .agg(F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    )
    best = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("best"))
    # Written, so that the join below has a plain exchange on either side: adaptive execution can then split a large group.
    groups = written(equal.join(best, "sha").select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid")), "exact-groups")
    return marked.join(groups.hint("merge"), "sha", "left").select(
        "doc_id",
        "rid",
        F.when(F.col("keep_rid").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns; of repeated rows (same id and text) one."""
    own_id, own_sha, gone_id, gone_sha = free_names(docs, "id", "sha", "gone_id", "gone_sha")
    groups = written(exact_groups(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(gone_id), "keep_id", F.col("text_sha256").alias(gone_sha)), "exact-copies")
    again = F.col(gone_id).eqNullSafe(F.col("keep_id"))
    gone = groups.where(~again).select(gone_id, gone_sha).distinct()
    sha = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), 256)
    rows = docs.withColumn(own_sha, sha).withColumn(own_id, F.col(id_col))
    kept = rows.join(gone.hint("merge"), F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(own_sha) == F.col(gone_sha)), "left_anti")
    if not groups.where(again).isEmpty():  # a row that stays is itself repeated
        kept = kept.dropDuplicates([own_id, own_sha])
    return kept.drop(own_id, own_sha)


ORACLE = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
     g as (select norm, max(doc_id) as keep_id, count(*) as group_size from n group by norm)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.norm) as text_sha256
from n join g using (norm)
"""
