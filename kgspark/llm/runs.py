"""Periodic runs of words, by Lyndon arrays of both orders of the alphabet.

A run is a stretch of words that no neighbour extends keeping its smallest period. The method is that of Ellert and Fischer:
in one of the two orders, the smaller-first one or its reverse, a run's period is the length of the longest Lyndon word at a
place of the run, which reaches from that place to the next smaller suffix. So each document's words are ranked by sorting,
and the next smaller suffix of every place is found in both orders, left to right, with a chain of previous smaller suffixes
as the stack. Every comparison of two suffixes keeps how far these agree. A later comparison inside a stretch that is known to
repeat an earlier one takes that one's extension over, and only what lies beyond the furthest place seen is compared word by
word; one between a suffix and the next on the chain takes the lesser of two known extensions. No suffix array, tree or hash
is made. Edges whose extension is long enough are runs, once extended to the left.

A run of exponent e or more holds only words that the document has e times at least, so other words cut a document into
pieces beforehand; that changes no run.

Documents are handled each by itself, on the partition where they lie: nothing is shuffled. Words are what stands between
ASCII white space, unchanged. Null and empty texts have no words and no runs. Repeated rows give the same runs each; a null id
is an id like any other. A very long text is handled whole in one task: time and memory are linear in it. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, sliced, texts_of

#: A run's least length, and its least number of periods.
LENGTH, EXPONENT = 6, 4


def next_smaller(w: list[int]) -> tuple[list[int], list[int], int]:
    """For each place the start of the next smaller suffix (len(w) if there is none) and how far the two suffixes agree; the
    number of equal words that were compared. A suffix that another one begins with is the smaller."""
    n = len(w)
    after, agree = [n] * n, [0] * n
    before, agree_before = [-1] * n, [0] * n
    neighbour = [0] * n
    # What starts at `copy`, up to `seen`, stands `shift` places further left, too.
    copy = seen = shift = compared = 0
    for i in range(1, n):
        j, k, scan = i - 1, 0, True
        if i < seen:
            k = neighbour[i - shift]
            if k < seen - i:
                scan = False
            else:
                k = seen - i
        if scan:
            m = k
            while i + k < n and w[j + k] == w[i + k]:
                k += 1
            compared += k - m
            if i + k > seen:
                copy, seen, shift = i, i + k, i - j
        neighbour[i] = k
        while i + k == n or w[j + k] > w[i + k]:
            after[j], agree[j] = i, k
            m, j = agree_before[j], before[j]
            if j < 0:
                break
            if m != k:
                if m < k:
                    k = m
                continue
            if i < seen:
                twin, known = i - shift, -1
                if j < copy:
                    if before[twin] == j:
                        known = agree_before[twin]
                elif after[j - shift] == twin:
                    known = agree[j - shift]
                elif before[twin] == j - shift:
                    known = agree_before[twin]
                if known >= 0:
                    if known < seen - i:
                        k = known
                        continue
                    k = max(k, seen - i)
            m = k
            while i + k < n and w[j + k] == w[i + k]:
                k += 1
            compared += k - m
            if i + k > seen:
                copy, seen, shift = i, i + k, i - j
        else:
            before[i], agree_before[i] = j, k
    return after, agree, compared


def _runs_in(w: list[int], length: int, exponent: int) -> set[tuple[int, int, int]]:
    n, found = len(w), set()
    for own in (w, [-x for x in w]):
        after, agree, _ = next_smaller(own)
        for i, j in enumerate(after):
            k, p = agree[i], j - i
            # At the first Lyndon root of a run that is long enough, the extension is this long at least.
            if k <= (exponent - 2) * p or j == n:
                continue
            if i >= p and after[i - p] == i and agree[i - p] >= p:
                continue
            a = i
            while a and own[a - 1] == own[a - 1 + p]:
                a -= 1
            if j + k - a >= max(length, exponent * p):
                found.add((a, j + k - a, p))
    return found


def ranked(words: list[bytes], least: int) -> tuple[list[int], np.ndarray]:
    """Ranks of words in their order, and which of them occur at least so many times."""
    n = len(words)
    order = sorted(range(n), key=words.__getitem__)
    rank, often = [0] * n, np.zeros(n, bool)
    now, a = -1, 0
    last = None
    for z, k in enumerate(order):
        if words[k] != last:
            if z - a >= least:
                often[order[a:z]] = True
            last, a, now = words[k], z, now + 1
        rank[k] = now
    if n - a >= least:
        often[order[a:]] = True
    return rank, often


def runs_of(words: list[bytes], length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run with at least that length and that many periods (2 or more), by start, period."""
    if len(words) < length:
        return []
    rank, often = ranked(words, exponent)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], often, [False])).astype(np.int8))).tolist()
    found = [(a + x, m, p) for a, z in zip(edge[::2], edge[1::2], strict=True) if z - a >= length for x, m, p in _runs_in(rank[a:z], length, exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for a, n, p in runs:
        edge[a + p] += 1
        edge[a + n] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _found(length: int, exponent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUNS), ("collapsed", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows):
            sizes, runs, kept = [], [], []
            for text in b.column(1):
                words = text.as_py().encode().split()
                own = runs_of(words, length, exponent)
                sizes.append(len(words))
                runs.append([{"start": a, "length": n, "period": p} for a, n, p in own])
                kept.append(b" ".join(collapsed(words, own)).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, RUNS), pa.array(kept, pa.string())], schema=schema)

    return run


def periodic_runs(docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (the text without what repeats a run's first period)."""
    prepare(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_found(length, exponent), OUT)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where one document in ten, by the checksum h of its id, repeats itself from some word to its end.

    With g = h div 10: words from the (g mod n)-th on repeat the first 1 + (n - a) div (3 + g mod 8) of them. A null id plants nothing.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def repeated(own):
        n = F.size(own)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(F.transform(own, lambda x, i: F.when(i < a, x).otherwise(F.get(own, (a + F.pmod(i - a, p)).cast("int")))), " ")

    # A list of one, so that the words are split once.
    again = F.element_at(F.transform(F.array(words), lambda own: F.when(F.size(own) > 0, repeated(own)).otherwise("")), 1)
    return docs.select(F.col(id_col).alias("doc_id"), F.when((h % 10 == 0) & F.col(text_col).isNotNull(), again).otherwise(F.col(text_col)).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length (ties: least start, then period), digests of the runs and of what is left."""
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), lines.alias("lines"), "collapsed", "n_words")
    length = -F.col("top.m")
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("top.start").alias("start"),
        length.alias("length"),
        F.col("top.period").alias("period"),
        F.floor(length * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
