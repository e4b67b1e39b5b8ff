"""Substring dedup by recompression: passages of WINDOW words that an earlier document holds, found by shared symbols.

A window is WINDOW consecutive words of one document. Each word is removed that lies in a window whose words also start in a
document with a smaller id; windows are judged on the input.

1. Words get names, and rounds name what they have: a round replaces every run of a symbol by one symbol (in every third
   round), then every pair of a left and a right symbol by one; a bit of a symbol's name says which it is in that round. A name
   is a digest of what is named, so each partition gives the same run or pair the same name without exchanging any.
2. Equal passages get equal symbols but for a few at either end: the first and last run, a right symbol at the start and a left
   one at the end may belong with words outside. What is left of a window then, its inside, depends on nothing but its words.
   A window goes through the rounds as long as its inside has PHRASE symbols, and is known by a phrase of so many neighbouring
   symbols of it, the least by hash among the first TRIES. Neighbouring windows mostly share their phrase: a region.
3. Spark counts the phrases' documents. A phrase that one document has alone can't stand in a repeated passage; all others
   reveal candidates. Equal regions fall together first: all but those of the smallest id are repeats as they are.
4. Where a phrase stands in regions that differ, the windows of its regions of smallest id are named, each by itself, and meet
   by these names (two sums of word names, 128 bits together); those that a smaller id has too are repeats, and the smallest
   one's is their source.

5. Repeated stretches are sent the words of their source, and are removed where these are the same, word for word.

Each exchange is by phrase, region, window or document;
partial minima and maxima shrink frequent ones before it, and joins have plain exchanges on either side, so that adaptive
execution can split a frequent one. Blocks of BLOCK words are parsed at once, which changes nothing, since insides depend on
the windows alone; so memory doesn't grow with a text but for the text itself.

Words are what stands between ASCII white space, unchanged. Null and empty texts have none. Of rows with one id none is
smaller than another; a null id counts as the largest long. Texts shorter than a window stay whole. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BATCH_ROWS, byte_views, discard, prepare, sliced, texts_of, written

WINDOW = 50
#: Rounds; rounds that name runs; symbols of a phrase; phrases of a window among which the least is taken.
ROUNDS, RUNS_EVERY, PHRASE, TRIES = 4, 3, 4, 8
#: Words parsed at once.
BLOCK = 1 << 15
#: Starts of a source after which a repeated stretch is cut.
CELL = 512
#: A null id stands as the largest one.
NO_ID = (1 << 63) - 1

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2 ** 64."""
    held = _POWERS.get((base, 0))
    if held is None or len(held) < n:
        x = np.full(max(n, 1 << 16), base, _U)
        x[0] = 1
        held = _POWERS[base, 0] = np.cumprod(x)
    return held[:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64 bits that leaves no order."""
    x = x + _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """For each stretch the sum of value times power of its place in the stretch, mixed."""
    n = len(values)
    total = np.zeros(n + 1, _U)
    np.cumsum(values * _powers(base, n), out=total[1:])
    return mixed((total[ends] - total[starts]) * _powers(pow(base, -1, 1 << 64), n + 1)[starts])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of some bytes; offsets: where texts begin and end, which no word crosses."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[[0, -1] if offsets is None else offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names of each word."""
    values = data.astype(_U) + _U(1)
    return tuple(sums(values, starts, ends, base) for base in _BASES)


def _named_runs(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal symbols as one symbol: the new symbols, where each starts, and which one each old symbol is in."""
    head = first.copy()
    head[1:] |= sym[1:] != sym[:-1]
    at = np.flatnonzero(head)
    count = np.diff(at, append=len(sym))
    return np.where(count > 1, mixed(sym[at] + mixed(count.astype(_U), 5)), sym[at]), at, np.cumsum(head) - 1


def _named_pairs(sym: np.ndarray, first: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each left symbol with a right one after it as one symbol."""
    joined = np.zeros(len(sym), bool)
    joined[1:] = right[1:] & ~right[:-1] & ~first[1:]
    at = np.flatnonzero(~joined)
    new = sym[at]
    pair = np.flatnonzero(joined) - 1
    own = np.cumsum(~joined) - 1
    new[own[pair]] = mixed(mixed(sym[pair], 1) + sym[pair + 1], 2)
    return new, at, own


def phrases(names: np.ndarray, first: np.ndarray, starts: np.ndarray, window: int, rounds: int = ROUNDS) -> np.ndarray:
    """The phrase of every window. first: where a document starts; starts: places of windows, each inside one document."""
    sym, key = names, np.zeros(len(starts), _U)
    a, b, own = starts.copy(), starts + window, np.arange(len(starts))
    size = min(PHRASE, window)

    def settle(which: np.ndarray, level: int) -> None:
        """Windows that go no further get their phrase."""
        if not len(which):
            return
        h = sym[: len(sym) - size + 1]
        for k in range(1, size):
            h = mixed(h, 3) + sym[k : len(sym) - size + 1 + k]
        h = mixed(h, level + 10)
        best = h[a[which]]
        for k in range(1, TRIES):
            more = a[which] + k + size <= b[which]
            best = np.where(more, np.minimum(best, h[np.minimum(a[which] + k, len(h) - 1)]), best)
        key[own[which]] = best

    for level in range(rounds):
        if not len(own):
            return key
        na, nb, new, mark = a, b, sym, first
        if level % RUNS_EVERY == 0:
            new, at, of = _named_runs(new, mark)
            mark = mark[at]
            na, nb = of[na] + 1, of[nb - 1]
        right = (mixed(new, level + 20) & _U(1)) == 1
        live = nb > na
        na, nb = np.where(live, na, 0), np.where(live, nb, 1)
        na = na + right[na]
        nb = nb - ~right[nb - 1]
        live &= nb > na
        na, nb = np.where(live, na, 0), np.where(live, nb, 1)
        new, at, of = _named_pairs(new, mark, right)
        na, nb = of[na], of[nb - 1] + 1
        live &= nb - na >= size
        settle(np.flatnonzero(~live), level)
        sym, first = new, mark[at]
        a, b, own = na[live], nb[live], own[live]
    settle(np.arange(len(own)), rounds)
    return key


def regions_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For the texts between offsets: text, first start (in words of it), number of starts, phrase, and two names of each region."""
    ws, we = words_of(data, offsets)
    text = np.searchsorted(offsets, ws, side="right") - 1
    one, two = word_names(data, ws, we)
    begin = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for x in range(0, len(ws), BLOCK):
        z = min(len(ws), x + BLOCK + window - 1)
        own = text[x:z]
        starts = np.flatnonzero(own[: max(0, len(own) - window + 1)] == own[window - 1 :]) if len(own) >= window else np.zeros(0, np.int64)
        starts = starts[starts < BLOCK]
        if not len(starts):
            continue
        first = np.concatenate(([True], own[1:] != own[:-1]))
        key = phrases(one[x:z], first, starts, window)
        head = np.concatenate(([True], (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1) | (own[starts[1:]] != own[starts[:-1]])))
        at = np.flatnonzero(head)
        n = np.diff(at, append=len(starts))
        s, e = starts[at], starts[at] + n + window - 1
        out.append((own[s], s + x - begin[own[s]], n, key[at], sums(one[x:z], s, e, _BASES[1]), sums(two[x:z], s, e, _BASES[0])))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U, _U))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


REGIONS = "id long, th long, at int, n int, key long, one long, two long"


def _regions(window: int):
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows, 2):
            data, offsets = byte_views(b.column(2))
            text, at, n, *names = regions_of(data, offsets, window)
            text = pa.array(text)
            yield pa.RecordBatch.from_arrays([b.column(0).take(text), b.column(1).take(text), pa.array(at, pa.int32()), pa.array(n, pa.int32()), *(pa.array(x.view(np.int64)) for x in names)], schema=schema)

    return run


WINDOWS = "id long, th long, at int, one long, two long"


def _windows(window: int):
    """Names of the windows of the given regions of a document."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("one", pa.int64()), ("two", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows, 2):
            for doc, th, text, own in zip(*(b.column(k) for k in range(4)), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                one, two = word_names(data, *words_of(data))
                at, n = (own.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                starts = np.unique(np.concatenate([np.arange(x, x + m) for x, m in zip(at.tolist(), n.tolist(), strict=True)]))
                for k in range(0, len(starts), BLOCK):
                    s = starts[k : k + BLOCK]
                    x = int(s[0])
                    z = int(s[-1]) + window
                    names = [pa.array(sums(v[x:z], s - x, s - x + window, base).view(np.int64)) for v, base in ((one, _BASES[1]), (two, _BASES[0]))]
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(s), pa.int64()), pa.array([th.as_py()] * len(s), pa.int64()), pa.array(s, pa.int32()), *names], schema=schema)

    return run


STRETCHES = "id long, th long, at int, n int, of_id long, of_th long, of_at int"


def _stretches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring repeated starts whose sources are neighbours too, as one stretch; cut at every CELL starts of the source."""
    for b in rows:
        out = []
        for doc, th, own in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            last = None
            for r in sorted(own, key=lambda r: r["at"]):
                source = (r["of"]["id"], r["of"]["th"])
                if last and last[2:4] == source and last[0] + last[1] == r["at"] and last[4] + last[1] == r["of"]["at"]:
                    last[1] += r["n"]
                else:
                    last = [r["at"], r["n"], *source, r["of"]["at"]]
                    out.append((doc, th, last))
        cut = []
        for doc, th, (at, n, of_id, of_th, of_at) in out:
            edge = [of_at, *range((of_at // CELL + 1) * CELL, of_at + n, CELL), of_at + n]
            cut += [(doc, th, at + x - of_at, z - x, of_id, of_th, x) for x, z in zip(edge[:-1], edge[1:], strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        columns = list(zip(*cut, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "th", "at", "n", "of_id", "of_th", "of_at"])


def _passages(window: int):
    """The words of the asked stretches of a document."""
    schema = pa.schema([("of_id", pa.int64()), ("of_th", pa.int64()), ("of_at", pa.int32()), ("n", pa.int32()), ("passage", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows, 2):
            for doc, th, text, asked in zip(*(b.column(k) for k in range(4)), strict=True):
                words = text.as_py().encode().split()
                doc, th, asked = doc.as_py(), th.as_py(), asked.as_py()
                for k in range(0, len(asked), BATCH_ROWS):
                    own = asked[k : k + BATCH_ROWS]
                    found = [b" ".join(words[r["of_at"] : r["of_at"] + r["n"] + window - 1]).decode() for r in own]
                    m = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * m, pa.int64()), pa.array([th] * m, pa.int64()), pa.array([r["of_at"] for r in own], pa.int32()), pa.array([r["n"] for r in own], pa.int32()), pa.array(found, pa.string())], schema=schema)

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OUT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"


def _cut(window: int):
    """Words in the union of the repeated windows go, where they are those of the source; what stays is joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", SPANS), ("kept", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows):
            out = []
            for doc, text, found in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in found or []:
                    a, z = r["at"], r["at"] + r["n"] + window - 1
                    if b" ".join(words[a:z]) == r["passage"].encode():
                        edge[a] += 1
                        edge[z] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                ends = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
                kept = b" ".join(words[k] for k in np.flatnonzero(~gone).tolist()) if ends else b" ".join(words)
                out.append({"doc_id": doc, "n_words": len(words), "spans": [{"start": x, "end": y} for x, y in zip(ends[::2], ends[1::2], strict=True)], "kept": kept.decode()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def repeats_of(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Repeated stretches and where they stand first. texts: id, th (a hash of the text), text; result: STRETCHES."""
    every = written(texts.mapInArrow(_regions(window), REGIONS), "regions")
    shared = written(every.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last").select("key"), "shared-phrases")
    own = written(every.join(shared.hint("merge"), "key", "left_semi"), "shared-regions")
    discard(every, shared)
    first = F.min(F.struct("id", "th", "at")).alias("of")
    alike = written(own.groupBy("key", "one", "two").agg(first), "distinct-regions")
    differing = alike.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    placed = own.join(alike.hint("merge"), ["key", "one", "two"])
    copies = written(placed.where("id > of.id").select("id", "th", "at", "n", "of"), "repeated-regions")
    # Rows that repeat each other ask once.
    unlike = placed.where("id = of.id").select("id", "th", "at", "n", "key").join(differing.hint("merge"), "key", "left_semi").select("id", "th", "at", "n").distinct()
    by_doc = unlike.groupBy("id", "th").agg(F.collect_list(F.struct("at", "n")).alias("own"))
    windows = written(texts.join(by_doc.hint("merge"), ["id", "th"]).select("id", "th", "text", "own").mapInArrow(_windows(window), WINDOWS), "windows")
    discard(own, alike)
    held = windows.groupBy("one", "two").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last").select("one", "two")
    held = written(held, "held-windows")
    twice = written(windows.join(held.hint("merge"), ["one", "two"], "left_semi"), "shared-windows")
    # Written, so that the join has a plain exchange on either side, and a window that many documents hold can be split.
    least = written(twice.groupBy("one", "two").agg(first), "first-windows")
    again = twice.join(least.hint("merge"), ["one", "two"]).where("id > of.id").select("id", "th", "at", F.lit(1).alias("n"), "of")
    found = copies.union(again).distinct().groupBy("id", "th").agg(F.collect_list(F.struct("at", "n", "of")).alias("own"))
    out = written(found.mapInArrow(_stretches, STRETCHES), "stretches")
    discard(windows, held, twice, least, copies)
    return out


def cut_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, spans (removed runs, in words), kept (the other words, joined by one space)."""
    prepare(docs.sparkSession)
    plain = texts_of(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")
    texts = plain.where(F.octet_length("text") >= 2 * window - 1).select("id", "th", "text")
    repeats = repeats_of(texts, window)
    # Of a source's stretches each is asked for once; that there are cells bounds how many a source can have.
    asked = repeats.select("of_id", "of_th", "of_at", "n").distinct().groupBy("of_id", "of_th").agg(F.collect_list(F.struct("of_at", "n")).alias("asked"))
    source = texts.select(F.col("id").alias("of_id"), F.col("th").alias("of_th"), "text").join(asked.hint("merge"), ["of_id", "of_th"]).select("of_id", "of_th", "text", "asked")
    passages = source.mapInArrow(_passages(window), "of_id long, of_th long, of_at int, n int, passage string")
    passages = written(passages.groupBy("of_id", "of_th", "of_at", "n").agg(F.max("passage").alias("passage")), "passages")
    placed = repeats.join(passages.hint("merge"), ["of_id", "of_th", "of_at", "n"]).select("id", "th", F.struct("at", "n", "passage").alias("r"))
    found = placed.groupBy("id", "th").agg(F.collect_list("r").alias("found"))
    return plain.join(found.hint("merge"), ["id", "th"], "left").select("doc_id", "text", "found").mapInArrow(_cut(window), OUT)


def report(cut: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), (removed > 0).alias("has_repeats"), F.col("spans").alias("removed_spans"))


#: The same rows in DuckDB, from windows as strings.
ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select doc_id, words, unnest(generate_series(1, len(words) - 49)) as k from w where len(words) >= 50),
x as (select doc_id, k, array_to_string(list_slice(words, k, k + 49), ' ') as own from s),
hit as (select doc_id, k from (select doc_id, k, min(doc_id) over (partition by own) as least from x) where doc_id > least),
gone as (select distinct doc_id, unnest(generate_series(k, k + 49)) as k from hit),
every as (select doc_id, list_extract(words, k) as word, k from (select doc_id, words, unnest(generate_series(1, len(words))) as k from w)),
kept as (select e.doc_id, string_agg(e.word, ' ' order by e.k) as text from every e anti join gone g on e.doc_id = g.doc_id and e.k = g.k group by e.doc_id),
lost as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(lost.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id) left join lost using (doc_id)
"""
