"""Suffix-array dedup: repeated byte strings, found by external induced sorting and cut out.

Every string of LENGTH bytes that starts at two places of the corpus is removed wherever it occurs. Texts are UTF-8 bytes;
strings never cross documents, and are judged on the input.

1. Each string has an owner among its own grams of GRAM bytes: the one with the least hash. Equal strings have owners of
   equal hash. Neighbouring starts whose owners have one hash are a run; a stretch that repeats itself after fewer bytes than
   a string has is one run, whatever its length. Runs whose owner occurs once in the corpus can't hold a repeat.
2. The bytes of the other runs, as far as their strings reach, are sent to the shard of the owner's hash. From a long stretch
   that repeats itself whole periods are left out, for all strings of those stand in the rest too. Copies of a region collapse
   to one with a count before the shuffle, so a passage that many documents share is sorted once.
3. An owner with more than CROWD different regions (a line that many documents hold, each in another place) is dealt again:
   its regions fall into runs by owners among longer grams, which reach beyond the line; what is crowded still, by digests of
   whole strings.
4. A task sorts the suffixes of its shard, a bounded number of bytes at once or, where one owner alone has more, on disk: its
   memory is bounded by suffix_sort's, not by the shard. The sort carries common prefixes: a start is repeated if one of
   LENGTH bytes joins it to a neighbour, or its region has copies.
5. Repeated places return to their documents by the region's digest.

Null and empty texts have nothing to remove. Repeated rows are copies of each other. A null id is an id like any other.
Texts shorter than LENGTH bytes stay whole. Very long texts are handled like others: starts are hashed STARTS at once, and
regions leave a task in batches. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_views, discard, prepare, sliced, texts_of, written
from .suffix_sort import Disk, suffixes

LENGTH, GRAM = 400, 100
#: Starts of a document, and bytes of short documents, handled at once; bytes of a shard sorted at once.
STARTS, GROUPED, SORTED = 1 << 20, 1 << 15, 2 << 20
#: Different regions of an owner that one task sorts; stretches of so many strings' length are shortened if they repeat themselves.
CROWD, STRETCH = 500, 4
#: Bytes of regions, and number of results, that leave a task in one batch.
BATCH_BYTES, BATCH_RESULTS = 2 << 20, 4096

_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 2**64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every gram of a byte array: polynomial, from prefix sums, then mixed."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every `width` neighbours, from running minima inside blocks of that width in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _runs_among(data: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of the strings that start at begin, begin + 1, ... begin + count - 1 of a byte array, for each pair of these arrays.

    Number of the pair, starts, sizes, owner hashes, and how many places of the owner each has. Strings of different pairs don't overlap.
    """
    some = np.flatnonzero(count > 0)
    begin, count = begin[some], count[some]
    if not len(some):
        return tuple(np.zeros(0, x) for x in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    h = gram_hashes(data, gram)
    place = np.arange(len(h), dtype=np.uint64)
    least = window_least((h >> np.uint64(24) << np.uint64(24)) | place, length - gram + 1)
    ahead = np.cumsum(count) - count
    at = np.arange(int(count.sum())) + np.repeat(begin - ahead, count)
    owner = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    moved = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    key = h[owner[moved]]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    fresh[np.searchsorted(moved, ahead)] = True  # owners lie inside their strings, so the first of a pair has moved
    first = np.flatnonzero(fresh)
    start = moved[first]
    return some[np.searchsorted(ahead, start, side="right") - 1], at[start], np.diff(start, append=len(at)), key[first], np.diff(first, append=len(moved))


def owned_runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and owner hashes of the runs of a document's strings, and how many places of the owner each has."""
    return owned_runs_of(data, np.array([0, len(data)]), length, gram)[1:]


def owned_runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of documents that lie end to end: number of the document, and what owned_runs says, in order.

    Short documents are handled together, GROUPED bytes at once; a long one by STARTS.
    """
    out: list[tuple[np.ndarray, ...]] = [_runs_among(data, np.zeros(0, np.int64), np.zeros(0, np.int64), length, gram)]
    k, n = 0, len(offsets) - 1
    while k < n:
        z = max(k + 1, int(np.searchsorted(offsets, offsets[k] + min(GROUPED, STARTS), side="right")) - 1)
        low, last = int(offsets[k]), int(offsets[z]) - length + 1
        if z > k + 1:
            which, at, *rest = _runs_among(data[low : offsets[z]], offsets[k:z] - low, np.diff(offsets[k : z + 1]) - length + 1, length, gram)
            out.append((which + k, at - (offsets[k:z] - low)[which], *rest))
        else:
            for a in range(low, max(low, last), STARTS):
                b = min(last, a + STARTS)
                which, at, *rest = _runs_among(data[a : b + length - 1], np.zeros(1, np.int64), np.array([b - a]), length, gram)
                out.append((which + k, at + a - low, *rest))
        k = z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shortened(region: bytes, key: int, length: int, gram: int) -> tuple[bytes, list[dict]]:
    """A region without most periods of its long stretches that repeat themselves, and what is left out: place, bytes.

    A stretch keeps a string and two periods at least, so that every string of the region is still there, and no other.
    """
    if len(region) < STRETCH * length:
        return region, []
    data = np.frombuffer(region, np.uint8)
    at = np.flatnonzero(gram_hashes(data, gram) == np.uint64(key & (2**64 - 1)))
    gaps = np.diff(at)
    if not len(gaps):
        return region, []
    first = np.flatnonzero(np.concatenate(([True], gaps[1:] != gaps[:-1])))
    last = np.append(first[1:], len(gaps))
    parts, cuts, done, gone = [], [], 0, 0
    for i in np.flatnonzero(at[last] - at[first] >= STRETCH * length).tolist():
        a, z, period = int(at[first[i]]), int(at[last[i]]) + gram, int(gaps[first[i]])
        if period > length or not np.array_equal(data[a : z - period], data[a + period : z]):
            continue
        n = (z - a - length - 2 * period) // period * period
        parts.append(region[done : a + period])
        done = a + period + n
        cuts.append({"at": a + period - gone, "gone": n})
        gone += n
    return b"".join([*parts, region[done:]]), cuts


RUN_DDL = "doc_id long, th long, at long, n long, key long, places long"


def _runs(length: int, gram: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "th", "at", "n", "key", "places")])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows, 2):
            which, at, n, key, places = owned_runs_of(*byte_views(b.column(2)), length, gram)
            own = pa.array(which)
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(at), pa.array(n), pa.array(key.view(np.int64)), pa.array(places)], schema=schema)

    return run


CUTS = pa.list_(pa.struct([("at", pa.int64()), ("gone", pa.int64())]))
REGION_DDL = "doc_id long, th long, at long, key long, digest binary, region binary, cuts array<struct<at:long,gone:long>>"


def _regions(length: int, gram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("key", pa.int64()), ("digest", pa.binary()), ("region", pa.binary()), ("cuts", CUTS)])

    def packed(b: pa.RecordBatch, which: list[int], own: list[tuple], parts: list[bytes], cuts: list[list]) -> pa.RecordBatch:
        of = pa.array(which, pa.int64())
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(of), b.column(1).take(of), pa.array([x[0] for x in own], pa.int64()), pa.array([x[2] for x in own], pa.int64()), pa.array([xxhash.xxh128_digest(p) for p in parts], pa.binary()), pa.array(parts, pa.binary()), pa.array(cuts, CUTS)],
            schema=schema,
        )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows, 2):
            data, offsets = byte_views(b.column(2))
            ends, runs = b.column(3).offsets.to_numpy(), b.column(3).flatten()
            runs = list(zip(*(runs.field(c).to_pylist() for c in ("at", "n", "key")), strict=True))
            which, own, parts, cuts, held = [], [], [], [], 0
            for k, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                text = data[a:z].tobytes()
                for x in sorted(set(runs[ends[k] - ends[0] : ends[k + 1] - ends[0]])):
                    part, cut = text[x[0] : x[0] + x[1] + length - 1], []
                    if len(part) >= STRETCH * length:
                        part, cut = shortened(part, x[2], length, gram)
                    which.append(k)
                    own.append(x)
                    parts.append(part)
                    cuts.append(cut)
                    held += len(part)
                    if held >= BATCH_BYTES:
                        yield packed(b, which, own, parts, cuts)
                        which, own, parts, cuts, held = [], [], [], [], 0
            if own:
                yield packed(b, which, own, parts, cuts)

    return run


class Shard:
    """Regions end to end, in memory or on disk."""

    def __init__(self, disk: Disk | None = None) -> None:
        self.disk = disk or Disk()
        self.text, self.sizes, self.counts, self.digests = (self.disk.growing(x) for x in (np.uint8, np.int64, np.int64, np.uint8))

    def add(self, region: bytes, count: int, digest: bytes = b"") -> None:
        # Bytes of UTF-8 stay below 245: 0 and 1 are free for the end and for what stands after a region.
        own = np.empty(len(region) + 1, np.uint8)
        np.add(np.frombuffer(region, np.uint8), np.uint8(2), out=own[:-1])
        own[-1] = 1
        self.text.add(own)
        self.sizes.add(np.array([len(region)]))
        self.counts.add(np.array([count]))
        self.digests.add(np.frombuffer(digest, np.uint8))

    def add_all(self, regions: np.ndarray, sizes: np.ndarray, counts: np.ndarray, digests: np.ndarray) -> None:
        """Several regions, whose bytes and digests lie end to end."""
        own = np.ones(len(regions) + len(sizes), np.uint8)
        inside = np.ones(len(own), np.bool_)
        inside[np.cumsum(sizes + 1) - 1] = False
        own[inside] = regions + np.uint8(2)
        for grown, x in ((self.text, own), (self.sizes, sizes), (self.counts, counts), (self.digests, digests)):
            grown.add(x)

    def _groups(self, begin: np.ndarray) -> Iterator[tuple[int, int]]:
        """Bounds of regions that have a chunk of bytes together, or are single; begin: of each, and the end."""
        k, n = 0, len(begin) - 1
        while k < n:
            z = max(k + 1, min(k + BATCH_RESULTS, int(np.searchsorted(begin, begin[k] + self.disk.chunk, side="right")) - 1))
            yield k, z
            k = z

    def repeated(self, length: int) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each region its digest, and the starts of its own strings that occur more than once, counts included."""
        for begin, digests, repeated in self._marked(length):
            wide = len(digests) // max(1, len(begin) - 1)
            for k in range(len(begin) - 1):
                yield digests[k * wide : (k + 1) * wide].tobytes(), np.flatnonzero(repeated[begin[k] : begin[k + 1]])

    def found(self, length: int) -> Iterator[pa.RecordBatch]:
        """The regions with repeats: digest, and the unions of the strings that are repeated."""
        for begin, digests, repeated in self._marked(length):
            digests = digests.reshape(len(begin) - 1, -1)
            for k, z in self._groups(begin):
                at = np.flatnonzero(repeated[begin[k] : begin[z]]) + begin[k]
                if not len(at):
                    continue
                of = np.searchsorted(begin[k : z + 1], at, side="right") - 1 + k
                first = np.flatnonzero(np.concatenate(([True], (np.diff(at) > length) | (of[1:] != of[:-1]))))
                start, end, of = at[first], at[np.append(first[1:], len(at)) - 1] + length, of[first]
                head = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                own = of[head]
                names = np.ascontiguousarray(digests[own])
                digest = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1) * names.shape[1]).astype(np.int32)), pa.py_buffer(names)])
                spans = pa.StructArray.from_arrays([pa.array(start - begin[of]), pa.array(end - begin[of])], ["start", "end"])
                yield pa.RecordBatch.from_arrays([digest, pa.ListArray.from_arrays(np.append(head, len(of)).astype(np.int32), spans)], ["digest", "spans"])

    def _marked(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Once: where regions begin and the last one ends, their digests, and a mark for each start that is repeated."""
        disk = self.disk
        try:
            self.text.add(np.zeros(1, np.uint8))
            text, sizes, counts, digests = (x.done() for x in (self.text, self.sizes, self.counts, self.digests))
            own, repeated = disk.array(len(text), np.bool_), disk.array(len(text), np.bool_)
            begin = np.concatenate(([0], np.cumsum(sizes + 1)))
            for k, z in self._groups(begin):
                low, high = begin[k], begin[z]
                if z == k + 1:
                    own[low : high - length] = True
                else:
                    edge = np.zeros(high - low, np.int8)
                    edge[begin[k:z] - low] = 1
                    edge[begin[k + 1 : z + 1] - length - low] = -1
                    own[low:high] = np.cumsum(edge, dtype=np.int8)
                repeated[low:high] = own[low:high] & np.repeat(counts[k:z] > 1, sizes[k:z] + 1)
            last, carried = -1, length

            def compare(items: np.ndarray, prefix: np.ndarray) -> None:
                """Own starts that agree with the own start before them: the least prefix in between reaches the length."""
                nonlocal last, carried
                at = np.flatnonzero(own[items])
                if not len(at):
                    carried = min(carried, int(prefix.min()))
                    return
                shared = np.minimum.reduceat(prefix[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
                shared[0] = min(int(shared[0]), carried)
                places = np.concatenate(([last], items[at]))
                hit = np.flatnonzero(shared >= length)
                hit = hit[places[hit] >= 0]
                repeated[places[hit]] = True
                repeated[places[hit + 1]] = True
                last = int(items[at[-1]])
                carried = int(prefix[at[-1] + 1 :].min(initial=length))

            suffixes(text, length, compare, disk)
            yield begin, digests, repeated
        finally:
            disk.close()


def repeated_starts(regions: Iterable[bytes], counts: Iterable[int], length: int, disk: Disk | None = None) -> list[np.ndarray]:
    """For each region, the starts of its own strings that occur more than once among all regions, counts included."""
    shard = Shard(disk)
    for region, count in zip(regions, counts, strict=True):
        shard.add(region, count)
    return [at for _, at in shard.repeated(length)]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


FOUND_DDL = "digest binary, spans array<struct<start:long,end:long>>"


def _sorted(length: int, at_once: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = Shard(), None
        for b in rows:
            key, count = (b.column(c).to_numpy() for c in ("key", "count"))
            (regions, ends), (digests, wide) = byte_views(b.column("region")), byte_views(b.column("digest"))

            def add(a: int, z: int) -> None:
                shard.add_all(regions[ends[a] : ends[z]], np.diff(ends[a : z + 1]), count[a:z], digests[wide[a] : wide[z]])

            a = 0
            for k in np.flatnonzero(np.concatenate((key[:1] != now, key[1:] != key[:-1]))).tolist():
                if shard.text.n + ends[k] - ends[a] + k - a >= at_once:
                    add(a, k)
                    yield from shard.found(length)
                    shard, a = Shard(), k
            add(a, len(key))
            now = key[-1] if len(key) else now
        if shard.text.n:
            yield from shard.found(length)

    return run


AGAIN_DDL = "parent binary, at long, key long, places long, count long, digest binary, region binary"


def _again(length: int, gram: int):
    """Regions dealt again, by owners among longer grams."""
    schema = pa.schema([("parent", pa.binary()), ("at", pa.int64()), ("key", pa.int64()), ("places", pa.int64()), ("count", pa.int64()), ("digest", pa.binary()), ("region", pa.binary())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for digest, region, count in zip(*(b.column(c).to_pylist() for c in ("digest", "region", "count")), strict=True):
                at, n, key, places = owned_runs(np.frombuffer(region, np.uint8), length, gram)
                parts = [region[x : x + y + length - 1] for x, y in zip(at.tolist(), n.tolist(), strict=True)]
                m = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([digest] * m, pa.binary()), pa.array(at), pa.array(key.view(np.int64)), pa.array(places), pa.array([count] * m, pa.int64()), pa.array([xxhash.xxh128_digest(p) for p in parts], pa.binary()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _strings(length: int):
    """Digests of all strings of regions."""
    schema = pa.schema([("parent", pa.binary()), ("at", pa.int64()), ("count", pa.int64()), ("digest", pa.binary())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for digest, region, count in zip(*(b.column(c).to_pylist() for c in ("digest", "region", "count")), strict=True):
                m = len(region) - length + 1
                own = [xxhash.xxh128_digest(region[x : x + length]) for x in range(m)]
                yield pa.RecordBatch.from_arrays([pa.array([digest] * m, pa.binary()), pa.array(range(m), pa.int64()), pa.array([count] * m, pa.int64()), pa.array(own, pa.binary())], schema=schema)

    return run


def united(starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of the spans of each row, touching ones as one: starts, ends, rows. Rows lie end to end, in order."""
    if not len(starts):
        return starts, ends, row
    order = np.argsort(starts, kind="stable")
    starts, row, far = starts[order], row[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate(([True], (starts[1:] > far[:-1]) | (row[1:] != row[:-1]))))
    return starts[first], far[np.append(first[1:], len(starts)) - 1], row[first]


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", SPANS), ("kept", pa.binary())])
    for b in sliced(rows):
        data, offsets = byte_views(b.column(1))
        size, base, found = np.diff(offsets), offsets[:-1], b.column(2)
        row = np.repeat(np.arange(b.num_rows), found.value_lengths().fill_null(0).to_numpy())
        starts, ends, row = united(*(found.flatten().field(c).to_numpy() + base[row] for c in ("start", "end")), row)
        edge = np.concatenate(([0], np.stack([starts, ends], axis=1).ravel(), [len(data)])).tolist()
        gone = np.bincount(row, ends - starts, len(base)).astype(np.int64)
        raw, kept_ends = data.tobytes(), np.concatenate(([0], np.cumsum(size - gone)))
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(kept_ends), pa.py_buffer(b"".join(raw[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True)))])
        listed = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(base))))).astype(np.int32)
        spans = pa.ListArray.from_arrays(listed, pa.StructArray.from_arrays([pa.array(starts - base[row]), pa.array(ends - base[row])], ["start", "end"]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), spans, kept.cast(pa.binary())], schema=schema)


def _alike(regions: DataFrame) -> DataFrame:
    return regions.groupBy("key", "digest", "region").agg(F.sum("count").alias("count"))


def _merge(df: DataFrame) -> DataFrame:
    """One row for each digest."""
    return df.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeats_of(regions: DataFrame, length: int, gram: int, at_once: int, crowd: int) -> DataFrame:
    """digest, spans (in bytes of the region) for regions with repeats. regions: key, digest, region, count."""
    crowded = written(regions.select("key", "digest").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key"), "crowded-owners")
    # One owner in `crowd` regions at most is crowded: Spark broadcasts these where their size allows, and shuffles them where not.
    sort = lambda rows: _alike(rows).repartition("key").sortWithinPartitions("key", "digest").mapInArrow(_sorted(length, at_once), FOUND_DDL)
    if crowded.isEmpty():
        return written(sort(regions), "repeats")
    found = written(sort(regions.join(crowded, "key", "left_anti")), "repeats")
    many, longer = _alike(regions.join(crowded, "key", "left_semi")), gram + length // 4
    if longer < length:
        again = written(many.mapInArrow(_again(length, longer), AGAIN_DDL), "dealt-again")
        shared = again.groupBy("key").agg(F.sum(F.col("count") * F.col("places")).alias("n")).where("n > 1").select("key")
        own = written(again.join(shared.hint("merge"), "key", "left_semi"), "shared-again")
        discard(again)
        inner = repeats_of(own.select("key", "digest", "region", "count"), length, longer, at_once, crowd)
        spans = F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end")))
        back = written(_merge(own.select("parent", "at", "digest").join(inner.hint("merge"), "digest").select(F.col("parent").alias("digest"), spans.alias("spans"))), "repeats")
        discard(own, inner)
    else:
        strings = written(many.mapInArrow(_strings(length), "parent binary, at long, count long, digest binary"), "crowded-strings")
        twice = strings.groupBy("digest").agg(F.sum("count").alias("n")).where("n > 1").select("digest")
        span = F.array(F.struct(F.col("at").alias("start"), (F.col("at") + length).alias("end")))
        back = written(_merge(strings.join(twice.hint("merge"), "digest", "left_semi").select(F.col("parent").alias("digest"), span.alias("spans"))), "repeats")
        discard(strings)
    return found.union(back)


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, at_once: int = SORTED, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, spans (removed runs, in bytes), kept (the other bytes)."""
    spark = docs.sparkSession
    prepare(spark)
    plain = texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    runs = written(plain.where(F.octet_length("text") >= length).mapInArrow(_runs(length, gram), RUN_DDL), "runs")
    # Written, so that the join below has a plain exchange on either side: adaptive execution can then split a frequent owner.
    shared = written(runs.groupBy("key").agg(F.sum("places").alias("n")).where("n > 1").select("key"), "shared-owners")
    by_doc = runs.join(shared.hint("merge"), "key", "left_semi").groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "n", "key")).alias("runs"))
    by_doc = by_doc.select(F.col("doc_id").alias("run_doc"), F.col("th").alias("run_th"), "runs")
    same = lambda a, b: plain["doc_id"].eqNullSafe(F.col(a)) & (plain["th"] == F.col(b))
    regions = written(plain.join(by_doc, same("run_doc", "run_th")).select("doc_id", "th", "text", "runs").mapInArrow(_regions(length, gram), REGION_DDL), "regions")
    discard(runs, shared)
    found = repeats_of(regions.select("key", "digest", "region", F.lit(1).cast("long").alias("count")), length, gram, at_once, crowd)

    def moved(place, after):
        """A place of the region as one of the document."""
        return F.aggregate("cuts", place + F.col("at"), lambda sum_, c: sum_ + F.when(after(c["at"], place), c["gone"]).otherwise(F.lit(0)))

    own = F.transform("spans", lambda s: F.struct(moved(s["start"], lambda c, x: c <= x).alias("start"), moved(s["end"], lambda c, x: c < x).alias("end")))
    placed = regions.select("doc_id", "th", "at", "cuts", "digest").join(found.hint("merge"), "digest").select("doc_id", "th", own.alias("spans"))
    spans = placed.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")).select(F.col("doc_id").alias("span_doc"), F.col("th").alias("span_th"), "spans")
    return plain.join(spans, same("span_doc", "span_th"), "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def report(cut: DataFrame) -> DataFrame:
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (removed > 0).alias("has_repeats"), F.col("spans").alias("removed_spans"))
