"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles. Two fingerprints at 3 or fewer
differing bits meet in a variant that both emit: for an even distance each flips one bit; at an odd distance exactly one
of the two has an even number of ones, and that one flips two bits, the other one. Of three differing bits two lie in the
same half of the word, so two flips are emitted within a half only. A variant's low bits name its owner. A fingerprint is
sent once to each owner that any of its variants has; the owner expands the variants there, sorts them, and finds those
that several fingerprints share.

In a shared variant all members within one flip are at 2 or fewer bits from each other, and all others at 3 or fewer from
these: links to one such centre keep every connection without pairs of all members. Links are verified by counting bits,
made distinct, and joined to components by alternating stars, each round written to the shared folder.

An owner whose fingerprints have more than CROWD variants (a family of texts whose low bits agree) is split by more of the
variants' bits, so no task holds many more than that.

Only distinct fingerprints are expanded, so copies, however many, cost nothing. Null and empty texts have fingerprint 0 and
are linked as any other. Fewer words than a shingle has: the whole sequence is one. Repeated rows are in one component. A
null id is never a component's smallest id, unless there is no other: then it is null. Of very long texts RUN shingles are
counted at once. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, prepare, sliced, texts_of, written

SEED, WIDTH = 42, 3
#: Shingles whose bits are counted at once.
RUN = 65_536
#: Distinct fingerprints of an owner's own part of the space.
OWNED = 2000


def shingle_hashes(text: bytes, width: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in runs. text: lower case. Words are what stands between ASCII white space."""
    words = text.split()
    if not words:
        return
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        yield np.array([digest(joined, seed)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    for k in range(0, n, RUN):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + RUN], stops[k : k + RUN], strict=True)], np.uint64)


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Bits that are set in over half the shingles' hashes; 0 for a text without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width, seed):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows):
            texts = pc.ascii_lower(b.column(1)).cast(pa.large_binary())
            fps = np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], schema=schema)

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the unsigned fingerprint's bits as a long)."""
    prepare(docs.sparkSession)
    return texts_of(docs, id_col, text_col).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _masks(bits: list[int]) -> list[int]:
    """Two flips within a half of the word, both among these bits."""
    return [(1 << i) | (1 << j) for i, j in combinations(bits, 2) if (i < 32) == (j < 32)]


def _routes(owner_bits: int):
    """Each fingerprint with every owner that one of its variants has."""
    schema = pa.schema([("owner", pa.int64()), ("fp", pa.int64())])
    low = np.uint64((1 << owner_bits) - 1)
    one = [0] + [1 << i for i in range(owner_bits)]
    two = np.array(one + _masks(list(range(owner_bits))), np.uint64)
    one = np.array(one, np.uint64)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            even = _ones(fps) % 2 == 0
            for own, flips in ((fps[even], two), (fps[~even], one)):
                for k in range(0, len(own), 20_000):
                    part = own[k : k + 20_000]
                    to = ((part & low)[:, None] ^ flips[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], schema=schema)

    return run


def links_of(owner: int, fps: np.ndarray, owner_bits: int) -> np.ndarray:
    """Links (smaller, larger) found in the variants that this owner has. fps: distinct, uint64."""
    outside = list(range(owner_bits, 64))
    single = np.array([1 << i for i in outside], np.uint64)
    double = np.array(_masks(outside), np.uint64)
    low_single = np.array([1 << i for i in outside if i < 32], np.uint64)
    there = (fps & np.uint64((1 << owner_bits) - 1)) ^ np.uint64(owner)
    off, even = _ones(there), _ones(fps) % 2 == 0
    here = fps ^ there  # with the flips that lead to this owner
    number = np.arange(len(fps), dtype=np.int32)
    variants, members, near = [], [], []

    def emit(pick: np.ndarray, flips: np.ndarray, is_near: bool) -> None:
        v = (here[pick][:, None] ^ flips[None, :]).ravel()
        variants.append(v)
        members.append(np.repeat(number[pick], len(flips)))
        near.append(np.full(len(v), is_near))

    none = np.zeros(1, np.uint64)
    emit(off == 0, none, True)
    emit(off == 0, single, True)
    emit((off == 0) & even, double, False)
    emit(off == 1, none, True)
    emit((off == 1) & even, low_single, False)
    emit((off == 2) & even, none, False)
    v, m, close = np.concatenate(variants), np.concatenate(members), np.concatenate(near)
    order = np.argsort(v)
    v = v[order]
    same = v[1:] == v[:-1]
    shared = np.zeros(len(v), bool)
    shared[1:] |= same
    shared[:-1] |= same
    v, m, close = v[shared], m[order[shared]], close[order[shared]]
    if not len(v):
        return np.zeros((0, 2), np.uint64)
    start = np.concatenate(([True], v[1:] != v[:-1]))
    run = np.cumsum(start) - 1
    # fps is sorted: the smallest number within one flip is the centre of its variant
    centre = np.minimum.reduceat(np.where(close, m, np.int32(len(fps))), np.flatnonzero(start))[run]
    use = (centre < len(fps)) & (centre != m)
    pairs = np.unique((np.minimum(centre, m)[use].astype(np.int64) << 32) | np.maximum(centre, m)[use])
    a, b = fps[pairs >> 32], fps[pairs & 0xFFFFFFFF]
    ok = _ones(a ^ b) <= 3
    return np.stack([a[ok], b[ok]], axis=1)


def _meet(owner_bits: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        fps = np.unique(group.column("fp").to_numpy().astype(np.int64).view(np.uint64))
        found = links_of(key[0].as_py(), fps, owner_bits).view(np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return run


#: Variants that one task sorts; bits by which an owner with more is split, and the most that an owner may have.
CROWD, SPLIT, BITS = 6_000_000, 6, 31


def _routes_on(bits: int):
    """The fingerprints of owners of so many bits with the owners of SPLIT bits more that their variants have."""
    schema = pa.schema([("owner", pa.int64()), ("fp", pa.int64())])
    flips = np.arange(1 << SPLIT, dtype=np.uint64)
    flips = flips[_ones(flips) <= 2]
    low, part = np.uint64((1 << bits) - 1), np.uint64((1 << SPLIT) - 1)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            owner, fps = (c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in b.columns)
            left = np.where(_ones(fps) % 2 == 0, 2, 1) - _ones((fps ^ owner) & low)
            for k in range(0, len(fps), 20_000):
                own, fp, rest = owner[k : k + 20_000], fps[k : k + 20_000], left[k : k + 20_000]
                use = _ones(flips)[None, :] <= rest[:, None]
                to = own[:, None] | ((((fp >> np.uint64(bits)) & part)[:, None] ^ flips[None, :]) << np.uint64(bits))
                yield pa.RecordBatch.from_arrays([pa.array(to[use].view(np.int64)), pa.array(np.repeat(fp, use.sum(axis=1)).view(np.int64))], schema=schema)

    return run


def _linked(routed: DataFrame, bits: int) -> DataFrame:
    """Links of routed fingerprints (owner, fp). An owner with more than CROWD variants is split by more bits, as often as it takes."""
    meet = lambda rows: rows.groupBy("owner").applyInArrow(_meet(bits), "a long, b long")
    if bits + SPLIT > BITS:
        return meet(routed)
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("owner")).bitwiseAND(F.lit((1 << bits) - 1)))
    # So many variants has a fingerprint that lies in the owner's own part, a flip away, or two.
    inside, half = 64 - bits, 32 - bits
    weight = F.when(away == 0, 1 + inside + len(_masks(list(range(bits, 64))))).when(away == 1, 1 + half).otherwise(1)
    crowded = written(routed.groupBy("owner").agg(F.sum(weight).alias("n")).where(F.col("n") > CROWD).select("owner"), "crowded-owners")
    if crowded.isEmpty():
        return meet(routed)
    few = routed.join(crowded.hint("merge"), "owner", "left_anti")
    many = written(routed.join(crowded.hint("merge"), "owner", "left_semi").mapInArrow(_routes_on(bits), "owner long, fp long"), "routed")
    return meet(few).union(_linked(many, bits + SPLIT))


def links(distinct: DataFrame, count: int) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp), enough for every connection at 3 or fewer bits."""
    owner_bits = max(6, int(count // OWNED).bit_length())  # below 32 for 2 ** 42 fingerprints
    routed = written(distinct.select("fp").mapInArrow(_routes(owner_bits), "owner long, fp long"), "routed")
    return _linked(routed, owner_bits).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): alternating large and small stars until nothing changes."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written, so that a join has a plain exchange on either side: adaptive execution can then split the edges of
        # a node that has very many.
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star-minima")
        large = both.join(least.hint("merge"), "a").where("b > a and b > m").select(F.col("m").alias("a"), "b").distinct()
        large = written(large, "large-star")
        down = written(large.groupBy("b").agg(F.min("a").alias("m")), "star-minima")
        small = large.join(down.hint("merge"), "b")
        small = small.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(down.select(F.col("m").alias("a"), "b")).distinct()
        edges = written(small, "small-star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = state


def near_groups(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links)."""
    rows = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, distinct.count()))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# --- Similar documents ----------------------------------------------------------------------------------------------
#
# Near copies are found by fingerprints first, as above: texts of one fingerprint and of fingerprints that meet are suggested, and
# verified on the shingles themselves. Texts that are alike to four fifths mostly differ in more than three bits, though, so what is
# still apart is found by prefixes: with shingles in one order for all texts, two texts of that similarity share one of the first n - ceil(0.8 n) + 1 of
# their n distinct shingles. That holds for any order; frequent shingles come last, so that few texts share a prefix's. Every
# pair that shares one, and whose sizes and places leave room for the similarity, is verified on the shingles themselves, or is
# connected already by others that were.

WORDS, SIMILAR = 5, 0.8
#: One of so many texts is counted to tell frequent shingles, and so many of these are known at most: matters of speed only.
SAMPLED, FREQUENT = 8, 200_000
#: Rows of a shingle that are paired at once; more are paired with some of them first, then where these left several groups.
PAIRED = 32
#: Stands for a text without words.
NOTHING = 0x9E3779B97F4A7C15


def shingle_set(text: bytes, width: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([*shingle_hashes(text, width, SEED), np.zeros(0, np.uint64)]))


def prefix(own: np.ndarray, least: float, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a text's distinct shingles: by rank (0: not known as frequent), then by hash. known is sorted."""
    n = len(own)
    if not n:
        return np.array([NOTHING], np.uint64)
    place = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        place = np.where(known[at] == own, rank[at], 0)
    return own[np.argsort(place, kind="stable")][: n - math.ceil(n * least - 1e-9) + 1]


def similarity(a: bytes, b: bytes, width: int = WORDS) -> float:
    """Shared shingles over all, as sets; two texts without words are alike."""
    return _similarity(shingle_set(a, width), shingle_set(b, width))


def _similarity(*own: np.ndarray) -> float:
    shared = len(np.intersect1d(*own, assume_unique=True))
    every = len(own[0]) + len(own[1]) - shared
    return shared / every if every else 1.0


def _shingles(width: int):
    schema = pa.schema([("token", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows, 0):
            for text in pc.ascii_lower(b.column(0)).cast(pa.large_binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), width).view(np.int64))], schema=schema)

    return run


def frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and their ranks from 1, the most frequent last."""
    sample = rows.where(F.pmod("uid", F.lit(SAMPLED)) == 0).select("text")
    counts = sample.mapInArrow(_shingles(width), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - order).astype(np.int64)


def _prefixes(width: int, least: float, packed):
    schema = pa.schema([("token", pa.int64()), ("uid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = packed.value
        for b in sliced(rows):
            first, sizes = [], []
            for text in pc.ascii_lower(b.column(1)).cast(pa.large_binary()):
                own = shingle_set(text.as_py(), width)
                first.append(prefix(own, least, known, rank))
                sizes.append(len(own))
            if not first:
                continue
            held = np.array([len(f) for f in first])
            pos = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
            uids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), held)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(uids, pa.int64()), pa.array(np.repeat(sizes, held).astype(np.int32)), pa.array(pos.astype(np.int32))], schema=schema)

    return run


def _alike(width: int, least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lru_cache(64)(lambda t: shingle_set(t, width))  # a centre's pairs come in a row
        for b in sliced(rows, 2):
            texts = [pc.ascii_lower(b.column(k)).cast(pa.large_binary()).to_pylist() for k in (2, 3)]
            ok = pa.array([_similarity(own(x), own(y)) >= least for x, y in zip(*texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], schema=schema)

    return run


#: Texts of a block, shingles of a block's texts together, and shingles whose bits are compared at once.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 1 << 14


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each set named in `left` has in common with each named in `right`: as bits, a slice of all values at once."""
    values, column = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, len(values), COLUMNS):
        low, high = np.searchsorted(column, (a, a + COLUMNS))
        marks = np.zeros((len(sets), COLUMNS), bool)
        marks[row[low:high], column[low:high] - a] = True
        bits = np.packbits(marks, axis=1).view(np.uint64)
        for k, i in enumerate(left.tolist()):
            out[k] += np.bitwise_count(bits[right] & bits[i]).sum(axis=1, dtype=np.int64)
    return out


def _block_links(least: float):
    """Of the pairs between two blocks of a shingle's rows (or inside one), links that connect what the similar ones connect."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        uids, roots, block = (group.column(c).to_numpy() for c in ("uid", "root", "block"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        left, right = (np.flatnonzero(block == key[k].as_py()) for k in (1, 2))
        size = np.array([len(s) for s in sets])
        shared = shared_counts(sets, left, right)
        every = size[left][:, None] + size[right][None, :] - shared
        ok = (np.where(every > 0, shared / np.maximum(every, 1), 1.0) >= least) & (roots[left][:, None] != roots[right][None, :])
        part, out = np.unique(roots, return_inverse=True)[1], []
        for i, alike in zip(left.tolist(), ok, strict=True):
            near = right[alike]
            for j in near[np.unique(part[near], return_index=True)[1]].tolist():
                if part[i] != part[j]:
                    out.append((uids[i], uids[j]))
                    part[part == part[j]] = part[i]
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.table([pa.array(found.min(axis=1, initial=2**63 - 1)), pa.array(found.max(axis=1, initial=-(2**63)))], schema=schema)

    return run


def _sets(width: int):
    schema = pa.schema([("uid", pa.int64()), ("shingles", pa.binary())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows):
            texts = pc.ascii_lower(b.column(1)).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([shingle_set(t.as_py(), width).tobytes() for t in texts], pa.binary())], schema=schema)

    return run


def row_key(id_col: str, text_col: str) -> F.Column:
    """A row by its id and text: rows with the same of both are one."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def _room(least: float) -> F.Column:
    """Whether two rows x and y of a shingle can be of texts of that similarity: by sizes, and by what follows the shingle if it
    is the first that they share."""
    x, y = F.col("x.n"), F.col("y.n")
    left = F.least(x - F.col("x.pos"), y - F.col("y.pos"))
    return (F.least(x, y) >= F.greatest(x, y) * least - 1e-9) & (left >= (x + y) * (least / (1 + least)) - 1e-9)


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """a, b: pairs of rows (uid, text), enough for every connection that fingerprints of three-word shingles at 3 or fewer bits make:
    each row with the first one of its fingerprint, and the first ones of fingerprints that are linked."""
    own = written(fingerprints(rows, WIDTH, "uid", "text").select(F.col("doc_id").alias("uid"), "fp").distinct(), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("uid").alias("first")), "distinct-fingerprints")
    first = lambda k: distinct.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}")).hint("merge")
    same = own.join(distinct.hint("merge"), "fp").where("uid <> first").select(F.col("uid").alias("a"), F.col("first").alias("b"))
    near = links(distinct, distinct.count()).join(first("a"), "a").join(first("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame, width: int = WORDS, least: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, kept for every row that is in a group of similar texts; rows in none are not listed.

    Links are pairs of that similarity; a group is what they connect. Of a group the smallest id stays (no id: last). First come
    pairs suggested by fingerprints; pairs that these have connected aren't verified again. All pairs of a shingle's rows are
    verified if these are few. Otherwise its rows are verified with four of them, and after that, in
    blocks, all pairs of rows that are still in different groups: copies of one text, however many, are then in one.
    """
    prepare(docs.sparkSession)
    rows = docs.select(row_key(id_col, text_col).alias("uid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    packed = docs.sparkSession.sparkContext.broadcast(frequent(rows, width))
    found = written(rows.select("uid", "text").mapInArrow(_prefixes(width, least, packed), "token long, uid long, n int, pos int"), "prefixes")
    ids = written(rows.select("uid", "doc_id").distinct(), "row-ids")

    # The smallest id is often what the others were copied from; three more, by different orders, stand in where it isn't.
    shared = found.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("uid").alias("a"), F.max("uid").alias("b")).where("a < b").select("token", "rows")
    live = written(found.join(shared.hint("merge"), "token").distinct(), "shared-shingles")
    few, many = live.where(F.col("rows") <= PAIRED), written(live.where(F.col("rows") > PAIRED).join(ids.hint("merge"), "uid"), "crowded-shingles")
    row = F.struct("uid", "n", "pos")
    by = [F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", "uid")), F.min_by(row, "uid"), F.max_by(row, "uid"), F.min_by(row, F.xxhash64("uid"))]
    centres = written(many.groupBy("token").agg(F.array_distinct(F.array(*by)).alias("centres")), "centres").select("token", F.explode("centres").alias("c")).select("token", "c.*")

    def paired(left: DataFrame, right: DataFrame, which: str) -> DataFrame:
        both = left.alias("x").join(right.alias("y").hint("merge"), F.col("x.token") == F.col("y.token")).where(F.expr(which) & _room(least))
        return both.select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "suggested-pairs")
        asked = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
        texts = written(rows.select("uid", "text").join(asked.hint("merge"), "uid", "left_semi").dropDuplicates(["uid"]), "suggested-texts")
        both = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("left")).hint("merge"), "a").join(texts.select(F.col("uid").alias("b"), F.col("text").alias("right")).hint("merge"), "b")
        return written(both.select("a", "b", "left", "right").mapInArrow(_alike(width, least), "a long, b long"), "similar-pairs")

    def crowded(apart: DataFrame) -> DataFrame:
        """Links across the groups of a shingle's many rows: by pairs of blocks, a task for each, so that a row is sent once to
        each block and no pair is a row."""
        size = apart.groupBy("token").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        dealt = apart.join(size.hint("merge"), "token").select("token", "uid", "root", "blocks", F.pmod(F.xxhash64("uid"), "blocks").cast("int").alias("block"))
        sets = written(rows.select("uid", "text").join(apart.select("uid").distinct().hint("merge"), "uid", "left_semi").dropDuplicates(["uid"]).mapInArrow(_sets(width), "uid long, shingles binary"), "crowded-sets")
        met = dealt.select("token", "uid", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        held = met.join(sets.hint("merge"), "uid").select("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "uid", "root", "block", "shingles")
        return written(held.groupBy("token", "x", "y").applyInArrow(_block_links(least), "a long, b long").distinct(), "crowded-links")

    edges = verified(fingerprint_pairs(rows))
    roots = written(components(edges), "fingerprint-roots")
    suggested = paired(few, few, "x.uid < y.uid").union(paired(many, centres, "x.uid <> y.uid")).distinct()
    own = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")).hint("merge")
    open_ones = suggested.join(own("a"), "a", "left").join(own("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    roots = written(components(edges.union(verified(open_ones))), "similar-roots")
    # Where a crowded shingle's rows are in several groups, pairs across them are left to verify.
    placed = many.join(roots.select(F.col("node").alias("uid"), "root").hint("merge"), "uid", "left").select("token", "uid", "n", "pos", F.coalesce("root", "uid").alias("root"))
    split = placed.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("token")
    apart = written(placed.join(split.hint("merge"), "token", "left_semi"), "apart")
    if not apart.isEmpty():
        more = crowded(apart)
        # Groups as they were, joined by the links across them.
        roots = written(components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "similar-roots")
    ids = ids.join(roots.select(F.col("node").alias("uid"), "root"), "uid")
    first = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    return ids.join(first, "root").select("uid", (F.col("uid") == F.col("first.uid")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = WORDS, least: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that stay: of each group of similar texts one, and all that are in none."""
    mine, theirs = free_names(docs, "row", "gone")
    gone = written(similar_groups(docs, width, least, id_col=id_col, text_col=text_col).where("not kept").select(F.col("uid").alias(theirs)).distinct(), "near-copies")
    rows = docs.withColumn(mine, row_key(id_col, text_col))
    return rows.join(gone.hint("merge"), F.col(mine) == F.col(theirs), "left_anti").drop(mine)
