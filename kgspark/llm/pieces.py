"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The vocabulary is of the BPE kind: neighbouring symbols are merged by the best score, the leftmost first. A sequence of
pieces is a text's encoding exactly if each two neighbours, encoded together, stay these two. So encoding is a path in a
lattice whose steps weigh 0 where the neighbours hold and minus infinity where not, and the path is unique.

Documents of more than `chunk` characters are split there into chunks. A boundary's states are the pieces that could cross
or end at it. A chunk yields a matrix, from the states of its left boundary to those of its right: the max-plus sum over
its paths. Matrices combine associatively, in a tree: products of FAN neighbours, of FAN such products, and so on. Handed
down the same tree, sums from the left and from the right meet in the one state that the whole document has at each
boundary, and given its two states each chunk is traced back on its own. Where a chunk holds a place
that no piece spans (before a space, say), the matrix is an outer product, and only the ends of the chunk need the lattice.

Shorter documents are encoded whole by the library in one task. Decoding joins pieces and bytes; it gives back the text
exactly, but for the character U+2581, which the vocabulary doesn't tell from a space.

Null and empty texts have no tokens. Repeated rows are encoded each. Very long texts are the giants above. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_bytes, prepare, sliced, texts_of, tokenizer_path, written

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 16_384
#: Pairs of pieces whose compatibility a task remembers.
REMEMBERED = 500_000

#: A piece's place in the text, start and end.
State = tuple[int, int]


class Pieces:
    """The vocabulary, and the lattice over a text."""

    def __init__(self, model: bytes) -> None:
        self.library = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = p.get_piece_size()
        self.ids, self.scores, self.raw = {}, {}, []
        self.byte = [0] * 256
        for i in range(size):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, p.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        self.inside = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        # Where any character stands before a space mark, no piece spans the place.
        self.spaced = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.inside)
        self.cut = re.compile(f"(?<=[^{SPACE}]){SPACE}")
        self.known: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text, by merging the best pair, the leftmost first."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def holds(self, left: str, right: str) -> bool:
        """Whether two pieces stay neighbours; left may be empty: whether the right one is its own encoding."""
        if left and left[-1] + right[0] not in self.inside:
            left = ""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return found

    def states(self, text: str, at: int) -> list[State]:
        """Pieces that cross the boundary at `at`, or end there."""
        found = []
        for s in range(max(0, at - self.longest), at):
            for e in range(at, min(len(text), s + self.longest) + 1):
                if (e - s == 1 or text[s:e] in self.ids) and e > s:
                    found.append((s, e))
        return found

    def spans(self, text: str, at: int) -> bool:
        """Whether some piece could span the place before text[at]."""
        return text[at - 1 : at + 1] in self.inside

    def walk(self, text: str, state: State | None, start: int, stop: int) -> dict[int, int]:
        """From a state (or afresh from a place that no piece spans): for each end that a path reaches, where its last
        piece begins. There is one path at most to each end."""
        first = state[1] if state else start
        last: dict[int, int] = {first: state[0] if state else -1}
        for p in range(first + 1, stop + 1):
            for s in range(p - 1, max(first, p - self.longest) - 1, -1):
                before = last.get(s)
                if before is None:
                    continue
                right = text[s:p]
                if p - s > 1 and right not in self.ids:
                    continue
                left = text[before:s] if before >= 0 else ""
                if self.holds(left, right) and (p - s == 1 or left == "" or self.holds("", right)):
                    last[p] = s
                    break
        return last

    @staticmethod
    def trace(last: dict[int, int], first: int, end: int) -> list[State]:
        """The pieces of the path from `first` to `end`."""
        out = []
        while end > first:
            out.append((last[end], end))
            end = last[end]
        return out[::-1]

    def to_ids(self, text: str, spans: list[State]) -> list[int]:
        out: list[int] = []
        for s, e in spans:
            i = self.ids.get(text[s:e])
            if i is None:
                out.extend(self.byte[b] for b in text[s:e].encode())
            else:
                out.append(i)
        return out

    def cuts(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last place in [low, high) that no piece spans and where a space mark follows another character."""
        if not self.spaced:
            return None
        first = self.cut.search(text, max(low, 1), high)
        if first is None:
            return None
        at = high
        while True:  # the last one, from the right
            at = text.rfind(SPACE, first.start(), at)
            if at == first.start() or text[at - 1] != SPACE:
                return first.start(), at

    def matrix(self, text: str, left: int, right: int, ends: bool) -> tuple[list[State], list[State], np.ndarray]:
        """States of the chunk [left, right) of the text on either side, and the sums over its paths: 0 or minus infinity.

        left 0: the text begins there, with no state but the empty one. ends: the text ends at `right`.
        """
        ins = self.states(text, left) if left else [(-1, 0)]
        outs = [s for s in self.states(text, right) if not ends or s[1] == right]
        sums = np.full((len(ins), len(outs)), -np.inf)
        place = {s: k for k, s in enumerate(outs)}
        far = min(len(text), right + self.longest)
        cut = self.cuts(text, left, right)

        def reached(last: dict[int, int]) -> list[int]:
            return [k for (s, e), k in place.items() if last.get(e) == s]

        if cut is None:
            for i, state in enumerate(ins):
                sums[i, reached(self.walk(text, state if state[0] >= 0 else None, 0, far))] = 0
            return ins, outs, sums
        row = np.full(len(outs), -np.inf)
        row[reached(self.walk(text, None, cut[1], far))] = 0
        for i, state in enumerate(ins):
            if cut[0] in self.walk(text, state if state[0] >= 0 else None, 0, cut[0]):
                sums[i] = row
        return ins, outs, sums

    def chunk_ids(self, text: str, state: State | None, out: State) -> list[int]:
        """Ids of the pieces after `state` (None: from the beginning) up to `out`, that included."""
        first = state[1] if state else 0
        if first >= out[1]:
            return []
        cut = self.cuts(text, first, out[0] + 1) if out[0] >= first else None
        if cut is None:
            return self.to_ids(text, self.trace(self.walk(text, state, 0, out[1]), first, out[1]))
        ids = self.to_ids(text, self.trace(self.walk(text, state, 0, cut[0]), first, cut[0]))
        if cut[1] > cut[0]:  # the library puts the first space mark itself
            ids += self.library.encode(text[cut[0] + 1 : cut[1]].replace(SPACE, " "))
        return ids + self.to_ids(text, self.trace(self.walk(text, None, cut[1], out[1]), cut[1], out[1]))

    def decode(self, ids: list[int], first: bool = True) -> str:
        """first: the text begins with these ids, so that a space mark was put before it."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode()
        return text[1:] if first else text


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Pieces:
    return Pieces(model)


def marked(text: str) -> str:
    """The text as the vocabulary sees it."""
    return SPACE + text.replace(" ", SPACE) if text else ""


ROW = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("chunk", pa.int64()), ("n_chunks", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("part", pa.string()), ("sha", pa.binary())])
ROW_DDL = "doc_id long, rid long, chunk long, n_chunks long, left long, right long, part string, sha binary"


def _split(chunk: int, margin: int):
    """Chunks of giant documents, with a margin on either side that holds all pieces that cross its boundaries."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for b in sliced(rows):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                plain = text.as_py()
                sha, whole = hashlib.sha256(plain.encode()).digest(), marked(plain)
                n = -(-len(whole) // chunk)
                for k in range(n):
                    a, z = k * chunk, min(len(whole), (k + 1) * chunk)
                    low = max(0, a - margin)
                    part = whole[low : z + margin]
                    yield pa.RecordBatch.from_pylist([dict(zip(ROW.names, (doc, rid, k, n, a - low, z - low, part, sha), strict=True))], schema=ROW)
                rid += 1

    return run


#: Neighbouring matrices whose product a task forms.
FAN = 64
MATRIX = pa.schema([("rid", pa.int64()), ("pos", pa.int64()), ("ins", pa.list_(pa.int64())), ("outs", pa.list_(pa.int64())), ("sums", pa.list_(pa.float32()))])
MATRIX_DDL = "rid long, pos long, ins array<long>, outs array<long>, sums array<float>"
PLACED = pa.schema([*[MATRIX.field(c) for c in ("rid", "pos", "ins", "outs")], ("left", pa.list_(pa.float64())), ("right", pa.list_(pa.float64())), *[(c, pa.int64()) for c in ("in_s", "in_e", "out_s", "out_e")]])
PLACED_DDL = "rid long, pos long, ins array<long>, outs array<long>, left array<double>, right array<double>, in_s long, in_e long, out_s long, out_e long"


def _matrices(model):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model.value)
        for b in sliced(rows, 6):
            out = []
            for r in b.to_pylist():
                ins, outs, sums = own.matrix(r["part"], r["left"], r["right"], r["chunk"] == r["n_chunks"] - 1)
                # States by their places relative to the boundary: the neighbour names them alike.
                out.append({"rid": r["rid"], "pos": r["chunk"], "ins": [x - r["left"] for s in ins for x in s], "outs": [x - r["right"] for s in outs for x in s], "sums": sums.ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=MATRIX)

    return run


def _pairs(flat: list[int]) -> list[State]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def _members(group: pa.Table) -> list[tuple[dict, np.ndarray]]:
    """A group's matrices in order; a matrix's rows stand in the order of the columns of the one before."""
    out, names = [], None
    for r in sorted(group.to_pylist(), key=lambda r: r["pos"]):
        ins, outs = _pairs(r["ins"]), _pairs(r["outs"])
        m = np.array(r["sums"]).reshape(len(ins), len(outs))
        if names is not None:
            at = {s: i for i, s in enumerate(ins)}
            m, ins = m[[at[s] for s in names]], names
        out.append((r | {"ins": [x for s in ins for x in s]}, m))
        names = outs
    return out


def _product(key: tuple, group: pa.Table) -> pa.Table:
    """The max-plus product of neighbouring matrices."""
    members = _members(group)
    m = members[0][1]
    for _, after in members[1:]:
        m = (m[:, :, None] + after[None, :, :]).max(axis=1)
    first, last = members[0][0], members[-1][0]
    return pa.Table.from_pylist([{"rid": first["rid"], "pos": key[1].as_py(), "ins": first["ins"], "outs": last["outs"], "sums": m.ravel().tolist()}], schema=MATRIX)


def _descend(group: pa.Table, above: pa.Table) -> pa.Table:
    """For each matrix of a group: the best sums of paths from the document's begin to its left boundary's states, and from its
    right boundary's states to the end. above: the same of the whole group; its states are those of the first and the last."""
    members, top = _members(group), above.to_pylist()[0]
    named = dict(zip(_pairs(top["ins"]), top["left"], strict=True))
    left = [np.array([named[s] for s in _pairs(members[0][0]["ins"])])]
    for _, m in members:
        left.append((left[-1][:, None] + m).max(axis=0))
    named = dict(zip(_pairs(top["outs"]), top["right"], strict=True))
    right = [np.array([named[s] for s in _pairs(members[-1][0]["outs"])])]
    for _, m in reversed(members):
        right.append((m + right[-1][None, :]).max(axis=1))
    right = right[::-1]
    out = []
    for k, (r, _) in enumerate(members):
        state = lambda names, at: _pairs(r[names])[int(np.argmax(left[at] + right[at]))]  # noqa: B023, E731
        (in_s, in_e), (out_s, out_e) = state("ins", k), state("outs", k + 1)
        out.append({"rid": r["rid"], "pos": r["pos"], "ins": r["ins"], "outs": r["outs"], "left": left[k].tolist(), "right": right[k + 1].tolist(), "in_s": in_s, "in_e": in_e, "out_s": out_s, "out_e": out_e})
    return pa.Table.from_pylist(out, schema=PLACED)


def _ends(top: DataFrame) -> DataFrame:
    """The vectors of whole documents: nothing before them, nothing after."""
    zeros = lambda c: F.array_repeat(F.lit(0.0), (F.size(c) / 2).cast("int"))
    return top.select("rid", "pos", "ins", "outs", zeros("ins").alias("left"), zeros("outs").alias("right"))


def states(matrices: DataFrame, most: int) -> DataFrame:
    """rid, chunk, in_s, in_e, out_s, out_e: the state of each document at every boundary. most: chunks of a document.

    Products of FAN neighbours, then of FAN such products, until a document is one matrix; then sums are handed down the same
    tree. A task holds FAN matrices, however long a document is."""
    levels = [matrices]
    while most > 1:
        by = (F.col("pos") / FAN).cast("long")
        levels.append(written(levels[-1].groupBy("rid", by.alias("group")).applyInArrow(_product, MATRIX_DDL), "products"))
        most = -(-most // FAN)
    above = _ends(levels[-1])
    if len(levels) == 1:
        levels.append(levels[0])
    for level in reversed(levels[:-1]):
        group = level.groupBy("rid", (F.col("pos") / FAN).cast("long"))
        above = written(group.cogroup(above.groupBy("rid", "pos")).applyInArrow(_descend, PLACED_DDL), "boundaries")
    return above.select("rid", F.col("pos").alias("chunk"), "in_s", "in_e", "out_s", "out_e")


CODE = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int32())), ("sha", pa.binary())])
CODE_DDL = "doc_id long, rid long, chunk long, ids array<int>, sha binary"


def _traced(model):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model.value)
        for b in sliced(rows, 6):
            ids = []
            for r in b.to_pylist():
                state = (r["in_s"] + r["left"], r["in_e"] + r["left"]) if r["chunk"] else None
                ids.append(own.chunk_ids(r["part"], state, (r["out_s"] + r["right"], r["out_e"] + r["right"])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), b.column("chunk"), pa.array(ids, CODE.field("ids").type), b.column("sha")], schema=CODE)

    return run


def _whole(model):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model.value)
        rid = -1 - (TaskContext.get().partitionId() << 40)
        for b in sliced(rows):
            texts = b.column(1).to_pylist()
            ids = own.library.encode(texts, num_threads=1)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(range(rid, rid - n, -1), pa.int64()), pa.array([0] * n, pa.int64()), pa.array(ids, CODE.field("ids").type), pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())], schema=CODE)
            rid -= n

    return run


def _steps(*steps):
    """Several functions on batches as one."""
    return lambda rows: reduce(lambda r, step: step(r), steps, rows)


def _prepared(docs: DataFrame, chunk: int, model_path: str | None, id_col: str, text_col: str) -> tuple:
    """The model on the workers, the shorter documents, and the chunks of the others with their states."""
    spark = docs.sparkSession
    prepare(spark)
    data = file_bytes(model_path or tokenizer_path(MODEL))
    model = spark.sparkContext.broadcast(data)
    plain = texts_of(docs, id_col, text_col)
    giant = F.char_length("text") > chunk
    parts = written(plain.where(giant).mapInArrow(_split(chunk, vocabulary(data).longest + 1), ROW_DDL).repartition("rid", "chunk"), "chunks")
    matrices = written(parts.mapInArrow(_matrices(model), MATRIX_DDL), "matrices")
    most = parts.agg(F.max("n_chunks")).first()[0] or 0
    return model, plain.where(~giant), parts.join(states(matrices, most).hint("merge"), ["rid", "chunk"])


def encode(docs: DataFrame, chunk: int = CHUNK, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid (the row), chunk, ids, sha (of the whole text): a row per document, or per chunk of a giant one."""
    model, short, placed = _prepared(docs, chunk, model_path, id_col, text_col)
    return short.mapInArrow(_whole(model), CODE_DDL).unionByName(placed.mapInArrow(_traced(model), CODE_DDL))


def _flat(lists: pa.Array) -> tuple[np.ndarray, list[int]]:
    """All values of a list column, and where each list begins and the last one ends."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    edge = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[edge[0] : edge[-1]], (edge - edge[0]).tolist()


def _decoded(model):
    schema = pa.schema([*CODE, ("text", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model.value)
        for b in rows:
            flat, edge = _flat(b.column("ids"))
            flat = flat.tolist()
            texts = [own.decode(flat[i:j], chunk == 0) for i, j, chunk in zip(edge, edge[1:], b.column("chunk").to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema=schema)

    return run


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """encode()'s rows with the text of each; a document's text is that of its chunks, joined in their order."""
    spark = encoded.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(file_bytes(model_path or tokenizer_path(MODEL)))
    return encoded.select(*CODE.names).mapInArrow(_decoded(model), f"{CODE_DDL}, text string")


REPORT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_chunks", pa.int64()), ("ids_sha256", pa.string()), ("text_sha256", pa.string()), ("exact", pa.bool_())])
REPORT_DDL = "doc_id long, ids array<int>, n_tokens long, n_chunks long, ids_sha256 string, text_sha256 string, exact boolean"


def _summary(doc: int | None, rows: list[tuple[np.ndarray, str, bytes]]) -> dict:
    ids, text = hashlib.sha256(), hashlib.sha256()
    for i, t, _ in rows:
        ids.update(np.asarray(i, "<i4").tobytes())
        text.update(t.encode())
    return {"doc_id": doc, "ids": np.concatenate([i for i, _, _ in rows]), "n_tokens": sum(len(i) for i, _, _ in rows), "n_chunks": len(rows), "ids_sha256": ids.hexdigest(), "text_sha256": text.hexdigest(), "exact": text.digest() == rows[0][2]}


def _lists(table: pa.Table | pa.RecordBatch) -> list[tuple]:
    flat, edge = _flat(table.column("ids"))
    return list(zip([flat[i:j] for i, j in zip(edge, edge[1:], strict=False)], table.column("text").to_pylist(), table.column("sha").to_pylist(), strict=True))


def _each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        rows = [_summary(d, [x]) for d, x in zip(b.column("doc_id").to_pylist(), _lists(b), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("ids") if f.name == "ids" else pa.array([r[f.name] for r in rows], f.type) for f in REPORT], schema=REPORT)


def _joined(group: pa.Table) -> pa.Table:
    group = group.sort_by("chunk")
    return pa.Table.from_pylist([_summary(group.column("doc_id")[0].as_py(), _lists(group))], schema=REPORT)


def report(docs: DataFrame, chunk: int = CHUNK, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document, encoded and decoded: ids, counts, digests of ids (32-bit, little endian) and of the decoded text, and
    whether that is the text. The steps of a row run one after another in one worker."""
    model, short, placed = _prepared(docs, chunk, model_path, id_col, text_col)
    joined = placed.mapInArrow(_steps(_traced(model), _decoded(model)), f"{CODE_DDL}, text string").groupBy("rid").applyInArrow(_joined, REPORT_DDL)
    return short.mapInArrow(_steps(_whole(model), _decoded(model), _each), REPORT_DDL).union(joined)
