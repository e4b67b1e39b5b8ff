"""Secret scans through a trigram inverted index.

Each regex yields a Boolean query of trigrams that any match must hold, found by walking its parse tree. The documents of a
block (an Arrow batch) are indexed: a posting bitmap over the block's documents for each trigram that some rule asks for.
Postings are intersected and joined by the queries, and only candidates are searched with the regex. A rule without
mandatory trigrams (a run of hex digits) scans every document. Blocks are independent, so nothing is shuffled, and a lost
executor costs its blocks only.

Null and empty texts have no spans. Repeated rows are scanned each. Very long texts are blocks of their own, searched whole.
An empty table gives no rows. Matches of one rule don't
overlap; those of different rules may. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_views, prepare, sliced, texts_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Characters that the group (0: the whole match) has at least; shorter matches are consumed and dropped.
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # Maximal runs of [0-9a-f], those under 24 dropped: the same as runs of 24 or more.
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
# Public formats of common credentials, beyond the base rules.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: A query: None (no constraint), a trigram, or ("and" | "or", queries).
Query = None | str | tuple

#: Alternatives that are still spelled out, and the size of a character class that is.
MOST_STRINGS, MOST_CLASS = 64, 4


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    return None if any(p is None for p in parts) or not parts else parts[0] if len(parts) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _of_strings(strings: set[str]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items: list) -> set[str] | None:
    """A small class as strings (lower case)."""
    out: set[str] = set()
    for op, arg in items:
        if op is K.LITERAL:
            out.add(chr(arg).lower())
        elif op is K.RANGE and arg[1] - arg[0] < MOST_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(all strings that it matches, or None; the query that holds for its matches)."""
    now: set[str] = {""}
    whole, needs = True, []

    def flush() -> None:
        nonlocal now, whole
        needs.append(_of_strings(now))
        now, whole = {""}, False

    for op, arg in tree:
        more: set[str] | None = None
        need: Query = None
        if op is K.LITERAL:
            more = {chr(arg).lower()}
        elif op is K.IN:
            more = _class(arg)
        elif op is K.SUBPATTERN:
            more, need = _walk(arg[3])
        elif op is K.BRANCH:
            found = [_walk(x) for x in arg[1]]
            more = set().union(*[s for s, _ in found]) if all(s is not None for s, _ in found) else None
            need = _any([q for _, q in found])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, sub = arg
            strings, inner = _walk(sub)
            if (low, high) == (0, 1) and strings is not None:
                more = strings | {""}
            elif low == high and strings is not None and len(strings) ** low <= MOST_STRINGS:
                more = {""}
                for _ in range(low):
                    more = {a + b for a in more for b in strings}
            elif low >= 1:
                need = inner if inner is not None else _of_strings(strings) if strings else None
        elif op is K.AT:
            more = {""}
        if more is not None and len(now) * len(more) <= MOST_STRINGS:
            now = {a + b for a in now for b in more}
        else:
            flush()
            needs.append(need if need is not None or more is None else _of_strings(more))
    if whole:
        return now, _of_strings(now)
    needs.append(_of_strings(now) if now != {""} else None)
    return None, _all(needs)


def trigram_query(pattern: str) -> Query:
    """Trigrams, in lower case, that any text with a match holds; None where there is no such constraint."""
    return _walk(_parser.parse(pattern, re.ASCII))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


class Index:
    """Posting bitmaps of one block."""

    def __init__(self, wanted: list[str]) -> None:
        codes = np.array([[*t.encode("latin-1")] for t in wanted], np.uint32).reshape(-1, 3)
        self.row = {t: i for i, t in enumerate(wanted)}
        self.codes = (codes[:, 0] << 16) | (codes[:, 1] << 8) | codes[:, 2]
        self.order = np.argsort(self.codes)
        self.short = np.zeros(1 << 16, bool)  # a small table first: it stays in the cache
        self.short[self._hash(self.codes)] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        return (codes ^ (codes >> np.uint32(9))) & np.uint32(0xFFFF)

    def build(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which of the block's documents hold each trigram."""
        posts = np.zeros((len(self.codes), len(offsets) - 1), bool)
        if len(data) < 3 or not len(self.codes):
            return posts
        low = self.lower[data].astype(np.uint32)
        codes = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
        at = np.flatnonzero(self.short[self._hash(codes)])
        found = codes[at]
        near = np.minimum(np.searchsorted(self.codes, found, sorter=self.order), len(self.codes) - 1)
        row = self.order[near]
        same = self.codes[row] == found
        at, row = at[same], row[same]
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[doc + 1]
        posts[row[inside], doc[inside]] = True
        return posts

    def ask(self, query: Query, posts: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(posts.shape[1], bool)
        if isinstance(query, str):
            return posts[self.row[query]]
        found = [self.ask(q, posts) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(found)


def rule_spans(rule: Rule, searched: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in searched.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _scan(rules: tuple[Rule, ...], base: frozenset[str]):
    asked = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for q in asked for t in trigrams(q)})
    schema = pa.schema([("doc_id", pa.int64()), ("spans", SPANS)])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, searched = Index(wanted), [r.compiled() for r in rules]
        for block in sliced(blocks):
            column = block.column(1)
            posts = index.build(*byte_views(column))
            texts: list[str] = column.to_pylist()
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, query) in enumerate(zip(rules, asked, strict=True)):
                for d in np.flatnonzero(index.ask(query, posts)):
                    found[d] += [(a, k, b) for a, b in rule_spans(rule, searched[k], texts[d])]
            spans = [[{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].kind in base} for a, k, b in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([block.column(0).cast(pa.int64()), pa.array(spans, SPANS)], schema=schema)

    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end in code points, base) by start, then in the rules' order."""
    prepare(docs.sparkSession)
    return texts_of(docs, id_col, text_col).mapInArrow(_scan(rules, frozenset(r.kind for r in BASE)), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of scan()'s spans."""
    joined = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined("spans").alias("spans"))
