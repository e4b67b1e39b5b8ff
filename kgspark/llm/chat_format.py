r"""Chat formatting in budgeted windows.

A turn is written as ``<turn ROLE>TEXT</turn>`` and a line end. Inside role and text a backslash is doubled and a control
string gets one in front, which reading back undoes, so no text can forge a mark.

Turns of a conversation, by turn number, are cut into windows of whole turns by prefix sums of their token counts. Every
window begins with the conversation's system turn (a first turn of that role) and repeats the nearest earlier turns that
fit a limited share of the budget; these repeats are masked. The loss covers texts of assistant turns where they are new:
each is under it once. A turn that exceeds the budget alone has its own window, marked over_budget; turns are never cut.

Token counts are made before the shuffle, evenly spread. A conversation is then read by one task, batch by batch: the ends of
windows and the beginnings of histories are found in the batch's prefix sums by binary search. The task holds the system turn,
the limited history, one window and a batch: a conversation with a third of all rows needs no more memory.

Null role or text: empty. Null conv_id: one conversation of its own. Ties of a turn number, and repeated rows, are all
kept, by (turn, role, text); a null turn comes first. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import batches, file_bytes, prepare, tokenizer_path

BUDGET, HISTORY = 2048, 512

_MARK = re.compile(r"(?=</?turn)")
_ROLE = re.compile(r"((?:[^\\>]|\\.)*)>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _MARK.sub(r"\\", text) if "turn" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends."""
    head = f"<turn {escape(role).replace('>', chr(92) + '>')}>"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith("<turn ", at):
            raise ValueError(f"no turn begins at {at}")
        head = _ROLE.match(formatted, at + 6)
        end = formatted.index("</turn>", head.end())
        while (end - len(formatted[head.end() : end].rstrip("\\")) - head.end()) % 2:  # escaped
            end = formatted.index("</turn>", end + 1)
        yield unescape(head[1]), unescape(formatted[head.end() : end])
        at = end + 8


def _counted(ranks):
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n_tokens", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoding(ranks.value)
        for b in rows:
            n = tokens.counts(enc, [format_turn(r, t)[0] for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(schema.field(i).type) for i in range(4)), pa.array(n, pa.int64())], schema=schema)

    return run


class Windows:
    """The windows of one conversation, cut from prefix sums of its turns' tokens by binary search.

    Turns come in blocks. What a block can't decide, the last window and the history that the next one may repeat, stays.
    """

    def __init__(self, conv_id: int | None, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, min(history, budget)
        self.system: tuple[str, str] | None = None
        self.system_n, self.number = 0, 0
        self.turns: list[tuple[str, str]] = []
        self.sums = np.zeros(1, np.int64)  # of the tokens of turns, from the first that is held
        self.at = 0  # where the next window's new turns begin

    def feed(self, turns: list[tuple[str, str]], n: list[int], last: bool) -> Iterator[dict]:
        """The windows that are sure with these turns; last: no more will come."""
        if self.system is None and not self.number and not self.turns and turns and turns[0][0] == "system":
            self.system, self.system_n = turns[0], n[0]
        self.turns += turns
        self.sums = np.concatenate((self.sums, self.sums[-1] + np.cumsum(np.array(n, np.int64))))
        while self.at < len(self.turns):
            from_, to, total = self._window()
            if to == len(self.turns) and not last:
                break
            yield self._row(from_, to, total)
            self.at = to
            self.number += 1
        keep = self._history(self.at)
        self.turns, self.sums, self.at = self.turns[keep:], self.sums[keep:] - self.sums[keep], self.at - keep

    def _history(self, at: int) -> int:
        """The first of the nearest turns before a place that fit the history; the system turn is repeated apart."""
        first = 1 if self.system and not self.number or self.turns and self.turns[0] is self.system else 0
        return min(at, max(first, int(np.searchsorted(self.sums, self.sums[at] - self.history))))

    def _window(self) -> tuple[int, int, int]:
        """Where the repeated turns begin and the new ones end, and the window's tokens."""
        sums, at = self.sums, self.at
        head = self.system_n if self.number else 0
        room = self.budget - head
        # A turn that is long displaces history; all of it, if it doesn't fit alone.
        own = sums[at + 1] - sums[at]
        from_ = at if own > room else min(at, max(self._history(at), int(np.searchsorted(sums, sums[at + 1] - room))))
        to = max(at + 1, int(np.searchsorted(sums, sums[from_] + room, side="right")) - 1)
        return from_, to, int(head + sums[to] - sums[from_])

    def _row(self, from_: int, to: int, total: int) -> dict:
        repeated = [*([self.system] if self.system and self.number else []), *self.turns[from_ : self.at]]
        parts, spans, place = [], [], 0
        for k, (role, text) in enumerate([*repeated, *self.turns[self.at : to]]):
            turn, a, b = format_turn(role, text)
            if k >= len(repeated) and role == "assistant" and b > a:
                spans.append({"start": place + a, "end": place + b})
            parts.append(turn)
            place += len(turn)
        return {"conv_id": self.conv_id, "window": self.number, "text": "".join(parts), "n_tokens": total, "over_budget": total > self.budget, "n_repeated": len(repeated), "n_new": to - self.at, "loss": spans}


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("n_repeated", pa.int64()), ("n_new", pa.int64()), ("loss", pa.list_(SPAN))])
WINDOW_DDL = "conv_id long, window long, text string, n_tokens long, over_budget boolean, n_repeated long, n_new long, loss array<struct<start:long,end:long>>"


def _windows(budget: int, history: int):
    def windows(rows: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now: Windows | None = None
        for b in rows:
            convs, roles, texts, sizes = (b.column(c).to_pylist() for c in ("conv_id", "role", "text", "n_tokens"))
            edge = [0, *(k for k in range(1, len(convs)) if convs[k] != convs[k - 1]), len(convs)]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                if a == z:
                    continue
                if now is None or now.conv_id != convs[a]:
                    if now is not None:
                        yield from now.feed([], [], True)
                    now = Windows(convs[a], budget, history)
                yield from now.feed(list(zip(roles[a:z], texts[a:z], strict=True)), sizes[a:z], False)
        if now is not None:
            yield from now.feed([], [], True)

    return lambda rows: batches(windows(rows), WINDOW, 200)


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """A row per window: conv_id, window, text, n_tokens, over_budget, n_repeated (turns before the new ones), n_new, loss spans.

    The windows of a conversation are neighbours of one partition, in order.
    """
    spark = conversations.sparkSession
    prepare(spark)
    ranks = spark.sparkContext.broadcast(file_bytes(vocabulary or tokenizer_path(tokens.VOCABULARY)))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", empty("role"), empty("text")).mapInArrow(_counted(ranks), "conv_id long, turn long, role string, text string, n_tokens long")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_windows(budget, history), WINDOW_DDL)


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()), ("n_over_budget", pa.int64())])


def _digests(windows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        conv, now, started = None, None, False
        for b in windows:
            for w in b.to_pylist():
                if not started or w["conv_id"] != conv:
                    if started:
                        yield done(now)
                    conv, started = w["conv_id"], True
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for k, (role, text) in enumerate(read_turns(w["text"])):
                    if k >= w["n_repeated"]:
                        now[1] += 1
                        now[2].update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    text = unescape(w["text"][span["start"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(w["text"])
                now[6] += 1
                now[7] += w["over_budget"]
        if started:
            yield done(now)

    def done(x: list) -> dict:
        return dict(zip(DIGEST.names, [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6], x[7]], strict=True))

    yield from batches(rows(), DIGEST)


def read_back(windows: DataFrame) -> DataFrame:
    """A row per conversation, from format_conversations()'s text alone: counts and digests of turns and of the loss."""
    return windows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, n_over_budget long")
