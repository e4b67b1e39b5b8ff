"""Text scalars: the legal text normaliser, snippets, string keys of evaluation."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# What is written out, and what it becomes.
REPLACEMENTS = {
    "ﬁ": "fi",
    "ﬂ": "fl",
    "æ": "ae",
    "Æ": "AE",
    "œ": "oe",
    "Œ": "OE",
    "ﬀ": "ff",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
    "“": '"',
    "”": '"',
    "‘": "'",
    "’": "'",
    "—": "-",
    "–": "-",
}


def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Canonical composition. Only texts beyond ASCII go to Python."""
    ship(SparkSession.active())
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.arrow_udf(_nfc, "string")(c)).otherwise(c)


def normalize_text(c: Column, compose: bool = True) -> Column:
    """Composed, ligatures and quotes written out, control characters gone, words joined over line breaks, blanks collapsed."""
    out = nfc(c) if compose else c
    for old, new in REPLACEMENTS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"[\p{C}&&[^\n\t]]", "")
    out = F.regexp_replace(out, r"(?U)(\b[a-zA-Z]{2,})-\s*\n\s*([a-zA-Z]{2,}\b)", "$1$2")
    out = F.regexp_replace(out, r"[\x{2028}\x{2029}]", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"(?mU)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.coalesce(F.regexp_replace(out, r"(?U)^\s+|\s+$", ""), F.lit(""))


def snippet(text: Column, start: Column, end: Column, around: int) -> Column:
    """The span with some characters on either side, on one line."""
    first = F.greatest(start - around, F.lit(0))
    return F.trim(F.replace(F.substring(text, first + 1, F.least(F.length(text), end + around) - first), F.lit("\n"), F.lit(" ")))


def page_text(raw: Column, normalized: Column) -> Column:
    """The raw text, or the normalised one where there is none."""
    return F.coalesce(F.when(raw != "", raw), normalized)


def key(c: Column) -> Column:
    """What evaluation compares: trimmed, lower case, underscores and hyphens as blanks."""
    return F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "_-", "  ")


def overlaps(a: Column, b: Column) -> Column:
    """Whether either string holds the other; an empty one is held by all."""
    return F.contains(a, b) | F.contains(b, a)
