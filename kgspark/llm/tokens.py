"""Byte-level BPE token counts from a public vocabulary file."""

from __future__ import annotations

import base64
from functools import lru_cache

import tiktoken

# Fixed value: the split pattern that belongs to the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """ranks: the bytes of a vocabulary file (base64 token and rank a line)."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def counts(enc: tiktoken.Encoding, texts: list[str]) -> list[int]:
    """Tokens of each text; strings that look like special tokens are ordinary text."""
    return [len(enc.encode_ordinary(t)) for t in texts]
