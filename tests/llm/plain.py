"""Plain versions, written apart from the operators."""

import math
import struct
import zlib

import numpy as np
import xxhash
import zstandard

PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def tokens(text):
    out = []
    for w in (text or "").lower().split():
        a, z = 0, len(w)
        while a < z and w[a] in PUNCTUATION:
            a += 1
        while z > a and w[z - 1] in PUNCTUATION:
            z -= 1
        out.append(w[a:z] or w)
    return out


def stretch_matches(match):
    """Matches of the stretch with the largest sum of 1 for a match and -2 for a mismatch; the most of those with that sum."""
    best, most, total, count = 0, 0, 0, 0
    for m in match:
        total, count = total + (1 if m else -2), count + m
        if total <= 0:
            total = count = 0
        elif (total, count) > (best, most):
            best, most = total, count
    return most


def contaminated(text, item, least=16):
    doc, item = tokens(text), tokens(item)
    for shift in range(1 - len(item), len(doc)):
        match = [doc[shift + k] == item[k] for k in range(len(item)) if 0 <= shift + k < len(doc)]
        if not sum(match):
            continue
        if stretch_matches(match) >= least or sum(match) >= (len(item) if len(item) < 8 else -(-3 * len(item) // 4)):
            return True
    return False


def quality_scores(texts, labels):
    """id -> score by the compression classifier, from dictionaries of ids to texts and to labels 0 or 1.

    Labelled ids that aren't held out, in the order of a hash, give two dictionaries by their first two thirds; the rest is fitted by
    reweighted least squares on three features, their squares and products.
    """
    learnt = [i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1 and len((texts[i] or "").encode()) <= 32_768]
    learnt.sort(key=lambda i: (struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0], i))
    cut = lambda t: [t[k : k + 2048] for k in range(0, len(t), 2048)]
    packers, rest = [], []
    for label in (1, 0):
        own = [t for i in learnt if labels[i] == label and (t := (texts[i] or "").encode())][:3000]
        n = -(-2 * len(own) // 3)
        pieces = [p for t in own[:n] for p in cut(t)]
        try:
            data = zstandard.train_dictionary(65_536, pieces, k=512, d=8).as_bytes()
            kind = zstandard.DICT_TYPE_FULLDICT
        except zstandard.ZstdError:
            data, kind = b"".join(pieces)[-65_536:], zstandard.DICT_TYPE_RAWCONTENT
        packers.append(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind), write_checksum=False, write_content_size=False, write_dict_id=False))
        rest += [(t, label) for t in own[n:]]

    def features(t):
        if not t:
            x = (0.0, 0.0, 0.0)
        else:
            good, bad = (sum(len(c.compress(p)) for p in cut(t)) for c in packers)
            x = ((bad - good) / len(t), min(good, bad) / len(t), math.log1p(len(t)))
        return [*x, *(x[i] * x[j] for i in range(3) for j in range(i, 3))]

    raw = np.array([features(t) for t, _ in rest])
    mean, deviation = raw.mean(axis=0), raw.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(raw)), (raw - mean) / deviation])
    y, w = np.array([label for _, label in rest], float), np.zeros(10)
    ridge = np.diag([0.0] + [1.0] * 9)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        v = p * (1 - p)
        w = np.linalg.solve(x.T @ (v[:, None] * x) + ridge, x.T @ (v * (x @ w) + y - p))
    z = {i: w[0] + (np.array(features((t or "").encode())) - mean) / deviation @ w[1:] for i, t in texts.items()}
    return {i: 1 / (1 + math.exp(-min(30.0, max(-30.0, a)))) for i, a in z.items()}
