"""A 64-bit fingerprint of text for near-duplicate records: the majority, bit by bit, of the MD5 heads of its words."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Heads of words that a worker remembers; it forgets all at once, which costs time only.
REMEMBERED = 1 << 18
_HEADS: dict[bytes, bytes] = {}


def _head(word: bytes) -> bytes:
    head = _HEADS.get(word)
    if head is None:
        if len(_HEADS) >= REMEMBERED:
            _HEADS.clear()
        head = _HEADS[word] = hashlib.md5(word).digest()[:8]
    return head


def _fingerprint(text: str) -> str:
    counts = Counter(text.encode().split())
    if not counts:
        return "0" * 16
    bits = np.unpackbits(np.frombuffer(b"".join(map(_head, counts)), np.uint8).reshape(-1, 8), axis=1)
    times = np.fromiter(counts.values(), np.float64, len(counts))
    return np.packbits(2 * (times @ bits) > times.sum()).tobytes().hex()


def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(_fingerprint)


def word_fingerprint(text: Column) -> Column:
    """16 hex digits; words are runs of anything but ASCII white space, in lower case; null counts as empty."""
    return F.pandas_udf(_fingerprints, "string")(F.lower(text))
