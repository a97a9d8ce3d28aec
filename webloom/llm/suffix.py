"""Operator 5: byte repeats by prefix-free parsing.

Every byte covered by a string of ``LENGTH`` bytes that also starts
elsewhere (in the same or another text) is removed; overlaps count, and
strings are judged on the input. See ``repeats`` for the parse into phrases
at rolling-hash triggers, the dictionary and the order of its windows.
Matches never cross texts. Null texts count as empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Scheme, covered, remove_repeats

LENGTH = 200
GRAM = 24


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 of every row."""
    def finish(raw: np.ndarray, starts: np.ndarray):
        if not len(starts):
            return len(raw), 0, 0, hashlib.sha256(raw.tobytes()).hexdigest()
        gone = covered(starts, len(raw), length)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()

    return remove_repeats(docs, Scheme(length, min(GRAM, length), False), finish,
                          "n_bytes long, n_removed long, n_spans long, kept_sha256 string", doc_id, text)
