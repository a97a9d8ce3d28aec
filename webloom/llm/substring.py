"""Operator 8: repeated passages of words, located by phrase automata.

Every word covered by a window of ``LENGTH`` consecutive words whose
sequence also starts elsewhere (same text included) is removed; windows are
judged on the input. Words are unchanged runs of bytes outside white space.
Null texts count as empty.

Recurring passages are confirmed by the dictionary of ``repeats``: each
distinct phrase of the corpus is taken once, with its number of occurrences,
and windows that recur in several phrases are joined to maximal passages.
A shard holds the phrases of a range of triggers. Its passages are compiled
into one Aho-Corasick automaton, and the shard's phrases, which between
them spell every place of every document that can hold a passage, are
streamed through it to locate all occurrences. What a phrase's occurrences
say then holds wherever the phrase stands in a document. So the automata
are as large as their shard allows, and no document meets more of them than
it has phrases.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .repeats import Scheme, covered, remove_repeats

LENGTH = 35
GRAM = 5


def automaton(passages: set[str]) -> ahocorasick.Automaton:
    """Aho-Corasick automaton of passages, each with its number of words;
    spaces at both ends keep matches on whole words."""
    a = ahocorasick.Automaton()
    for p in passages:
        a.add_word(f" {p} ", p.count(" ") + 1)
    a.make_automaton()
    return a


def locate(bodies: list[bytes], flags: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """Flags of the windows of every body that lie in an occurrence of a
    recurring passage; ``flags`` say which windows recur."""
    parts = [b.decode().split(" ") for b in bodies]
    passages = set()
    for words_, flag in zip(parts, flags):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
        passages.update(" ".join(words_[a: b + length - 1]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
    out = [np.zeros(len(f), bool) for f in flags]
    if not passages:
        return out
    known = automaton(passages)
    for words_, found in zip(parts, out):
        ends = np.cumsum([len(w) + 1 for w in words_])          # of the space after each word
        for stop, n in known.iter(f" {' '.join(words_)} "):
            last = int(np.searchsorted(ends, stop))
            found[last - n + 1: last - length + 2] = True
    return out


def without_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one
    space) of every row."""
    def finish(raw: np.ndarray, starts: np.ndarray):
        all_words = raw.tobytes().split()
        if len(starts):
            gone = covered(starts, len(all_words), length)
            kept = [w for w, g in zip(all_words, gone.tolist()) if not g]
        else:
            kept = all_words
        return len(all_words), len(all_words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return remove_repeats(docs, Scheme(length, min(GRAM, length), True), finish,
                          "n_words long, n_removed long, kept_sha256 string", doc_id, text,
                          lambda bodies, flags: locate(bodies, flags, length))
