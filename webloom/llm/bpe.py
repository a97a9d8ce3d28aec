"""Operator 9: byte-pair encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be covered by
one token, so a text may be cut there before encoding. Fragments between
cuts are encoded independently (each distinct fragment of a batch once)
and their ids concatenated. A cut must also leave the pre-tokenizer's
pieces unchanged; that holds if the byte on its left is printable ASCII
other than a space (it then never ends a run of white space whose last
character belongs to the next piece) and the byte on its right starts a
character that is no apostrophe (which could open a contraction).

Distinct fragments in Latin script are merged by tiktoken from the same
file's vocabulary when its ids follow its merge order (checked on load);
all others, and those with a special token's text, by tokenizers.

Null texts count as empty: no ids, decoded to the empty text.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import add_columns
from .textvec import text_buffer

# Fixed value: the pre-tokenizer pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MAX_CACHED = 150_000        # distinct fragments kept per Python worker
MAX_CACHED_BYTES = 12 << 20
PIECES = 200_000            # fragments handled at a time


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others are numbered from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder for one byte-level tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        conf = json.loads(spec)
        vocab = dict(conf["model"]["vocab"]) | {t["content"]: t["id"] for t in conf.get("added_tokens", [])}
        chars = byte_alphabet()
        size = max(vocab.values()) + 1
        tokens = [b""] * size
        for t, i in vocab.items():
            tokens[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
        inside = np.zeros(65536, dtype=bool)
        for t in tokens:
            for a, b in zip(t, t[1:]):
                inside[a << 8 | b] = True
        left, right = np.arange(65536) >> 8, np.arange(65536) & 255
        safe = (left > 0x20) & (left < 0x7F) & (right != 0x27) & ((right & 0xC0) != 0x80)
        self.cut = ~inside & safe
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.special = [t["content"].encode() for t in conf.get("added_tokens", [])]
        self.fast = self.ranked(conf, tokens)
        self.reset()

    @staticmethod
    def ranked(conf: dict, tokens: list[bytes]):
        """tiktoken's ``encode_ordinary`` over the same vocabulary, or None
        where ids do not give the merge order or texts are prepared otherwise."""
        pre, vocab, merges = conf.get("pre_tokenizer") or {}, conf["model"]["vocab"], conf["model"]["merges"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or conf.get("normalizer") or made != sorted(made)):
            return None
        import tiktoken
        ranks = {tokens[i]: i for i in vocab.values()}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.lens = np.zeros(0, np.int64)          # ids per known fragment
        self.ids = np.zeros(0, np.uint32)          # of all known fragments

    def learn(self, fresh: list[bytes]) -> None:
        """Encode fragments not met before."""
        if not fresh:
            return
        # lead bytes below 0xCA: code points below U+0280, classed alike by both libraries
        quick = [self.fast is not None and max(f) < 0xCA and not any(t in f for t in self.special) for f in fresh]
        slow = iter(self.tok.encode_batch([f.decode() for f, q in zip(fresh, quick) if not q], add_special_tokens=False))
        got = [self.fast(f.decode()) if q else next(slow).ids for f, q in zip(fresh, quick)]
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.known_bytes += sum(map(len, fresh))
        self.lens = np.concatenate([self.lens, np.fromiter(map(len, got), np.int64, len(got))])
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in got for i in ids), np.uint32)])

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted cut positions of a buffer, text ends included."""
        pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
        inner = np.flatnonzero(self.cut[pair]) + 1
        return np.union1d(inner, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text)."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        at = self.fragments(data, offsets)
        raw = data.tobytes()
        parts, sizes = [], []
        for lo in range(0, len(at) - 1, PIECES):
            ends = at[lo: lo + PIECES + 1].tolist()
            frags = [raw[a:b] for a, b in zip(ends, ends[1:])]
            if len(self.known) > MAX_CACHED or self.known_bytes > MAX_CACHED_BYTES:
                self.reset()
            self.learn(list({f for f in frags if f not in self.known}))
            which = np.fromiter(map(self.known.__getitem__, frags), np.int64, len(frags))
            n = self.lens[which]
            first = (np.cumsum(self.lens) - self.lens)[which]
            sizes.append(n)
            parts.append(self.ids[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)])
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(parts), np.diff(total[np.searchsorted(at, offsets)])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text of one list of ids."""
        if not len(ids):
            return b""
        lens = self.size[ids]
        base = np.cumsum(lens) - lens
        raw = self.flat[np.arange(int(lens.sum())) + np.repeat(self.start[ids] - base, lens)].tobytes()
        return raw.decode("utf-8", "replace").encode()


_CODECS: dict[str, Codec] = {}


def _codec(spec: str) -> Codec:
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def _spec(docs: DataFrame, path: str):
    """The tokenizer file, read once on the driver (a few MB whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids array<int>``, the token ids of each text."""
    spec = _spec(docs, path)

    def fn(col):
        ids, n = _codec(spec.value).encode(*text_buffer(col))
        off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))]

    return add_columns(docs, "ids array<int>", fn, text, keep)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded string``, the text of each list of ids (null: empty)."""
    spec = _spec(encoded, path)

    @F.pandas_udf("string")
    def text_of(col):
        c = _codec(spec.value)
        return col.map(lambda x: c.decode(np.asarray([] if x is None else x, dtype=np.int64)).decode())

    return encoded.withColumn("decoded", text_of(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None,
               ids: bool = False) -> DataFrame:
    """Encodes and decodes every text in one pass. Adds ``n_tokens long``,
    ``ids_sha256`` (ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` (UTF-8 of the decoded text) and on demand ``ids``."""
    with_ids = ids
    spec = _spec(docs, path)

    def fn(col):
        c = _codec(spec.value)
        ids, n = c.encode(*text_buffer(col))
        ends = np.cumsum(n)
        digests, texts = [], []
        for lo, hi in zip((ends - n).tolist(), ends.tolist()):
            own = ids[lo:hi]
            digests.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            texts.append(hashlib.sha256(c.decode(own)).hexdigest())
        out = [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        if with_ids:
            off = np.concatenate([[0], ends]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32))))
        return out

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return add_columns(docs, schema, fn, text, keep)
