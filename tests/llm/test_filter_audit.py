"""Operator 13 against a brute-force audit that removes row by row."""
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import filter_audit as fa
from webloom.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed(text, i, least):
    w = WORD.findall(text)
    out = {"A"} if len(w) < 200 else set()
    out |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
    out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
    return out | ({"E"} if i is not None and least.get(text, i) < i else set())


def brute(rows, labels):
    """rows: (id, text, lang)."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    docs = [(i, p, failed(t, i, least)) for i, t, p in rows]
    out, shap = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {p for _, p, _ in docs}:
            left = [(i, f) for i, p, f in docs if p == part]
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if k in f]
                every = [(i, f) for i, p, f in docs if p == part and k in f]
                left = [(i, f) for i, f in left if k not in f]
                shap[part, k] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), sum(f == {k} for _, f in every),
                                                   sum(i is not None and i in good for i, _ in gone),
                                                   sum(i is not None and i in toxic for i, _ in gone)]
    return {k: (*v, shap[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    got = [((r.part, r.filter_order, r.step), (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley))
           for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_audit_brute(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert collected(queries.op13_filter_audit(spark, SF)) == brute(docs, labels)


def test_audit_odd(spark):
    many = " ".join(f"w{i}" for i in range(250))
    rows = [(1, None, "en"), (2, "", "en"), (3, "", None), (4, many, "en"), (5, many, ""), (5, many, "de"), (6, many + " A$", "de"),
            (6, "AB " * 300, "de"), (None, many, "en"), (None, None, None), (None, many, "en"), (4, many, "en"), (7, "é" * 40 + "ABC", "fr"),
            (8, " \t\n\x0b", "fr"), (9, "x " * 100_000, "fr"), (10, "\x85 \x1c " + many, "fr"), (0, many, "zz")]
    labels = [(1, 1, 1), (1, 0, 0), (2, None, 1), (4, 1, None), (6, 0, 1), (None, 1, 1), (99, 1, 1), (9, 1, 1)]
    docs = spark.createDataFrame([(*r, 5, "q", 1) for r in rows], "doc_id long, text string, lang string, n_words long, part string, good int")
    lab = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int, failed int")
    assert collected(fa.audit(docs, lab)) == brute(rows, labels)
    assert collected(fa.audit(docs, lab.limit(0))) == brute(rows, [])
    assert fa.audit(docs.limit(0), lab).count() == 0
    got = fa.measure(docs).where("doc_id = 7").first()
    assert (got.n_words, got.n_distinct, got.n_capitals, got.n_points, got.n_symbols, got.part) == (1, 1, 3, 43, 0, "q")


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 20])
def test_transducer_at_any_chunk(chunk):
    rng = np.random.default_rng(chunk)
    texts = ["".join(rng.choice(list("ab A#é日\n 🙂"), rng.integers(0, 40))) for _ in range(60)] + ["", "", "Z"]
    data, offsets = fa.text_buffer(pa.array(texts))
    starts, ends, counts = fa.transduce(data, offsets, chunk)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == [w for t in texts for w in WORD.findall(t)]
    assert counts.tolist() == [[len(re.findall("[A-Z]", t)), len(t), t.count("#")] for t in texts]


def test_table_verifies_bytes():
    """Words of one hash and length are told apart by their bytes."""
    words = ["aa", "bb", "aa", "cc", "bb", "aa"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    starts = np.arange(6) * 2
    got = fa.first_occurrences(data, starts, starts + 2, np.zeros(6, np.int64), np.zeros(6, np.uint64))
    assert got.tolist() == [True, True, False, True, False, False]
    got = fa.first_occurrences(data, starts, starts + 2, np.array([0, 0, 0, 1, 1, 1]), np.zeros(6, np.uint64))
    assert got.tolist() == [True, True, False, True, True, True]
