"""Operator 11 against brute force over all pairs of words."""
import re
import zlib
from collections import Counter

import numpy as np

from webloom.llm import queries, variants

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_groups(n):
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    out = {}
    for w in n:
        close = [v for k in (-1, 0, 1) for v in by.get(len(w) + k, []) if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 5 * n[w] else None, len(close)]
    rows = set()
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        form = out[w][0]
        rows.add((w, form, root, n[w], out[w][1], n[form] if form else None))
    return rows


def collected(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_variants_brute(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_groups(brute_words(rows))
    assert sum(r[1] is not None for r in want) >= 1
    assert collected(queries.op11_spelling_variants(spark, SF)) == want


def test_near_words_of_all_lengths(spark):
    """Families with edits at every place, doubled letters, chains, ties, long words."""
    rng = np.random.default_rng(3)
    n = {}
    for size in (6, 7, 8, 9, 15, 16, 17, 18, 33, 70):
        base = "".join(rng.choice(list("abé"), size))
        family = {base} | {base[:i] + base[i + 1:] for i in range(size)} | {base[:i] + "z" + base[i + 1:] for i in range(size)} | \
            {base[:i] + c + base[i:] for i in range(size + 1) for c in "zb"} | {base[:2] + "yy" + base[2:]}
        n |= {w: int(rng.choice([5, 6, 25, 30, 150, 700, 4000])) for w in family if len(w) >= 6}
    n |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 700, "baaaaaaaa": 700, "aaaaaaaaaa": 3500, "lonely": 9}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert collected(variants.group(df)) == brute_groups(n)
    assert collected(variants.group(df.limit(0))) == set()


def test_chains_of_forms(spark):
    """Chains longer than one doubling."""
    words = ["x" * k for k in range(6, 30)]
    df = spark.createDataFrame([(w, 5 ** (i + 1)) for i, w in enumerate(words)], "word string, n long")
    assert {r.root for r in variants.group(df).collect()} == {words[-1]}


def test_words_odd(spark):
    text = "Straße straße STRASSE× naïveté abcdef9abcdefg " * 30
    rows = [(1, None), (2, ""), (3, " 12 "), (4, text), (4, text), (None, text), (None, None), (5, "a" * 50_000), (6, ("Wörterbuch " * 300))]
    rows += [(i, "wonderful Wonderful weather") for i in range(10, 700)]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in variants.count_words(df, edit=variants.drop_letter).collect()}
    assert got == brute_words(rows) and len([w for w in got if near(w, "wonderful")]) >= 0
    plain = {r.word: r.n for r in variants.count_words(df).collect()}
    assert plain["wonderful"] == 1380 and plain["straße"] == 180
    assert variants.count_words(df.limit(0)).count() == 0


def test_no_table_of_words_goes_to_the_driver(spark, monkeypatch):
    """A table that is small as stored grows with its keys: no join broadcasts it."""
    plans, whole = [], variants.stage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(variants, "stage", lambda df, tag: plans.append(plan(df)) or whole(df, tag))
    df = spark.createDataFrame([("wonderful", 500), ("wonderfull", 50), ("wonderfulll", 5)], "word string, n long")
    got = variants.group(df)
    plans.append(plan(got))
    assert {(r.word, r.root) for r in got.collect()} == {(w, "wonderful") for w in ("wonderful", "wonderfull", "wonderfulll")}
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5 and not [p for p in plans if "Broadcast" in p]
