"""Wildcards against regular expressions, and on patterns that
make a backtracking matcher run for hours."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import crawl as C


def glob(path, pattern):
    escaped = re.sub(r"[.+^${}()|\[\]\\]", lambda m: "\\" + m[0], pattern).replace("*", ".*")
    try:
        return re.fullmatch(escaped, path, re.S) is not None
    except re.error:
        return False


def robots(path, pattern):
    end = pattern.endswith("$")
    body = ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*")))
    return re.match(body + (r"\Z" if end else ""), path, re.S) is not None


def cases():
    rng = random.Random(11)
    for _ in range(3000):
        path = "/" + "".join(rng.choice("ab/.$?") for _ in range(rng.randrange(9)))
        yield path, "".join(rng.choice(["a", "b", "/", ".", "*", "$", "ab", "**"]) for _ in range(rng.randrange(7)))
        yield path, "/" + "".join(rng.choice(["a", "b", "a?", "*", "/", "b?", "*a", "."]) for _ in range(rng.randrange(7)))
    yield from [("", ""), ("", "*"), ("a", ""), ("/a", "*"), ("/é日x", "/é*x"), ("/é日x", "/é日?x"), ("/aXb", "/a*?b"), ("/ab", "/a??b"), ("/b", "/a??b"),
                ("/b", "?b"), ("/a", "/a???"), ("/docs", "/docs$"), ("/docs$", "/docs$")]


def test_globs_like_regular_expressions(spark):
    rows = [(p, g, glob(p, g)) for p, g in cases()]
    df = spark.createDataFrame(rows, "path string, pattern string, want boolean")
    assert {True, False} == {r[2] for r in rows}
    assert df.where(U.glob_match("path", "pattern") != F.col("want")).collect() == []


def test_robots_like_regular_expressions(spark):
    rows = [(p, g, robots(p, g)) for p, g in cases()]
    df = spark.createDataFrame(rows, "path string, pattern string, want boolean")
    assert df.where(C.robots_match(F.col("path"), F.col("pattern")) != F.col("want")).collect() == []


@pytest.mark.parametrize("pattern", ["/" + "*a" * 50 + "*b", "/" + "a?" * 50 + "a" * 50 + "b", "/" + "*a?" * 25 + "*b"])
def test_many_wildcards_on_a_long_path(spark, pattern):
    df = spark.createDataFrame([("/" + "a" * 10_000, pattern), ("/" + "a" * 10_000 + "b", pattern)], "path string, pattern string")
    got = df.select(U.glob_match("path", "pattern").alias("hit"), C.robots_match(F.col("path"), F.col("pattern")).alias("robots"))
    start = time.time()
    hits = [r.hit for r in got.collect()]
    assert time.time() - start < 20
    assert hits == [False, not pattern.startswith("/a?")]


def test_fifty_stars_cost_milliseconds(spark):
    rows = [("/" + "a" * 10_000 + str(i), "/" + "*a" * 50 + "*b") for i in range(400)]
    df = spark.createDataFrame(rows, "path string, pattern string").repartition(1).cache()
    df.count()
    start = time.time()
    assert df.where(U.glob_match("path", "pattern")).count() == 0
    assert (time.time() - start) / len(rows) < 0.02


def test_patterns_that_are_none(spark):
    rows = [("https://e.com/a", [], ["?x"], False), ("https://e.com/a", ["?a", "/a"], [], True), ("https://e.com/a", ["/a???"], [], False)]
    df = spark.createDataFrame(rows, "url string, inc array<string>, exc array<string>, want boolean")
    assert all(r.want == r.got for r in df.select("want", U.allowed_by_patterns("url", "inc", "exc").alias("got")).collect())
