"""M8 on long texts: the former full-trace search as the reference for the
edit script, and bounded memory on rewritten texts that share blank lines."""
import random
import tracemalloc

from webloom.operators import diff as D
from webloom.operators import monitor as M


def full_trace(a, b):
    """Shortest edit script with the front of every step kept (small inputs only)."""
    n, m = len(a), len(b)
    v, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(v))
        for k in range(-d, d + 1, 2):
            x = v[k + 1] if k == -d or (k != d and v[k - 1] < v[k + 1]) else v[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            v[k] = x
        if v.get(n - m) == n:
            break
    ops, x, y = [], n, m
    while x or y:
        v, k = trace[d], x - y
        if d == 0:
            pk, px, py = k, 0, 0
        else:
            pk = k + 1 if k == -d or (k != d and v[k - 1] < v[k + 1]) else k - 1
            px, py = v[pk], v[pk] - pk
        while x > px and y > py:
            x, y = x - 1, y - 1
            ops.append((" ", a[x]))
        if d:
            if x == px:
                y -= 1
                ops.append(("+", b[y]))
            else:
                x -= 1
                ops.append(("-", a[x]))
        d -= 1
    return ops[::-1]


def test_same_script_as_the_full_trace():
    rng = random.Random(9)
    for _ in range(600):
        letters = "abcdefghijkl"[: rng.choice([1, 2, 3, 12])]
        a = [rng.choice(letters) for _ in range(rng.randrange(40))]
        b = [rng.choice(letters) for _ in range(rng.randrange(40))]
        if rng.random() < 0.4:
            b = list(a)
            for _ in range(rng.randrange(5)):
                b.insert(rng.randrange(len(b) + 1), rng.choice("xyz"))
        got = D._myers_core(a, b) if a and b else D.myers_ops(a, b)
        assert got == full_trace(a, b)


def rewritten(n, mark):
    return "".join(f"{mark}{i}\n" + ("\n" if i % 3 == 0 else "") for i in range(n))


def test_memory_of_a_rewritten_text():
    old, new = rewritten(4000, "a"), rewritten(4000, "b")
    tracemalloc.start()
    got = D.chunks(old, new)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert D.apply_chunks(old, got) == new and peak < 48e6
    assert sum(k == " " for k, _ in got) >= 4000 // 3


def test_twenty_thousand_rewritten_lines_in_one_task(spark):
    old, new = rewritten(20_000, "a"), rewritten(20_000, "b")
    df = spark.createDataFrame([("m", "u", old, new)], "monitor_id string, url string, old_markdown string, new_markdown string").coalesce(1)
    diff = M.line_diff(df).first().diff
    assert diff.count("a") == diff.count("b") == 20_000
