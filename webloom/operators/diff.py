"""M8 helper: line diff of two texts (called per changed page inside an
Arrow batch).

Lines are tokens that keep their trailing newline. The edit script is the
shortest one (Myers' O(ND) greedy algorithm); within a change, removed
lines come before added lines, consecutive lines of one kind form one
chunk, and each chunk is written once with a single '+' or '-' prefix.
"""

from __future__ import annotations

import re

import numpy as np

_LINE = re.compile(r"[^\n]*\n|[^\n]+$")


def split_lines(text: str) -> list[str]:
    return [t for t in _LINE.findall(text or "") if t]


def myers_ops(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Shortest edit script as [(' '|'-'|'+', token)]."""
    n, m = len(a), len(b)
    # trim common prefix / suffix (cheap and common for monitoring diffs)
    pre = 0
    while pre < n and pre < m and a[pre] == b[pre]:
        pre += 1
    suf = 0
    while suf < n - pre and suf < m - pre and a[n - 1 - suf] == b[m - 1 - suf]:
        suf += 1
    a2, b2 = a[pre:n - suf], b[pre:m - suf]
    ops = [(" ", t) for t in a[:pre]] + _myers_core(a2, b2) + [(" ", t) for t in a[n - suf:]]
    return ops


def _step(x: np.ndarray, d: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Furthest ends of paths with ``d`` edits on the diagonals -d, -d+2, .. d,
    from those (``x``) with d - 1 edits. ``a`` and ``b`` end in values that
    equal nothing."""
    n, m = len(a) - 1, len(b) - 1
    if d == 0:
        x = np.zeros(1, np.int64)
    else:
        out = np.empty(d + 1, np.int64)
        out[1:-1] = np.where(x[:-1] < x[1:], x[1:], x[:-1] + 1)
        out[0], out[-1] = x[0], x[-1] + 1
        x = out
    y = x - np.arange(-d, d + 1, 2)
    run = np.flatnonzero(a[np.minimum(x, n)] == b[np.minimum(y, m)])
    width = 1
    while len(run):             # equal lines ahead: all such diagonals at once, in growing strides
        ahead = np.arange(width)
        same = a[np.minimum(x[run, None] + ahead, n)] == b[np.minimum(y[run, None] + ahead, m)]
        count = np.where(same.all(axis=1), width, same.argmin(axis=1))
        x[run] += count
        y[run] += count
        run = run[count == width]
        width = min(2 * width, 64)
    return x


def _myers_core(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Forward greedy search. Every ``every``-th front is kept, the ones
    between are searched again while the path is read back, so D edits need
    space for about D * sqrt(D) numbers instead of D * D."""
    n, m = len(a), len(b)
    if n == 0:
        return [("+", t) for t in b]
    if m == 0:
        return [("-", t) for t in a]
    codes: dict[str, int] = {}
    ia = np.array([codes.setdefault(t, len(codes)) for t in a] + [-1], np.int64)
    ib = np.array([codes.setdefault(t, len(codes)) for t in b] + [-2], np.int64)
    kept, every, x, d = {}, 16, None, 0
    while True:
        x = _step(x, d, ia, ib)
        if abs(n - m) <= d and (d - n + m) % 2 == 0 and x[(n - m + d) // 2] >= n:
            break
        if d % every == 0:
            kept[d] = x.astype(np.int32)
            if d > 2 * every * every:
                every *= 2
                kept = {k: v for k, v in kept.items() if k % every == 0}
        d += 1
    return _backtrack(kept, ia, ib, a, b, d)


def _backtrack(kept, ia, ib, a, b, d_end):
    x, y = len(a), len(b)
    ops, fronts = [], {}
    for d in range(d_end, 0, -1):
        if d - 1 not in fronts:             # search again from the front kept before it
            at = max(k for k in kept if k <= d - 1)
            fronts = {at: kept[at]}
            for e in range(at + 1, d):
                fronts[e] = _step(fronts[e - 1].astype(np.int64), e, ia, ib).astype(np.int32)
        v, k = fronts[d - 1], x - y          # v[j] lies on diagonal 2 * j - (d - 1)
        j = (k + d) // 2
        if k == -d or (k != d and v[j - 1] < v[j]):
            pk, px = k + 1, int(v[j])
        else:
            pk, px = k - 1, int(v[j - 1])
        py = px - pk
        while x > px and y > py:
            ops.append((" ", a[x - 1]))
            x -= 1
            y -= 1
        if x == px:
            ops.append(("+", b[y - 1]))
            y -= 1
        else:
            ops.append(("-", a[x - 1]))
            x -= 1
    while x > 0 and y > 0:
        ops.append((" ", a[x - 1]))
        x -= 1
        y -= 1
    ops.reverse()
    return ops


def chunks(old: str, new: str) -> list[tuple[str, str]]:
    """[(kind, text)] with removed-before-added inside each change."""
    out: list[tuple[str, str]] = []
    pend_rm, pend_add = [], []

    def flush():
        if pend_rm:
            out.append(("-", "".join(pend_rm)))
        if pend_add:
            out.append(("+", "".join(pend_add)))
        pend_rm.clear()
        pend_add.clear()

    for kind, tok in myers_ops(split_lines(old), split_lines(new)):
        if kind == " ":
            flush()
            out.append((" ", tok))
        elif kind == "-":
            pend_rm.append(tok)
        else:
            pend_add.append(tok)
    flush()
    return out


def render_line_diff(old: str, new: str) -> str:
    """Added/removed chunks only, each with one '+'/'-' prefix, concatenated."""
    return "".join(k + t for k, t in chunks(old, new) if k != " ")


def apply_chunks(old: str, ops: list[tuple[str, str]]) -> str:
    """Rebuild the new text from an edit script (test helper)."""
    return "".join(t for k, t in ops if k != "-")
