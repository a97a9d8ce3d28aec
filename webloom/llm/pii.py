"""Operator 3: personal numbers and dates as format-preserving pseudonyms.

A value is found by its kind's pattern, validated (check digits, calendar,
numbering plan), mapped to an integer below the number of valid values of
its kind and format, permuted there by a keyed Feistel network, and written
back in its own format. So a pseudonym is again a valid value with the same
separators, equal values get equal pseudonyms in all documents (however
they are written), different values different ones, and the key undoes it.
Where a match fails validation its shorter beginnings are tried, the longest
first, as far as the pattern lets a value end there; then the search goes on
one character later. So a valid value is found next to other digits too
("2024 4111 1111 1111 1111 123"). What no candidate covers stays as it is.
A pseudonym may be valid together with its neighbours: ``restored`` undoes
a text by its spans.

Kinds, by precedence where matches overlap at one start: email (its local
part, character class by character class), iban, card (Luhn), date, ssn,
phone (North American plan, +1 optional), ip (IPv4).

Digits are ASCII digits; those of other scripts stay as they are and end no
value. Null texts stay null and have no spans, empty ones stay empty. Texts
of any length are read whole. Repeated rows and ids are rows of their own
and get equal results; an empty table gives an empty one. Input columns
named n_pii or pii_spans are replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import add_columns

ROUNDS = 10
DEMO_KEY = b"webloom pseudonym key"      # pass your own secret

PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])([A-Za-z0-9][A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}(?!\w)"),
    "date": re.compile(r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?!(?!T[0-9][0-9]:?[0-9][0-9])[\w/-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)"),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w.]*[0-9])"),
}
# where a value may end: the closing look-ahead of its pattern
ENDS = {kind: re.compile(rx.pattern[rx.pattern.index("(?!", 5):]) for kind, rx in PATTERNS.items()}
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


class Feistel:
    """A keyed permutation of 0 .. size-1 for any size: an alternating
    network over Z_a x Z_b with a * b >= size, repeated until the value
    falls below size again (cycle walking)."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.a = isqrt(max(size - 1, 0)) + 1
        self.b = -(-size // self.a)
        self.key = hmac.new(key, f"{tweak}:{size}".encode(), hashlib.sha256).digest()

    def _f(self, i: int, x: int) -> int:
        raw = i.to_bytes(1, "big") + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
        out = hmac.new(self.key, raw, hashlib.sha512).digest()
        while len(out) * 8 < self.size.bit_length() + 64:
            out += hmac.new(self.key, out, hashlib.sha512).digest()
        return int.from_bytes(out, "big")

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * self._f(i, right)) % self.a
            else:
                right = (right + sign * self._f(i, left)) % self.b
        return left * self.b + right

    def permute(self, x: int, back: bool = False) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, account: str) -> str:
    text = account + country + "00"
    return f"{98 - int(''.join(str(int(c, 36)) for c in text)) % 97:02d}"


def _classes(text: str) -> list[str]:
    digit, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [digit if c in digit else lower if c in lower else upper if c in upper else c for c in text]


def _mixed(key: bytes, tweak: str, text: str, back: bool) -> str:
    """Permutes a text among all texts of its character classes."""
    classes = _classes(text)
    x, size = 0, 1
    for c, own in zip(text, classes):
        x, size = x * len(own) + own.index(c), size * len(own)
    x = Feistel(key, tweak + ":" + "".join(k[0] for k in classes), size).permute(x, back)
    out = []
    for own in reversed(classes):
        x, r = divmod(x, len(own))
        out.append(own[r])
    return "".join(reversed(out))


def _into(shape: str, digits: str) -> str:
    """Writes digits and letters over those of ``shape``, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value (or, ``back``, the value of a pseudonym);
    None if it is not valid."""
    bare = re.sub(r"[^A-Za-z0-9]", "", value)
    if kind == "email":
        local, _, host = value.partition("@")
        return _mixed(key, "email", local, back) + "@" + host
    if kind == "iban":
        if not 15 <= len(bare) <= 34 or iban_check(bare[:2], bare[4:]) != bare[2:4]:
            return None
        account = _mixed(key, "iban" + bare[:2], bare[4:], back)
        return _into(value, bare[:2] + iban_check(bare[:2], account) + account)
    if kind == "card":
        if len(set(bare)) == 1 or luhn(bare[:-1]) != int(bare[-1]):
            return None
        body = f"{Feistel(key, 'card', 10 ** (len(bare) - 1)).permute(int(bare[:-1]), back):0{len(bare) - 1}d}"
        return _into(value, body + str(luhn(body)))
    if kind == "date":
        iso = value[4] == "-"
        try:
            day = datetime.date(*((int(value[:4]), int(value[5:7]), int(value[8:])) if iso
                                  else (int(value[6:]), int(value[3:5]), int(value[:2]))))
        except ValueError:
            return None
        if not 0 <= day.toordinal() - FIRST_DAY < DAYS:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + Feistel(key, "date", DAYS).permute(day.toordinal() - FIRST_DAY, back))
        return new.isoformat() if iso else f"{new.day:02d}{value[2]}{new.month:02d}{value[5]}{new.year:04d}"
    if kind == "ssn":
        area, group, serial = int(bare[:3]), int(bare[3:5]), int(bare[5:])
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(Feistel(key, "ssn", 898 * 99 * 9999).permute(x, back), 9999)
        area, group = divmod(x, 99)
        return _into(value, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")
    if kind == "phone":
        lead, ten = bare[:-10], bare[-10:]
        if ten[0] in "01" or ten[3] in "01":
            return None
        x = ((int(ten[:3]) - 200) * 800 + int(ten[3:6]) - 200) * 10000 + int(ten[6:])
        x, line = divmod(Feistel(key, "phone", 800 * 800 * 10000).permute(x, back), 10000)
        area, exchange = divmod(x, 800)
        return _into(value, f"{lead}{area + 200}{exchange + 200}{line:04d}")
    octets = value.split(".")
    if any(int(o) > 255 or str(int(o)) != o for o in octets):
        return None
    x = int.from_bytes(bytes(map(int, octets)), "big")
    return ".".join(map(str, Feistel(key, "ip", 2 ** 32).permute(x, back).to_bytes(4, "big")))


def _found(kind: str, text: str, at: int, key: bytes, back: bool) -> tuple[int, int, str] | None:
    """(start, end, pseudonym) of the first valid value from ``at`` on, the
    longest at its start."""
    rx, ends = PATTERNS[kind], ENDS[kind]
    while m := rx.search(text, at):
        start = m.start()
        for end in range(m.end(), start, -1):
            if end == m.end() or (ends.match(text, end) and rx.fullmatch(text, start, end)):
                new = pseudonym(kind, text[start:end], key, back)
                if new is not None:
                    return start, end, new
        at = start + 1
    return None


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(text with pseudonyms, [(kind, start, end)] in the given text)."""
    if not text or not re.search(r"[0-9@]", text):
        return text, []
    ahead = {kind: _found(kind, text, 0, key, back) for kind in PATTERNS if kind != "email" or "@" in text}
    out, spans, at = [], [], 0
    while ahead := {k: f for k, f in ahead.items() if f}:
        kind = min(ahead, key=lambda k: ahead[k][0])          # of equal starts the first kind
        start, end, new = ahead[kind]
        out += [text[at:start], new]
        spans.append((kind, start, end))
        at = end
        ahead = {k: f if f[0] >= at else _found(k, text, at, key, back) for k, f in ahead.items()}
    return "".join(out) + text[at:], spans


def restored(text: str | None, spans: str, key: bytes) -> str | None:
    """The input of a text with pseudonyms and its ``pii_spans``. Only an IP
    address may differ from its pseudonym in length."""
    out, at, shift = [], 0, 0
    for kind, a, b in (s.split(":") for s in spans.split(",") if s):
        start, end = int(a) + shift, int(b) + shift
        if kind == "ip":
            end = PATTERNS["ip"].search(text, start).end()
        old = pseudonym(kind, text[start:end], key, back=True)
        out += [text[at:start], old]
        at, shift = end, end - int(b)
    return "".join(out) + text[at:] if out else text


def pseudonymised(docs: DataFrame, key: bytes = DEMO_KEY, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Replaces ``text``; adds ``n_pii long`` and ``pii_spans string``
    (kind:start:end in code points of the input, comma-joined). Other
    columns are kept."""
    def fn(col):
        got = [pseudonymise(t, key) for t in col.to_pylist()]
        return [pa.array([g[0] for g in got], pa.string()), pa.array([len(g[1]) for g in got], pa.int64()),
                pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in g[1]) for g in got], pa.string())]

    return add_columns(docs, f"`{text}` string, n_pii long, pii_spans string", fn, text, keep)
