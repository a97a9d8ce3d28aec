"""Small string scalars shared by several operators."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every named character reference that ends with a semicolon, from the
# standard library's HTML5 table.
NAMED_ENTITIES = {f"&{name}": text for name, text in html5.items() if name.endswith(";")}
# JavaScript String.prototype.trim whitespace (ECMAScript WhiteSpace + LineTerminator).
JS_WS = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf16_length(s) -> Column:
    """Length in UTF-16 code units (JavaScript ``String.length``)."""
    return (F.octet_length(F.encode(_c(s), "UTF-16BE")) / 2).cast("int")


def utf16_prefix(s, n: int) -> Column:
    """First ``n`` UTF-16 code units (``String.slice(0, n)``).

    A surrogate pair cut in half would decode to U+FFFD; like a JS string
    slice it then keeps only whole code points before the cut.
    """
    def body(c):
        dec = F.decode(F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n), "UTF-16BE")
        split_pair = (utf16_length(dec) > n - 1) & dec.endswith("\ufffd") \
            & (F.substring(c, F.length(dec), 1) != F.lit("\ufffd"))
        return F.when(utf16_length(c) <= n, c) \
                .when(split_pair, F.substring(dec, 1, F.length(dec) - 1)).otherwise(dec)
    return F.element_at(F.transform(F.array(_c(s)), body), 1)


def js_trim(s) -> Column:
    return F.regexp_replace(_c(s), f"^{JS_WS}+|{JS_WS}+$", "")


def math_round(x) -> Column:
    """JavaScript Math.round: floor(x + 0.5)."""
    return F.floor(_c(x) + F.lit(0.5))


def decode_entities(s) -> Column:
    """Decode numeric (decimal / hex) and all named entities in one pass over
    the text's pieces; the table is one constant map."""
    c = _c(s)
    table = F.from_json(F.lit(json.dumps(NAMED_ENTITIES)), "map<string,string>")

    def tok(t):
        dec = F.regexp_extract(t, r"^&#([0-9]{1,7});$", 1)
        hx = F.regexp_extract(t, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        cp = F.when(dec != "", dec.try_cast("long")).when(hx != "", F.conv(hx, 16, 10).try_cast("long"))
        ok = cp.isNotNull() & (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
        ch = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
        named = F.coalesce(F.try_element_at(table, t), t)
        return F.when(~F.startswith(t, F.lit("&")), t).when(ok, ch).when(cp.isNotNull(), F.lit("\ufffd")).otherwise(named)

    piece = r"(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]{1,31};|[^&]++|&)"
    toks = F.regexp_extract_all(c, F.lit(piece), 1)
    return F.when(F.instr(c, "&") > 0, F.array_join(F.transform(toks, tok), "")).otherwise(c)
