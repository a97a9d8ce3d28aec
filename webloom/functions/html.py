"""Native (JVM-side) page extraction columns: X1, X2, X4, X5.

These run inside whole-stage codegen / interpreted Catalyst and never
leave the JVM. They use regular expressions over the raw document, which
is enough for what the reference extracts natively from a parsed tree:
the stripped document, the ``<title>`` text and the ``a[href]`` values.
The full HTML -> markdown conversion (X3) needs a tree walk and lives in
``webloom.operators.extract``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import decode_entities, js_trim, utf16_length

# Elements the reference removes before extraction.
STRIPPED_TAGS = ("script", "style", "noscript", "iframe", "svg")
THIN_THRESHOLD = 150  # markdown shorter than this (UTF-16 units) is "thin"

# A self-closing svg is an empty element; other elements ignore the slash.
_STRIP_RE = (r"(?is)<!--.*?(?:-->|$)|<svg\b[^>]*/>|<(" + "|".join(STRIPPED_TAGS)
             + r")\b[^>]*>(?:.*?</\1\s*>|.*$)")
_TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
# Possessive runs: matched in a loop, never by recursion, whatever the tag's length.
_A_TAG_RE = r"""(?is)<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
# Attributes in order: the names and values before href are passed over as a whole.
_HREF_RE = (r"""(?is)^<a(?:[\s/]*+(?!href[\s=>/])[^\s=>/"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+"""
            r"""[\s/]*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_nodes(html) -> Column:
    """Drop script/style/noscript/iframe/svg elements (and comments).

    An unclosed raw-text element runs to the end of the document, as in an
    HTML parser. Comments carry no text, links or markdown, so they go too.
    """
    return F.regexp_replace(_c(html), _STRIP_RE, "")


def page_title(html, stripped: bool = False) -> Column:
    """Text of all <title> elements, entity-decoded and trimmed; '' if none."""
    s = _c(html) if stripped else strip_nodes(html)
    raw = F.array_join(F.regexp_extract_all(s, F.lit(_TITLE_RE), 1), "")
    return F.coalesce(js_trim(decode_entities(raw)), F.lit(""))


def page_links(html, stripped: bool = False) -> Column:
    """Every a[href] value in document order, raw (entity-decoded
    attribute), non-empty, not deduplicated, whole document."""
    s = _c(html) if stripped else strip_nodes(html)
    tags = F.regexp_extract_all(s, F.lit(_A_TAG_RE), 0)

    def href(t):
        v = F.regexp_extract(t, _HREF_RE, 1)
        unq = F.regexp_replace(v, r"""^["']|["']$""", "")
        return F.when(v == "", F.lit(None).cast("string")).otherwise(decode_entities(unq))

    return F.filter(F.transform(tags, href), lambda x: x.isNotNull() & (x != ""))


def is_thin(markdown) -> Column:
    """Markdown shorter than 150 UTF-16 code units."""
    return utf16_length(F.coalesce(_c(markdown), F.lit(""))) < THIN_THRESHOLD
