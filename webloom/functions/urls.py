"""URL scalars as pure Catalyst expressions.

Everything here returns a ``Column`` built only from built-in functions,
so it runs inside the JVM, keeps predicate pushdown and never ships rows
to Python. ``parse_url`` is deliberately not used: it throws on spaces,
keeps host case and does not percent-encode non-ASCII paths, all of which
the WHATWG parser the reference relies on does differently. We split with
regular expressions instead and re-implement the parts of WHATWG URL
parsing that matter for http(s):

* leading/trailing C0+space trimmed, tab/CR/LF removed;
* scheme lower-cased; only ``http``/``https`` are kept by ``normalize_url``;
* backslash is a path separator; slashes before the authority are ignored;
* host lower-cased, default port (80/443) dropped, leading port zeros
  dropped, port > 65535 or non-digit => invalid;
* dot segments removed, empty path => ``/``;
* space, ``"``, ``<``, ``>``, `````, ``{``, ``}`` and non-ASCII in the path
  are percent-encoded (UTF-8);
* query re-serialised as form data.

Not covered (documented in README): IDNA/punycode of non-ASCII hosts,
IPv4 number canonicalisation, userinfo percent-encoding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (WHATWG URL standard / the reference's helpers).
SPECIAL_SCHEMES = ("http", "https")
DEFAULT_PORTS = {"http": "80", "https": "443"}
# Characters of the WHATWG path percent-encode set that can reach the
# path component (C0 controls are removed or rare), with their escapes.
PATH_ESCAPES = [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"),
                ("`", "%60"), ("{", "%7B"), ("}", "%7D")]
# Forbidden host code points (WHATWG "forbidden domain code point").
FORBIDDEN_HOST_RE = r"[\x00-\x20#%/:<>?@\[\\\]^|]"

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_MEMO: dict = {}


def _memo(fn):
    """Reuse built Columns for identical argument expressions.

    A URL column is a tree of a few thousand nodes and every node is one
    call into the JVM, so building it costs about a second of driver time.
    Columns are immutable and resolve by name, so the same object can be
    used in any number of plans.
    """
    def key(a):
        if a is None or isinstance(a, (str, int, float, bool)):
            return ("v", a)
        return ("c", str(a))

    def wrapper(*args):
        from pyspark import SparkContext
        gw = id(SparkContext._gateway)  # cached Columns are JVM objects of this gateway
        k = (gw, fn.__name__) + tuple(key(a) for a in args)
        col = _MEMO.get(k)
        if col is None:
            col = _MEMO[k] = fn(*args)
        return col
    wrapper.__name__, wrapper.__doc__ = fn.__name__, fn.__doc__
    return wrapper


def _clean(c: Column) -> Column:
    c = F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.regexp_replace(c, r"[\t\n\r]", "")


def _let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it many times inside ``fn``.

    Re-using a Column object in several places copies its whole tree; nested
    re-use grows the plan exponentially. A one-element ``transform`` turns
    the value into a lambda variable that is evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def _split_fragment_query(t: Column) -> Column:
    """struct(pre, q): t without fragment, split at the first '?'."""
    def body(nf):
        has_q = F.instr(nf, "?") > 0
        return F.struct(
            F.when(has_q, F.substring_index(nf, "?", 1)).otherwise(nf).alias("pre"),
            F.when(has_q, F.substring(nf, F.instr(nf, "?") + 1, 1 << 30)).alias("q"))
    return _let(F.regexp_extract(t, r"^([^#]*)", 1), body)


def _authority_and_path(pre: Column) -> Column:
    """struct(auth, path): leading slashes ignored, authority cut at next '/'."""
    return _let(F.regexp_replace(pre, r"^/+", ""), lambda a: F.struct(
        F.regexp_extract(a, r"^([^/]*)", 1).alias("auth"),
        F.regexp_extract(a, r"^[^/]*(.*)$", 1).alias("path")))


def _merge(base_path: Column, rel: Column) -> Column:
    return F.concat(F.regexp_replace(base_path, r"[^/]*$", ""), rel)


def _remove_dot_segments(path: Column) -> Column:
    init = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("trail"))

    def step(acc, seg):
        low = F.lower(seg)
        out = acc["out"]
        popped = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return (F.when(low.isin(".", "%2e"), F.struct(out.alias("out"), F.lit(True).alias("trail")))
                .when(low.isin("..", ".%2e", "%2e.", "%2e%2e"),
                      F.struct(popped.alias("out"), F.lit(True).alias("trail")))
                .otherwise(F.struct(F.concat(out, F.array(seg)).alias("out"),
                                    F.lit(False).alias("trail"))))

    def finish(r):
        trail = F.when(r["trail"] & (F.size(r["out"]) > 0), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lit("/"), F.array_join(r["out"], "/"), trail)

    def body(segs):
        tail = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
        return F.aggregate(tail, init, step, finish)

    return _let(F.split(path, "/", -1), body)


def _encode_path(path: Column) -> Column:
    runs = F.regexp_extract_all(path, F.lit(r"([\x00-\x7F]+|[^\x00-\x7F]+)"), 1)

    def enc(run):
        ascii_run = run
        for ch, esc in PATH_ESCAPES:
            ascii_run = F.replace(ascii_run, F.lit(ch), F.lit(esc))
        return F.when(run.rlike(r"^[\x00-\x7F]"), ascii_run).otherwise(F.url_encode(run))

    return F.array_join(F.transform(runs, enc), "")


def _form_decode(s: Column) -> Column:
    return _let(s, lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" "))))


def _canonical_query(q: Column) -> Column:
    """Form-decode pairs, stable locale-aware sort by key, collapse duplicate
    keys to the last value, form-encode again; '' when there are no pairs."""
    parts = F.filter(F.split(q, "&", -1), lambda x: x != "")

    def to_pair(x, i):
        def body(pos):
            k = F.when(pos > 0, F.substring(x, 1, pos - 1)).otherwise(x)
            v = F.when(pos > 0, F.substring(x, pos + 1, 1 << 30)).otherwise(F.lit(""))
            return F.struct(_form_decode(k).alias("k"), _form_decode(v).alias("v"), i.alias("i"))
        return _let(F.instr(x, "="), body)

    pairs = F.transform(parts, to_pair)

    def cmp(l, r):
        lk, rk = F.collate(l["k"], "UNICODE"), F.collate(r["k"], "UNICODE")
        return (F.when(lk < rk, -1).when(lk > rk, 1)
                .when(l["i"] < r["i"], -1).when(l["i"] > r["i"], 1).otherwise(0))

    ordered = F.array_sort(pairs, cmp)
    empty = F.array().cast("array<struct<k:string,v:string>>")

    def fold(acc, e):
        kv = F.struct(e["k"].alias("k"), e["v"].alias("v"))
        same = (F.size(acc) > 0) & (F.element_at(acc, -1)["k"] == e["k"])
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(kv))) \
                .otherwise(F.concat(acc, F.array(kv)))

    merged = F.aggregate(ordered, empty, fold)
    enc = F.transform(merged, lambda e: F.concat(F.url_encode(e["k"]), F.lit("="), F.url_encode(e["v"])))
    return F.coalesce(F.array_join(enc, "&"), F.lit(""))


def _host_port(auth: Column, scheme: Column) -> Column:
    """struct(userinfo|null, host, port|null, ok) of an authority string."""
    def split(a):
        return F.struct(
            F.when(F.instr(a, "@") > 0, F.regexp_extract(a, r"^(.*)@", 1)).alias("userinfo"),
            F.regexp_extract(a, r"([^@]*)$", 1).alias("hp"))

    def parts(s):
        hp = s["hp"]
        bracket = hp.startswith("[")
        host = F.when(bracket, F.regexp_extract(hp, r"^(\[[^\]]*\])", 1)) \
                .otherwise(F.regexp_extract(hp, r"^([^:]*)", 1))
        port_raw = F.when(bracket, F.regexp_extract(hp, r"^\[[^\]]*\]:?(.*)$", 1)) \
                    .otherwise(F.regexp_extract(hp, r"^[^:]*:?(.*)$", 1))
        return F.struct(s["userinfo"].alias("userinfo"), bracket.alias("bracket"),
                        host.alias("host"), port_raw.alias("port_raw"))

    def finish(s):
        port_raw, host = s["port_raw"], s["host"]
        port_ok = (port_raw == "") | (port_raw.rlike(r"^[0-9]{1,5}$") & (port_raw.try_cast("int") <= 65535))
        port_norm = port_raw.try_cast("int").cast("string")
        default = F.when(scheme == "http", F.lit(DEFAULT_PORTS["http"])) \
                   .when(scheme == "https", F.lit(DEFAULT_PORTS["https"]))
        port = F.when((port_raw == "") | (port_norm == default), F.lit(None).cast("string")) \
                .otherwise(port_norm)
        host_ok = (host != "") & (s["bracket"] | ~host.rlike(FORBIDDEN_HOST_RE))
        return F.struct(s["userinfo"].alias("userinfo"), F.lower(host).alias("host"),
                        port.alias("port"), (port_ok & host_ok).alias("ok"))

    return _let(_let(_let(auth, split), parts), finish)


_NULL_PARTS = ("struct<ok:boolean,scheme:string,userinfo:string,host:string,"
               "port:string,path:string,query:string>")


def _parse_body(h: Column, b: Column) -> Column:
    """h: cleaned href (lambda var); b: parsed base struct or null."""
    def head(s):
        h_, b_ = s["h"], s["b"]
        scheme, rest = s["scheme"], s["rest"]
        special = scheme.isin(*SPECIAL_SCHEMES)
        b_ok = F.coalesce(b_["ok"] & b_["scheme"].isin(*SPECIAL_SCHEMES), F.lit(False))
        sq = _split_fragment_query(rest)

        def absolute(x):
            pre_s = F.regexp_replace(x["pre"], r"\\", "/")
            same_rel = s["has_scheme"] & special & b_ok & (b_["scheme"] == scheme) & ~pre_s.startswith("//")
            return F.struct(pre_s.alias("pre"), x["q"].alias("q"), same_rel.alias("same_rel"))

        def resolve(x):
            relative = (~s["has_scheme"]) | x["same_rel"]
            ref = F.when(x["same_rel"], rest).otherwise(h_)

            def rel_branch(r):
                r_pre = F.regexp_replace(r["pre"], r"\\", "/")
                return _let(F.struct(r_pre.alias("pre"), r["q"].alias("q")), rel_resolve)

            def rel_resolve(r):
                r_pre, r_q = r["pre"], r["q"]
                has_auth = r_pre.startswith("//")
                ap = _authority_and_path(r_pre)

                def with_ap(ap_):
                    hp = _host_port(ap_["auth"], b_["scheme"])

                    def with_hp(hp_):
                        path = (F.when(has_auth, ap_["path"])
                                .when(r_pre.startswith("/"), r_pre)
                                .when(r_pre == "", b_["path"])
                                .otherwise(_merge(b_["path"], r_pre)))
                        query = F.when((r_pre == "") & r_q.isNull(), b_["query"]).otherwise(r_q)
                        return F.struct(
                            (b_ok & F.when(has_auth, hp_["ok"]).otherwise(F.lit(True))).alias("ok"),
                            b_["scheme"].alias("scheme"),
                            F.when(has_auth, hp_["userinfo"]).otherwise(b_["userinfo"]).alias("userinfo"),
                            F.when(has_auth, hp_["host"]).otherwise(b_["host"]).alias("host"),
                            F.when(has_auth, hp_["port"]).otherwise(b_["port"]).alias("port"),
                            path.alias("path"), query.alias("query"))
                    return _let(hp, with_hp)
                return _let(ap, with_ap)

            def abs_branch(_):
                ap = _authority_and_path(x["pre"])

                def with_ap(ap_):
                    hp = _host_port(ap_["auth"], scheme)

                    def with_hp(hp_):
                        return F.struct(
                            F.when(special, hp_["ok"]).otherwise(F.lit(True)).alias("ok"),
                            scheme.alias("scheme"),
                            F.when(special, hp_["userinfo"]).alias("userinfo"),
                            F.when(special, hp_["host"]).otherwise(F.lit("")).alias("host"),
                            F.when(special, hp_["port"]).alias("port"),
                            F.when(special, ap_["path"]).otherwise(rest).alias("path"),
                            x["q"].alias("query"))
                    return _let(hp, with_hp)
                return _let(ap, with_ap)

            rel = _let(_split_fragment_query(ref), rel_branch)
            ab = abs_branch(None)
            return F.when(relative, rel).otherwise(ab)

        return _let(_let(sq, absolute), resolve)

    hs = F.struct(h.alias("h"), b.alias("b"), h.rlike(_SCHEME_RE).alias("has_scheme"),
                  F.lower(F.regexp_extract(h, _SCHEME_RE, 1)).alias("scheme"),
                  F.regexp_extract(h, _SCHEME_RE + r"(.*)$", 2).alias("rest"))

    def tidy(p):
        special_out = p["scheme"].isin(*SPECIAL_SCHEMES)
        raw = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
        path = F.when(special_out, _encode_path(_remove_dot_segments(raw))).otherwise(p["path"])
        ok = F.coalesce(p["ok"] & h.isNotNull(), F.lit(False))
        return F.struct(ok.alias("ok"), p["scheme"].alias("scheme"), p["userinfo"].alias("userinfo"),
                        p["host"].alias("host"), p["port"].alias("port"), path.alias("path"),
                        p["query"].alias("query"))

    return _let(_let(hs, head), tidy)


def _parse_url_parts_full(href, base=None) -> Column:
    """WHATWG-style parse of ``href`` (resolved against ``base`` when given).

    Returns struct(ok, scheme, userinfo, host, port, path, query) where
    query is the raw query (null when absent). ``ok`` is false for any
    input the reference's URL constructor would reject.
    """
    b = _parse_url_parts_full(base) if base is not None else F.lit(None).cast(_NULL_PARTS)
    return _let(F.struct(_clean(_c(href)).alias("h"), b.alias("b")),
                lambda s: _parse_body(s["h"], s["b"]))


def _normalize_url_full(href, base) -> Column:
    """Canonical http(s) URL of ``href`` resolved against ``base``, or NULL.

    Fragment dropped; query sorted by key (locale-aware, stable) with
    duplicate keys collapsed to the last value and re-encoded as form data;
    exactly one trailing '/' stripped unless the path is '/'.
    """
    def build(p):
        path = F.when((F.length(p["path"]) > 1) & p["path"].endswith("/"),
                      F.regexp_replace(p["path"], "/$", "")).otherwise(p["path"])
        query = _let(F.when(p["query"].isNotNull(), _canonical_query(p["query"])).otherwise(F.lit("")),
                     lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
        user = F.when(p["userinfo"].isNotNull() & (p["userinfo"] != ""),
                      F.concat(F.regexp_replace(p["userinfo"], ":$", ""), F.lit("@"))).otherwise(F.lit(""))
        port = F.when(p["port"].isNotNull(), F.concat(F.lit(":"), p["port"])).otherwise(F.lit(""))
        url = F.concat(p["scheme"], F.lit("://"), user, p["host"], port, path, query)
        return F.when(p["ok"] & p["scheme"].isin(*SPECIAL_SCHEMES), url)
    return _let(_parse_url_parts_full(href, base), build)


# Fast path. Most hrefs and page URLs are lower-case http(s) URLs or
# root-relative paths made of characters WHATWG keeps as they are, without a
# query, dot segments or a port. For those the canonical form is plain string
# surgery done by codegen'd regex functions; every other input takes the full
# parser above (CASE WHEN evaluates only the branch it needs).
_FAST_CHARS = r"[A-Za-z0-9_\-.~/%!$&'()*+,;=:@]"
_FAST_HOST = r"[a-z0-9][a-z0-9.\-]*"
_FAST_ABS = r"^(https?)://(" + _FAST_HOST + r")(/" + _FAST_CHARS + r"*)?(#.*)?$"
_FAST_REL = r"^/(?!/)(" + _FAST_CHARS + r"*)(#.*)?$"
_FAST_BASE = r"^(https?://" + _FAST_HOST + r")(?:[/?#].*)?$"
_DOT_SEG = r"(^|/)(\.|%2[eE]){1,2}(/|$)"


def _fast_path_of(p: Column) -> Column:
    path = F.when(p == "", F.lit("/")).otherwise(p)
    return F.regexp_replace(path, r"(?<=.)/$", "")


@_memo
def normalize_url(href, base) -> Column:
    """Canonical http(s) URL of ``href`` resolved against ``base``, or NULL.

    Fragment dropped; query sorted by key (locale-aware, stable) with
    duplicate keys collapsed to the last value and re-encoded as form data;
    exactly one trailing '/' stripped unless the path is '/'.
    """
    h, b = _c(href), _c(base)
    abs_path = F.regexp_extract(h, _FAST_ABS, 3)
    fast_abs = h.rlike(_FAST_ABS) & ~abs_path.rlike(_DOT_SEG)
    rel_path = F.concat(F.lit("/"), F.regexp_extract(h, _FAST_REL, 1))
    fast_rel = h.rlike(_FAST_REL) & b.rlike(_FAST_BASE) & ~rel_path.rlike(_DOT_SEG)
    abs_url = F.concat(F.regexp_extract(h, _FAST_ABS, 1), F.lit("://"), F.regexp_extract(h, _FAST_ABS, 2),
                       _fast_path_of(abs_path))
    rel_url = F.concat(F.regexp_extract(b, _FAST_BASE, 1), _fast_path_of(rel_path))
    return F.when(fast_abs, abs_url).when(fast_rel, rel_url).otherwise(_normalize_url_full(href, base))


_FAST_PARSE = r"^(https?)://(" + _FAST_HOST + r")(/" + _FAST_CHARS + r"*)?(\?[^#]*)?(#.*)?$"


@_memo
def parse_url_parts(href, base=None) -> Column:
    """WHATWG-style parse of ``href`` (resolved against ``base`` when given).

    Returns struct(ok, scheme, userinfo, host, port, path, query) where
    query is the raw query (null when absent). ``ok`` is false for any
    input the reference's URL constructor would reject. Absolute URLs of
    the common shape are split by one codegen'd regex; the rest go through
    the full parser.
    """
    if base is not None:
        return _parse_url_parts_full(href, base)
    h = _c(href)
    path = F.regexp_extract(h, _FAST_PARSE, 3)
    fast = h.rlike(_FAST_PARSE) & ~path.rlike(_DOT_SEG)
    q = F.regexp_extract(h, _FAST_PARSE, 4)
    parts = F.struct(F.lit(True).alias("ok"), F.regexp_extract(h, _FAST_PARSE, 1).alias("scheme"),
                     F.lit(None).cast("string").alias("userinfo"),
                     F.regexp_extract(h, _FAST_PARSE, 2).alias("host"),
                     F.lit(None).cast("string").alias("port"),
                     F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
                     F.when(q == "", F.lit(None).cast("string")).otherwise(F.substring(q, 2, 1 << 30)).alias("query"))
    return F.when(fast, parts).otherwise(_parse_url_parts_full(href))


@_memo
def url_host(url) -> Column:
    """Hostname of an absolute URL (lower-case), NULL when unparseable."""
    return _let(parse_url_parts(url), lambda p: F.when(p["ok"], p["host"]))


@_memo
def url_path(url) -> Column:
    """Normalised pathname of an absolute URL, NULL when unparseable."""
    return _let(parse_url_parts(url), lambda p: F.when(p["ok"], p["path"]))


@_memo
def url_origin(url) -> Column:
    """scheme://host[:port] of an absolute http(s) URL (robots.txt scope)."""
    def build(p):
        port = F.when(p["port"].isNotNull(), F.concat(F.lit(":"), p["port"])).otherwise(F.lit(""))
        return F.when(p["ok"] & p["scheme"].isin(*SPECIAL_SCHEMES),
                      F.concat(p["scheme"], F.lit("://"), p["host"], port))
    return _let(parse_url_parts(url), build)


@_memo
def same_host(a, b) -> Column:
    """Hostnames equal (scheme and port ignored); bad URL -> false."""
    return F.coalesce(url_host(a) == url_host(b), F.lit(False))


def wildcard_match(text, pattern) -> Column:
    """Whether ``pattern`` matches the whole ``text``; '*' stands for any run
    of characters, every other character for itself.

    The pieces between the stars are looked for one after the other, each
    at its first place behind the piece before it: if any match exists, this
    finds one, so nothing is tried twice and the work grows with the lengths
    of text and pattern alone, whatever the pattern. No regular expression
    is built from it."""
    text = _c(text)

    def build(pieces):
        first, tail = F.get(pieces, F.lit(0)), F.element_at(pieces, -1)
        start = F.when(F.startswith(text, first), F.length(first))

        def step(at, piece):
            found = F.position(piece, text, at + 1)
            return F.when(found > 0, found - 1 + F.length(piece))

        inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
        stop = F.aggregate(inner, start, step)
        rest = F.coalesce(F.length(text) - F.length(tail) >= stop, F.lit(False)) & F.endswith(text, tail)
        return F.when(F.size(pieces) == 1, text == first).otherwise(rest)

    return _let(F.split(F.regexp_replace(_c(pattern), r"\*+", "*"), r"\*", -1), build)


def _optional_match(text: Column, pattern: Column) -> Column:
    """``wildcard_match`` for patterns in which '?' makes the character before
    it optional. A piece is followed through the set of places that it can
    end at, one character of it at a time; behind a star the first end is
    enough. Work grows with length times length at most."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"\*\?", "*"), r"\?\?", "?"), r"\*+", "*")

    def build(x):
        chars, pieces, n = x["chars"], x["pieces"], F.length(text)

        def ends(piece, starts):
            def step(places, token):
                hit = F.transform(F.filter(places, lambda p: F.get(chars, p) == F.substring(token, 1, 1)), lambda p: p + 1)
                return F.when(F.length(token) == 2, F.array_union(places, hit)).otherwise(hit)
            return F.aggregate(F.regexp_extract_all(piece, F.lit(r"(?s).\??"), 0), starts, step)

        anchored = ends(F.get(pieces, F.lit(0)), F.array(F.lit(0)))
        inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
        free = lambda at: F.when(at.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(at, n))
        stop = F.aggregate(inner, F.array_min(anchored), lambda at, piece: F.array_min(ends(piece, free(at))))
        return F.when(F.size(pieces) == 1, F.array_contains(anchored, n)) \
                .otherwise(F.array_contains(ends(F.element_at(pieces, -1), free(stop)), n))

    return _let(F.struct(F.split(text, "").alias("chars"), F.split(plain, r"\*", -1).alias("pieces")), build)


# A '?' with nothing to make optional is not a pattern.
_BAD_GLOB = r"^\?|\?\?\?|\*\?\?"


def glob_match(path, pattern) -> Column:
    """Case-sensitive anchored glob match of a pathname: '*' is any run
    of characters, '?' makes the character before it optional. A pattern in
    which '?' has nothing before it matches nothing."""
    path, pattern = _c(path), _c(pattern)
    general = F.when(pattern.rlike(_BAD_GLOB), F.lit(False)).otherwise(_optional_match(path, pattern))
    return F.when(F.contains(pattern, F.lit("?")), general).otherwise(wildcard_match(path, pattern))


def _glob_verdict(path: Column, include: Column, exclude: Column) -> Column:
    """U4 on a pathname: an exclude that matches, or is no pattern, refuses;
    a non-empty include list needs a match."""
    hit_exc = F.exists(exclude, lambda g: glob_match(path, g) | g.rlike(_BAD_GLOB))
    hit_inc = F.exists(include, lambda g: glob_match(path, g))
    return F.coalesce(path.isNotNull() & ~hit_exc & ((F.size(include) == 0) | hit_inc), F.lit(False))


@_memo
def allowed_by_patterns(url, include, exclude) -> Column:
    """U4: exclude wins; non-empty include list needs a hit; bad URL -> false."""
    inc = F.coalesce(_c(include), F.array().cast("array<string>"))
    exc = F.coalesce(_c(exclude), F.array().cast("array<string>"))

    return _let(url_path(url), lambda path: _glob_verdict(path, inc, exc))


@_memo
def redact_url(url) -> Column:
    """Mask the first ':password@' of a connection URL; null/'' -> 'not set'."""
    # first occurrence only: regexp_replace replaces all, so split at the
    # leftmost match and rewrite just that one.
    def body(u):
        pos = F.regexp_instr(u, F.lit(r":([^:@]+)@"))
        tail = F.regexp_replace(F.substring(u, pos, 1 << 30), r"^:([^:@]+)@", ":••••@")
        out = F.when(pos > 0, F.concat(F.substring(u, 1, pos - 1), tail)).otherwise(u)
        return F.when(u.isNull() | (u == ""), F.lit("not set")).otherwise(out)
    return _let(_c(url), body)


def mask_secret(value) -> Column:
    """First 6 characters then 12 bullets; null/'' -> 'not set'."""
    v = _c(value)
    return F.when(v.isNull() | (v == ""), F.lit("not set")) \
            .otherwise(F.concat(F.substring(v, 1, 6), F.lit("•" * 12)))


def url_origin_of(parts: Column) -> Column:
    """scheme://host[:port] from a ``parse_url_parts`` struct."""
    port = F.when(parts["port"].isNotNull(), F.concat(F.lit(":"), parts["port"])).otherwise(F.lit(""))
    return F.when(parts["ok"] & parts["scheme"].isin(*SPECIAL_SCHEMES),
                  F.concat(parts["scheme"], F.lit("://"), parts["host"], port))


def allowed_path(path, include, exclude) -> Column:
    """U4 on an already parsed pathname (null path -> false)."""
    inc = F.coalesce(_c(include), F.array().cast("array<string>"))
    exc = F.coalesce(_c(exclude), F.array().cast("array<string>"))
    return _glob_verdict(_c(path), inc, exc)


def evaluate_once(df, **cols):
    """Add columns computed exactly once per row.

    Catalyst pushes filters below projections by substituting the
    projected expression into the predicate, so a filter on a costly
    derived column (a normalised URL) would evaluate it again. A
    single-row ``inline`` is a Generate node; predicates on its output
    stay above it, so each expression runs once.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


# Output shape of normalize_url: scheme://[userinfo@]host[:port]path[?query],
# lower-case host, no fragment, path starting with '/'.
_CANONICAL = r"^(https?)://(?:([^@/]*)@)?(\[[^\]]*\]|[^:/?#]+)(?::([0-9]+))?(/[^?#]*)(?:\?([^#]*))?$"


def canonical_parts(url) -> Column:
    """struct(ok, scheme, userinfo, host, port, path, query) of a URL that
    ``normalize_url`` produced, by one regex (no general parsing needed:
    the canonical form is fixed). Not for raw input URLs."""
    u = _c(url)
    g = [F.regexp_extract(u, _CANONICAL, i) for i in range(1, 7)]
    ok = u.isNotNull() & u.rlike(_CANONICAL)
    nullable = [F.when(x != "", x) for x in (g[1], g[3])]
    q = F.when(F.regexp_extract(u, r"^[^?]*(\?)", 1) == "?", g[5])
    return F.when(ok, F.struct(ok.alias("ok"), g[0].alias("scheme"), nullable[0].alias("userinfo"),
                               g[2].alias("host"), nullable[1].alias("port"), g[4].alias("path"),
                               q.alias("query")))
