"""DuckDB SQL text for the correctness oracle.

Each helper returns a DuckDB SQL *expression* (string) computing the same
value as the Spark column function of the same name, written
independently in DuckDB's dialect (RE2 regexes without back-references,
``list_*`` lambdas, form encoding patched over ``url_encode``). The
fixture CTEs mirror ``webloom.sources.fixtures`` line by line.
"""

from __future__ import annotations

import itertools

from .sources import fixtures as FX

_ids = itertools.count()


def _v() -> str:
    return f"v{next(_ids)}"


def let(value: str, body) -> str:
    """Bind ``value`` to a fresh lambda variable; ``body(name) -> sql``."""
    n = _v()
    return f"(list_transform([{value}], lambda {n}: {body(n)}))[1]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- text

def utf16_length(s: str) -> str:
    # code points + one extra unit per astral-plane character
    return (f"(length({s}) + length(regexp_replace({s}, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')))")


JS_WS = "[\\s\\x{A0}\\x{FEFF}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def js_trim(s: str) -> str:
    return f"regexp_replace({s}, {q('^' + JS_WS + '+|' + JS_WS + '+$')}, '', 'g')"


def decode_entities(s: str) -> str:
    def numeric(x):
        toks = f"regexp_extract_all({x}, '(&#[0-9]{{1,7}};|&#[xX][0-9a-fA-F]{{1,6}};|[^&]+|&)', 1)"

        def tok(t):
            dec = f"regexp_extract({t}, '^&#([0-9]{{1,7}});$', 1)"
            hx = f"regexp_extract({t}, '^&#[xX]([0-9a-fA-F]{{1,6}});$', 1)"
            cp = (f"(CASE WHEN {dec} <> '' THEN TRY_CAST({dec} AS BIGINT) "
                  f"WHEN {hx} <> '' THEN TRY_CAST(('0x' || {hx}) AS BIGINT) END)")
            return (f"CASE WHEN {cp} > 0 AND {cp} <= 1114111 AND NOT ({cp} BETWEEN 55296 AND 57343) "
                    f"THEN chr(CAST({cp} AS INTEGER)) WHEN {cp} IS NOT NULL THEN chr(65533) ELSE {t} END")
        return (f"CASE WHEN position('&#' IN {x}) > 0 THEN "
                f"array_to_string(list_transform({toks}, lambda t_: {tok('t_')}), '') ELSE {x} END")
    out = let(s, numeric)
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
                    ("&nbsp;", "\u00a0"), ("&amp;", "&")]:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def math_round(x: str) -> str:
    return f"floor(({x}) + 0.5)"


# ---------------------------------------------------------------- html

_STRIP_TAGS = ("script", "style", "noscript", "iframe", "svg")


def strip_nodes(html: str) -> str:
    # RE2 has no back-reference: one alternation per element, leftmost match wins.
    alts = ["<!--.*?(?:-->|$)", "<svg\\b[^>]*/>"] + [f"<{t}\\b[^>]*>(?:.*?</{t}\\s*>|.*$)" for t in _STRIP_TAGS]
    return f"regexp_replace({html}, {q('(?is)' + '|'.join(alts))}, '', 'g')"


def page_title(doc: str) -> str:
    raw = f"array_to_string(regexp_extract_all({doc}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '')"
    return f"coalesce({js_trim(decode_entities(raw))}, '')"


def page_links(doc: str) -> str:
    tags = f"""regexp_extract_all({doc}, {q('(?is)<a\\s(?:[^>"' + "'" + ']|"[^"]*"|' + "'[^']*'" + ')*>')}, 0)"""
    # attributes in order, quoted values as a whole; the first one named href
    attr_re = q("(?is)([^\\s=>/\"']+)(?:\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+))?")

    def one(t):
        rest = f"substr({t}, 3)"
        names = f"list_transform(regexp_extract_all({rest}, {attr_re}, 1), lambda a_: lower(a_))"
        v = f"coalesce(regexp_extract_all({rest}, {attr_re}, 2)[list_position({names}, 'href')], '')"
        unq = f"regexp_replace({v}, {q('^[\"' + chr(39) + ']|[\"' + chr(39) + ']$')}, '', 'g')"
        return f"CASE WHEN {v} = '' THEN NULL ELSE {decode_entities(unq)} END"
    n = _v()
    return (f"list_filter(list_transform({tags}, lambda {n}: {one(n)}), "
            f"lambda x_: x_ IS NOT NULL AND x_ <> '')")


# ---------------------------------------------------------------- urls

_SCHEME = "^([A-Za-z][A-Za-z0-9+.\\-]*):"
_FORBIDDEN_HOST = "[\\x00-\\x20#%/:<>?@\\[\\\\\\]^|]"


def _clean(s: str) -> str:
    return (f"regexp_replace(regexp_replace({s}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), "
            f"'[\\t\\n\\r]', '', 'g')")


def _hostport(auth: str, scheme: str) -> str:
    """struct(userinfo, host, port, ok) of an authority."""
    def body(a):
        hp = f"regexp_extract({a}, '([^@]*)$', 1)"

        def body2(h):
            host = f"regexp_extract({h}, '^([^:]*)', 1)"
            pr = f"regexp_extract({h}, '^[^:]*:?(.*)$', 1)"

            def body3(p):
                pn = f"CAST(TRY_CAST({p} AS INTEGER) AS VARCHAR)"
                dflt = f"(CASE WHEN {scheme} = 'http' THEN '80' WHEN {scheme} = 'https' THEN '443' END)"
                port = f"CASE WHEN {p} = '' OR {pn} = {dflt} THEN NULL ELSE {pn} END"
                pok = f"({p} = '' OR (regexp_full_match({p}, '[0-9]{{1,5}}') AND TRY_CAST({p} AS INTEGER) <= 65535))"
                hok = f"({host} <> '' AND NOT regexp_matches({host}, {q(_FORBIDDEN_HOST)}))"
                ui = f"CASE WHEN position('@' IN {a}) > 0 THEN regexp_extract({a}, '^(.*)@', 1) END"
                return (f"{{'userinfo': {ui}, 'host': lower({host}), 'port': {port}, "
                        f"'ok': coalesce({pok} AND {hok}, false)}}")
            return let(pr, body3)
        return let(hp, body2)
    return let(auth, body)


def _remove_dots(path: str) -> str:
    def body(segs):
        step = ("CASE WHEN lower(s_) IN ('.', '%2e') THEN {'out': acc_.out, 'trail': true} "
                "WHEN lower(s_) IN ('..', '.%2e', '%2e.', '%2e%2e') THEN "
                "{'out': list_slice(acc_.out, 1, greatest(len(acc_.out) - 1, 0)), 'trail': true} "
                "ELSE {'out': list_append(acc_.out, s_), 'trail': false} END")
        init = "{'out': []::VARCHAR[], 'trail': false}"
        red = (f"CASE WHEN len({segs}) < 2 THEN {init} ELSE "
               f"list_reduce(list_slice({segs}, 2, len({segs})), lambda acc_, s_: {step}, {init}) END")

        def fin(r):
            return (f"'/' || array_to_string({r}.out, '/') || "
                    f"CASE WHEN {r}.trail AND len({r}.out) > 0 THEN '/' ELSE '' END")
        return let(red, fin)
    return let(f"string_split({path}, '/')", body)


def _encode_path(path: str) -> str:
    runs = f"regexp_extract_all({path}, '([\\x00-\\x7F]+|[^\\x00-\\x7F]+)', 1)"
    asc = "r_"
    for ch, esc in [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"),
                    ("{", "%7B"), ("}", "%7D")]:
        asc = f"replace({asc}, {q(ch)}, {q(esc)})"
    return (f"array_to_string(list_transform({runs}, lambda r_: CASE WHEN regexp_matches(r_, '^[\\x00-\\x7F]') "
            f"THEN {asc} ELSE url_encode(r_) END), '')")


def _form_encode(s: str) -> str:
    return f"replace(replace(replace(url_encode({s}), '%20', '+'), '%2A', '*'), '~', '%7E')"


def _form_decode(s: str) -> str:
    return f"url_decode(replace({s}, '+', ' '))"


def _canonical_query(qs: str) -> str:
    parts = f"list_filter(string_split({qs}, '&'), lambda x_: x_ <> '')"
    pairs = (f"list_transform({parts}, lambda x_, i_: {{'k': {_form_decode(f'CASE WHEN position(chr(61) IN x_) > 0 THEN split_part(x_, chr(61), 1) ELSE x_ END')}, "
             f"'v': {_form_decode("CASE WHEN position(chr(61) IN x_) > 0 THEN substr(x_, position(chr(61) IN x_) + 1) ELSE '' END")}, 'i': i_}})")
    ordered = f"list_sort({pairs})"
    init = "[]::STRUCT(k VARCHAR, v VARCHAR)[]"
    merged = (f"list_reduce({ordered}, lambda acc_, e_: CASE WHEN len(acc_) > 0 AND acc_[-1].k = e_.k "
              f"THEN list_append(list_slice(acc_, 1, len(acc_) - 1), {{'k': e_.k, 'v': e_.v}}) "
              f"ELSE list_append(acc_, {{'k': e_.k, 'v': e_.v}}) END, {init})")
    enc = f"list_transform({merged}, lambda e_: {_form_encode('e_.k')} || '=' || {_form_encode('e_.v')})"
    return f"coalesce(array_to_string({enc}, '&'), '')"


def _abs_parts(u: str) -> str:
    """struct(ok, scheme, userinfo, host, port, path, query) of an absolute URL (cleaned)."""
    def body(x):
        scheme = f"lower(regexp_extract({x}, {q(_SCHEME)}, 1))"
        rest = f"regexp_extract({x}, {q(_SCHEME + '(.*)$')}, 2)"

        def b2(r):
            nofrag = f"regexp_extract({r}, '^([^#]*)', 1)"

            def b3(nf):
                pre = f"replace(regexp_extract({nf}, '^([^?]*)', 1), '\\', '/')"
                qq = f"CASE WHEN position('?' IN {nf}) > 0 THEN substr({nf}, position('?' IN {nf}) + 1) END"

                def b4(a):
                    auth = f"regexp_extract({a}, '^([^/]*)', 1)"
                    path = f"regexp_extract({a}, '^[^/]*(.*)$', 1)"

                    def b5(hp):
                        return (f"{{'ok': regexp_matches({x}, {q(_SCHEME)}) AND {hp}.ok, 'scheme': {scheme}, "
                                f"'userinfo': {hp}.userinfo, 'host': {hp}.host, 'port': {hp}.port, "
                                f"'path': {path}, 'query': {qq}}}")
                    return let(_hostport(auth, scheme), b5)
                return let(f"regexp_replace({pre}, '^/+', '')", b4)
            return let(nofrag, b3)
        return let(rest, b2)
    return let(u, body)


def parse_url_parts(href: str, base: str | None = None) -> str:
    def with_base(b):
        def body(h):
            has_scheme = f"regexp_matches({h}, {q(_SCHEME)})"
            nofrag = f"regexp_extract({h}, '^([^#]*)', 1)"

            def rel(nf):
                pre = f"replace(regexp_extract({nf}, '^([^?]*)', 1), '\\', '/')"
                qq = f"CASE WHEN position('?' IN {nf}) > 0 THEN substr({nf}, position('?' IN {nf}) + 1) END"

                def rel2(p):
                    a = f"regexp_replace({p}, '^/+', '')"
                    auth = f"regexp_extract({a}, '^([^/]*)', 1)"
                    apath = f"regexp_extract({a}, '^[^/]*(.*)$', 1)"
                    has_auth = f"starts_with({p}, '//')"

                    def rel3(hp):
                        merged = f"regexp_replace({b}.path, '[^/]*$', '') || {p}"
                        path = (f"CASE WHEN {has_auth} THEN {apath} WHEN starts_with({p}, '/') THEN {p} "
                                f"WHEN {p} = '' THEN {b}.path ELSE {merged} END")
                        query = f"CASE WHEN {p} = '' AND ({qq}) IS NULL THEN {b}.query ELSE {qq} END"
                        bok = f"coalesce({b}.ok AND {b}.scheme IN ('http', 'https'), false)"
                        return (f"{{'ok': {bok} AND (NOT {has_auth} OR {hp}.ok), 'scheme': {b}.scheme, "
                                f"'userinfo': CASE WHEN {has_auth} THEN {hp}.userinfo ELSE {b}.userinfo END, "
                                f"'host': CASE WHEN {has_auth} THEN {hp}.host ELSE {b}.host END, "
                                f"'port': CASE WHEN {has_auth} THEN {hp}.port ELSE {b}.port END, "
                                f"'path': {path}, 'query': {query}}}")
                    return let(_hostport(auth, f"{b}.scheme"), rel3)
                return let(pre, rel2)

            relative = let(nofrag, rel)
            absolute = _abs_parts(h)
            return f"CASE WHEN {has_scheme} THEN {absolute} ELSE {relative} END"

        def tidy(p):
            raw = f"CASE WHEN {p}.path = '' THEN '/' ELSE {p}.path END"
            path = (f"CASE WHEN {p}.scheme IN ('http', 'https') THEN {_encode_path(_remove_dots(raw))} "
                    f"ELSE {p}.path END")
            return (f"{{'ok': coalesce({p}.ok, false), 'scheme': {p}.scheme, 'userinfo': {p}.userinfo, "
                    f"'host': {p}.host, 'port': {p}.port, 'path': {path}, 'query': {p}.query}}")
        return let(let(_clean(href), body), tidy)

    if base is None:
        null_base = ("{'ok': false, 'scheme': NULL::VARCHAR, 'userinfo': NULL::VARCHAR, 'host': NULL::VARCHAR, "
                     "'port': NULL::VARCHAR, 'path': NULL::VARCHAR, 'query': NULL::VARCHAR}")
        return let(null_base, with_base)
    return let(parse_url_parts(base), with_base)


def normalize_url(href: str, base: str) -> str:
    def build(p):
        path = (f"CASE WHEN length({p}.path) > 1 AND ends_with({p}.path, '/') "
                f"THEN substr({p}.path, 1, length({p}.path) - 1) ELSE {p}.path END")
        query = let(f"CASE WHEN {p}.query IS NOT NULL THEN {_canonical_query(f'{p}.query')} ELSE '' END",
                    lambda qq: f"CASE WHEN {qq} <> '' THEN '?' || {qq} ELSE '' END")
        user = (f"CASE WHEN {p}.userinfo IS NOT NULL AND {p}.userinfo <> '' "
                f"THEN regexp_replace({p}.userinfo, ':$', '') || '@' ELSE '' END")
        port = f"CASE WHEN {p}.port IS NOT NULL THEN ':' || {p}.port ELSE '' END"
        return (f"CASE WHEN {p}.ok AND {p}.scheme IN ('http', 'https') THEN "
                f"{p}.scheme || '://' || {user} || {p}.host || {port} || {path} || {query} END")
    return let(parse_url_parts(href, base), build)


def url_host(u: str) -> str:
    return let(parse_url_parts(u), lambda p: f"CASE WHEN {p}.ok THEN {p}.host END")


def url_path(u: str) -> str:
    return let(parse_url_parts(u), lambda p: f"CASE WHEN {p}.ok THEN {p}.path END")


def same_host(a: str, b: str) -> str:
    return f"coalesce({url_host(a)} = {url_host(b)}, false)"


def glob_to_regex(p: str) -> str:
    esc = f"regexp_replace({p}, '([.+^$\\{{\\}}()|\\[\\]\\\\])', '\\\\\\1', 'g')"
    return f"'^' || replace({esc}, '*', '.*') || '$'"


def glob_match(path: str, pattern: str) -> str:
    return f"regexp_matches({path}, {glob_to_regex(pattern)})"


def allowed_by_patterns(url: str, inc: str, exc: str) -> str:
    def body(path):
        hit_exc = f"len(list_filter({exc}, lambda g_: {glob_match(path, 'g_')})) > 0"
        hit_inc = f"len(list_filter({inc}, lambda g_: {glob_match(path, 'g_')})) > 0"
        return (f"coalesce({path} IS NOT NULL AND NOT ({hit_exc}) AND (len({inc}) = 0 OR {hit_inc}), false)")
    return let(url_path(url), body)


# ---------------------------------------------------------------- fixtures

def ts(s: str) -> str:
    return f"TIMESTAMP {q(s)}"


FIXTURE_CTES = {
    "responses": f"""responses AS (
  SELECT page_id, url, 'fetch' AS engine, http_status, '"e' || CAST(page_id AS VARCHAR) || '"' AS etag,
    NULL::VARCHAR AS last_modified,
    CASE WHEN http_status IS NULL OR http_status = 304 THEN NULL ELSE html END AS html, error,
    {ts(FX.FETCH_EPOCH)} + to_seconds(page_id) AS fetched_at,
    CAST(100 + page_id % 400 AS INTEGER) AS duration_ms
  FROM (SELECT *,
    CASE WHEN page_id % 17 = 0 OR page_id % 19 = 0 OR page_id % 23 = 0 THEN NULL
         WHEN page_id % 29 = 0 THEN 'TimeoutError: The operation was aborted due to timeout'
         WHEN page_id % 31 = 0 THEN 'fetch failed: ECONNREFUSED' END AS error,
    CAST(CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 19 = 0 THEN 403 WHEN page_id % 23 = 0 THEN 304
         WHEN page_id % 29 = 0 OR page_id % 31 = 0 THEN NULL
         WHEN page_id % 37 = 0 THEN 429 WHEN page_id % 41 = 0 THEN 500 ELSE 200 END AS INTEGER) AS http_status
    FROM pages))""",
    "jobs": f"""jobs AS (
  SELECT 'job_' || CAST(o_orderkey AS VARCHAR) AS id,
    CASE WHEN o_orderstatus = 'P' THEN 'queued' WHEN o_orderstatus = 'O' THEN 'running'
         WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'completed' END AS status,
    'https://c' || CAST(o_custkey AS VARCHAR) || '.example.com/' AS url,
    2 AS max_depth, 100 AS max_pages, []::VARCHAR[] AS include_patterns, []::VARCHAR[] AS exclude_patterns,
    CASE WHEN o_custkey % 4 = 0 THEN 'https://hooks.example.com/' || CAST(o_custkey AS VARCHAR) END AS webhook_url,
    'auto' AS engine,
    CAST(o_orderkey % 12 AS INTEGER) AS pages_discovered,
    CAST(o_orderkey % 7 AS INTEGER) AS pages_scraped,
    CAST(o_orderkey % 3 AS INTEGER) AS pages_failed,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 HOUR END AS started_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 HOUR END AS completed_at,
    CASE WHEN o_orderstatus = 'O' THEN o_orderdate + to_seconds(o_orderkey % 240) END AS last_heartbeat_at,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'crawl aborted' END AS error,
    o_orderdate AS created_at
  FROM orders)""",
    "job_pages": """job_pages AS (
  SELECT 'job_' || CAST(l_orderkey AS VARCHAR) AS job_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
        l_quantity, l_extendedprice, l_discount, l_tax) AS BIGINT) AS ord,
    'https://s' || CAST(l_suppkey AS VARCHAR) || '.example.com/p/' || CAST(l_partkey AS VARCHAR) AS url,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'blocked' WHEN l_returnflag = 'R' THEN 'not_found'
         ELSE 'scraped' END AS status,
    CASE WHEN l_linestatus = 'O' THEN 'browser' ELSE 'fetch' END AS engine,
    NULL::VARCHAR AS markdown,
    CASE WHEN l_returnflag <> 'R' THEN 'Part ' || CAST(l_partkey AS VARCHAR) END AS title,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'HTTP 403' WHEN l_returnflag = 'R' THEN 'HTTP 404' END AS error,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(round(l_quantity * 10) AS INTEGER) END AS duration_ms,
    CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey % 5000 AS INTEGER) END AS markdown_length,
    l_shipdate AS scraped_at, l_shipdate AS created_at
  FROM lineitem)""",
    "scrape_requests": """scrape_requests AS (
  SELECT event_id AS id,
    'https://u' || CAST(user_id % 50 AS VARCHAR) || '.example.com/e/' || CAST(event_id AS VARCHAR) AS url,
    CASE WHEN event_type = 'signup' THEN 'extract' ELSE 'scrape' END AS source,
    CASE WHEN user_id % 3 = 0 THEN 'fetch' WHEN user_id % 3 = 1 THEN 'browser' END AS engine,
    CASE WHEN event_type <> 'error' THEN 'ok' ELSE 'error' END AS status,
    CAST(floor(value * 10) AS INTEGER) AS duration_ms,
    CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100) AS INTEGER) END AS markdown_length,
    CASE WHEN event_type <> 'error' THEN 'Event ' || CAST(event_id AS VARCHAR) END AS title,
    CASE WHEN event_type = 'error' THEN 'HTTP 500' END AS error,
    ts AS created_at
  FROM events)""",
    "monitors": """monitors AS (
  SELECT 'mon_' || source AS id, 'https://' || source || '.example.org/' AS url, 2 AS max_depth, 100 AS max_pages,
    []::VARCHAR[] AS include_patterns, []::VARCHAR[] AS exclude_patterns,
    (['hourly', 'daily', 'weekly'])[CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 3 + 1] AS frequency,
    'https://hooks.example.com/m/' || source AS webhook_url,
    CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 7 = 0 THEN 'paused' ELSE 'active' END AS status,
    CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 10 = 5 THEN ''
         WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 2 = 0 THEN 'Track updates for ' || source END AS goal,
    TIMESTAMP '2024-01-29 23:30:00' AS last_checked_at, NULL::VARCHAR AS last_job_id,
    TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM (SELECT DISTINCT source FROM documents))""",
    "monitor_prev": """monitor_prev AS (
  SELECT 'mon_' || source AS monitor_id, 'https://' || source || '.example.org/d/' || CAST(doc_id AS VARCHAR) AS url,
    text AS markdown, '"d' || CAST(doc_id AS VARCHAR) || '"' AS etag,
    CASE WHEN doc_id % 4 = 0 THEN 'Mon, 29 Jan 2024 00:00:00 GMT' END AS last_modified, TIMESTAMP '2024-01-29 00:00:00' AS checked_at
  FROM documents WHERE doc_id % 11 <> 0)""",
    "monitor_cur": """monitor_cur AS (
  SELECT 'mon_' || source AS monitor_id, 'https://' || source || '.example.org/d/' || CAST(doc_id AS VARCHAR) AS url,
    CASE WHEN doc_id % 13 = 0 THEN 304 ELSE 200 END AS http_status,
    CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'Updated line ' || CAST(doc_id AS VARCHAR) ELSE text END AS markdown,
    '"d' || CAST(doc_id AS VARCHAR) || '"' AS etag,
    CASE WHEN doc_id % 3 = 0 THEN 'Tue, 30 Jan 2024 00:00:00 GMT' END AS last_modified, TIMESTAMP '2024-01-30 00:00:00' AS checked_at
  FROM documents WHERE doc_id % 7 <> 0)""",
    "logs": """logs AS (
  SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'job_' || CAST(user_id AS VARCHAR) END AS job_id,
    CASE WHEN user_id % 2 = 1 THEN 'mon_src' || CAST(user_id % 20 AS VARCHAR) END AS monitor_id,
    CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'warn' ELSE 'info' END AS level,
    event_type AS message, props AS context, ts AS created_at
  FROM events)""",
    "crawl_requests": """crawl_requests AS (
  SELECT 'req_' || CAST(o_orderkey AS VARCHAR) AS id,
    CASE WHEN o_orderkey % 10 = 3 THEN '' ELSE 'https://' END || 'c' || CAST(o_custkey AS VARCHAR) || '.example.com/' AS url,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 13 - 1 AS INTEGER) END AS max_depth,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((o_custkey * 37) % 1200 AS INTEGER) END AS max_pages,
    CASE WHEN o_orderkey % 9 = 0 THEN ['/docs/*'] END AS include_patterns,
    NULL::VARCHAR[] AS exclude_patterns,
    CASE WHEN o_orderkey % 6 = 0 THEN 'not a url' WHEN o_orderkey % 6 = 1 THEN 'https://hooks.example.com/x' END AS webhook_url,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'fetch' WHEN o_orderkey % 4 = 2 THEN 'browser'
         WHEN o_orderkey % 8 = 3 THEN 'chrome' ELSE 'auto' END AS engine,
    o_orderdate AS created_at
  FROM orders)""",
    "link_graph": """link_graph AS (
  SELECT page_id, url, html, host, rnk AS rank, '/n/' || CAST(rnk AS VARCHAR) AS path FROM (
    SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
      row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY page_id) AS rnk
    FROM pages))""",
    "crawl_sitemaps": """sm_hosts AS (SELECT host FROM link_graph WHERE rank = 1 AND page_id % 4 = 0),
sm_pages AS (SELECT g.*, CAST(floor((rank - 1) / 1000) AS INTEGER) AS bucket FROM link_graph g JOIN sm_hosts USING (host)),
sm_child AS (SELECT host, bucket,
    'https://' || host || '/sitemap-' || CAST(bucket AS VARCHAR) || '.xml' AS sitemap_url,
    '<?xml version="1.0"?><urlset>'
      || string_agg('<url><loc> https://' || host || path || ' </loc></url>', '' ORDER BY rank DESC)
      || '<url><LOC>https://' || host || '/n/1</LOC></url>'
      || '<url><loc>http://' || host || '/n/2</loc></url><url><loc>https://' || host || ':8443/n/3</loc></url>'
      || '<url><loc>https://elsewhere.example.com/n/1</loc></url></urlset>' AS xml
  FROM sm_pages GROUP BY host, bucket),
crawl_sitemaps AS (
  SELECT 'https://' || host || '/sitemap.xml' AS sitemap_url,
    '<?xml version="1.0"?><sitemapindex>' || string_agg('<sitemap><loc>' || sitemap_url || '</loc></sitemap>', '' ORDER BY bucket)
      || '<sitemap><loc>https://' || host || '/sitemap-missing.xml</loc></sitemap></sitemapindex>' AS xml
  FROM sm_child GROUP BY host
  UNION ALL SELECT sitemap_url, xml FROM sm_child)""",
    "crawl_robots": """crawl_robots AS (
  SELECT 'https://' || host AS origin,
    CASE WHEN page_id % 3 = 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /n/5' || chr(10) || 'Allow: /n/5$' || chr(10)
           || chr(10) || 'User-agent: otherbot' || chr(10) || 'Disallow: /' || chr(10)
         ELSE '# crawl rules' || chr(10) || 'User-agent: __AGENT__' || chr(10) || 'Disallow: /n/1*3' || chr(10) || 'Disallow:' || chr(10)
    END AS body
  FROM link_graph WHERE rank = 1 AND page_id % 3 <> 2)""",
    "robots_rules": r"""rb_lines AS (
  SELECT origin, CAST(ln AS BIGINT) - 1 AS ln, trim(regexp_replace(raw, '#.*$', '')) AS line FROM (
    SELECT origin, unnest(l) AS raw, generate_subscripts(l, 1) AS ln FROM (
      SELECT origin, regexp_split_to_array(body, '\r\n|\r|\n') AS l FROM crawl_robots))),
rb_kv AS (SELECT origin, ln, lower(trim(regexp_extract(line, '^([^:]+):', 1))) AS key,
                 trim(regexp_extract(line, '^[^:]+:(.*)$', 1)) AS value FROM rb_lines),
rb_kv2 AS (SELECT *, lag(key) OVER (PARTITION BY origin ORDER BY ln) AS prev_key FROM rb_kv
           WHERE key IN ('user-agent', 'allow', 'disallow')),
rb_grp AS (SELECT *, sum(CASE WHEN key = 'user-agent' AND (prev_key IS NULL OR prev_key <> 'user-agent') THEN 1 ELSE 0 END)
             OVER (PARTITION BY origin ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM rb_kv2),
rb_agents AS (SELECT origin, grp, CASE WHEN bool_or(lower(value) = '__AGENT_LC__') THEN 2
                                       WHEN bool_or(lower(value) = '*') THEN 1 ELSE 0 END AS score
              FROM rb_grp WHERE key = 'user-agent' GROUP BY origin, grp),
rb_best AS (SELECT origin, max(score) AS score FROM rb_agents WHERE score > 0 GROUP BY origin),
rb_chosen AS (SELECT a.origin, a.grp FROM rb_agents a JOIN rb_best b ON a.origin = b.origin AND a.score = b.score),
robots_rules AS (
  SELECT g.origin, g.ln, g.key = 'allow' AS allow, g.value AS pattern,
    '^' || replace(regexp_replace(CASE WHEN ends_with(g.value, '$') THEN substr(g.value, 1, length(g.value) - 1) ELSE g.value END,
                                  '([.+?^${}()|\[\]\\])', '\\\1', 'g'), '*', '.*')
      || CASE WHEN ends_with(g.value, '$') THEN '$' ELSE '' END AS regex
  FROM rb_grp g JOIN rb_chosen c ON g.origin = c.origin AND g.grp = c.grp
  WHERE g.key IN ('allow', 'disallow') AND g.value <> '')""",
    "crawl_jobs": """crawl_jobs AS (
  SELECT 'job_h' || CAST(page_id AS VARCHAR) AS id, 'https://' || host || '/n/1' AS url,
    CAST(1 + page_id % 10 AS INTEGER) AS max_depth,
    CAST(CASE WHEN page_id % 3 = 0 THEN 2 + page_id % 9 ELSE 20 + (page_id * 37) % 981 END AS INTEGER) AS max_pages,
    CASE WHEN page_id % 5 = 0 THEN ['/n/*'] ELSE []::VARCHAR[] END AS include_patterns,
    CASE WHEN page_id % 6 = 0 THEN ['/n/3'] ELSE []::VARCHAR[] END AS exclude_patterns
  FROM link_graph WHERE rank = 1)""",
    "crawl_responses": f"""crawl_responses AS (
  SELECT 'https://' || host || path AS url, http_status,
    CASE WHEN http_status = 200 THEN
      regexp_extract(h2, '(?s)^(.*?<body>)', 1)
      || '<nav><a href="/n/' || CAST(rank * 2 AS VARCHAR) || '">next</a>'
      || '<a href="https://' || host || '/n/' || CAST(rank * 2 + 1 AS VARCHAR) || '#top">more</a><a href="/n/1/">home</a></nav>'
      || regexp_replace(h2, '(?s)^.*?<body>', '') END AS html,
    NULL::VARCHAR AS error, {ts(FX.FETCH_EPOCH)} + to_seconds(page_id * 7) AS fetched_at, 120 AS duration_ms
  FROM (SELECT *, regexp_replace(html, '(?s)<nav>.*?</nav>', '', 'g') AS h2,
          CASE WHEN page_id % 19 = 0 THEN 403 WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS http_status
        FROM link_graph))""",
}


def _agent_token() -> str:
    from .operators.crawl import USER_AGENT
    return USER_AGENT.split("/")[0]


FIXTURE_CTES = {k: v.replace("__AGENT_LC__", _agent_token().lower()).replace("__AGENT__", _agent_token())
                for k, v in FIXTURE_CTES.items()}


def with_fixtures(*names: str) -> str:
    return "WITH " + ",\n".join(FIXTURE_CTES[n] for n in names)
