"""Registered queries of the operators: name -> (spark, sf_dir) callable,
and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, fingerprint, langid, neardup, neighbours, pii, secrets, substring, suffix, toxicity, variants
from .base import documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows not held out."""
    docs = documents(spark, sf_dir)
    learned = langid.fit(docs.where(~langid.held_out()))
    out = langid.classify(docs, learned, keep=["doc_id"])
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeated 35-word windows cover."""
    return substring.without_passages(documents(spark, sf_dir))


def op9_bpe_forced_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the byte-level vocabulary."""
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path(), keep=["doc_id"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items and overlaps."""
    return decontaminate.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its validated numbers and dates pseudonymised."""
    return pii.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"))


def op4_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 2-word shingles, 80 %."""
    return neardup.duplicates(documents(spark, sf_dir), shingle=2, similarity=80) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 200-byte repeats cover."""
    return suffix.without_repeats(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows not held out."""
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.in_training(F.col("doc_id"))))
    return toxicity.score(docs, model, keep=["doc_id"]) \
        .select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every document, with code point spans."""
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = len(secrets.BASE_RULES)
    spans = F.col("secret_spans")
    count = [F.size(F.filter(spans, secrets.is_kind(i))).cast("long").alias(f"n_{r.kind}")
             for i, r in enumerate(secrets.BASE_RULES)]
    return found.select("doc_id", *count,
                        F.sha2(secrets.digest(F.filter(spans, lambda s: s["order"] < base)), 256).alias("base_sha256"),
                        secrets.digest(spans).alias("spans"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprint.edit_likeness(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of the words of all documents."""
    return variants.group(variants.count_words(documents(spark, sf_dir), edit=variants.drop_letter))


def op12_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found of every embedding whose id 100 divides."""
    return neighbours.nearest(documents(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language, in every order."""
    return filter_audit.audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def _op7_sql() -> str:
    """The same spans by splitting every text at the matches of every rule."""
    parts = []
    for i, r in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        rx = r.regex.replace("'", "''")
        parts.append(f"""
        SELECT doc_id, n, '{r.kind}' AS kind, {i} AS ord, hit, val, piece FROM (
          SELECT doc_id, unnest(range(len(hits))) AS n, unnest(hits) AS hit, unnest(vals) AS val,
                 unnest(pieces[:len(hits)]) AS piece, {r.least} AS least
          FROM (SELECT doc_id, regexp_extract_all(t, '{rx}', 0) AS hits, regexp_extract_all(t, '{rx}', {r.group}) AS vals,
                       string_split_regex(t, '{rx}') AS pieces FROM d))""")
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(secrets.BASE_RULES + secrets.MORE_RULES))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    p AS (SELECT *, sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, ord ORDER BY n) AS stop FROM m),
    s AS (SELECT doc_id, kind, ord, (stop - length(hit))::BIGINT AS a, stop::BIGINT AS b FROM p
          WHERE length(val) >= CASE ord {least} END),
    g AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access,
                 count(*) FILTER (ord = 2) AS n_hex,
                 coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (ord < 3), '') AS base,
                 string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans
          FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_feistel_pseudonyms": op3_feistel_pseudonyms,
    "op4_minhash_odd_sketch": op4_minhash_odd_sketch,
    "op5_prefix_free_parsing": op5_prefix_free_parsing,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_repeated_phrases": op8_repeated_phrases,
    "op9_bpe_forced_boundary": op9_bpe_forced_boundary,
    "op10_fingerprints": op10_fingerprints,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_neighbour_graph": op12_neighbour_graph,
    "op13_filter_audit": op13_filter_audit,
}

_OP4_SQL = r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE
            list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * i >= 80 * (x.c + y.c - i)),
    b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    r(node, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT b.v, r.reach FROM r JOIN b ON r.node = b.u)
    SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
    FROM d JOIN (SELECT node, min(reach) AS c FROM r GROUP BY node) m ON m.node = d.doc_id LEFT JOIN n USING (doc_id)"""

# crc32 by its table of 256 remainders; near words share a key with one place left out.
_OP11_SQL = r"""
    WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
    r AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
    d AS (SELECT i, run, count(*) AS c, hex(encode(i || ':' || run)) AS x FROM r WHERE length(run) >= 6 GROUP BY i, run),
    h AS (SELECT run, c, xor(list_reduce([4294967295] || list_transform(range(0, length(x), 2), lambda j: ('0x' || substr(x, j + 1, 2))::BIGINT),
            lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM d, tbl),
    w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
    v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
    cut AS (SELECT word, n, j, substr(word, 1, j - 1) AS a, substr(word, j + 1) AS b
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS j FROM v)),
    near AS (SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.j = y.j AND x.a = y.a AND x.b = y.b AND x.word <> y.word
             UNION SELECT x.word, y.word, y.n FROM cut x JOIN v y ON x.a || x.b = y.word
             UNION SELECT y.word, x.word, x.n FROM cut x JOIN v y ON x.a || x.b = y.word),
    best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form,
                 CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
    chain(word, last) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n
    FROM f JOIN chain c ON c.word = f.word JOIN f e ON e.word = c.last AND e.form IS NULL"""

_OP13_SQL = r"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    least AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
    known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
              FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
              'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
              'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(least < doc_id, false)} AS bad
          FROM w LEFT JOIN least USING (t) LEFT JOIN known USING (doc_id)),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
    o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM l a, l b, l c, l d, l e
          WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
    s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
    g AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS k, bad, good, toxic,
                 list_bool_or(list_transform(range(1, step), lambda i: bad[substr(filter_order, i, 1)])) AS early FROM f, s),
    r AS (SELECT part, filter_order, step, k,
            count(*) FILTER (NOT bad[k] AND NOT coalesce(early, false)) AS kept,
            count(*) FILTER (bad[k] AND NOT coalesce(early, false)) AS removed,
            count(*) FILTER (bad[k] AND coalesce(early, false)) AS redundant,
            count(*) FILTER (bad[k] AND len(list_filter(map_values(bad), lambda b: b)) = 1) AS unique_fails,
            sum(CASE WHEN bad[k] AND NOT coalesce(early, false) THEN good ELSE 0 END)::BIGINT AS good_lost,
            sum(CASE WHEN bad[k] AND NOT coalesce(early, false) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
          FROM g GROUP BY ALL)
    SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r"""

ORACLE_SQL: dict[str, str] = {
    "op4_minhash_odd_sketch": _OP4_SQL,
    "op7_secret_scan": _op7_sql(),
    "op11_spelling_variants": _OP11_SQL,
    "op13_filter_audit": _OP13_SQL,
}
