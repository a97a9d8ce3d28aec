"""Operator 7: secret scan behind a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query: an OR of
clauses, each the AND of the trigrams that one way of matching must
contain. The index holds (trigram, text) postings of the trigrams that any
rule asks for. A clause is answered by intersecting the postings of its
trigrams; only texts in a rule's answer are searched with its expression.
Rules whose expression requires no trigram (hex runs) search every text.
Postings and answers are keyed by a digest of the text, so copies are
indexed alike and repeated rows keep their multiplicity.

DataFrame functions only. Null texts count as empty; they have no spans.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import configure


class Rule(NamedTuple):
    kind: str
    regex: str            # Java and Python syntax alike
    group: int = 0        # whose length counts
    least: int = 1        # shorter matches are dropped


# The three base rules, in the order of the result's kinds.
BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),   # runs of 24 and more: the same as dropping shorter runs
]
# Published formats of further credentials.
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
MAX_STRINGS = 64      # alternatives followed at once when a query is derived


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which any match contains in
    full; None if a match needs no trigram."""
    from re import _constants as op
    from re import _parser

    runs: list[set[str]] = [{""}]      # literal runs in order, each with its alternatives

    def choices(node) -> set[str] | None:
        """All strings a node can match, if these are few."""
        kind, arg = node
        if kind is op.LITERAL:
            return {chr(arg).lower()}
        if kind is op.IN:
            got: set[str] = set()
            for k, a in arg:
                if k is op.LITERAL:
                    got.add(chr(a).lower())
                elif k is op.RANGE and a[1] - a[0] < 8:
                    got |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            return got if len(got) <= 8 else None
        if kind is op.SUBPATTERN:
            return joined(arg[3])
        if kind is op.BRANCH:
            parts = [joined(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if kind is op.MAX_REPEAT and arg[1] == 1:
            inner = joined(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def joined(nodes) -> set[str] | None:
        out = {""}
        for x in nodes:
            got = choices(x)
            if got is None or len(out) * len(got) > MAX_STRINGS:
                return None
            out = {a + b for a, b in product(out, got)}
        return out

    for node in _parser.parse(regex):
        got = choices(node)
        if got is None or len(runs[-1]) * len(got) > MAX_STRINGS:
            runs.append({""} if got is None else got)
        else:
            runs[-1] = {a + b for a, b in product(runs[-1], got)}
    clauses = {frozenset()}
    for run in runs:
        grams = {frozenset(s[i: i + 3] for i in range(len(s) - 2)) for s in run}
        clauses = {a | b for a in clauses for b in grams}
        clauses = {c for c in clauses if not any(d < c for d in clauses)}
    return None if frozenset() in clauses else sorted(clauses, key=sorted)


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of the given trigrams: (trigram, key) of ``texts``
    (key, low)."""
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return texts.select("key", F.explode(found).alias("trigram"))


def candidates(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, rules): for each text the rules whose trigram query it answers."""
    spark = texts.sparkSession
    wanted = [(r.kind, n, t, 1 << i, (1 << len(c)) - 1) for r in rules
              for n, c in enumerate(trigram_query(r.regex) or []) for i, t in enumerate(sorted(c))]
    clauses = spark.createDataFrame(wanted, "kind string, clause int, trigram string, bit long, full long")
    index = postings(texts, sorted({w[2] for w in wanted}))
    met = (index.join(F.broadcast(clauses), "trigram")     # bounded by the rules
           .groupBy("key", "kind", "clause", "full").agg(F.bit_or("bit").alias("mask"))
           .where("mask = full"))
    return met.groupBy("key").agg(F.collect_set("kind").alias("rules"))


def _scan(values: Column, join) -> Column:
    """Running sums (or other joins) of an int array by doubling steps: each
    pass reads the array of the pass before, so n values cost n log n."""
    steps = F.filter(F.lit([1 << k for k in range(31)]), lambda p: p < F.size(values))
    return F.aggregate(steps, values, lambda acc, p: F.transform(
        acc, lambda v, i: F.when(i < p, v).otherwise(join(v, F.get(acc, i - p)))))


def _let(value: Column, fn) -> Column:
    """Binds a value once for many uses in ``fn``."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of a rule's matches: running
    sums of the lengths of the matches and of the pieces between them."""
    rx = F.lit(rule.regex)
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    hits = F.transform(F.regexp_extract_all(text, rx, 0), F.length)
    found = F.struct(F.transform(F.split(text, rule.regex, -1), F.length).alias("gap"), hits.alias("hit"),
                     F.transform(F.regexp_extract_all(text, rx, rule.group), F.length).alias("value"))

    def spans(x):
        ends = _scan(F.transform(x["hit"], lambda h, i: h + F.get(x["gap"], i)), lambda a, b: a + b)
        each = F.transform(F.arrays_zip(ends.alias("end"), x["hit"].alias("hit"), x["value"].alias("value")), lambda m: F.struct(
            (m["end"] - m["hit"]).alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(rule.kind).alias("kind"), m["value"].alias("value")))
        return F.transform(F.filter(each, lambda m: m["value"] >= rule.least),
                           lambda m: F.struct(*[m[c].alias(c) for c in ("start", "order", "end", "kind")]))

    return F.when(text.rlike(rule.regex), _let(found, spans)).otherwise(none)


def scan(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """``docs`` plus ``out``: array<struct<start, order, end, kind>> of all
    matches in code points, end exclusive, by start and then rule order. A
    column of that name is replaced."""
    configure(docs.sparkSession)
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rest = docs.drop(out)
    rows = rest.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"), body.alias("body"),
                       F.sha2(body, 256).alias("key"))
    indexed = [r for r in rules if trigram_query(r.regex)]
    texts = docs.select(F.sha2(body, 256).alias("key"), F.lower(body).alias("low"))
    if indexed:
        found = rows.join(candidates(texts, indexed), "key", "left")
    else:
        found = rows.withColumn("rules", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    spans = [F.when(F.array_contains("rules", r.kind), rule_spans(F.col("body"), r, i)).otherwise(none)
             if r in indexed else rule_spans(F.col("body"), r, i) for i, r in enumerate(rules)]
    return found.select("row.*", F.array_sort(F.concat(*spans)).alias(out))


def is_kind(order: int):
    """Predicate on a span: it belongs to the rule of that place."""
    return lambda s: s["order"] == order


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


BLOCK = 1024      # code points of a text that are addressed as one block


def redact(docs: DataFrame, spans: str = "secret_spans", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replaces what the spans cover by ``mask`` (once per run of overlapping
    spans) and drops the span column. Null texts stay null."""
    body = F.col(f"`{text}`")

    def cut(x):
        def part(start, end):       # code points start .. end - 1
            first = (start / BLOCK).cast("int")
            some = F.slice(x["blocks"], first + 1, (end / BLOCK).cast("int") - first + 1)
            return F.substring(F.array_join(some, ""), start - first * BLOCK + 1, end - start)

        def piece(s, i):            # what stands before a run, and its mask
            before = F.when(i == 0, 0).otherwise(F.get(x["reach"], i - 1))
            return F.when(s["start"] >= before, F.concat(part(before, s["start"]), F.lit(mask))).otherwise(F.lit(""))

        last = F.element_at(x["reach"], -1)
        return F.concat(F.array_join(F.transform(F.col(spans), piece), ""), part(last, F.length(body)))

    bound = F.struct(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), 0).alias("blocks"),
                     _scan(F.transform(F.col(spans), lambda s: s["end"]), lambda a, b: F.greatest(a, b)).alias("reach"))
    return docs.withColumn(text, F.when(F.size(spans) > 0, _let(bound, cut)).otherwise(body)).drop(spans)
