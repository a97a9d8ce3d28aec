"""LLM batch extraction and judging: E1-E7 (and the reply parsing M14 uses).

Model calls are an input boundary: prompts are built as columns, hashed,
and joined to a table of captured completions keyed by (prompt_hash,
attempt). A caller with live access can produce that table with a
``mapInPandas`` over the prompt table; nothing here talks to a network.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utf16_length, utf16_prefix

# Prompt texts and limits of the reference.
MAX_MARKDOWN_CHARS = 100_000
TRUNCATION_NOTE = "\n\n[Note: content was truncated to 100,000 characters]"
EXTRACTION_HEAD = (
    "You are a structured data extractor. Extract the requested fields from the webpage content below "
    "and return them as a JSON object.\n\nSchema (field name → type):\n")
EXTRACTION_RULES = (
    "\n\nRules:\n"
    "- Return ONLY a valid JSON object — no markdown fences, no explanation, no other text\n"
    "- Use null for any field not found on the page — do not guess or hallucinate values\n"
    "- \"string\": a string value\n"
    "- \"number\": a numeric value only (no currency symbols, units, or commas)\n"
    "- \"boolean\": true or false\n"
    "- \"array of strings\": a JSON array of strings\n\n"
    "Page content (markdown):\n")
RETRY_SUFFIX = ("\n\nIMPORTANT: Your previous response was not valid JSON. "
                "Return ONLY a JSON object, nothing else.")
JUDGE_HEAD = "You are evaluating whether a webpage content change is relevant to a stated monitoring goal.\n\nGoal: "
JUDGE_MID = ("\n\nContent diff (lines starting with + were added, lines starting with - were removed):\n")
JUDGE_TAIL = ("\n\nReply with ONLY a valid JSON object in this exact format, no other text:\n"
              '{ "relevant": true, "reason": "brief one-sentence explanation" }\nor\n'
              '{ "relevant": false, "reason": "brief one-sentence explanation" }')
HINT_TYPES = {"string": "string", "number": "double", "boolean": "boolean", "array of strings": "array<string>"}
DEFAULT_PROVIDER, DEFAULT_MODEL = "openai", "gpt-4o"


def truncate_for_prompt(markdown) -> tuple[Column, Column]:
    """(content, truncated) - first 100,000 UTF-16 units when longer."""
    md = F.coalesce(F.col(markdown) if isinstance(markdown, str) else markdown, F.lit(""))
    truncated = utf16_length(md) > MAX_MARKDOWN_CHARS
    return F.when(truncated, utf16_prefix(md, MAX_MARKDOWN_CHARS)).otherwise(md), truncated


def schema_json(schema: dict[str, str]) -> str:
    """The request schema as the prompt shows it (2-space JSON, key order kept)."""
    return json.dumps(schema, indent=2, ensure_ascii=False)


def extraction_prompt(content: Column, truncated: Column, schema: dict[str, str]) -> Column:
    """Fixed template around the schema JSON and the page content."""
    note = F.when(truncated, F.lit(TRUNCATION_NOTE)).otherwise(F.lit(""))
    return F.concat(F.lit(EXTRACTION_HEAD + schema_json(schema) + EXTRACTION_RULES), content, note)


def judge_prompt(goal: Column, diff: Column) -> Column:
    """One judging prompt per (monitor goal, diff)."""
    return F.concat(F.lit(JUDGE_HEAD), goal, F.lit(JUDGE_MID), diff, F.lit(JUDGE_TAIL))


def prompt_hash(prompt: Column) -> Column:
    """E7 key: SHA-256 hex of the prompt text."""
    return F.sha2(prompt, 256)


def clean_llm_json(raw: Column) -> Column:
    """E3 (text part): drop a leading ```json fence and a trailing fence, trim."""
    s = F.regexp_replace(raw, r"(?i)^```(?:json)?\s*", "")
    s = F.regexp_replace(s, r"\s*```\s*$", "")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def parse_llm_json(raw: Column) -> Column:
    """Variant of the cleaned reply, NULL when it does not parse."""
    return F.try_parse_json(clean_llm_json(raw))


def is_truthy(v: Column) -> Column:
    """JavaScript truthiness of a parsed JSON value (variant): false, 0,
    "" and null are falsy; objects, arrays, other numbers/strings truthy."""
    t = F.to_json(v)
    falsy = t.isin("false", "null", '""') | (t.rlike(r"^-?[0-9.eE+-]+$") & (t.try_cast("double") == 0))
    return F.coalesce(v.isNotNull() & ~falsy, F.lit(False))


def complete(prompts: DataFrame, completions: DataFrame, attempt: int = 1) -> DataFrame:
    """E7 seam: attach the captured reply of ``attempt`` by prompt hash."""
    c = completions.where(F.col("attempt") == attempt).select(
        "prompt_hash", F.col("text").alias("reply"), F.col("error").alias("call_error"),
        F.lit(True).alias("has_reply"))
    return prompts.join(c, "prompt_hash", "left") \
                  .withColumn("has_reply", F.coalesce("has_reply", F.lit(False)))


def retry_prompt(prompt: Column) -> Column:
    """The second prompt - the first one plus the retry instruction."""
    return F.concat(prompt, F.lit(RETRY_SUFFIX))


def retry_failed(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """Parse attempt 1; a null/falsy parse retries once (attempt 2 is the
    reply to the prompt plus the retry instruction; when ``prompts`` carries
    the prompt text, rows that needed a retry get it as ``retry_prompt`` for
    a live caller to complete); a second failure gives 'extraction-failed'
    in ``error`` instead of raising."""
    a1 = complete(prompts, completions, 1).withColumn("data1", parse_llm_json(F.col("reply")))
    ok1 = is_truthy(F.col("data1"))
    a2 = completions.where(F.col("attempt") == 2).select(
        "prompt_hash", F.col("text").alias("reply2"))
    j = a1.join(a2, "prompt_hash", "left")
    data = F.when(ok1, F.col("data1")).otherwise(parse_llm_json(F.col("reply2")))
    out = j.withColumn("data", data).withColumn("attempts", F.when(ok1, 1).otherwise(2))
    if "prompt" in prompts.columns:
        out = out.withColumn("retry_prompt", F.when(~ok1, retry_prompt(F.col("prompt"))))
    failed = ~is_truthy(F.col("data"))
    return out.withColumn("data", F.when(failed, F.lit(None)).otherwise(F.col("data"))) \
              .withColumn("error", F.when(failed, F.lit("extraction-failed"))) \
              .drop("data1", "reply2")


def typed_fields(data: Column, schema: dict[str, str]) -> Column:
    """E5 (extension): one typed column per requested field, NULL on a
    type mismatch; the raw variant stays next to it."""
    return F.struct(*[F.try_variant_get(data, f'$["{k}"]', HINT_TYPES.get(v, "string")).alias(k)
                      for k, v in schema.items()])


def extract_results(pages: DataFrame, completions: DataFrame, schema: dict[str, str],
                    provider: str = DEFAULT_PROVIDER, model: str = DEFAULT_MODEL,
                    extracted_at: str | None = None) -> DataFrame:
    """(url, data, typed, provider, model, extracted_at, error) for
    pages with markdown (output of scrape_pages)."""
    content, truncated = truncate_for_prompt("markdown")
    prompts = pages.select("url", *[c for c in ("page_id",) if c in pages.columns],
                           content.alias("content"), truncated.alias("truncated"))
    prompts = prompts.withColumn("prompt", extraction_prompt(F.col("content"), F.col("truncated"), schema)) \
                     .withColumn("prompt_hash", prompt_hash(F.col("prompt"))).drop("content")
    r = retry_failed(prompts, completions)
    # "now" is always explicit: the caller passes the run's as_of
    ts = F.lit(extracted_at).cast("timestamp_ntz")
    return r.select(*[c for c in ("page_id",) if c in r.columns], "url", "truncated", "prompt_hash", "attempts",
                    F.col("data").cast("string").alias("data"), typed_fields(F.col("data"), schema).alias("typed"),
                    F.lit(provider).alias("provider"), F.lit(model).alias("model"),
                    ts.alias("extracted_at"), "error")
