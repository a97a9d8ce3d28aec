"""Extension seams: caller-supplied fetch / complete functions.

The engine never opens a network connection. A caller that has live
access passes a plain Python function; Spark runs it inside tasks over
Arrow batches with ``mapInPandas``, so fetching or model calls are spread
over the cluster like any other partitioned work, and the result is a
captures / completions table with the declared schema that the operators
then join exactly like captured inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .. import schemas


def captures_from(urls: DataFrame, fetch_fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run ``fetch_fn`` over batches of (url, ...) rows; it must return the
    columns of ``schemas.RESPONSES``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fetch_fn(b)
    return urls.mapInPandas(run, schemas.RESPONSES)


def completions_from(prompts: DataFrame, complete_fn: Callable[[str], tuple[str | None, str | None]],
                     attempt: int = 1) -> DataFrame:
    """Call ``complete_fn(prompt) -> (text, error)`` for each (prompt_hash,
    prompt) row; returns rows of ``schemas.COMPLETIONS``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [complete_fn(p) for p in b["prompt"]]
            yield pd.DataFrame({"prompt_hash": b["prompt_hash"], "attempt": attempt,
                                "text": [o[0] for o in out], "error": [o[1] for o in out]})
    return prompts.select("prompt_hash", "prompt").mapInPandas(run, schemas.COMPLETIONS)
