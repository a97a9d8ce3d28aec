"""webloom: a Spark-native web corpus engine.

Captured page responses in, tables out: page extraction (title, links,
markdown), URL canonicalisation and filtering, bounded multi-job crawls,
change monitoring with line diffs, LLM prompt / reply batches and
operational statistics, as DataFrame, SQL and Structured Streaming code.
See README.md for the layout and ``__spark_entry__.py`` for the registered
queries.
"""

__version__ = "0.1.0"
