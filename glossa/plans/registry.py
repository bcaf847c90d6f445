"""All registered queries of the core library, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossa.plans import additions, corpus, events, further, indexes, measures, models, pages, secondary, textual, web

_PARTS = (corpus, textual, pages, models, events, secondary, further, additions, indexes, measures, web)
FLAGSHIP = "corpus_stats"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
