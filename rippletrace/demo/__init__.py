"""Every operator run over the derived fleet, with the same question in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from . import changes, corpus, dirty, graph, history, views

    out: dict[str, Query] = {}
    for module in (graph, views, history, corpus, dirty, changes):
        out.update(module.QUERIES)
    return out


def all_sql() -> dict[str, str]:
    from . import changes, corpus, dirty, graph, history, views

    out: dict[str, str] = {}
    for module in (graph, views, history, corpus, dirty, changes):
        out.update(module.SQL)
    return out
