"""Registered queries of the library and their SQL twins; the modules of `plans` add to both."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a (spark, sf_dir) -> DataFrame function under `name`, with its SQL twin."""

    def add(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = _plain_counts(sql)
        return function

    return add


def _plain_counts(sql: str) -> str:
    """count_if(..) as BIGINT, which is what Spark's is."""
    out, at = "", 0
    while (found := sql.find("count_if(", at)) >= 0:
        end, depth = found + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:found] + "CAST(" + sql[found:end] + " AS BIGINT)"
        at = end
    return out + sql[at:]


def load() -> None:
    """Import every module that registers queries."""
    from tidewatch.plans import adapter_queries, audit_queries, correlation_queries, detail_queries, ingest_queries, leakage_queries, report_queries, scoring_queries, stream_queries, text_queries  # noqa: F401
