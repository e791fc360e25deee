"""All registered queries."""

from __future__ import annotations

from hearsay.plans import (  # noqa: F401
    aggregate_queries, boosting_queries, coverage_queries, evaluation_queries, model_queries, network_queries,
    source_queries, text_queries)
from hearsay.plans.registry import ORACLES, QUERIES, ROWS


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)


def rows():
    return dict(ROWS)
