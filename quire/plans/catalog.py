"""Registry of named queries (one per SURVEY §2 operator or report).

Each query is a function (spark, sf_dir) -> DataFrame over the driver
tables; `oracle` is an equivalent DuckDB SQL string over the same tables
(or None where SQL cannot express the operator, see README).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ops: str


REGISTRY: dict[str, Query] = {}


def query(name: str, ops: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the plan modules registers their queries.
    from quire.plans import (q_text, q_pii, q_chunks, q_vectors, q_access, q_audit, q_gate, q_requests, q_search, q_stores)  # noqa: F401
    return REGISTRY
