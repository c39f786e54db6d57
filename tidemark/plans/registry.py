"""Query registry: one output contract shared by the Spark plan and its oracle SQL.

A contract is a list of ``column[:rule]``: a digit rounds a double to that many
places, ``b`` casts to BIGINT, ``i`` to INT, ``s`` to text; no rule passes the
column through.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.stage import new_run

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    contract: tuple[tuple[str, str], ...]
    build: Builder
    oracle: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        new_run()
        df = self.build(spark, sf_dir)
        return df.select(*[_spark_col(c, rule) for c, rule in self.contract])


REGISTRY: dict[str, Query] = {}
CTES: dict[str, str] = {}


def _spark_col(name: str, rule: str):
    c = F.col(name)
    if rule.isdigit():
        return F.round(c.cast("double"), int(rule)).alias(name)
    kind = {"b": "bigint", "i": "int", "s": "string", "": None}[rule]
    return c.cast(kind).alias(name) if kind else c


def _sql_col(name: str, rule: str) -> str:
    if rule.isdigit():
        return f"round(CAST({name} AS DOUBLE), {rule}) + 0.0 AS {name}"
    kind = {"b": "BIGINT", "i": "INTEGER", "s": "VARCHAR", "": None}[rule]
    return f"CAST({name} AS {kind}) AS {name}" if kind else name


def parse_contract(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((c, rule) for c, _, rule in (item.partition(":") for item in text.split()))


def register(name: str, contract: str, sql: str | None = None):
    """Register a builder under ``name`` with the oracle's FROM-able query ``sql``."""

    def wrap(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise KeyError(f"{name} registered twice")
        cols = parse_contract(contract)
        REGISTRY[name] = Query(cols, fn, sql and oracle_query(cols, sql))
        return fn

    return wrap


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def twin(prefix: str, start: str, names: list[str]) -> None:
    """The named building blocks once more, over ``{prefix}{start}`` instead of ``start``."""
    for name in names:
        sql = CTES[name]
        for n in (start, *names):
            sql = re.sub(rf"\b{n}\b", prefix + n, sql)
        cte(prefix + name, sql)


def _needed(sql: str, seen: list[str], path: tuple[str, ...] = ()) -> list[str]:
    """Names of the CTEs a query uses, dependencies first; a recursive CTE may name itself."""
    for word in re.findall(r"\b[a-z_0-9]+\b", sql):
        if word in CTES and word not in seen and word not in path:
            _needed(CTES[word], seen, (*path, word))
            seen.append(word)
    return seen


def oracle_query(cols: tuple[tuple[str, str], ...], sql: str) -> str:
    needed = _needed(sql, [])
    recursive = "RECURSIVE " if "UNION ALL" in sql.upper() or any("UNION ALL" in CTES[n].upper() for n in needed) else ""
    head = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in needed)
    body = f"SELECT {', '.join(_sql_col(c, r) for c, r in cols)}\nFROM (\n{sql.strip()}\n) AS result"
    return f"WITH {recursive}{head}\n{body}" if needed else body
