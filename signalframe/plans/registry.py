"""Named queries: a Spark builder and, where SQL can say it, the DuckDB text."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(T)``; ``T`` gives the tables of one scale-factor folder."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def build(spark, sf_dir):
            from .fixtures import Tables

            return fn(Tables(spark, sf_dir))

        QUERIES[name] = Query(name, build, sql)
        return fn

    return add


def scratch(spark, what: str) -> str:
    """A new path in the shared folder, for what a query writes before it reads it back."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


# Results are rounded in both engines because summation order differs. The
# offset moves exact decimal ties off the rounding boundary, the final +0.0
# turns a negative zero into zero.
_NUDGE = 1.7e-9


def rnd(c, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(_NUDGE), digits) + F.lit(0.0)


def sql_rnd(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::double + 1.7e-9::double, {digits}) + 0.0::double)"


def sql_uniform(seed, *exprs: str) -> str:
    """DuckDB form of functions.hashing.uniform."""
    return f"(('0x' || substr({sql_digest(seed, *exprs)}, 1, 16))::ubigint::double / pow(2::double, 64))"


def sql_normal(seed, *exprs: str) -> str:
    """DuckDB form of element i of functions.hashing.normals; the last expression is i."""
    *keys, i = exprs
    text = sql_digest(seed, *keys, f"({i}) // 4")
    part = lambda k: f"(('0x' || substr({text}, ({k}) * 16 + 1, 16))::ubigint::double / pow(2::double, 64))"
    pair = f"(({i}) % 4 // 2 * 2)"
    angle = f"2.0::double * pi() * {part(pair + ' + 1')}"
    return f"(sqrt(-2.0::double * ln(greatest({part(pair)}, 1e-12::double))) * case when ({i}) % 2 = 0 then cos({angle}) else sin({angle}) end)"


def sql_digest(seed, *exprs: str) -> str:
    key = " || '::' || ".join([f"'{seed}'"] + [f"({e})::varchar" for e in exprs])
    return f"sha256({key})"


def sql_values(name: str, columns, rows) -> str:
    """A CTE of constant rows."""

    def lit(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}::double"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) as (values {body})"


def sql_case(expr: str, mapping: dict) -> str:
    """Constant lookup as CASE, null when absent."""
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "case " + expr + " " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in mapping.items()) + " end"
