"""Registered queries and their SQL checks."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tapeloom.plans.market import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """SQL of a derived table that checks may name; later views may use earlier ones."""
    assert name not in VIEWS, name
    VIEWS[name] = sql


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, decimals as doubles, so that any client can compare rows."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            col = col.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DecimalType):
            col = col.cast("double")
        out.append(col.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, shared: bool = True):
    """Register a query. ``shared=False`` is for those that use the daily bars in one branch only."""
    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Market(spark, sf_dir, shared)))
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return wrap


def check_sql(name: str) -> str:
    """The check with the views it needs as common table expressions."""
    body = CHECKS[name]
    need: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[a-z_][a-z0-9_]*", todo.pop()))
        for v in words & VIEWS.keys() - need:
            need.add(v)
            todo.append(VIEWS[v])
    ctes = [f"{v} AS (\n{VIEWS[v].strip()}\n)" for v in VIEWS if v in need]
    body = body.strip()
    if not ctes:
        return body
    own = re.match(r"with\s+(recursive\s+)?", body)
    tail = ",\n" + body[own.end():] if own else "\n" + body
    return "WITH RECURSIVE " + ",\n".join(ctes) + tail
