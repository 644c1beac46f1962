"""Expressions written once and used by Spark and by the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A level is a set of columns computed from those before; later levels see earlier ones.
Levels = list[dict[str, str]]


def apply(df: DataFrame, levels: Levels, drop: bool = True) -> DataFrame:
    """Add the columns of all levels; with ``drop``, helper columns (names with a leading underscore) go at the end."""
    for level in levels:
        df = df.selectExpr("*", *(f"{text} AS {name}" for name, text in level.items()))
    return df.drop(*(n for level in levels for n in level if n.startswith("_"))) if drop else df


def sql(source: str, levels: Levels) -> str:
    """The same as nested SQL over ``source`` (a table name or a query in brackets)."""
    for k, level in enumerate(levels):
        source = f"(SELECT *, {', '.join(f'{text} AS {name}' for name, text in level.items())} FROM {source} AS s{k})"
    return source


def ctes(name: str, source: str, levels: Levels) -> str:
    """The same as materialised common table expressions, the last one called ``name``; no engine then repeats a level."""
    out = []
    for k, level in enumerate(levels):
        mine = name if k == len(levels) - 1 else f"{name}{k}"
        out.append(f"{mine} AS MATERIALIZED (SELECT *, {', '.join(f'{text} AS {column}' for column, text in level.items())} FROM {source} AS s{k})")
        source = mine
    return ",\n".join(out)


def settled(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, whose rows ``keys`` tell apart and are already grouped by, behind an aggregate of one row a group.

    A filter on a column of many levels would be pushed below all of them, each reference replaced by its expression, which
    grows exponentially; it isn't pushed below an aggregate.  No exchange is added.
    """
    return df.groupBy(*keys).agg(*(F.first(c).alias(c) for c in df.columns if c not in keys))
