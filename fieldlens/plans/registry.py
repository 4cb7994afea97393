"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldlens.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# tables only the checking SQL needs: name -> (tables it needs, SQL)
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {}


class Tables:
    """Engine tables of one data folder, read on first use: ``t.tracks``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = adapters.load(self.spark, self.sf_dir, name)
        setattr(self, name, df)
        return df


def derive(name: str, needs: tuple[str, ...], sql: str) -> None:
    DERIVED[name] = (needs, " ".join(sql.split()))


def renamed(text: str, names: dict[str, str]) -> str:
    """``text`` with other tables; a name behind a dot or before a bracket is a column, a text or a function."""
    return re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {names.get(m[2], m[2])}", text)


def derive_as(prefix: str, names: dict[str, str], *tables: str) -> None:
    """Derived tables once more, over other tables than those they name; later ones read the earlier ones."""
    names = dict(names)
    for table in tables:
        needs, text = DERIVED[table]
        DERIVED[prefix + table] = (tuple(names.get(n, n) for n in needs), renamed(text, names))
        names[table] = prefix + table


def query(
    name: str, plan: Callable[[Tables], DataFrame], needs: tuple[str, ...] = (), sql: str | None = None, swap: dict[str, str] | None = None
) -> None:
    """Register ``plan`` and, if it has one, the SQL over the tables in ``needs``.

    ``swap`` lets derived tables read other engine tables than those they name.
    """
    QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = _with_tables(needs, " ".join(sql.split()), swap or {})


def _with_tables(needs: tuple[str, ...], body: str, swap: dict[str, str]) -> str:
    def other(text: str) -> str:
        return re.sub(r"\w+", lambda m: swap.get(m[0], m[0]), text)

    known = {**adapters.ADAPTERS, **{n: (tuple(swap.get(x, x) for x in from_), other(text)) for n, (from_, text) in DERIVED.items()}}
    order: list[str] = []

    def visit(name: str) -> None:
        for need in known[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    views = {t: t for t in adapters.SOURCES}
    parts = []
    for name in order:
        text = known[name][1]
        parts.append(f"{name} AS ({text.format(**views) if name in adapters.ADAPTERS else text})")
    return f"WITH {', '.join(parts)} {body}" if parts else body


def rounded(expr: str, digits: int = 0) -> str:
    """SQL for half-even rounding, as ``scale.pyround``."""
    if digits == 0:
        return f"round_even({expr}, 0)"
    return f"round_even(({expr}) * CAST({10**digits} AS DOUBLE), 0) / CAST({10**digits} AS DOUBLE)"
