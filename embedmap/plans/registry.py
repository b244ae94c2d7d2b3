"""Named queries over the provided tables, each with its SQL check where one exists."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from embedmap.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    """A named common table expression for the check queries; it may use other parts."""
    PARTS[name] = sql


def with_parts(body: str) -> str:
    """Prefix ``body`` with every part it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in PARTS and word not in ordered:
                visit(PARTS[word])
                ordered.append(word)

    visit(body)
    ctes = ", ".join(f"{name} AS ({PARTS[name]})" for name in ordered)
    if not ctes:
        return body
    own = re.match(r"\s*WITH\s", body)
    return f"WITH {ctes}, {body[own.end():]}" if own else f"WITH {ctes} {body}"


def query(name: str, check: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return fn(spark, sf)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if check:
            CHECKS[name] = with_parts(check)
        return fn

    return wrap
