"""Named queries with the operators they cover and their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stipendia.plans.mapping import VIEWS, Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame``; ``sql`` may name entity views."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, with_views(sql) if sql else None)
        return build

    return add


def with_views(sql: str, views: dict[str, str] | None = None) -> str:
    """Prefix the entity views a statement uses, dependencies first."""
    views = VIEWS if views is None else views
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_]+\b", text)):
            if word in views and word not in ordered:
                visit(views[word])
                ordered.append(word)

    visit(sql)
    if not ordered:
        return sql.strip()
    head = ", ".join(f"{n} AS ({views[n]})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
