"""Registered queries: a name, a function of (spark, sf_dir), and the same result in SQL where SQL can tell it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .roles import ROLE_SQL, Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_roles(names: str, body: str) -> str:
    """``body`` behind the common table expressions of the named roles and of those they rest on."""
    needed: list[str] = []

    def add(name: str):
        for other in ROLE_SQL[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        add(name)
    head = ",\n".join(f"{n} AS ({ROLE_SQL[n][1]})" for n in needed)
    body = body.strip()
    if not head:
        return body
    recursive = body.startswith("WITH RECURSIVE ")
    if body.startswith("WITH "):
        return f"WITH {'RECURSIVE ' * recursive}{head},\n{body.removeprefix('WITH ').removeprefix('RECURSIVE ')}"
    return f"WITH {head}\n{body}"


def query(name: str, roles: str = "", sql: str | None = None):
    """Register ``f(r)``, r being the Roles of the tables, under ``name`` with its SQL."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if sql:
            SQL[name] = with_roles(roles, sql)
        return f

    return register
