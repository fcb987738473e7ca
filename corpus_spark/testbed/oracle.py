"""Assembles checking queries: named common table expressions, pulled in by need."""

from __future__ import annotations

import re

from corpus_spark.testbed import adapters

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _body(name: str) -> str:
    return adapters.duck_text(name) if name in adapters.TABLES else CTES[name]


def _needs(sql: str) -> list[str]:
    known = set(adapters.TABLES) | set(CTES)
    bare = re.sub(r"'[^']*'", "''", sql)  # words inside literals name nothing
    return [w for w in dict.fromkeys(re.findall(r"\b[a-z][a-z0-9_]*\b", bare)) if w in known]


def duck(sql: str) -> str:
    """`sql` with a WITH clause carrying every derived table it names, in dependency order."""
    ordered: list[str] = []
    open_names: set[str] = set()

    def visit(name: str) -> None:
        if name in ordered or name in open_names:
            return
        open_names.add(name)
        for need in _needs(_body(name)):
            if need != name:
                visit(need)
        ordered.append(name)

    for name in _needs(sql):
        visit(name)
    if not ordered:
        return sql
    parts = ", ".join(f"{n} AS MATERIALIZED ({_body(n)})" for n in ordered)
    if sql.startswith("WITH "):
        return f"WITH {parts}, {sql[5:]}"
    return f"WITH {parts} {sql}"
