"""Registry of queries and their DuckDB counterparts."""

from __future__ import annotations

import re

from .views import VIEWS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PARTS: dict[str, str] = dict(VIEWS)
# blocks worth computing once in the oracle statements
KEEP = {"pool", "triple_keys", "hyps", "best_hyp", "plane_points", "refined"}


def part(name: str, text: str) -> None:
    """Name a reusable SQL block for oracle statements."""
    PARTS[name] = text.strip()


def oracle(text: str) -> str:
    """Prefix a statement with the blocks it mentions, in dependency order."""
    order: list[str] = []

    def visit(body: str) -> None:
        for word in re.findall(r"[a-z_][a-z_0-9]*", body):
            if word in PARTS and word not in order:
                visit(PARTS[word])
                if word not in order:
                    order.append(word)

    visit(text)
    if not order:
        return text.strip()
    blocks = ",\n".join(f"{name} as {'materialized ' if name in KEEP else ''}({PARTS[name]})" for name in order)
    text = text.strip()
    if text.lower().startswith("with recursive"):
        return f"with recursive {blocks},\n{text[len('with recursive'):].strip()}"
    if text.lower().startswith("with"):
        return f"with {blocks},\n{text[len('with'):].strip()}"
    return f"with {blocks}\n{text}"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return wrap
