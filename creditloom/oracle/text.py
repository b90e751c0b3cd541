"""Pieces the SQL twins are put together from."""

from __future__ import annotations

from creditloom.functions.rounding import grid
from creditloom.sources.mapped import oracle_view

def settled(sql: str, *keys: str) -> str:
    """All columns but ``keys`` as doubles, rounded to ``DIGITS`` significant digits.

    Sums of doubles depend on the order of addition, so the last bits of two
    engines differ.
    """
    x = f"cast(COLUMNS(* EXCLUDE ({', '.join(keys)})) as double)"
    lead = ", ".join(keys)
    return f"SELECT {lead}, {grid(x)} FROM ({sql}) s"


def lines(block: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" = ", 1)) for line in block.strip().splitlines()]


def columns(block: str) -> str:
    return ", ".join(f"{formula} AS {name}" for name, formula in lines(block))


def names(*blocks: str) -> str:
    return ", ".join(name for block in blocks for name, _ in lines(block))


def with_views(views: list[str], sql: str) -> str:
    """``sql`` with the derived tables it names as leading common table expressions."""
    body = ", ".join(f"{name} AS ({oracle_view(name)})" for name in views)
    return f"WITH {body}, {sql}" if sql.startswith("_") else f"WITH {body} {sql}"


def grouped(source: str, key: str, block: str, where: str | None = None) -> str:
    condition = f" WHERE {where}" if where else ""
    return f"SELECT {key}, {columns(block)} FROM {source}{condition} GROUP BY {key}"


def joined(key: str, *parts: str) -> str:
    """First part left-joined with the others on ``key``."""
    out = f"SELECT * FROM ({parts[0]}) p0"
    for i, part in enumerate(parts[1:], start=1):
        out += f" LEFT JOIN ({part}) p{i} USING ({key})"
    return out


def extended(sql: str, block: str) -> str:
    """``sql`` with columns computed from its own."""
    return f"SELECT *, {columns(block)} FROM ({sql}) e"


def fully_joined(key: str, *parts: str) -> str:
    out = f"SELECT * FROM ({parts[0]}) p0"
    for i, part in enumerate(parts[1:], start=1):
        out += f" FULL JOIN ({part}) p{i} USING ({key})"
    return out
