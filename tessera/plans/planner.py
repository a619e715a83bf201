"""A query as a DataFrame: names are resolved, literals typed, filters put on their tables, and tables joined along the
conditions. Pushdown, pruning, join order and methods are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tessera.functions.types import kind, literal
from tessera.operators import relational
from tessera.plans.model import AnalysisError, Attr, Cond, Literal, Query


@dataclass(frozen=True)
class Planned:
    """``attrs`` says which attribute each column of ``rows`` is, and ``fields`` how it is declared."""

    attrs: tuple[Attr, ...]
    fields: tuple[T.StructField, ...]
    rows: DataFrame
    shape: str


def names(attrs: tuple[Attr, ...]) -> list[str]:
    """The bare column name where only one column has it, else T_c; a repeated attribute is numbered from its second, past
    names that others have.
    """
    bare = Counter(a.column for a in attrs)
    first = {a: a.column if bare[a.column] == 1 else f"{a.table}_{a.column}" for a in attrs}
    used, given, out = Counter(first.values()), set(), []
    for a in attrs:
        name, n = first[a], 1
        while name in given or (n > 1 and used[name]):
            n += 1
            name = f"{first[a]}_{n}"
        given.add(name)
        out.append(name)
    return out


class _Names:
    def __init__(self, query: Query, tables: Mapping[str, DataFrame]):
        if missing := [t for t in query.tables if t not in tables]:
            raise AnalysisError(f"no table {missing[0]!r}")
        if twice := [t for t, n in Counter(query.tables).items() if n > 1]:
            raise AnalysisError(f"table {twice[0]!r} stands twice in FROM")
        self.fields = {Attr(t, f.name): f for t in query.tables for f in tables[t].schema.fields}

    def field(self, attr: Attr) -> T.StructField:
        if attr not in self.fields:
            raise AnalysisError(f"no column {attr} in the tables of FROM")
        return self.fields[attr]

    def check(self, cond: Cond) -> None:
        left = self.field(cond.left)
        if isinstance(cond.right, Literal):
            literal(cond.right.text, left)
        elif kind(left) != kind(self.field(cond.right)):
            raise AnalysisError(f"{cond}: {kind(left)} does not compare with {kind(self.field(cond.right))}")

    def key(self, left: Attr, right: Attr) -> tuple[Column, Column] | None:
        """The two columns as ones of a type, so that equal values hash alike; nothing for types that may not."""
        a, b = self.fields[left], self.fields[right]
        what = {"INTEGER": "bigint", "TIME": "bigint", "REAL": "double"}.get(kind(a))
        if what:
            return relational.column(left).cast(what), relational.column(right).cast(what)
        return (relational.column(left), relational.column(right)) if a.dataType == b.dataType == T.StringType() else None


def plan(query: Query, tables: Mapping[str, DataFrame], join_method: str | None = None, theta: str = "sql") -> Planned:
    """``theta="equality"`` takes every comparison between columns of different tables for ``=``."""
    if theta not in ("sql", "equality"):
        raise AnalysisError(f"theta is 'sql' or 'equality', not {theta!r}")
    known = _Names(query, tables)
    for cond in query.where:
        known.check(cond)
    attrs = query.select or tuple(known.fields)
    fields = tuple(known.field(a) for a in attrs)
    for a in query.order_by:
        known.field(a)

    used = {*attrs, *query.order_by, *(a for c in query.where for a in (c.left, c.right) if isinstance(a, Attr))}
    sides = {t: relational.scan(tables[t], t, [a.column for a in known.fields if a in used and a.table == t]) for t in query.tables}
    shapes = {t: t for t in query.tables}
    for cond in query.where:
        if len(cond.tables()) == 1:
            t = cond.left.table
            right = literal(cond.right.text, known.field(cond.left)) if isinstance(cond.right, Literal) else relational.column(cond.right)
            sides[t] = relational.select(sides[t], relational.column(cond.left), cond.op, right)
            shapes[t] = f"Select({shapes[t]} [{cond}])"

    pending = [c for c in query.where if len(c.tables()) == 2]
    joined, left = {query.tables[0]}, list(query.tables[1:])
    rows, shape = sides[query.tables[0]], shapes[query.tables[0]]
    while left:
        t = next((t for t in left if any(t in c.tables() and c.tables() - {t} <= joined for c in pending)), left[0])
        left.remove(t)
        joined.add(t)
        on = [c for c in pending if c.tables() <= joined]
        pending = [c for c in pending if c not in on]
        pairs = [(relational.column(c.left), c.op if theta == "sql" else "=", relational.column(c.right)) for c in on]
        keys = [known.key(*((c.left, c.right) if c.right.table == t else (c.right, c.left))) for c, (_, op, _) in zip(on, pairs, strict=True) if op == "="]
        bounds = [(a, op, b) if c.right.table == t else (b, relational.MIRROR[op], a) for c, (a, op, b) in zip(on, pairs, strict=True) if op in relational.MIRROR]
        rows = relational.join(rows, sides[t], pairs, join_method, keys=[k for k in keys if k], bound=next(iter(bounds), None))
        shape = f"Join({shape} [{', '.join(map(str, on))}] {shapes[t]})"
    if query.order_by:
        rows, shape = relational.order_by(rows, query.order_by), f"OrderBy({shape} [{', '.join(map(str, query.order_by))}])"
    rows, shape = relational.project(rows, attrs, names(attrs)), f"Project({shape} [{', '.join(map(str, attrs))}])"
    return Planned(tuple(attrs), fields, rows, shape)
