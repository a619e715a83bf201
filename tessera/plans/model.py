"""What the parser makes of a query, and the errors of this engine."""

from __future__ import annotations

from dataclasses import dataclass


class ParseError(ValueError):
    """The text is not a query of the dialect."""


class AnalysisError(ValueError):
    """The query names something that is not there, or compares what can't be compared."""


@dataclass(frozen=True)
class Attr:
    table: str
    column: str

    def __str__(self) -> str:
        return f"{self.table}.{self.column}"


@dataclass(frozen=True)
class Literal:
    """The text between the quotes, as written; the compared column gives its type."""

    text: str


@dataclass(frozen=True)
class Cond:
    left: Attr
    op: str
    right: Attr | Literal

    def tables(self) -> frozenset[str]:
        return frozenset({self.left.table} | ({self.right.table} if isinstance(self.right, Attr) else set()))

    def __str__(self) -> str:
        return f"{self.left} {self.op} " + (f'"{self.right.text}"' if isinstance(self.right, Literal) else str(self.right))


@dataclass(frozen=True)
class Query:
    """``select`` is empty for ``*``."""

    select: tuple[Attr, ...]
    tables: tuple[str, ...]
    where: tuple[Cond, ...] = ()
    order_by: tuple[Attr, ...] = ()
