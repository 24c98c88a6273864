"""Syntax tree of the SQL dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any  # None, bool, int, float, str or tuple of floats


@dataclass(frozen=True)
class Column:
    name: str
    table: str | None = None

    @property
    def text(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Aggregate:
    kind: str  # COUNT, SUM, AVG, MIN, MAX
    column: Column | None  # None: COUNT(*)

    @property
    def text(self) -> str:
        return f"{self.kind}({self.column.text if self.column else '*'})"


@dataclass(frozen=True)
class Binary:
    op: str  # = != < > <= >= LIKE AND OR
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    operand: Any


@dataclass(frozen=True)
class IsNull:
    operand: Any
    negated: bool = False


@dataclass(frozen=True)
class In:
    operand: Any
    choices: Any  # tuple of expressions, or Select
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    query: "Select"
    negated: bool = False


@dataclass(frozen=True)
class Scalar:
    query: "Select"


@dataclass(frozen=True)
class SimilarTo:
    column: Column
    text: str


@dataclass(frozen=True)
class Item:
    value: Any  # Column, Aggregate, Literal or "*"
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # INNER, LEFT, RIGHT
    table: str
    alias: str | None
    left: Column
    right: Column


@dataclass(frozen=True)
class Order:
    value: Any  # Column or Aggregate
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    alias: str | None = None
    joins: tuple[Join, ...] = ()
    where: Any = None
    group_by: tuple[Column, ...] = ()
    having: Any = None
    order_by: tuple[Order, ...] = ()
    similar_to: str | None = None
    shuffled: bool = False
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class ColumnType:
    name: str
    kind: str  # int, float, text, bool, embedding
    dim: int | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnType, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable:
    table: str
    if_exists: bool = False


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: ColumnType


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str


@dataclass(frozen=True)
class RenameColumn:
    table: str
    old: str
    new: str


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Literal], ...]
    where: Any = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any = None


@dataclass(frozen=True)
class Begin:
    pass


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Rollback:
    pass


@dataclass(frozen=True)
class Vacuum:
    table: str | None = None


def walk(node: Any):
    """Every expression node below and including ``node``, not entering subqueries."""
    yield node
    parts: list[Any] = []
    if isinstance(node, Binary):
        parts = [node.left, node.right]
    elif isinstance(node, (Not, IsNull)):
        parts = [node.operand]
    elif isinstance(node, In):
        parts = [node.operand, *([] if isinstance(node.choices, Select) else node.choices)]
    for p in parts:
        yield from walk(p)


__all__ = [n for n in dir() if n[0].isupper()] + ["walk", "field"]
