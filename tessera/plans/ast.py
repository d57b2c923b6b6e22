"""Statements of the SQL dialect as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field

Literal = int | float | str | bool

#: Aggregates by keyword, and comparison operators.
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class ColumnRef:
    """A column, perhaps with its table, perhaps under an aggregate; ``name`` is ``*`` for COUNT(*)."""

    name: str
    table: str | None = None
    func: str | None = None

    @property
    def plain(self) -> ColumnRef:
        return ColumnRef(self.name, self.table)


@dataclass(frozen=True)
class Compare:
    column: ColumnRef
    op: str
    value: Literal


@dataclass(frozen=True)
class InList:
    column: ColumnRef
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class BoolOp:
    """``AND`` or ``OR`` of two predicates."""

    op: str
    left: Expr
    right: Expr


Expr = Compare | InList | BoolOp


@dataclass(frozen=True)
class Join:
    table: str
    left: ColumnRef
    right: ColumnRef


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[ColumnRef, ...] = ()  # empty: all
    join: Join | None = None
    where: Expr | None = None
    group_by: tuple[ColumnRef, ...] = ()
    order_by: ColumnRef | None = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[Literal, ...], ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class Update:
    table: str
    column: str
    value: Literal
    where: Expr | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str], ...] = field(default=())


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class Vacuum:
    table: str


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
class Backup:
    path: str


@dataclass(frozen=True)
class SetBackup:
    """``option`` is INTERVAL or RETENTION, in seconds."""

    option: str
    seconds: int


Statement = Select | Insert | Delete | Update | CreateTable | CreateIndex | Vacuum | Begin | Commit | Rollback | Backup | SetBackup
