"""Relational operators over tables whose columns have internal names.

A scan gives its columns unique internal names (``l0``, ``l1``, ... and ``r0``, ...), so
public names may repeat, hold dots or differ in case only.  Everything here is a lazy DataFrame
expression; Catalyst prunes columns, pushes filters into the files and picks join
strategies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument, NotFound
from ..functions.types import NUMERIC, literal_for, of_spark
from ..plans import ast


@dataclass(frozen=True)
class Field:
    """A column of a scan: its table, public name, internal name and type."""

    table: str
    name: str
    internal: str
    kind: str | None
    spark_type: T.DataType


@dataclass(frozen=True)
class Scan:
    """A DataFrame of internal names and what they stand for."""

    df: DataFrame
    fields: tuple[Field, ...]


def scan(df: DataFrame, table: str, prefix: str, hidden: tuple[str, ...] = ()) -> Scan:
    """A table's columns under internal names, without the hidden ones."""
    kept = [f for f in df.schema.fields if f.name not in hidden]
    fields = tuple(Field(table, f.name, f"{prefix}{k}", of_spark(f.dataType), f.dataType) for k, f in enumerate(kept))
    return Scan(df.select(*[F.col(f"`{f.name}`").alias(x.internal) for f, x in zip(kept, fields, strict=True)]), fields)


def resolve(ref: ast.ColumnRef, fields: tuple[Field, ...]) -> Field:
    """The field that a reference means; names are case-sensitive."""
    tables = {f.table for f in fields}
    if ref.table is not None and ref.table not in tables:
        raise NotFound(f"table {ref.table} isn't in the query")
    found = [f for f in fields if f.name == ref.name and ref.table in (None, f.table)]
    if not found:
        raise NotFound(f"column {ref.name} not found")
    if len({f.table for f in found}) > 1:
        raise InvalidArgument(f"column {ref.name} is ambiguous")
    return found[0]


def compare(field: Field, op: str, value: ast.Literal) -> Column:
    """A comparison with a literal; one of another kind never matches."""
    lit = literal_for(value, field.kind, field.spark_type) if field.kind else None
    if lit is None:
        return F.lit(False)
    c = F.col(field.internal)
    return {"=": c == lit, "!=": c != lit, "<": c < lit, "<=": c <= lit, ">": c > lit, ">=": c >= lit}[op]


def predicate(expr: ast.Expr, fields: tuple[Field, ...]) -> Column:
    """A WHERE expression as a Column; a null makes a comparison not match."""
    if isinstance(expr, ast.BoolOp):
        left, right = predicate(expr.left, fields), predicate(expr.right, fields)
        return left & right if expr.op == "AND" else left | right
    field = resolve(expr.column, fields)
    if isinstance(expr, ast.Compare):
        return compare(field, expr.op, expr.value)
    literals = [x for v in expr.values if field.kind and (x := literal_for(v, field.kind, field.spark_type)) is not None]
    return F.col(field.internal).isin(*literals) if literals else F.lit(False)


def equi_join(left: Scan, right: Scan, a: ast.ColumnRef, b: ast.ColumnRef) -> Scan:
    """Inner join on one key of either side, in any order; a string meets a number as that number's text."""
    both = left.fields + right.fields

    def side(ref: ast.ColumnRef) -> Field:
        try:
            return resolve(ref, both)
        except InvalidArgument as e:
            raise NotFound(str(e)) from e

    x, y = side(a), side(b)
    if (x in left.fields) == (y in left.fields):
        raise InvalidArgument("both sides of ON are of one table")
    if x not in left.fields:
        x, y = y, x
    p, q = F.col(x.internal), F.col(y.internal)
    if x.kind != y.kind and "VARCHAR" in (x.kind, y.kind):
        p, q = p.cast("string"), q.cast("string")
    return Scan(left.df.join(right.df, p == q, "inner"), both)


def aggregate_name(ref: ast.ColumnRef) -> str:
    inner = f"{ref.table}.{ref.name}" if ref.table else ref.name
    return f"{ref.func}({inner})"


def aggregate(ref: ast.ColumnRef, fields: tuple[Field, ...], alone: bool) -> Column:
    """One aggregate; ``alone``: without GROUP BY, where no rows give 0."""
    if ref.name == "*":
        return F.count(F.lit(1))
    field = resolve(ref.plain, fields)
    c = F.col(field.internal)
    if ref.func == "COUNT":
        return F.count(c)
    if ref.func in ("SUM", "AVG"):
        if field.kind not in NUMERIC:
            raise InvalidArgument(f"{ref.func} takes a number, {field.name} is none")
        out = (F.sum if ref.func == "SUM" else F.avg)(c.cast("double"))
        return F.coalesce(out, F.lit(0.0)) if alone else out
    out = (F.min if ref.func == "MIN" else F.max)(c)
    return F.coalesce(out, F.lit(0).cast(field.spark_type)) if alone and field.kind in NUMERIC else out


def window_of(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
