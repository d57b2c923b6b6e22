"""SELECT to one lazy DataFrame.

Steps: scan, join, filter, group, order, offset, limit, and last the projection to public
names, so that an ordering column needn't be selected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators import relational as rel
from . import ast


def compile_select(stmt: ast.Select, table: Callable[[str], DataFrame], hidden: tuple[str, ...] = ("_seq", "_rid"), ordered: bool = False) -> DataFrame:
    """The statement over the tables that ``table`` gives by name.

    With ``ordered``, rows of a managed table without ORDER BY come in insertion order.
    """
    source = table(stmt.table)
    own = rel.scan(source, stmt.table, "l", hidden)
    by_insertion = ordered and stmt.join is None and stmt.order_by is None and set(hidden) <= set(source.columns)
    if by_insertion:
        own = rel.Scan(source.select(*[F.col(f"`{f.name}`").alias(f.internal) for f in own.fields], *hidden), own.fields)
    if stmt.join:
        if stmt.join.table == stmt.table:
            raise InvalidArgument("a table can't be joined with itself")
        own = rel.equi_join(own, rel.scan(table(stmt.join.table), stmt.join.table, "r", hidden), stmt.join.left, stmt.join.right)
    df, fields = own.df, own.fields
    if stmt.where is not None:
        df = df.filter(rel.predicate(stmt.where, fields))
    if stmt.group_by or any(c.func for c in stmt.columns):
        return _grouped(stmt, df, fields)
    if stmt.order_by is not None:
        if stmt.order_by.func:
            raise InvalidArgument("ORDER BY an aggregate needs GROUP BY")
        key = F.col(rel.resolve(stmt.order_by, fields).internal)
        df = df.orderBy(key.desc() if stmt.descending else key.asc())
    elif by_insertion:
        df = df.orderBy(*hidden)
    df = rel.window_of(df, stmt.limit, stmt.offset)
    if not stmt.columns:
        chosen = [(f, f"{f.table}.{f.name}" if stmt.join else f.name) for f in fields]
    else:
        chosen = [(rel.resolve(c, fields), f"{c.table}.{c.name}" if stmt.join and c.table else c.name) for c in stmt.columns]
    return df.select(*[F.col(f.internal).alias(name) for f, name in chosen])


def _grouped(stmt: ast.Select, df: DataFrame, fields: tuple[rel.Field, ...]) -> DataFrame:
    keys = [rel.resolve(c, fields) for c in stmt.group_by]
    if not stmt.columns:
        raise InvalidArgument("SELECT * can't be grouped")
    outs: list[tuple[str, str]] = []
    aggregates: list[Column] = []
    for k, c in enumerate(stmt.columns):
        if c.func:
            aggregates.append(rel.aggregate(c, fields, not keys).alias(f"a{k}"))
            outs.append((f"a{k}", rel.aggregate_name(c)))
            continue
        field = rel.resolve(c, fields)
        if field not in keys:
            raise InvalidArgument(f"column {c.name} is neither grouped nor aggregated")
        outs.append((field.internal, f"{c.table}.{c.name}" if stmt.join and c.table else c.name))
    order = None
    if stmt.order_by is not None:
        if stmt.order_by.func:
            aggregates.append(rel.aggregate(stmt.order_by, fields, not keys).alias("o"))
            order = F.col("o")
        else:
            field = rel.resolve(stmt.order_by, fields)
            if field in keys:
                order = F.col(field.internal)
            else:  # groups stand by the first of their rows in that order
                aggregates.append((F.max if stmt.descending else F.min)(field.internal).alias("o"))
                order = F.col("o")
    names = list(dict.fromkeys(f.internal for f in keys))
    if aggregates:
        df = df.groupBy(*names).agg(*aggregates) if names else df.agg(*aggregates)
    else:
        df = df.select(*names).distinct()
    if order is not None:
        df = df.orderBy(order.desc() if stmt.descending else order.asc())
    df = rel.window_of(df, stmt.limit, stmt.offset)
    return df.select(*[F.col(i).alias(name) for i, name in outs])
