"""SELECT as a DataFrame plan: filter, group or sort, project, distinct, limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.errors import SchemaError
from tidemark.functions.aggregates import aggregate
from tidemark.functions.predicates import RANK, Kinds, compile_predicate
from tidemark.operators.relation import Relation
from tidemark.plans import ast


def sort_columns(c: Kinds) -> list[Column]:
    """Keys of the strict order of kinds: null, integers, decimals, texts, blobs."""
    if len(c) == 1:
        return list(c.values())
    rank = reduce(lambda w, k: w.when(c[k].isNotNull(), RANK[k]), list(c)[1:], F.when(c[next(iter(c))].isNotNull(), RANK[next(iter(c))])).otherwise(0)
    return [rank, *c.values()]


def _directed(c: Kinds, descending: bool) -> list[Column]:
    return [x.desc_nulls_last() if descending else x.asc_nulls_first() for x in sort_columns(c)]


def _project(rel: Relation, chosen: list[tuple[str, int]]) -> tuple[list[Column], list[str], list[dict[str, str]]]:
    """Output columns under names of their own, so that labels may repeat or hold anything."""
    columns, names, physical = [], [], []
    for i, (name, index) in enumerate(chosen):
        own = {}
        for k, p in rel.physical[index].items():
            own[k] = f"o{i}__{k}"
            columns.append(F.col(p).alias(own[k]))
        names.append(name)
        physical.append(own)
    return columns, names, physical


def _distinct(rel: Relation, columns: list[Column], names: list[str], physical: list[dict[str, str]], keys: list[tuple[Kinds, bool]]) -> Relation:
    """The first row of each output row in the order of ``keys``, kept in that order."""
    outs = [p for own in physical for p in own.values()]
    directions = {d for _, d in keys}
    parts = [x for c, _ in keys for x in sort_columns(c)]
    if not keys and rel.row_id is None:
        return Relation(rel.df.select(*columns).distinct(), names, physical)
    if len(directions) < 2:
        down = directions == {True}
        if rel.row_id is not None:
            parts.append(-F.col(rel.row_id) if down else F.col(rel.row_id))
        key = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(parts)])
        found = rel.df.select(*columns, key.alias("__k")).groupBy(*outs).agg((F.max if down else F.min)("__k").alias("__k"))
        found = found.orderBy(F.col("__k").desc() if down else F.col("__k").asc())
        return Relation(found.select(*outs), names, physical)
    order = [x for c, d in keys for x in _directed(c, d)] + ([F.col(rel.row_id)] if rel.row_id else [])
    kept = [x.alias(f"__s{i}") for i, x in enumerate(y for c, _ in keys for y in sort_columns(c))]
    flags = [d for c, d in keys for _ in sort_columns(c)]
    tie = [F.col(rel.row_id).alias("__r")] if rel.row_id else []
    del order
    again = [F.col(f"__s{i}").desc_nulls_last() if d else F.col(f"__s{i}").asc_nulls_first() for i, d in enumerate(flags)] + ([F.col("__r")] if tie else [])
    found = rel.df.select(*columns, *kept, *tie).withColumn("__n", F.row_number().over(Window.partitionBy(*outs).orderBy(*again))).where("__n = 1")
    return Relation(found.orderBy(*again).select(*outs), names, physical)


def _ungrouped(rel: Relation, q: ast.Select, stable: bool) -> Relation:
    items = q.items if q.items is not None else tuple(ast.Item(n) for n in rel.names)
    if q.items is None:
        chosen = [(n, i) for i, n in enumerate(rel.names)]
    else:
        chosen = [(item.name, rel.find(item.expr)) for item in items]
    # Sort keys are columns of the source: aliases can't be seen, and sorting precedes projection.
    keys = [(rel.resolve(k.column), k.descending) for k in q.order_by]
    columns, names, physical = _project(rel, chosen)
    if q.distinct:
        out = _distinct(rel, columns, names, physical, keys)
    else:
        df = rel.df
        order = [x for c, d in keys for x in _directed(c, d)]
        if rel.row_id is not None and (stable or keys or q.limit is not None):
            order.append(F.col(rel.row_id))
        if order:
            df = df.orderBy(*order)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Relation(df.select(*columns), names, physical)
    return Relation(out.df.limit(q.limit), names, physical) if q.limit is not None else out


def _grouped(rel: Relation, q: ast.Select) -> Relation:
    if q.items is None:
        raise SchemaError("SELECT * can't be grouped")
    keys = [(name, rel.find(name)) for name in q.group_by]
    for item in q.items:
        if isinstance(item.expr, str):
            rel.find(item.expr)
            if item.expr not in q.group_by:
                raise SchemaError(f"column {item.expr} must be in GROUP BY or an aggregate")
    key_kinds: dict[str, dict[str, str]] = {}
    grouping: list[Column] = []
    for i, (name, index) in enumerate(keys):
        if name not in key_kinds:
            key_kinds[name] = {k: f"g{i}__{k}" for k in rel.physical[index]}
            grouping += [F.col(p).alias(key_kinds[name][k]) for k, p in rel.physical[index].items()]
    measures: dict[ast.Aggregate, dict[str, str]] = {}
    aggs: list[Column] = []

    def measure(a: ast.Aggregate) -> dict[str, str]:
        if a not in measures:
            found = aggregate(a.func, rel.resolve(a.column) if a.column is not None else None, F.col(rel.row_id) if rel.row_id else None)
            measures[a] = {k: f"a{len(measures)}__{k}" for k in found}
            aggs.extend(x.alias(measures[a][k]) for k, x in found.items())
        return measures[a]

    outputs = [(item.name, key_kinds[item.expr] if isinstance(item.expr, str) else measure(item.expr)) for item in q.items]

    def output(term: str | ast.Aggregate) -> Kinds:
        if isinstance(term, ast.Aggregate):
            own = next((p for item, (_, p) in zip(q.items, outputs, strict=True) if item.expr == term), None) or measure(term)
        else:
            own = next((p for name, p in outputs if name == term), None)
            if own is None:
                raise SchemaError(f"no such output column: {term}")
        return {k: F.col(p) for k, p in own.items()}

    having = compile_predicate(q.having, output) if q.having is not None else None
    order = [(output(k.column), k.descending) for k in q.order_by]
    if grouping:
        df = rel.df.groupBy(*grouping).agg(*aggs) if aggs else rel.df.select(*grouping).distinct()
    else:
        df = rel.df.agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
    if having is not None:
        df = df.where(having)
    grouped = Relation(df, [n for n, _ in outputs], [p for _, p in outputs])
    columns, names, physical = _project(grouped, [(n, i) for i, (n, _) in enumerate(outputs)])
    if not order:
        order = [({k: F.col(p) for k, p in key_kinds[n].items()}, False) for n in dict.fromkeys(q.group_by)]
    if q.distinct:
        out = _distinct(grouped, columns, names, physical, order)
    else:
        by = [x for c, d in order for x in _directed(c, d)]
        if q.order_by:  # groups of equal sort keys stay in key order
            by += [x for n in dict.fromkeys(q.group_by) for x in _directed({k: F.col(p) for k, p in key_kinds[n].items()}, False)]
        out = Relation((df.orderBy(*by) if by else df).select(*columns), names, physical)
    return Relation(out.df.limit(q.limit), names, physical) if q.limit is not None else out


def select(rel: Relation, q: ast.Select, stable: bool = True) -> Relation:
    """``stable``: without ORDER BY, rows of a versioned table come in insertion order."""
    if q.where is not None:
        rel = Relation(rel.df.where(compile_predicate(q.where, rel.resolve)), rel.names, rel.physical, rel.row_id)
    if q.group_by or q.having is not None or any(isinstance(i.expr, ast.Aggregate) for i in q.items or ()):
        return _grouped(rel, q)
    return _ungrouped(rel, q, stable)
