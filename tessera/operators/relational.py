"""Scan, select, project, join and order-by over columns named ``T.c``."""

from __future__ import annotations

import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.model import AnalysisError, Attr

COMPARE = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "=": operator.eq, "!=": operator.ne}
#: Comparisons by order, and what they are with the sides exchanged.
MIRROR = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}

#: Join methods by name, and the hint that asks Spark for the like.
JOIN_HINTS = {"page_nested": "shuffle_replicate_nl", "block_nested": "broadcast", "sort_merge": "merge", "hash": "shuffle_hash"}
#: A side estimated to be larger is not broadcast, whatever the hint asks.
BROADCAST_BYTES = 64 << 20
#: Estimated bytes of the smaller side for each class of pages, the most classes, and the binary logarithm of a page's most rows.
CLASS_BYTES, MOST_CLASSES, PAGE_BITS = 128, 4096, 16

#: Estimated bytes of one side times those of the other for each task of a join without equality, and the most tasks.
PAIR_BYTES, MOST_TASKS = 1 << 30, 2000
#: The binary logarithm of the rows of a run, the estimated bytes of a side beyond which it is not sorted into runs, and the types whose
#: values are of a few bytes, so that a run is small.
RUN_BITS, RUN_BYTES, SHORT = 8, 4 << 30, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def column(attr: Attr) -> Column:
    return F.col(f"`{attr}`")


def scan(table: DataFrame, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The table, or ``columns`` of it, with each under its qualified name. A column called ``a`` of T is ``T.a`` from here on."""
    return table.select([F.col(f"`{c}`").alias(f"{name}.{c}") for c in (table.columns if columns is None else columns)])


def select(rows: DataFrame, left: Column, op: str, right: Column) -> DataFrame:
    """Rows for which the comparison holds; a null on either side does not."""
    return rows.filter(COMPARE[op](left, right))


def project(rows: DataFrame, attrs: Iterable[Attr], names: Iterable[str]) -> DataFrame:
    """The columns in this order, repeats included; duplicate rows stay."""
    return rows.select([column(a).alias(n) for a, n in zip(attrs, names, strict=True)])


def estimated_bytes(rows: DataFrame) -> float:
    """Spark's estimate of the rows' size; where the session does not tell it, more than any bound."""
    try:
        return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return float("inf")


def pages(rows: DataFrame, keys: Iterable[Column], classes: int, side: str) -> DataFrame:
    """The rows without null keys as pages of rows whose keys hash to the same class."""
    keys = list(keys)
    whole = F.struct([F.col(f"`{c}`") for c in rows.columns])
    for key in keys:
        rows = rows.filter(key.isNotNull())
    page = F.shiftright(F.monotonically_increasing_id(), PAGE_BITS)
    rows = rows.select(F.pmod(F.xxhash64(*keys), F.lit(classes)).alias(f"{side} class"), page.alias("page"), whole.alias("row"))
    return rows.groupBy(f"{side} class", "page").agg(F.collect_list("row").alias(side)).drop("page")


def page_nested(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], condition: Column) -> DataFrame:
    """Nested loops over all pairs of pages, and over the rows of two pages of the same class."""
    classes = min(MOST_CLASSES, max(1, int(min(estimated_bytes(left), estimated_bytes(right), CLASS_BYTES * MOST_CLASSES)) // CLASS_BYTES))
    outer, inner = pages(left, [a for a, _ in keys], classes, "outer"), pages(right, [b for _, b in keys], classes, "inner")
    pairs = outer.join(inner.hint(JOIN_HINTS["page_nested"]), F.col("outer class") == F.col("inner class"), "inner")
    rows = pairs.select(F.explode("outer").alias("outer"), "inner").select("outer", F.explode("inner").alias("inner"))
    fields = [(side, f) for side, schema in (("outer", left.schema), ("inner", right.schema)) for f in schema.fields]
    return rows.select([F.col(side).getField(f.name).alias(f.name, metadata=f.metadata) for side, f in fields]).filter(condition)


def tasks_for(left: DataFrame, right: DataFrame, broadcast_bytes: int) -> int:
    """The tasks that a join without equality is dealt to, by the pairs to compare; 0 if neither side is small."""
    a, b = estimated_bytes(left), estimated_bytes(right)
    return 0 if min(a, b) > broadcast_bytes else int(max(1, min(MOST_TASKS, a * b // PAIR_BYTES)))


def spread(left: DataFrame, right: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """The sides of a join without equality: the smaller one is broadcast, and the other dealt to tasks, as a file of few bytes is
    one task's.
    """
    first = estimated_bytes(left) < estimated_bytes(right)
    small, large = (left, right) if first else (right, left)
    small, large = small.hint("broadcast"), large.repartition(tasks) if tasks > 1 else large
    return (small, large) if first else (large, small)


def runs(rows: DataFrame, key: Column, side: str) -> DataFrame:
    """The rows without a null key as runs of rows that lie next to each other by it, each with its least and greatest key. Rows of
    equal keys lie by what else they hold, so that their place is the same in each attempt.
    """
    order = (key, F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)))
    rows = rows.filter(key.isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    whole = F.struct([F.col(f"`{c}`") for c in rows.columns])
    rows = rows.select(F.shiftright(F.monotonically_increasing_id(), RUN_BITS).alias("run"), key.alias("key"), whole.alias("row"))
    return rows.groupBy("run").agg(F.min("key").alias(f"{side} least"), F.max("key").alias(f"{side} most"), F.collect_list("row").alias(side)).drop("run")


def run_nested(left: DataFrame, right: DataFrame, bound: tuple[Column, str, Column], condition: Column, tasks: int) -> DataFrame:
    """Nested loops over the runs of both sides that may meet by ``bound``, a column of ``left``, how it compares and one of ``right``.

    The runs of the larger side are dealt to tasks, so equal keys are not one task's, and those of the smaller one are broadcast.
    In the result a column of the smaller one stays as it is for the length of a run, and what a column of the larger one holds
    repeats with each run, so that encoders have little to keep of rows that grow with the product of the sides.
    """
    a, op, b = bound
    lower = op[0] == "<"
    one, other = runs(left, a, "left"), runs(right, b, "right")
    (few, small), (many, large) = ((one, "left"), (other, "right")) if estimated_bytes(left) < estimated_bytes(right) else ((other, "right"), (one, "left"))
    may = COMPARE[op](F.col("left least" if lower else "left most"), F.col("right most" if lower else "right least"))
    pairs = many.repartition(tasks).join(few.hint("broadcast"), may, "inner")
    # A function that Spark does not compile: else all rows of a run, with each of the others, are made before the first is taken.
    pairs = pairs.select(F.filter(small, lambda row: row.isNotNull()).alias(small), large)
    rows = pairs.select(F.explode(small).alias(small), large).select(small, F.explode(large).alias(large))
    fields = [(side, f) for side, schema in (("left", left.schema), ("right", right.schema)) for f in schema.fields]
    return rows.select([F.col(side).getField(f.name).alias(f.name, metadata=f.metadata) for side, f in fields]).filter(condition)


def join(
    left: DataFrame, right: DataFrame, on: list[tuple[Column, str, Column]], method: str | None = None, broadcast_bytes: int = BROADCAST_BYTES, keys: list[tuple[Column, Column]] | None = None, bound: tuple[Column, str, Column] | None = None
) -> DataFrame:
    """The inner join where all of ``on`` hold; of an empty ``on`` the cross product.

    ``method`` is a hint, one of JOIN_HINTS. ``block_nested`` broadcasts ``right`` only if its estimate is below
    ``broadcast_bytes``; beyond, Spark chooses. ``page_nested`` compares all pairs of rows, or with ``keys``, pairs of a
    column of ``left`` and one of ``right`` that ``on`` takes for equal and that hash alike, those in pages whose keys may meet.
    Without method and equality the pairs are spread over tasks, and with ``bound``, the one of ``on`` that compares a column of
    ``left`` with one of ``right`` by order, made in runs if all values are short and the
    larger side is not too large to sort.
    """
    tasks = 0
    if method is not None:
        if method not in JOIN_HINTS:
            raise AnalysisError(f"no join method {method!r}; there are {', '.join(JOIN_HINTS)}")
        if not (method == "page_nested" and keys) and (JOIN_HINTS[method] != "broadcast" or estimated_bytes(right) <= broadcast_bytes):
            right = right.hint(JOIN_HINTS[method])
    elif not any(op == "=" for _, op, _ in on):
        tasks = tasks_for(left, right, broadcast_bytes)
    short = all(isinstance(f.dataType, SHORT) for f in (*left.schema, *right.schema))
    in_runs = tasks > 1 and bound is not None and short and max(estimated_bytes(left), estimated_bytes(right)) <= RUN_BYTES
    if tasks and not in_runs:
        left, right = spread(left, right, tasks)
    if not on:
        return left.crossJoin(right)
    condition = None
    for a, op, b in on:
        one = COMPARE[op](a, b)
        condition = one if condition is None else condition & one
    if method == "page_nested" and keys:
        return page_nested(left, right, keys, condition)
    if in_runs:
        return run_nested(left, right, bound, condition, tasks)
    return left.join(right, condition, "inner")


def order_by(rows: DataFrame, attrs: Iterable[Attr]) -> DataFrame:
    """All rows in ascending order of the columns; ties in any order."""
    return rows.orderBy([column(a).asc() for a in attrs])
