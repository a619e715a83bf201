"""The dialect's four types over Spark's, and literals of a column's type.

TIME is an integer of seconds of the day whose field carries ``{"logical": "TIME"}``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.model import AnalysisError

TIME_METADATA = {"logical": "TIME"}
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
INTEGER = re.compile(r"[+-]?[0-9]+")
REAL = re.compile(r"[+-]?(?:NaN|Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?)")
TIME = re.compile(r"([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})")


def kind(field: T.StructField) -> str:
    """INTEGER, STRING, REAL or TIME; for any other Spark type its own name."""
    if field.metadata.get("logical") == "TIME":
        return "TIME"
    if type(field.dataType) in BITS:
        return "INTEGER"
    if isinstance(field.dataType, T.FloatType | T.DoubleType):
        return "REAL"
    return "STRING" if isinstance(field.dataType, T.StringType) else field.dataType.simpleString()


def seconds(text: str) -> int:
    """Seconds of the day of HH:MM:SS."""
    m = TIME.fullmatch(text)
    h, minute, s = map(int, m.groups()) if m else (24, 0, 0)
    if h > 23 or minute > 59 or s > 59:
        raise AnalysisError(f"not a time of day: {text!r}")
    return h * 3600 + minute * 60 + s


def literal(text: str, field: T.StructField) -> Column:
    """``text`` as a value of exactly the field's type."""
    what = kind(field)
    if what == "STRING":
        return F.lit(text)
    if what == "TIME":
        return F.lit(seconds(text)).cast(field.dataType)
    if what == "INTEGER":
        bits = BITS[type(field.dataType)]
        if not INTEGER.fullmatch(text) or not -(1 << bits - 1) <= int(text) < 1 << bits - 1:
            raise AnalysisError(f"not an integer of {bits} bits: {text!r} (compared with {field.name})")
        return F.lit(int(text)).cast(field.dataType)
    if what == "REAL":
        bare = text.strip()
        if not REAL.fullmatch(bare):
            raise AnalysisError(f"not a real number: {text!r} (compared with {field.name})")
        return F.lit(float(bare.rstrip("fFdD") if bare[-1:] in "fFdD" else bare)).cast(field.dataType)
    raise AnalysisError(f"{field.name} has type {what}, which no literal compares with")


def shown(column: Column, field: T.StructField) -> Column:
    """The text of a value in a result file."""
    if kind(field) == "TIME":
        return F.format_string("%02d:%02d:%02d", (column / 3600).cast("int"), (column / 60).cast("int") % 60, column % 60)
    return column.cast("string")
