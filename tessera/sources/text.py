"""Tables as text: a ``.det`` file declares the columns, a ``.txt`` file has a row a line, a ``.stat`` file counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import TIME_METADATA, shown
from tessera.plans.model import AnalysisError

SPARK_TYPES = {"INTEGER": T.IntegerType(), "STRING": T.StringType(), "REAL": T.FloatType(), "TIME": T.IntegerType()}


@dataclass(frozen=True)
class Declared:
    """A column of a ``.det`` file. ``range``: a string's length, a number's exclusive upper bound, a time's hours."""

    name: str
    type: str
    range: int
    key: str
    size: int

    def field(self) -> T.StructField:
        return T.StructField(self.name, SPARK_TYPES[self.type], True, TIME_METADATA if self.type == "TIME" else {})


def whole(spark: SparkSession, path: str) -> str:
    """The text of a small file, read by Spark wherever it lies."""
    return spark.read.text(path, wholetext=True).first()[0]


def parse_det(text: str) -> list[Declared]:
    """Line 1 counts the columns and line 2 a row's bytes; then ``name TYPE range KEY bytes`` for each column."""
    lines = [line.split() for line in text.splitlines() if line.strip()]
    try:
        n = int(lines[0][0])
        columns = [Declared(name, kind, int(top), key, int(size)) for name, kind, top, key, size in lines[2 : 2 + n]]
    except (ValueError, IndexError) as error:
        raise AnalysisError(f"not a table declaration: {error}") from error
    if len(columns) != n:
        raise AnalysisError(f"{n} columns are announced and {len(columns)} declared")
    for c in columns:
        if c.type not in SPARK_TYPES:
            raise AnalysisError(f"{c.name} has type {c.type}; there are {', '.join(SPARK_TYPES)}")
    return columns


def parse_stat(text: str) -> tuple[int, list[int]]:
    """The number of rows, and of distinct values in each column."""
    numbers = [int(x) for x in text.split()]
    return numbers[0], numbers[1:]


def _value(token: Column, kind: str) -> Column:
    if kind == "TIME":
        part = F.split(token, ":")
        right = token.rlike("^([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]$")
        at = part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int")
        return F.when(right, at).otherwise(F.raise_error(F.concat(F.lit("not a time of day: "), token)).cast("int"))
    return token.cast(SPARK_TYPES[kind])


def read_text(spark: SparkSession, det: str, txt: str) -> DataFrame:
    """The rows of ``txt`` with the columns that ``det`` declares. Blank lines are skipped; a malformed value is an error when its
    column is read, and so is, whatever is read, a line with more or fewer values than columns.
    """
    columns = parse_det(whole(spark, det))
    tokens = F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0))
    lines = spark.read.text(txt).select("value", tokens.alias("v")).filter(F.size("v") > 0)
    wrong = F.raise_error(F.concat(F.lit(f"a line without {len(columns)} values: "), F.col("value"))).cast("boolean")
    lines = lines.filter(F.when(F.size("v") == len(columns), F.lit(True)).otherwise(wrong))
    return lines.select([_value(F.get("v", F.lit(i)), c.type).alias(c.name, metadata=c.field().metadata) for i, c in enumerate(columns)])


def write_text(rows: DataFrame, columns: list[Declared], det: str, txt: str) -> None:
    """Writes a declaration under ``det``, and the rows under ``txt`` in part files, with a tab after each value.

    Values can't hold white space, as that parts them. A null has no text and is an error.
    """
    spark = rows.sparkSession
    declared = [str(len(columns)), str(sum(c.size for c in columns)), *(f"{c.name} {c.type} {c.range} {c.key} {c.size}" for c in columns)]
    spark.createDataFrame([("\n".join(declared),)], "value string").coalesce(1).write.text(det)
    values = []
    for c in columns:
        text = shown(F.col(f"`{c.name}`").cast(SPARK_TYPES[c.type]), c.field())
        right = F.coalesce(text.rlike(r"^\S+$"), F.lit(False))
        values.append(F.when(right, F.concat(text, F.lit("\t"))).otherwise(F.raise_error(F.lit(f"{c.name} has a value that text can't hold"))))
    rows.select(F.concat(*values).alias("value")).write.text(txt)
