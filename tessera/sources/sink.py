"""Results as text: a header of ``T.c`` with two spaces after each, then rows with a tab after each value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import shown
from tessera.plans.planner import Planned


def header(result: Planned) -> str:
    return "".join(f"{a}  " for a in result.attrs)


def lines(result: Planned) -> DataFrame:
    """A column ``value`` with a line for each row, without its line end. The order of the rows stays."""
    numbered = result.rows.toDF(*[f"c{i}" for i in range(len(result.attrs))])
    values = [F.concat(F.coalesce(shown(F.col(f"c{i}"), f), F.lit("null")), F.lit("\t")) for i, f in enumerate(result.fields)]
    return numbered.select(F.concat(*values).alias("value"))


def whole(result: Planned) -> DataFrame:
    """The lines of a result file, the header before the rows."""
    first = result.rows.sparkSession.createDataFrame([(header(result),)], "value string")
    return first.unionAll(lines(result))


def write_file(result: Planned, path: str) -> int:
    """One file on the driver, fetched a partition at a time; returns the number of rows."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="\n") as file:
        file.write(header(result) + "\n")
        for row in lines(result).toLocalIterator(prefetchPartitions=True):
            file.write(row[0] + "\n")
            n += 1
    return n


def write_folder(result: Planned, path: str) -> None:
    """Part files written by the executors, without headers."""
    lines(result).write.mode("error").text(path)
