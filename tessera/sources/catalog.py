"""Tables by name."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.model import AnalysisError
from tessera.sources.text import read_text


class Catalog(Mapping[str, DataFrame]):
    """Names are case-sensitive. Each table is also a temporary view, for ``spark.sql``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise AnalysisError(f"no table {name!r}")
        return self._tables[name]

    def __contains__(self, name: object) -> bool:
        return name in self._tables

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def register(self, name: str, table: DataFrame) -> DataFrame:
        table.createOrReplaceTempView(name)
        self._tables[name] = table
        return table

    def register_parquet(self, name: str, path: str) -> DataFrame:
        return self.register(name, self.spark.read.parquet(path))

    def register_text(self, name: str, det: str, txt: str) -> DataFrame:
        return self.register(name, read_text(self.spark, det, txt))

    def analyze(self, name: str, saved_as: str | None = None, path: str | None = None) -> DataFrame:
        """Saves the table in the warehouse, or under ``path``, with statistics of all its columns, for join ordering by cost,
        and uses that.
        """
        saved = saved_as or f"tessera_{name}"
        writer = self[name].write.mode("overwrite").format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(saved)
        self.spark.sql(f"ANALYZE TABLE `{saved}` COMPUTE STATISTICS FOR ALL COLUMNS")
        return self.register(name, self.spark.table(saved))

    def stats(self, name: str, columns: list[str] | None = None, error: float | None = None) -> DataFrame:
        """One row: n_tuples, and v_<column>, the number of distinct values, for each column.

        Exact counts shuffle the distinct values of every column; with an ``error``, the relative one that is borne, a sketch
        of bounded size counts each column in one pass.
        """
        table = self[name]
        count = F.count_distinct if error is None else (lambda c: F.approx_count_distinct(c, error))
        distinct = [count(F.col(f"`{c}`")).alias(f"v_{c}") for c in columns or table.columns]
        return table.agg(F.count(F.lit(1)).alias("n_tuples"), *distinct)
