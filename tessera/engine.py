"""The front door: ``Engine(spark).query(text)``."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.model import Query
from tessera.plans.parser import parse
from tessera.plans.planner import Planned, plan
from tessera.sources import sink
from tessera.sources.catalog import Catalog


class Engine:
    """``join_method``: a default hint for all joins. ``theta``: see ``plans.planner.plan``. ``cbo``: join reordering by cost
    for tables that ``catalog.analyze`` has saved with statistics.
    """

    def __init__(self, spark: SparkSession, join_method: str | None = None, theta: str = "sql", cbo: bool = False):
        self.spark, self.join_method, self.theta = spark, join_method, theta
        self.catalog = Catalog(spark)
        if cbo:
            spark.conf.set("spark.sql.cbo.enabled", "true")
            spark.conf.set("spark.sql.cbo.joinReorder.enabled", "true")

    def plan(self, text: str | Query, join_method: str | None = None) -> Planned:
        query = parse(text) if isinstance(text, str) else text
        return plan(query, self.catalog, join_method or self.join_method, self.theta)

    def query(self, text: str | Query, join_method: str | None = None) -> DataFrame:
        return self.plan(text, join_method).rows

    def explain(self, text: str | Query, mode: str = "formatted") -> str:
        """The plan's shape in a line, then Spark's plan."""
        planned, shown = self.plan(text), io.StringIO()
        with contextlib.redirect_stdout(shown):
            planned.rows.explain(mode=mode)
        return f"{planned.shape}\n{shown.getvalue()}"

    def write(self, text: str | Query, path: str) -> int:
        """The result as a text file on the driver; returns the number of rows."""
        return sink.write_file(self.plan(text), path)
