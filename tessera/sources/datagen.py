"""Seeded random tables from a declaration. The same seed gives the same rows on any cluster."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.model import AnalysisError
from tessera.sources.text import Declared


def _uniform(seed: int, name: str, below: int, *more: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id"), *more), F.lit(below))


def _letters(seed: int, name: str, length: int) -> Column:
    places = F.sequence(F.lit(1), F.lit(length))
    return F.array_join(F.transform(places, lambda i: F.char(F.lit(97) + _uniform(seed, name, 26, i))), "")


def generate(spark: SparkSession, columns: list[Declared], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows. An INTEGER column with key PK has distinct values below its range; the rest are uniform."""
    out = []
    for c in columns:
        if c.type == "INTEGER" and c.key == "PK":
            if n > c.range:
                raise AnalysisError(f"{c.name}: {n} distinct values below {c.range} don't exist")
            dice = random.Random(f"{seed}/{c.name}")
            step = next(s for s in iter(lambda: dice.randrange(1, c.range + 1), None) if math.gcd(s, c.range) == 1)
            value = F.pmod(F.col("id") * F.lit(step) + F.lit(dice.randrange(c.range)), F.lit(c.range)).cast("int")
        elif c.type == "INTEGER":
            value = _uniform(seed, c.name, max(1, c.range)).cast("int")
        elif c.type == "REAL":
            value = (_uniform(seed, c.name, 1 << 24) / F.lit(float(1 << 24)) * F.lit(float(c.range))).cast("float")
        elif c.type == "TIME":
            value = (_uniform(seed, c.name, max(1, min(24, c.range)) * 3600)).cast("int")
        else:
            value = _letters(seed, c.name, max(1, c.range))
        out.append(value.alias(c.name, metadata=c.field().metadata))
    return spark.range(n).select(out)
