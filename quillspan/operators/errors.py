"""Problems as rows, and the one of each batch that counts: the first in the order of evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHASES = {"request": 0, "snapshot": 1, "index": 2, "precondition": 3, "operation": 4, "output": 5, "budget": 6}


def problems(rows: DataFrame, phase: str, code: str | None = None, key: str = "''", ordinal: str = "0L") -> DataFrame:
    """``rows`` (with ``batch_id``, and ``problem`` where ``code`` is not given) as ranked problems of one phase."""
    return rows.select("batch_id", F.lit(PHASES[phase]).alias("phase"), F.expr(key).cast("string").alias("key"), F.expr(ordinal).cast("long").alias("ordinal"), (F.lit(code) if code else F.col("problem")).alias("problem"))


def first_problem(*parts: DataFrame) -> DataFrame:
    """Of each batch its first problem, by phase, then key, then ordinal."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("batch_id").agg(F.min(F.struct("phase", "key", "ordinal", "problem")).alias("x")).select("batch_id", "x.phase", "x.key", "x.ordinal", "x.problem")
