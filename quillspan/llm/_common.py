"""Shared helpers of the corpus operators: staging in the shared folder, table reading, result shapes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import shared_dir, staged  # noqa: F401  (for the operators)

#: Rows of an Arrow batch handed to Python; bounds a worker's memory when texts are long.
ARROW_ROWS = 1000

_held: dict = {}


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def keep(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next: the last operator's alone.

    Workers are used again by the stages of a pipeline; what an earlier operator remembered is given back first.
    """
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
    return _held[key]


def kept(make: Callable) -> Callable:
    """A function of hashable arguments whose last result is kept by :func:`keep`."""

    @wraps(make)
    def get(*args):
        return keep((make.__module__, make.__name__, *args), lambda: make(*args))

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (other columns cannot clash); a null text is the empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sha256_hex(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def join_spans(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    """``kind:start:end`` by start, then kind as listed in ``order``, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))
