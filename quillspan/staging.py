"""Cut lineage by writing a frame into the folder that driver and executors share.

What is written stays there, since a lost executor's work is done again from it, until the :func:`scope` around it ends; without one,
until the application has ended and the folder is cleared.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a folder of our own, but in local mode alone: on a cluster each
    machine would write to its own."""
    global _own_dir
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="quillspan-")
    return _own_dir


#: Left on, a column of variants is written by types guessed from its rows, and whole numbers come back as decimals.
GUESSED_TYPES = "spark.sql.variant.inferShreddingSchema"


#: Compressed bytes of a row group of whole documents or trees. Spark reads up to 4,096 rows at once, but never rows of two groups.
WIDE = 2 << 20


def staged(df: DataFrame, label: str, codec: str = "snappy", wide: bool = False) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back; digests in hex take half their length in ``zstd``.

    ``wide``: rows hold whole documents or trees. Their row groups are small, so that a reading task's memory does not grow with its rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspan/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(GUESSED_TYPES, None)
    variants = any("variant" in kind for _, kind in df.dtypes)
    try:
        if variants:
            spark.conf.set(GUESSED_TYPES, "false")
        written = df.write.option("compression", codec)
        (written.option("parquet.block.size", WIDE) if wide else written).parquet(path)
    finally:
        if variants:
            spark.conf.unset(GUESSED_TYPES) if before is None else spark.conf.set(GUESSED_TYPES, before)
    for made in _scopes[-1:]:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged inside; put the writing of a result into it, not the making of its frame alone."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in map(hadoop.Path, made):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
