"""Snapshots: requirements, acquisition, aliases, accounting and inspection.

``files``: :data:`quillspan.schemas.FILES`, one row a path. Results are ordered by columns (ranks and positions), never by row
order. Null paths match nothing; an empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lines import TERMINATOR, latin1, line_pieces
from ..functions.scalars import digest, identity_hash
from .scan import running


def from_binary_files(df: DataFrame) -> DataFrame:
    """The ``binaryFile`` source's rows as files; identities are not known there and stay null."""
    null = F.lit(None).cast("decimal(20,0)")
    return df.select("path", F.lit(True).alias("existed"), F.col("content").alias("bytes"), digest("content").alias("sha256"), *(null.alias(c) for c in ("device", "inode", "parent_device", "parent_inode", "link_count")))


def requirements(operations: DataFrame) -> DataFrame:
    """Every operation's two paths with the state that it asks for: ``role`` 0 source, 1 destination."""
    both = F.array(
        F.struct(F.lit(0).alias("role"), F.col("source.path").alias("path"), F.col("source.precondition.kind").alias("state"), F.col("source.precondition.value").alias("value")),
        F.struct(F.lit(1).alias("role"), F.col("destination.path").alias("path"), F.col("destination.precondition.kind").alias("state"), F.col("destination.precondition.value").alias("value")),
    )
    return operations.select("batch_id", "operation_index", F.inline(both))


def acquire(wanted: DataFrame, files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """One row for each (batch, path) wanted, without bytes: ``existed``, ``conflicting`` wishes, ``file_id`` (the rank of the files that exist),
    running use, the limit ``exceeded``, and whether the path is still ``read``: nothing is behind a batch's first excess or conflict."""
    states = wanted.groupBy("batch_id", "path").agg((F.count_distinct(F.when(F.col("state") == "must_not_exist", 0).otherwise(1)) > 1).alias("conflicting"))
    known = files.filter("existed").select(F.col("path").alias("file_path"), "bytes")
    joined = states.join(known, F.col("path") == F.col("file_path"), "left")
    sizes = running_usage(joined.withColumn("__group", F.col("batch_id")), "__group", limits).withColumnRenamed("__group", "batch_id")
    ranks = running(joined.select("batch_id", "path", "conflicting", F.col("file_path").isNotNull().alias("existed")), ["batch_id"], ["path"], {"files": F.col("existed").cast("int")})
    every = ranks.join(sizes, ["batch_id", "path"])
    stop = every.groupBy("batch_id").agg(F.max("conflicting").alias("torn"), F.min(F.when(F.col("exceeded").isNotNull(), F.col("path"))).alias("stop"))
    out = every.join(stop, "batch_id")
    read = ~F.col("torn") & (F.col("stop").isNull() | (F.col("path") < F.col("stop")))
    return out.select("batch_id", "path", "existed", "conflicting", F.when(F.col("existed"), F.col("files") - 1).alias("file_id"), "identities", "bytes", "lines", "index_bytes", "exceeded", read.alias("read"))


def aliases(files: DataFrame) -> DataFrame:
    """Paths that share an identity with a path before them: ``first_path, path``."""
    same = Window.partitionBy("device", "inode").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = files.filter(F.col("existed") & F.col("device").isNotNull() & F.col("inode").isNotNull())
    return known.withColumn("first_path", F.first("path").over(same)).filter(F.col("first_path") != F.col("path")).select("first_path", "path", "device", "inode")


def acquisition_problems(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """What keeps a batch's files from being read: ``batch_id, step, path, problem``.

    ``step`` 0: paths that are asked to exist and to be absent; 1, in path order: a file that is the same as an earlier one of the
    batch by another path.
    """
    states = wanted.groupBy("batch_id", "path").agg(F.count_distinct(F.col("state") == "must_not_exist").alias("n"))
    torn = states.filter("n > 1").select("batch_id", F.lit(0).alias("step"), "path", F.lit("PRECONDITION_FAILED").alias("problem"))
    known = files.filter(F.col("existed") & F.col("device").isNotNull() & F.col("inode").isNotNull()).select(F.col("path").alias("known"), "device", "inode")
    before = Window.partitionBy("batch_id", "device", "inode").orderBy("path")
    same = states.join(known, F.col("path") == F.col("known")).withColumn("earlier", F.lag("path").over(before)).filter(F.col("earlier") != F.col("path"))
    return torn.unionByName(same.select("batch_id", F.lit(1).alias("step"), "path", F.lit("FILE_ALIAS").alias("problem")))


#: Limits of a snapshot, in the order in which they are looked at; ``file_bytes`` is that of one file.
LIMITS = {"identities": 1000, "file_bytes": 1 << 28, "bytes": 1 << 30, "lines": 5_000_000, "index_bytes": 256 << 20}


def running_usage(files: DataFrame, group: str, limits: dict[str, int] | None = None) -> DataFrame:
    """Running use in path order inside each group, and the first limit that a file exceeds (null where none).

    ``files(path, bytes)``; a null is an absent path, which counts as an identity. A group may be of any size: see :mod:`.scan`. A file that is over
    its own limit and over what its group has left is told of the one that reading it meets first, the lesser.
    """
    limits = LIMITS | (limits or {})
    each = files.select(group, "path", F.length("bytes").cast("long").alias("n"), F.size(line_pieces("bytes")).cast("long").alias("l"))
    used = running(each, [group], ["path"], {"identities": F.lit(1), "bytes": F.col("n"), "lines": F.when(F.col("n").isNotNull(), F.col("l"))})
    used = used.withColumn("index_bytes", 8 * F.col("lines"))
    left = limits["bytes"] - (F.col("bytes") - F.coalesce("n", F.lit(0)))
    own = F.when((F.col("n") > limits["file_bytes"]) & (F.lit(limits["file_bytes"]) <= left), "file_bytes")
    over = F.coalesce(*(own if c == "file_bytes" else F.when(F.col(c) > limit, c) for c, limit in limits.items()))
    return used.select(group, "path", "identities", "bytes", "lines", "index_bytes", over.alias("exceeded"))


def first_excess(usage: DataFrame, group: str) -> DataFrame:
    """Of each group the first file that goes over a limit."""
    return usage.filter(F.col("exceeded").isNotNull()).groupBy(group).agg(F.min(F.struct("path", "exceeded")).alias("x")).select(group, "x.path", "x.exceeded")


def inspect(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``paths(request_id, paths)`` in request order, repeats kept: digest, length, lines and identity, or absent."""
    asked = paths.select("request_id", F.posexplode("paths").alias("position", "asked"))
    known = files.filter("existed").select("path", digest("bytes").alias("sha256"), F.length("bytes").cast("long").alias("byte_length"), F.size(line_pieces("bytes")).cast("long").alias("line_count"), identity_hash("device", "inode").alias("identity"))
    joined = asked.join(known, F.col("asked") == F.col("path"), "left")
    return joined.select("request_id", "position", F.col("asked").alias("path"), F.col("path").isNotNull().alias("exists"), "sha256", "byte_length", "line_count", "identity")


def read_one(files: DataFrame, path: str) -> DataFrame:
    """One file with id 0, or one row that says it is missing."""
    spark = files.sparkSession
    asked = spark.range(1).select(F.lit(path).alias("asked"))
    out = asked.join(files.filter(F.col("existed") & (F.col("path") == path)), F.col("asked") == F.col("path"), "left")
    return out.select(F.col("asked").alias("path"), F.when(F.col("bytes").isNotNull(), 0).cast("long").alias("file_id"), "bytes", F.when(F.col("bytes").isNull(), "PATH_NOT_FOUND").alias("problem"))


def terminator_histogram(lines: DataFrame) -> DataFrame:
    return lines.groupBy("terminator").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("path").alias("files"))


def terminator_total(data: str):
    return F.regexp_count(latin1(data), F.lit(TERMINATOR)).cast("long")
