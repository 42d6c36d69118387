"""Writing outputs: each version to a fresh place, verified while it is written, and visible only as a whole.

Object stores rename nothing safely, so a commit here is a new version and a file that names its parts, not a replacement in place. Every
writing task hashes what it is about to write and compares it with the plan; the version's file is written by the driver when all tasks have
reported, and a task that fails, or a row that differs, leaves no version to be seen.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..shipping import ship

FORMAT = "quillspan-version"
VERSION_FILE = "version.json"
STORED = pa.schema([("batch_id", pa.string()), ("path", pa.string()), ("bytes", pa.binary())])
ROW_GROUP_BYTES = 16 << 20


class Differs(ValueError):
    """Bytes that are not those that were planned."""


@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int
    bytes: int


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


class VersionWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, version: str):
        self.folder, self.version = folder, version

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One part of the version; each row's length and digest are compared before it is written."""
        store, root = _place(self.folder)
        context = TaskContext.get()
        part = f"part-{context.partitionId():05}-{context.taskAttemptId()}.parquet"
        rows = size = held = 0
        waiting: list[pa.RecordBatch] = []
        with store.open_output_stream(f"{root}/{self.version}/{part}") as out, pa.parquet.ParquetWriter(out, STORED) as file:
            for b in batches:
                for path, data, length, sha in zip(*(b.column(c) for c in ("path", "bytes", "after_length", "after_sha256"))):
                    raw = data.as_buffer()
                    if raw.size != length.as_py() or f"sha256:{hashlib.sha256(raw).hexdigest()}" != sha.as_py():
                        raise Differs(f"{path.as_py()}: {raw.size} bytes are not the {length.as_py()} that were planned")
                    size += raw.size
                rows += b.num_rows
                waiting.append(b.select(STORED.names))
                held += b.nbytes
                if held >= ROW_GROUP_BYTES:
                    file.write_table(pa.Table.from_batches(waiting).cast(STORED))
                    waiting, held = [], 0
            if waiting:
                file.write_table(pa.Table.from_batches(waiting).cast(STORED))
        return Written(part, rows, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _place(self.folder)
        told = [m for m in messages if m is not None]
        body = {"parts": sorted(m.part for m in told if m.rows), "rows": sum(m.rows for m in told), "bytes": sum(m.bytes for m in told)}
        with store.open_output_stream(f"{root}/{self.version}/{VERSION_FILE}") as out:
            out.write(json.dumps(body).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _place(self.folder)
        if store.get_file_info(f"{root}/{self.version}").type != pa.fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.version}")


class VersionSource(DataSource):
    """``df.write.format(FORMAT).option("folder", ...).option("version", ...)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> VersionWriter:
        return VersionWriter(self.options["folder"], self.options["version"])


def write_version(rendered: DataFrame, outputs: DataFrame, folder: str) -> str:
    """Write ``rendered(batch_id, path, bytes)`` as a new version below ``folder`` (a place that all executors share); returns its name.

    ``outputs(batch_id, path, after_length, after_sha256)`` are the plan's; one without bytes is an empty file. Fails, and leaves nothing to be
    seen, where any output's bytes are not the planned ones.
    """
    spark = rendered.sparkSession
    ship(spark)
    spark.dataSource.register(VersionSource)
    version = f"version-{uuid.uuid4().hex}"
    store, root = _place(folder)
    store.create_dir(f"{root}/{version}", recursive=True)
    planned = outputs.select("batch_id", "path", F.col("after_length").cast("long").alias("after_length"), "after_sha256")
    rows = planned.join(rendered.select("batch_id", "path", "bytes"), ["batch_id", "path"], "left").withColumn("bytes", F.coalesce("bytes", F.unhex(F.lit(""))))
    rows.select("batch_id", "path", "bytes", "after_length", "after_sha256").write.format(FORMAT).option("folder", folder).option("version", version).mode("append").save()
    return version


def versions(folder: str) -> list[str]:
    """The versions that are whole."""
    store, root = _place(folder)
    found = store.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path.split("/")[-2] for f in found if f.base_name == VERSION_FILE)


def read_version(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """``batch_id, path, bytes`` of a whole version; parts that its file does not name (of tasks tried twice) are not read."""
    store, root = _place(folder)
    with store.open_input_stream(f"{root}/{version}/{VERSION_FILE}") as file:
        parts = json.loads(file.read())["parts"]
    schema = "batch_id string, path string, bytes binary"
    return spark.read.schema(schema).parquet(*(f"{folder.rstrip('/')}/{version}/{p}" for p in parts)) if parts else spark.createDataFrame([], schema)


def same_plan(expected: DataFrame, again: DataFrame) -> DataFrame:
    """Batches whose digest changed between two plannings: ``batch_id, expected, found``."""
    a, b = expected.select("batch_id", F.col("plan_sha256").alias("expected")), again.select("batch_id", F.col("plan_sha256").alias("found"))
    return a.join(b, "batch_id", "full").filter(~F.col("expected").eqNullSafe(F.col("found")))
