"""Building the manifest of a transaction: what a plan will replace, with what, and out of which inputs.

Two numberings of the same files meet here: a plan's digest counts all inputs by path, a manifest the files that exist, by path, before the
paths that do not. Segments name their file by the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .journal import INPUT, MANIFEST, MANIFEST_TARGET, SEGMENT, decode_envelopes, encode_envelopes

VERSION = 1
FILE_MODES = 0o666  #: what a new file's mode may have; nothing is made executable


def identity(device: str, inode: str) -> Column:
    return F.when(F.col(device).isNotNull() & F.col(inode).isNotNull(), F.concat_ws(":", F.col(device).cast("decimal(20,0)").cast("string"), F.col(inode).cast("decimal(20,0)").cast("string")))


def manifests(p, transactions: DataFrame, new_file_mode: int = 0o644) -> DataFrame:
    """A row of :data:`~.journal.MANIFEST` for each of ``transactions(batch_id, transaction_id)`` whose plan changes a file.

    ``p``: a plan. Inputs are all files that the batch names; targets its changed outputs in path order, each with its recipe's segments.
    """
    asked = p.required.select("batch_id", F.col("path").alias("asked")).distinct().join(p.sound.select("batch_id").distinct(), "batch_id", "left_semi")
    known = p.all_files.filter("existed").withColumns({"file_identity": identity("device", "inode"), "length": F.length("bytes").cast("long")}).drop("bytes")
    inputs = asked.join(known, F.col("asked") == F.col("path"), "left").select("batch_id", F.col("asked").alias("path"), F.col("path").isNotNull().alias("existed"), "file_identity", "sha256", "length", F.col("link_count").cast("long").alias("link_count"))
    item = F.struct("path", "existed", "file_identity", "sha256", "length", "link_count")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct((~F.col("existed")).alias("absent"), F.col("path").alias("key"), item.alias("item")))), lambda x: x["item"])
    listed = inputs.groupBy("batch_id").agg(in_order.cast(f"array<{INPUT}>").alias("inputs"))

    files = inputs.filter("existed").select("batch_id", F.col("path").alias("source_path"), (F.row_number().over(Window.partitionBy("batch_id").orderBy("path")) - 1).cast("long").alias("input_index"))
    parts = p.layout.join(files, ["batch_id", "source_path"])
    segments = parts.groupBy("batch_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "input_index", "start", "end", "operation_index"))), lambda x: F.struct(x["input_index"].alias("input_index"), x["start"].alias("start"), x["end"].alias("end"), x["operation_index"].alias("operation_index"))).cast(f"array<{SEGMENT}>").alias("segments"))

    originals = inputs.select("batch_id", "path", F.col("existed").alias("original_existed"), F.col("file_identity").alias("original_identity"))
    changed = p.outputs.filter("change_kind <> 'unchanged'").join(originals, ["batch_id", "path"]).join(segments, ["batch_id", "path"], "left")
    numbered = changed.withColumn("target_index", (F.row_number().over(Window.partitionBy("batch_id").orderBy("path")) - 1).cast("long"))
    target = F.struct(
        "target_index",
        "path",
        "original_existed",
        "original_identity",
        F.col("before_sha256").alias("original_sha256"),
        F.col("before_length").alias("original_length"),
        F.format_string("candidate-%08d", "target_index").alias("candidate_name"),
        F.format_string("backup-%08d", "target_index").alias("backup_name"),
        F.col("after_sha256").alias("candidate_sha256"),
        F.col("after_length").alias("candidate_length"),
        F.when(F.col("original_existed"), "preserve_existing_mode").otherwise("new_file_mode").alias("metadata_policy"),
        F.when(~F.col("original_existed"), F.lit(new_file_mode & FILE_MODES)).alias("new_file_mode"),
        F.coalesce("segments", F.array().cast(f"array<{SEGMENT}>")).alias("segments"),
    )
    targets = numbered.groupBy("batch_id").agg(F.array_sort(F.collect_list(target)).cast(f"array<{MANIFEST_TARGET}>").alias("targets"))
    whole = targets.join(listed, "batch_id").join(p.digests(), "batch_id").join(transactions, "batch_id")
    return whole.select("transaction_id", F.lit(VERSION).alias("version"), "plan_sha256", "inputs", "targets")


def stored(made: DataFrame, magic: bytes) -> DataFrame:
    """``transaction_id, data``: each manifest as a record."""
    bodies = made.select(F.col("transaction_id").alias("name"), F.to_json(F.struct(*made.columns), {"ignoreNullFields": "false"}).alias("payload"))
    return encode_envelopes(bodies, magic).select(F.col("name").alias("transaction_id"), "data", "problem")


def loaded(records: DataFrame, magic: bytes) -> DataFrame:
    """``records(transaction_id, data)`` as manifests; a record that cannot be read is a ``problem``."""
    read = decode_envelopes(records.select(F.col("transaction_id").alias("name"), "data"), magic)
    body = read.withColumn("m", F.from_json("payload", MANIFEST))
    torn = F.coalesce("problem", F.when(~F.col("m.transaction_id").eqNullSafe(F.col("name")), "PAYLOAD"))
    return body.select(F.col("name").alias("record"), "m.*", torn.alias("problem"))
