"""What a plan uses, and the limits that it is held to. All figures are of each batch, never of the whole frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits in the order in which they are looked at; the first that is exceeded is told. Each can be lowered.
LIMITS = {
    "changed_targets": 100, "output_bytes": 512 << 20, "total_output_bytes": 1 << 30, "output_segments": 100_000,
    "total_segments": 100_000, "planning_memory_bytes": 256 << 20, "response_bytes": 16 << 20,
}
#: Model of a plan's memory: bytes an operation, an output and a segment take. A parameter, since it is no property of data.
MEMORY = {"operation": 512, "output": 256, "segment": 96}


def usage(resolved: DataFrame, made: DataFrame, recipe: DataFrame, memory: dict[str, int] | None = None) -> DataFrame:
    """One row a batch: sums and maxima over its operations, outputs and segments."""
    m = MEMORY | (memory or {})
    ops = resolved.groupBy("batch_id").agg(F.count(F.lit(1)).alias("operations"), F.sum(1024 + F.octet_length("source_path") + F.octet_length("destination_path")).alias("op_bytes"))
    segs = recipe.groupBy("batch_id", "path").agg(F.count(F.lit(1)).alias("segs"))
    outs = made.join(segs, ["batch_id", "path"], "left").withColumn("segs", F.coalesce("segs", F.lit(0)))
    per = outs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("outputs"),
        F.count_if(F.col("change_kind") != "unchanged").alias("changed_targets"),
        F.max("after_length").alias("output_bytes"),
        F.sum("after_length").alias("total_output_bytes"),
        F.max("segs").alias("output_segments"),
        F.sum("segs").alias("total_segments"),
        F.sum(512 + F.octet_length("path") + 512 * F.col("segs")).alias("out_bytes"),
    )
    names = ["outputs", "changed_targets", "output_bytes", "total_output_bytes", "output_segments", "total_segments", "out_bytes"]
    joined = ops.join(per, "batch_id", "left").na.fill(0, names)
    memory_bytes = m["operation"] * F.col("operations") + m["output"] * F.col("outputs") + m["segment"] * F.col("total_segments")
    return joined.select("batch_id", "operations", *names[:-1], memory_bytes.alias("planning_memory_bytes"), (1024 + F.col("op_bytes") + F.col("out_bytes")).alias("response_bytes"))


def limit_violations(used: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Batches over a limit, with the first one: ``limit_name, allowed, actual``."""
    bounds = LIMITS | (limits or {})
    first = F.coalesce(*(F.when(F.col(c) > bound, F.struct(F.lit(c).alias("limit_name"), F.lit(bound).cast("long").alias("allowed"), F.col(c).cast("long").alias("actual"))) for c, bound in bounds.items()))
    return used.withColumn("x", first).filter(F.col("x").isNotNull()).select("batch_id", "x.*")


def projected_disk(made: DataFrame, limit: int = 3 << 30) -> DataFrame:
    """Bytes that a commit would hold at once: new content and what it replaces."""
    changed = made.filter("change_kind <> 'unchanged'")
    return changed.groupBy("batch_id").agg(F.sum(F.col("after_length") + F.coalesce("before_length", F.lit(0))).alias("disk_bytes")).withColumn("exceeded", F.col("disk_bytes") > limit)
