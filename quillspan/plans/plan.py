"""The whole plan of many batches at once: from operations and files to recipes, outputs, use and problems."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import line_ends
from ..operators import accounting, compose, errors, planhash, resolve, snapshot
from ..staging import staged


class Plan:
    """One planning of all batches of ``operations`` over ``files``. Each frame is built when it is asked for.

    ``files`` must be pinned (a written version): both passes of a commit have to read the same bytes.
    """

    def __init__(self, operations: DataFrame, files: DataFrame):
        self.given, self.all_files = operations, files

    @cached_property
    def required(self) -> DataFrame:
        return snapshot.requirements(self.given)

    @cached_property
    def operations(self) -> DataFrame:
        return resolve.flat(self.given)

    @cached_property
    def used_files(self) -> DataFrame:
        """The files that any operation names."""
        return self.all_files.join(self.asked, F.col("path") == F.col("asked"), "left_semi")

    @cached_property
    def asked(self) -> DataFrame:
        return staged(self.required.select(F.col("path").alias("asked")).distinct(), "asked", "zstd")

    @cached_property
    def unread(self) -> DataFrame:
        """What is wrong with the batches' files before any operation is looked at."""
        first = snapshot.acquisition_problems(self.required, self.used_files).select("batch_id", F.lit("snapshot").alias("phase"), "path", F.col("step").alias("rank"), "problem")
        return first.unionByName(resolve.index_problems(self.required, self.used_files).select("batch_id", F.lit("index").alias("phase"), "path", F.lit(0).alias("rank"), "problem"))

    @cached_property
    def files(self) -> DataFrame:
        """What joins on paths read, each its own columns; operations name the files that they use, so nothing is picked out before."""
        return resolve.indexed(self.all_files, line_ends("bytes"))

    @cached_property
    def placed(self) -> DataFrame:
        """Resolved operations without digests, written down: everything after reads these few columns many times."""
        return staged(resolve.resolve(self.operations, self.files), "placed", "zstd")

    @cached_property
    def resolved(self) -> DataFrame:
        """Resolved operations with their payloads' digests, written down for those who tell them."""
        return staged(resolve.with_payloads(self.placed, self.all_files), "resolved", "zstd")

    @cached_property
    def conflicts(self) -> DataFrame:
        every = resolve.edit_events(self.placed)
        overlaps = compose.overlapping_deletions(every).select("batch_id", "path", "operation_index", F.lit(0).alias("rank"), F.lit("OVERLAPPING_DELETIONS").alias("problem"))
        inside = compose.insertions_in_deletions(every).select("batch_id", "path", "operation_index", F.lit(1).alias("rank"), F.lit("INSERTION_IN_DELETION").alias("problem"))
        return overlaps.union(inside)

    @cached_property
    def sound(self) -> DataFrame:
        """Placed operations of the batches without any problem so far."""
        return staged(compose.unclashing(self.placed).join(self.unread.select("batch_id").distinct(), "batch_id", "left_anti"), "sound", "zstd")

    @cached_property
    def good(self) -> DataFrame:
        """The same with their payloads' digests."""
        return self.resolved.join(self.sound.select("batch_id").distinct(), "batch_id", "left_semi")

    @cached_property
    def events(self) -> DataFrame:
        return resolve.edit_events(self.sound)

    @cached_property
    def layout(self) -> DataFrame:
        """The segments of all outputs, written down for the same reason."""
        return staged(compose.segments(self.sound), "layout", "zstd")

    @cached_property
    def recipe(self) -> DataFrame:
        """The same with their payloads' digests."""
        paid = self.resolved.select("batch_id", "operation_index", "payload_sha256")
        return self.layout.join(paid, ["batch_id", "operation_index"], "left").select(*self.layout.columns, "payload_sha256")

    @cached_property
    def outputs(self) -> DataFrame:
        """Lengths and digests of all outputs, written down: limits, reports and manifests read them, and put nothing together again."""
        return staged(compose.outputs(self.layout, self.events, self.files), "outputs", "zstd")

    @cached_property
    def changes(self) -> DataFrame:
        """How all outputs changed, and their lengths: what limits and sums read, for which few outputs are put together."""
        if "outputs" in self.__dict__:
            return self.outputs.select(*compose.KEY, "change_kind", "before_length", "after_length")
        return staged(compose.changes(self.layout, self.events, self.files), "changed", "zstd")

    @cached_property
    def sides(self) -> DataFrame:
        """Every output with its bytes before and after, put together once."""
        return compose.composed(self.layout, self.events, self.files)

    def usage(self) -> DataFrame:
        return accounting.usage(self.placed, self.changes, self.layout)

    def problems(self) -> DataFrame:
        """The first problem of each batch that has one."""
        torn = self.unread.filter("phase = 'snapshot'")
        # A path that is asked for in two states stops everything; files are then read in path order.
        read = errors.problems(torn, "snapshot", None, "concat(rank, path)")
        index = errors.problems(self.unread.filter("phase = 'index'"), "index", None, "path")
        pre = errors.problems(resolve.precondition_conflicts(self.required), "precondition", "PRECONDITION_CONFLICT", "''", "operation_index * 2 + role")
        ops = errors.problems(self.placed.filter("problem is not null"), "operation", None, "''", "operation_index")
        linked = compose.linked_outputs(self.changes, self.used_files).select("batch_id", "path", F.lit(None).cast("long").alias("operation_index"), F.lit(2).alias("rank"), F.lit("HARD_LINK_NOT_SUPPORTED").alias("problem"))
        outs = errors.problems(self.conflicts.unionByName(linked), "output", None, "path", "rank")
        used = errors.problems(accounting.limit_violations(self.usage()), "budget", "RESOURCE_LIMIT_EXCEEDED")
        return errors.first_problem(read, index, pre, ops, outs, used)

    def digests(self, domain: bytes = b"") -> DataFrame:
        asked = self.required.select("batch_id", F.col("path").alias("r_path")).distinct()
        known = self.all_files.withColumnRenamed("path", "f_path").withColumn("byte_length", F.length("bytes").cast("long")).drop("bytes")
        inputs = asked.join(known, F.col("r_path") == F.col("f_path"), "left").select("batch_id", F.col("r_path").alias("path"), F.coalesce("existed", F.lit(False)).alias("existed"), "byte_length", "sha256", "device", "inode", "parent_device", "parent_inode")
        return planhash.plan_digests(inputs, self.operations, self.resolved, self.outputs, self.recipe, domain=domain)


def plan(operations: DataFrame, files: DataFrame) -> Plan:
    return Plan(operations, files)
