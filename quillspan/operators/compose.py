"""Composition: edits of one output, laid out along its original bytes.

All of it is keyed by (batch, path): one exchange serves conflicts, segments and outputs, since their windows share that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lines import cut
from ..functions.scalars import digest
from ..staging import staged

KEY = ("batch_id", "path")


def overlapping_deletions(events: DataFrame) -> DataFrame:
    """Deletions that begin before the one before them on the same path has ended: ``batch_id, path, operation_index``."""
    before = Window.partitionBy(*KEY).orderBy("start", "end", "operation_index")
    cutting = events.filter("event = 'delete'")
    return cutting.withColumn("last_end", F.lag("end").over(before)).filter(F.col("start") < F.col("last_end")).select(*KEY, "operation_index")


def insertions_in_deletions(events: DataFrame) -> DataFrame:
    """Insertions strictly inside a deleted range: found by the depth of open deletions, without comparing pairs.

    At an offset deletions end first, then insertions stand, then deletions begin; so an insertion at either end of a
    deletion is outside of it. Two deletions that only meet there leave the depth at 0 between them.
    """
    order = F.when(F.col("event") == "end", 0).when(F.col("event") == "insert", 1).otherwise(2)
    cutting = events.filter("event = 'delete'")
    marks = (
        events.filter("event = 'insert'").select(*KEY, F.col("start").alias("at"), F.lit(0).alias("step"), "event", "operation_index")
        .unionByName(cutting.select(*KEY, F.col("start").alias("at"), F.lit(1).alias("step"), F.lit("begin").alias("event"), "operation_index"))
        .unionByName(cutting.select(*KEY, F.col("end").alias("at"), F.lit(-1).alias("step"), F.lit("end").alias("event"), "operation_index"))
    )
    upto = Window.partitionBy(*KEY).orderBy("at", order, "operation_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("depth", F.sum("step").over(upto)).filter("event = 'insert' and depth > 0").select(*KEY, "operation_index", F.col("at").alias("offset"))


def unclashing(resolved: DataFrame) -> DataFrame:
    """The operations of batches in which none has a problem, no deletions overlap and nothing is inserted inside one.

    Dealt out by batch once: marks of a path in order, then all of a batch. An operation's row goes along with its insertion.
    """
    live = F.col("problem").isNull() & (F.col("effect") == "changed")
    others = [c for c in resolved.columns if c != "batch_id"]
    kind = dict(resolved.select(F.struct(*others).alias("op")).dtypes)["op"]

    def mark(path: str, at: str, turn: int, step: int, op: Column) -> Column:
        return F.struct(F.col(path).alias("path"), F.col(at).alias("at"), F.lit(turn).alias("turn"), F.lit(step).alias("step"), op.cast(kind).alias("op"))

    # At an offset deletions end first, then insertions stand, then deletions begin.
    put = mark("destination_path", "destination_offset", 1, 0, F.struct(*others))
    none = F.lit(None)
    cutting = F.array(put, mark("source_path", "source_start", 2, 1, none), mark("source_path", "source_end", 0, -1, none))
    marks = resolved.repartition("batch_id").select("batch_id", F.inline(F.when(live & (F.col("kind") == "move"), cutting).otherwise(F.array(put))))
    upto = Window.partitionBy(*KEY).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = marks.withColumn("depth", F.sum("step").over(upto))
    inside = (F.col("turn") == 1) & F.col("op.problem").isNull() & (F.col("op.effect") == "changed") & (F.col("depth") > 0)
    bad = inside | ((F.col("turn") == 2) & (F.col("depth") > 1)) | F.col("op.problem").isNotNull()
    told = deep.withColumn("clash", F.max(F.coalesce(bad, F.lit(False))).over(Window.partitionBy("batch_id")))
    return told.filter(~F.col("clash") & F.col("op").isNotNull()).select(*(F.col(c) if c == "batch_id" else F.col(f"op.{c}").alias(c) for c in resolved.columns))


def segments(resolved: DataFrame) -> DataFrame:
    """The recipe of every output: ``seg`` from 0, ``seg_class`` original or payload, and the range it is taken from.

    ``resolved``: with the lengths of both files, 0 for one that does not exist; no edits clash. Kept ranges split at every event;
    payloads stand at their offset before the kept range that begins there, in order of their operations. Marks of a path are dealt out
    once: between two that stand apart the bytes are kept where no deletion is open.
    """
    live = resolved.filter(F.col("problem").isNull() & (F.col("effect") == "changed"))
    null = F.lit(None)
    part = "struct<place:bigint,rank:int,operation_index:bigint,source_path:string,start:bigint,end:bigint>"

    def mark(path: str, at: str, length: str, step: int, put: Column) -> Column:
        return F.struct(F.col(path).alias("path"), F.col(at).alias("at"), F.col(length).alias("length"), F.lit(step).alias("step"), put.cast(part).alias("put"))

    put = mark("destination_path", "destination_offset", "destination_length", 0, F.struct("destination_offset", F.lit(0), "operation_index", "source_path", "source_start", "source_end"))
    cutting = F.array(put, mark("source_path", "source_start", "source_length", 1, null), mark("source_path", "source_end", "source_length", -1, null))
    marks = live.select("batch_id", F.inline(F.when(F.col("kind") == "move", cutting).otherwise(F.array(put))))
    along = Window.partitionBy(*KEY).orderBy("at")
    found = marks.withColumns({
        "depth": F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "first": F.lag("at").over(along).isNull(),
        "next": F.coalesce(F.lead("at").over(along), F.col("length")),
    })

    def kept(start: Column, end: Column) -> Column:
        return F.struct(start, F.lit(1), null, F.col("path"), start, end).cast(part)

    zero = F.lit(0).cast("long")
    before = F.when(F.col("first") & (F.col("at") > 0), kept(zero, F.col("at")))
    behind = F.when((F.col("depth") == 0) & (F.col("next") > F.col("at")), kept(F.col("at"), F.col("next")))
    every = found.select(*KEY, F.inline(F.array_compact(F.array(before, "put", behind))))
    order = Window.partitionBy(*KEY).orderBy("place", "rank", "operation_index")
    return every.select(*KEY, (F.row_number().over(order) - 1).cast("long").alias("seg"), F.when(F.col("rank") == 0, "payload").otherwise("original").alias("seg_class"), "operation_index", "source_path", "start", "end", F.col("place").alias("offset"))


def composed(recipe: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """Every output with its bytes ``before`` (null for a new file) and ``after``, how it changed, and the digest before.

    ``files(path, existed, bytes)``.
    """
    joined = parts_of(recipe, files, events).join(contents(files), F.col("path") == F.col("b_path"), "left")
    existed = F.coalesce("b_existed", F.lit(False))
    made = joined.withColumn("after", put_together("parts", "b_bytes"))
    change = F.when(~existed, "created").when(F.col("after") == F.col("b_bytes"), "unchanged").when(F.length("after") == 0, "emptied").otherwise("modified")
    return made.select(*KEY, change.alias("change_kind"), F.when(existed, F.col("b_bytes")).alias("before"), "after", F.when(existed, F.length("b_bytes")).cast("long").alias("before_length"), F.when(existed, digest("b_bytes")).alias("before_sha256"))


def outputs(recipe: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """Every output with its bytes' length and digest before and after, and how it changed."""
    return composed(recipe, events, files).select(*KEY, "change_kind", "before_length", "before_sha256", F.length("after").cast("long").alias("after_length"), digest("after").alias("after_sha256"))


def changes(recipe: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """Every output with its length before and after and how it changed, without its bytes wherever lengths tell.

    ``files(path, existed, bytes, byte_length)``; ``recipe`` lies inside its files. An output that is as long as its file was may hold the
    same bytes: such outputs alone are put together and compared.
    """
    sums = recipe.select(*KEY, (F.col("end") - F.col("start")).alias("n")).unionByName(events.select(*KEY, F.lit(0).cast("long").alias("n")))
    known = files.select(F.col("path").alias("b_path"), F.col("existed").alias("b_existed"), F.col("byte_length").alias("b_length"))
    joined = sums.groupBy(*KEY).agg(F.sum("n").alias("after_length")).join(known, F.col("path") == F.col("b_path"), "left")
    existed = F.coalesce("b_existed", F.lit(False))
    same = F.col("after_length") == F.col("b_length")
    kind = F.when(~existed, "created").when(same & (F.col("after_length") > 0), None).when(same, "unchanged").when(F.col("after_length") == 0, "emptied").otherwise("modified")
    told = staged(joined.select(*KEY, kind.alias("change_kind"), F.when(existed, F.col("b_length")).alias("before_length"), "after_length"), "changes", "zstd")
    open_ = told.filter("change_kind is null")
    compared = composed(recipe.join(open_.select(*KEY), list(KEY), "left_semi"), open_, files)
    compared = compared.select(*KEY, "change_kind", "before_length", F.length("after").cast("long").alias("after_length"))
    return told.filter("change_kind is not null").unionByName(compared)


def contents(files: DataFrame) -> DataFrame:
    """What both joins below read of the files; alike, so that one exchange serves them."""
    return files.select(F.col("path").alias("b_path"), F.col("existed").alias("b_existed"), F.col("bytes").alias("b_bytes"))


def parts_of(recipe: DataFrame, files: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Every output (of ``events`` too, that have no segment) with its ``parts`` in order: the bytes of other files, the ranges of its own.

    Only payloads out of other files are cut at their sources. What is taken from the output's own file is cut where the file is joined to
    it, so that no output is exchanged whole.
    """
    null = F.lit(None)
    foreign = F.col("source_path") != F.col("path")
    paid = recipe.filter(foreign).join(contents(files), F.col("source_path") == F.col("b_path"), "left")
    paid = paid.select(*KEY, "seg", null.cast("long").alias("start"), null.cast("long").alias("end"), F.when(F.col("b_existed"), cut("b_bytes", F.col("start"), F.col("end"))).alias("part"))
    every = paid.unionByName(recipe.filter(~foreign).select(*KEY, "seg", "start", "end"), allowMissingColumns=True)
    if events is not None:
        every = every.unionByName(events.select(*KEY), allowMissingColumns=True)
    item = F.when(F.col("seg").isNotNull(), F.struct("seg", "start", "end", "part"))
    return every.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("parts"))


def put_together(parts: str, data: str) -> Column:
    """The bytes of an output; strings are bytes here, of no charset."""
    return F.array_join(F.transform(parts, lambda x: F.coalesce(x["part"], cut(data, x["start"], x["end"])).cast("string")), "").cast("binary")


def rendered(recipe: DataFrame, files: DataFrame) -> DataFrame:
    """The bytes of every output of a recipe."""
    return parts_of(recipe, files).join(contents(files), F.col("path") == F.col("b_path"), "left").select(*KEY, put_together("parts", "b_bytes").alias("bytes"))


def linked_outputs(made: DataFrame, files: DataFrame) -> DataFrame:
    """Outputs that change a file with more than one link."""
    links = files.filter("existed").select(F.col("path").alias("f_path"), "link_count")
    return made.filter("change_kind in ('modified', 'emptied')").join(links, F.col("path") == F.col("f_path")).filter("link_count <> 1").select(*KEY, "link_count")


def changed_paths(made: DataFrame) -> DataFrame:
    """Of each batch the changed paths in byte order."""
    return made.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.when(F.col("change_kind") != "unchanged", F.col("path")))).alias("paths"))
