"""Review and preview: logical lines before and after, insertion groups, diff modes and prefix/suffix diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lines import common_end, common_start, cut, fold_metrics, line_number, metrics, metrics_lines, rest, terminator_label, text_pieces
from ..functions.scalars import is_binary

KEY = ("batch_id", "path")
BINARY_SIDE = 8 << 20  #: larger sides are not compared as text


def review_operations(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Of each operation the bytes and the logical lines that it selects."""
    src = files.select(F.col("path").alias("s_path"), "bytes")
    good = resolved.filter(F.col("problem").isNull()).join(src, F.col("source_path") == F.col("s_path"))
    m = metrics(cut("bytes", F.col("source_start"), F.col("source_end")))
    return good.select("batch_id", "operation_index", (F.col("source_end") - F.col("source_start")).alias("selected_byte_length"), metrics_lines(m).alias("selected_logical_line_count"))


def review_outputs(made: DataFrame, recipe: DataFrame, files: DataFrame) -> DataFrame:
    """Of each output the logical lines before and after; a CRLF that is put together across a seam is one terminator."""
    src = files.select(F.col("path").alias("s_path"), "bytes")
    parts = recipe.join(src, F.col("source_path") == F.col("s_path")).select(*KEY, "seg", metrics(cut("bytes", F.col("start"), F.col("end"))).alias("m"))
    folded = parts.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "m"))), lambda x: x["m"]).alias("ms")).select(*KEY, metrics_lines(fold_metrics(F.col("ms"))).alias("after"))
    before = files.filter("existed").select(F.col("path").alias("b_path"), metrics_lines(metrics("bytes")).alias("before"))
    joined = made.join(folded, list(KEY), "left").join(before, F.col("path") == F.col("b_path"), "left")
    return joined.select(*KEY, F.coalesce("before", F.lit(0)).alias("before_logical_line_count"), F.coalesce("after", F.lit(0)).alias("after_logical_line_count"))


def insertion_groups(recipe: DataFrame) -> DataFrame:
    """Runs of payloads that stand next to each other at one offset: ``group`` from 0, with their operations in order."""
    by_path = Window.partitionBy(*KEY).orderBy("seg")
    paid = recipe.filter("seg_class = 'payload'").withColumn("fresh", (F.col("seg") - 1).eqNullSafe(F.lag("seg").over(by_path)) & F.col("offset").eqNullSafe(F.lag("offset").over(by_path)))
    numbered = paid.withColumn("group", F.sum(F.when(F.col("fresh"), 0).otherwise(1)).over(by_path.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return numbered.groupBy(*KEY, "group").agg(F.min("offset").alias("destination_offset"), F.transform(F.array_sort(F.collect_list(F.struct("seg", "operation_index"))), lambda x: x["operation_index"]).alias("operation_indices"))


def diff_mode(sides: DataFrame, wanted: bool = True) -> DataFrame:
    """``sides(batch_id, path, change_kind, before, after)``: of each batch how it is shown; one binary output makes it all binary."""
    changed = F.col("change_kind") != "unchanged"
    large = (F.coalesce(F.length("before"), F.lit(0)) > BINARY_SIDE) | (F.coalesce(F.length("after"), F.lit(0)) > BINARY_SIDE)
    binary = F.coalesce(is_binary("before"), F.lit(False)) | F.coalesce(is_binary("after"), F.lit(False))
    each = sides.groupBy("batch_id").agg(F.bool_or(changed).alias("any"), F.bool_or(changed & large).alias("large"), F.bool_or(changed & binary).alias("binary"))
    mode = F.when(F.lit(not wanted), "none").when(~F.col("any"), "unchanged").when(F.col("large"), "too_large").when(F.col("binary"), "binary").otherwise("text")
    return each.select("batch_id", mode.alias("mode"))


def prefix_suffix_diff(sides: DataFrame) -> DataFrame:
    """``sides(..., before, after)`` with one hunk each: lines in common at the start, then at the end of the rest, stay out.

    ``prefix``, ``suffix``, the hunk's ``header``, and ``removed`` / ``added`` lines with their terminators' labels.
    """
    keys = [c for c in sides.columns if c not in ("before", "after")]
    empty = F.unhex(F.lit(""))
    df = sides.select(*keys, F.coalesce("before", empty).alias("a"), F.coalesce("after", empty).alias("b"))
    # What is in common is found by bytes and only counted in lines; nothing but the hunk is split.
    df = df.withColumn("top", common_start("a", "b"))
    df = df.select(*keys, line_number(rest("a", F.lit(0), F.col("top"))).alias("prefix"), rest("a", F.col("top"), F.length("a")).alias("a"), rest("b", F.col("top"), F.length("b")).alias("b"))
    df = df.withColumn("low", common_end("a", "b"))
    # Lines end at bytes of one character, so a hunk is decoded whole; its lines hold no terminator but the last bytes.
    hunk = {c: F.decode(rest(c, F.lit(0), F.length(c) - F.col("low")), "UTF-8").alias(f"r{c}") for c in ("a", "b")}
    df = df.select(*keys, "prefix", line_number(rest("a", F.length("a") - F.col("low"), F.length("a"))).alias("suffix"), *hunk.values())

    def shown(c, sign):
        return F.transform(text_pieces(F.col(c)), lambda p: F.concat(F.lit(sign), F.rtrim(p, F.lit("\r\n")), F.lit(" ["), terminator_label(p), F.lit("]")))

    df = df.withColumn("removed", shown("ra", "-")).withColumn("added", shown("rb", "+"))
    header = F.format_string("@@ -%d,%d +%d,%d @@", F.col("prefix") + 1, F.size("removed"), F.col("prefix") + 1, F.size("added"))
    return df.select(*keys, "prefix", "suffix", header.alias("header"), "removed", "added")


def numbered(made: DataFrame) -> DataFrame:
    """Outputs with ``output_index``, their place in path order in their batch."""
    return made.withColumn("output_index", (F.row_number().over(Window.partitionBy("batch_id").orderBy("path")) - 1).cast("long"))


def human_report(ops: DataFrame, made: DataFrame, diffs: DataFrame) -> DataFrame:
    """``batch_id, text``: a line an operation, a line an output, the diff, and a line a warning.

    ``ops``: resolved operations; ``diffs(batch_id, mode, text, reason)``: as a preview has them.
    """
    from .preview import CHANGES, TRUNCATED, shown

    name = F.element_at(F.create_map(*(F.lit(x) for kv in CHANGES.items() for x in kv)), F.col("change_kind"))
    null = F.lit("null")
    lines = ops.select("batch_id", F.lit(1).alias("part"), F.lpad(F.col("operation_index").cast("string"), 12, "0").alias("key"), F.format_string("- [%d] %s %s[%d..%d) -> %s@%d effect=%s selected_payload_sha256=%s\n", "operation_index", "kind", shown(F.col("source_path")), "source_start", "source_end", shown(F.col("destination_path")), "destination_offset", "effect", "payload_sha256").alias("line"))
    outs = made.select("batch_id", F.lit(3).alias("part"), F.col("path").alias("key"), F.format_string("- %s change=%s before_length=%s before_sha256=%s after_length=%d after_sha256=%s\n", shown(F.col("path")), name, F.coalesce(F.col("before_length").cast("string"), null), F.coalesce("before_sha256", null), "after_length", "after_sha256").alias("line"))
    text = F.when(F.col("mode") == "omitted", "omitted\n").when((F.col("mode") == "unchanged") | (F.col("text") == ""), "(no byte changes)\n").when(F.col("mode") == "text", F.col("text")).otherwise(F.concat("mode", F.lit(" summary\n")))
    shown_diff = diffs.select("batch_id", F.lit(5).alias("part"), F.lit("").alias("key"), text.alias("line"))
    told = diffs.filter("reason is not null").select("batch_id", F.lit(7).alias("part"), F.lit("").alias("key"), F.lit("- %s: %s\n" % TRUNCATED).alias("line"))
    titles = diffs.select("batch_id", F.inline(F.array(*(F.struct(F.lit(k).alias("part"), F.lit("").alias("key"), F.lit(t).alias("line")) for k, t in ((0, "resolved_operations:\n"), (2, "outputs:\n"), (4, "diff:\n"), (6, "warnings:\n"))))))
    known = diffs.select("batch_id")
    every = titles.unionByName(lines.join(known, "batch_id", "left_semi")).unionByName(outs.join(known, "batch_id", "left_semi")).unionByName(shown_diff).unionByName(told)
    return every.groupBy("batch_id").agg(F.expr("listagg(line) within group (order by part, key)").alias("text"))
