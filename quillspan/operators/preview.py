"""The preview of a plan: resolved operations, outputs, a bounded diff, a review and warnings, as one JSON line and as text.

A diff is a batch's chunks (a header's lines, then each line that goes or comes) in order, kept whole up to the first that would exceed a budget:
work (bytes looked at and written), bytes of text, and bytes of that text inside JSON. All three are running sums over a batch, which
:mod:`.scan` takes apart, so a batch of very many changed lines is no task of its own. With a review in the response the diff has what the rest of
the response leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lines import running_sums
from ..functions.scalars import BIDI, digest, head_sample, is_binary, json_cost, tail_sample, terminal_escape
from ..staging import staged
from . import review
from .scan import running

SIDE_BYTES = 8 << 20  #: longest side of an output that is compared line by line
DIFF_BYTES = 4 << 20
DIFF_WORK = 10_000_000
RESPONSE_BYTES = 16 << 20

# Names of changes, and the warning of a diff that leaves something out.
CHANGES = {"unchanged": "unchanged", "modified": "modified_existing", "created": "created_new", "emptied": "emptied_existing"}
TRUNCATED = ("DIFF_TRUNCATED", "the bounded preview diff omitted detail")


def shown(text: Column) -> Column:
    """Text for a terminal; most has nothing to escape."""
    return F.when(text.rlike(rf"[\x00-\x1F\x7F-\x9F{BIDI}]"), terminal_escape(text)).otherwise(text)


def diff_chunks(sides: DataFrame, most: int | None = None, work: int | None = None) -> DataFrame:
    """``batch_id, path, seq, text, work, raw, json`` of the changed outputs of ``sides``: what each chunk adds to the three sums.

    The first chunk of an output has no text: it is the work of reading both sides. ``most`` and ``work``: what no budget of the batch exceeds;
    chunks behind one of their own output that exceeds it stay out, since none of them could be kept, nor be the first that is not.
    """
    changed = sides.filter("change_kind <> 'unchanged'").withColumn("read", F.coalesce(F.length("before"), F.lit(0)) + F.coalesce(F.length("after"), F.lit(0)))
    hunks = review.prefix_suffix_diff(changed.select("batch_id", "path", "read", "before", "after"))
    head = F.array(F.concat(F.lit("--- "), F.col("path"), F.lit(" (before)")), F.concat(F.lit("+++ "), F.col("path"), F.lit(" (after)")), F.col("header"))
    lines = F.concat(F.array(F.lit(None).cast("string")), head, F.col("removed"), F.col("added"))
    # Escapes only lengthen a line: what stands before it unescaped is a bound from below.
    sizes = running_sums(F.transform("lines", lambda x: F.coalesce(F.octet_length(x) + 1, F.lit(0)).cast("long")))
    each = hunks.select("batch_id", "path", "read", lines.alias("lines")).select("batch_id", "path", "read", F.posexplode(F.arrays_zip("lines", sizes.alias("upto"))).alias("seq", "x"))
    ahead = F.col("x.upto") - F.coalesce(F.octet_length("x.lines") + 1, F.lit(0))
    if most is not None:
        each = each.filter(ahead <= most)
    if work is not None:
        each = each.filter((F.col("seq") == 0) | (F.col("read") + ahead <= work))
    text = F.when(F.col("seq") > 0, F.concat(shown(F.col("x.lines")), F.lit("\n")))
    each = each.select("batch_id", "path", F.col("seq").cast("long").alias("seq"), "read", text.alias("text"))
    raw = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return each.select("batch_id", "path", "seq", "text", F.when(F.col("seq") == 0, F.col("read")).otherwise(raw).cast("long").alias("work"), raw.alias("raw"), F.coalesce(json_cost("text"), F.lit(0)).alias("json"))


def cut_to_budget(chunks: DataFrame, budgets: DataFrame, work: int = DIFF_WORK) -> DataFrame:
    """``budgets(batch_id, most)`` with ``text`` (the whole chunks before the first that exceeds something), ``chunks`` (their number) and ``truncation``:
    null, ``work`` or ``output``.

    Sums run over the outputs of a batch, without any text, and over the chunks of an output; text is exchanged by output, and what is kept of it
    by batch.
    """
    sums = ("work", "raw", "json")
    given = staged(chunks, "chunks", "zstd")
    totals = given.groupBy("batch_id", "path").agg(*(F.sum(c).alias(c) for c in sums)).join(budgets, "batch_id")
    ends = running(totals, ["batch_id"], ["path"], {f"{c}_end": F.col(c) for c in sums})
    ahead = ends.select("batch_id", "path", "most", *((F.col(f"{c}_end") - F.col(c)).alias(f"{c}_ahead") for c in sums))
    inside = Window.partitionBy("batch_id", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = given.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in sums}).join(ahead, ["batch_id", "path"])
    upto = {c: F.col(f"{c}_ahead") + F.col(f"{c}_upto") for c in sums}
    marked = summed.withColumn("spent", F.when(upto["work"] > work, "work").when((upto["raw"] > F.col("most")) | (upto["json"] > F.col("most")), "output"))
    # Sums only grow: what is within every budget stands before the first that is not.
    kept = F.col("spent").isNull() & (F.col("seq") > 0)
    each = marked.groupBy("batch_id", "path").agg(F.expr("listagg(text) within group (order by seq) filter (where spent is null and seq > 0)").alias("text"), F.count_if(kept).alias("chunks"), F.min(F.when(F.col("spent").isNotNull(), F.struct("path", "seq", "spent"))).alias("first"))
    whole = each.groupBy("batch_id").agg(F.expr("listagg(text) within group (order by path)").alias("text"), F.sum("chunks").alias("chunks"), F.min("first").alias("first"))
    return budgets.join(whole, "batch_id", "left").select("batch_id", "most", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.col("first.spent").alias("truncation"))


def modes(sides: DataFrame, wanted: bool, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """``batch_id, mode``: ``omitted``, ``unchanged``, ``too_large``, ``binary`` or ``text``; one large or binary side decides for its batch."""
    changed = F.col("change_kind") != "unchanged"
    size = F.greatest(F.coalesce(F.length("before"), F.lit(0)), F.coalesce(F.length("after"), F.lit(0)))
    binary = F.coalesce(is_binary("before"), F.lit(False)) | F.coalesce(is_binary("after"), F.lit(False))
    each = sides.groupBy("batch_id").agg(F.bool_or(changed).alias("any"), F.bool_or(changed & (size > side_bytes)).alias("large"), F.bool_or(changed & binary).alias("binary"))
    return each.select("batch_id", F.when(F.lit(not wanted), "omitted").when(~F.col("any"), "unchanged").when(F.col("large"), "too_large").when(F.col("binary"), "binary").otherwise("text").alias("mode"))


def _in_order(df: DataFrame, order: str, item: Column, name: str) -> DataFrame:
    """A JSON array of each batch's rows."""
    rows = df.select("batch_id", order, F.to_json(item, {"ignoreNullFields": "false"}).alias("one"))
    return rows.groupBy("batch_id").agg(F.concat(F.lit("["), F.expr(f"listagg(one, ',') within group (order by {order})"), F.lit("]")).alias(name))


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("t")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def summary_entries(sides: DataFrame) -> DataFrame:
    """``batch_id, entries``: of each changed output lengths, digests and samples of both sides, keys in order of their names."""
    changed = sides.filter("change_kind <> 'unchanged'")

    def samples(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(head_sample(c).alias("head_base64"), tail_sample(c).alias("tail_base64")))

    entry = F.struct(F.length("after").cast("long").alias("after_length"), samples("after").alias("after_samples"), digest("after").alias("after_sha256"), F.length("before").cast("long").alias("before_length"), samples("before").alias("before_samples"), F.col("before_sha256"), F.col("path"))
    return _in_order(changed, "path", entry, "entries")


def reviews(p) -> DataFrame:
    """``batch_id, review``: the review of each plan as JSON, keys in order of their names."""
    ops = review.review_operations(p.sound, p.files)
    ops = _in_order(ops, "operation_index", F.struct("operation_index", "selected_byte_length", "selected_logical_line_count"), "ops")
    groups = review.insertion_groups(p.layout).groupBy("batch_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "destination_offset", "operation_indices"))), lambda g: F.struct(g["destination_offset"].alias("destination_offset"), g["operation_indices"].alias("operation_indices"))).alias("groups"))
    lines = review.review_outputs(p.outputs, p.layout, p.files).join(groups, ["batch_id", "path"], "left").join(p.outputs.select("batch_id", "path", F.col("change_kind").alias("change")), ["batch_id", "path"])
    lines = review.numbered(lines)
    none = F.array().cast("array<struct<destination_offset:bigint,operation_indices:array<bigint>>>")
    before = F.when(F.col("change") != "created", F.col("before_logical_line_count"))
    item = F.struct(F.col("after_logical_line_count"), before.alias("before_logical_line_count"), F.coalesce("groups", none).alias("insertion_groups_in_output_order"), F.col("output_index"))
    outs = _in_order(lines, "output_index", item, "outs")
    both = ops.join(outs, "batch_id", "left").join(p.digests(), "batch_id")
    text = F.concat(F.lit('{"operations":'), F.col("ops"), F.lit(',"outputs":'), F.coalesce("outs", F.lit("[]")), F.lit(',"plan_hash_version":1,"plan_sha256":"'), F.col("plan_sha256"), F.lit('","version":1}'))
    return both.select("batch_id", "plan_sha256", text.alias("review"))


def preview(p, workspace: str, diff: bool = True, with_review: bool = True, work: int = DIFF_WORK, diff_bytes: int = DIFF_BYTES, response_bytes: int = RESPONSE_BYTES, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """Of every batch of a plan that has no problem: ``response`` (a JSON line), ``mode``, ``text``, ``reason`` of what is left out, ``budget`` and ``problem``.

    ``workspace``: the workspace's identity as a digest. ``problem``: RESOURCE_LIMIT_EXCEEDED where the response without any diff, or the whole of it
    with a review, is longer than ``response_bytes``.
    """
    ops = p.good.select("batch_id", "operation_index", F.struct("operation_index", "kind", "source_path", "source_start", "source_end", "destination_path", "destination_offset", "effect", F.col("payload_sha256").alias("selected_payload_sha256")).alias("item"))
    outs = p.outputs.withColumn("change_kind", F.element_at(F.create_map(*(F.lit(x) for kv in CHANGES.items() for x in kv)), F.col("change_kind")))
    outs = outs.select("batch_id", "path", F.struct("path", "change_kind", "before_length", "before_sha256", "after_length", "after_sha256").alias("item"))
    base = _in_order(ops, "operation_index", F.col("item"), "ops").join(_in_order(outs, "path", F.col("item"), "outs"), "batch_id", "left").join(reviews(p), "batch_id")
    base = base.join(modes(p.sides, diff, side_bytes), "batch_id", "left").withColumn("mode", F.coalesce("mode", F.lit("unchanged" if diff else "omitted")))
    base = base.join(summary_entries(p.sides), "batch_id", "left")

    def warning(reason: Column) -> Column:
        code, message = TRUNCATED
        return F.when(reason.isNotNull(), F.concat(F.lit(f'{{"code":"{code}","message":"{message}","context":{{"reason":"'), reason, F.lit('"}}'))).otherwise("")

    def response(kind: Column, text: Column, legacy: Column, reason: Column) -> Column:
        own = F.concat(F.lit('"review":'), F.col("review")) if with_review else F.lit(None).cast("string")
        parts = F.concat_ws(",", legacy, own)
        summary = F.when(parts == "", F.lit("null")).otherwise(F.concat(F.lit("{"), parts, F.lit("}")))
        head = F.concat(F.lit('{"protocol_version":1,"plan_hash_version":1,"plan_sha256":"'), F.col("plan_sha256"), F.lit(f'","workspace_identity_hash":"{workspace}","resolved_operations":'), F.col("ops"), F.lit(',"outputs":'), F.coalesce("outs", F.lit("[]")))
        return F.concat(head, F.lit(',"diff":{"kind":"'), kind, F.lit('","text":'), F.coalesce(_quoted(text), F.lit("null")), F.lit(',"summary":'), summary, F.lit('},"warnings":['), warning(reason), F.lit("]}\n"))

    def limits(reason: Column) -> Column:
        return F.when(reason.isNotNull(), F.concat(F.lit(f'"maximum_diff_bytes":{diff_bytes},"maximum_work_units":{work},"reason":"'), reason, F.lit('"')))

    reserve = F.lit("response_budget")
    left = F.lit(response_bytes) - F.octet_length(response(F.lit("text"), F.lit(""), limits(reserve), reserve))
    budget = F.least(F.lit(diff_bytes), left).cast("long") if with_review else F.lit(diff_bytes).cast("long")
    base = base.withColumn("most", budget)
    made = cut_to_budget(diff_chunks(p.sides, diff_bytes, work), base.filter("mode = 'text'").select("batch_id", F.greatest("most", F.lit(0)).cast("long").alias("most")), work)
    every = base.join(made.drop("most"), "batch_id", "left")
    text_reason = F.when(F.col("truncation").isNull(), None).when((F.col("truncation") == "output") & (F.col("most") < diff_bytes), "response_budget").otherwise("diff_budget")
    reason = F.when(F.col("mode") == "text", text_reason).when(F.col("mode") == "too_large", "detailed_input_limit")
    entries = F.concat(F.lit('"outputs":'), F.col("entries"), F.lit(',"reason":"'), F.when(F.col("mode") == "binary", "binary_content").otherwise("detailed_input_limit"), F.lit('"'))
    legacy = F.when(F.col("mode") == "text", limits(F.col("reason"))).when(F.col("mode").isin("binary", "too_large"), entries)
    every = every.withColumn("reason", reason).withColumn("text", F.when(F.col("mode") == "unchanged", "").when(F.col("mode") == "text", F.col("text")))
    kind = F.when(F.col("mode").isin("binary", "omitted"), F.col("mode")).otherwise("text")
    every = every.withColumn("response", response(kind, F.col("text"), legacy, F.col("reason")))
    over = ((F.col("mode") == "text") & (F.col("most") < 0)) | (F.octet_length("response") > response_bytes) if with_review else F.lit(False)
    return every.select("batch_id", "mode", F.col("most").alias("budget"), "text", "reason", F.when(~over, F.col("response")).alias("response"), F.when(over, "RESOURCE_LIMIT_EXCEEDED").alias("problem"))
