"""What is told at the edges: commit reports, negotiated capabilities, configured servers and the gate of read-only commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How changes are spelled in reports, and the position encodings that a server may choose.
CHANGES = {"unchanged": "unchanged", "modified": "modified_existing", "created": "created_new", "emptied": "emptied_existing"}
ENCODINGS = ("utf-8", "utf-16", "utf-32")
SYNC_FULL, SYNC_INCREMENTAL = 1, 2


def commit_report(resolved: DataFrame, outputs: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """One row a batch: ``operations`` in order, each with the digest that it inserted (null for a no-op), ``outputs`` by path,
    ``files_changed``, and ``preserved_modes`` by path of ``modes(batch_id, path, mode)``.

    A batch's operations and outputs are bounded by the request's own limits.
    """
    entry = F.struct("operation_index", "kind", "source_path", "source_start", "source_end", "destination_path", "destination_offset", "effect", F.col("payload_sha256").alias("selected_payload_sha256"), F.when(F.col("effect") == "changed", F.col("payload_sha256")).alias("inserted_payload_sha256"))
    ops = resolved.filter(F.col("problem").isNull()).groupBy("batch_id").agg(F.array_sort(F.collect_list(entry)).alias("operations"))
    spelled = F.create_map(*(F.lit(x) for pair in CHANGES.items() for x in pair))
    made = F.struct("path", spelled[F.col("change_kind")].alias("change_kind"), "before_length", "before_sha256", "after_length", "after_sha256")
    outs = outputs.groupBy(F.col("batch_id").alias("o_batch")).agg(F.array_sort(F.collect_list(made)).alias("outputs"), F.array_sort(F.collect_list(F.when(F.col("change_kind") != "unchanged", F.col("path")))).alias("files_changed"))
    joined = ops.join(outs, F.col("batch_id") == F.col("o_batch"), "left").drop("o_batch")
    if modes is None:
        return joined.withColumn("preserved_modes", F.create_map().cast("map<string,int>"))
    kept = modes.groupBy(F.col("batch_id").alias("m_batch")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "mode")))).alias("preserved_modes"))
    return joined.join(kept, F.col("batch_id") == F.col("m_batch"), "left").drop("m_batch")


WARNING = "struct<code:string,message:string,context:map<string,string>>"


def commit_responses(p, workspace: str, transactions: DataFrame, modes: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """``batch_id, response``: the whole report of a commit as a JSON line, its parts in the report's own order.

    ``p``: a plan; ``transactions(batch_id, transaction_id)``: of the batches that were committed, the others changed nothing; ``warnings(batch_id, k,
    code, message, context)``: in order of ``k``.
    """
    report = commit_report(p.good, p.outputs, modes).join(p.digests(), "batch_id").join(transactions, "batch_id", "left")
    none = F.array().cast(f"array<{WARNING}>")
    if warnings is None:
        report = report.withColumn("warnings", none)
    else:
        each = F.collect_list(F.struct("k", F.struct("code", "message", "context").cast(WARNING).alias("w")))
        in_order = F.array_sort(each, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))  # a map has no order
        told = warnings.groupBy("batch_id").agg(F.transform(in_order, lambda x: x["w"]).alias("warnings"))
        report = report.join(told, "batch_id", "left").withColumn("warnings", F.coalesce("warnings", none))
    null = F.lit(None).cast("string")
    outputs = dict(report.dtypes)["outputs"]
    body = F.struct(
        F.lit(1).alias("protocol_version"),
        F.lit(1).alias("plan_hash_version"),
        "plan_sha256",
        F.lit(workspace).alias("workspace_identity_hash"),
        F.col("operations").alias("resolved_operations"),
        F.coalesce("outputs", F.array().cast(outputs)).alias("outputs"),
        F.struct(F.lit("omitted").alias("kind"), null.alias("text"), null.alias("summary")).alias("diff"),
        "warnings",
        "transaction_id",
        F.when(F.col("transaction_id").isNull(), "no_op").otherwise("committed").alias("transaction_state"),
        F.coalesce("files_changed", F.array().cast("array<string>")).alias("files_changed"),
        F.coalesce("preserved_modes", F.create_map().cast("map<string,int>")).alias("preserved_permission_modes"),
        F.lit("complete").alias("recoverability_status"),
        F.lit("recoverable_not_atomic").alias("visibility"),
    )
    return report.select("batch_id", F.concat(F.to_json(body, {"ignoreNullFields": "false"}), F.lit("\n")).alias("response"))


def negotiate(results: DataFrame) -> DataFrame:
    """``results(name, result)``, JSON of initialize results: ``position_encoding`` (UTF-16 where none is told), the server's name and version,
    or why the server cannot be used: symbols, then document sync, then encoding."""

    tree = F.try_parse_json("result")

    def kind(path: str) -> Column:
        """The JSON type of a part, null where there is none."""
        return F.schema_of_variant(F.try_variant_get(tree, f"$.{path}", "variant"))

    def typed(path: str, name: str, target: str) -> Column:
        """A part of that type and no other: the text "true" is no true."""
        return F.when(kind(path) == name, F.try_variant_get(tree, f"$.{path}", target))

    symbols, sync, encoding = (f"capabilities.{x}" for x in ("documentSymbolProvider", "textDocumentSync", "positionEncoding"))
    shown = typed(symbols, "BOOLEAN", "boolean") | kind(symbols).startswith("OBJECT")
    kinds = (SYNC_FULL, SYNC_INCREMENTAL)
    synced = F.coalesce(typed(sync, "BIGINT", "int").isin(*kinds), F.lit(False)) | (typed(f"{sync}.openClose", "BOOLEAN", "boolean") & typed(f"{sync}.change", "BIGINT", "int").isin(*kinds))
    chosen = typed(encoding, "STRING", "string")
    told = kind(encoding).isNotNull() & (kind(encoding) != "VOID")
    problem = (
        F.when(~F.coalesce(kind(symbols).startswith("OBJECT") | shown, F.lit(False)), "LSP_CAPABILITY_UNAVAILABLE")
        .when(~F.coalesce(synced, F.lit(False)), "LSP_DOCUMENT_SYNC_UNAVAILABLE")
        .when(F.coalesce(told, F.lit(False)) & ~F.coalesce(chosen.isin(*ENCODINGS), F.lit(False)), "UNSUPPORTED_TEXT_ENCODING")
    )
    good = problem.isNull()
    return results.select("name", F.when(good, F.coalesce(chosen, F.lit("utf-16"))).alias("position_encoding"), typed("serverInfo.name", "STRING", "string").alias("server_name"), typed("serverInfo.version", "STRING", "string").alias("server_version"), problem.alias("problem"))


def resolve_server(asked: DataFrame, user: DataFrame, builtin: DataFrame) -> DataFrame:
    """``asked(query_id, program, id, extension)`` against ``user`` and ``builtin`` descriptors ``(id, extension, program)``: a stated program first, then
    a stated id (the user's, then built in), then the extension (the user's, then built in); two of one kind are ambiguous."""
    every = user.withColumn("rank", F.lit(1)).unionByName(builtin.withColumn("rank", F.lit(2))).select(F.col("id").alias("s_id"), F.lower("extension").alias("s_extension"), F.col("program").alias("s_program"), "rank")
    open_ = asked.filter(F.col("program").isNull())
    extension = F.lower(F.regexp_replace("extension", r"\A\.", ""))
    # A stated id decides alone; each way is a join on equality.
    found = open_.filter(F.col("id").isNotNull()).join(every, F.col("id") == F.col("s_id")).unionByName(open_.filter(F.col("id").isNull()).join(every, extension == F.col("s_extension")))
    best = found.withColumn("best", F.min("rank").over(Window.partitionBy("query_id"))).filter(F.col("rank") == F.col("best")).groupBy(F.col("query_id").alias("q")).agg(F.count_distinct("s_id").alias("n"), F.min(F.struct("s_id", "s_program")).alias("s"))
    joined = asked.join(best, F.col("query_id") == F.col("q"), "left")
    problem = F.when(F.col("program").isNotNull(), F.lit(None)).when(F.col("n").isNull(), F.when(F.col("id").isNotNull(), "UNKNOWN_SERVER_ID").otherwise("LSP_SERVER_NOT_CONFIGURED")).when(F.col("n") > 1, "AMBIGUOUS_EXTENSION")
    chosen = F.when(F.col("program").isNotNull(), F.col("program")).when(F.col("n") == 1, F.col("s.s_program"))
    return joined.select("query_id", chosen.alias("program"), problem.alias("problem"))


def diagnostic_gate(workspaces: DataFrame, entries: DataFrame) -> DataFrame:
    """``workspaces(workspace, locked)``: without a lock a ``warning``; with one, and unfinished ``entries(workspace, transaction_id, entry)``, a ``problem`` and
    their ids."""
    left = entries.filter("entry <> 'cleanup_only'").groupBy(F.col("workspace").alias("w")).agg(F.array_sort(F.collect_list("transaction_id")).alias("ids"))
    joined = workspaces.join(left, F.col("workspace") == F.col("w"), "left")
    unfinished = F.col("locked") & F.col("ids").isNotNull()
    return joined.select("workspace", F.when(~F.col("locked"), "OBSERVATION_MAY_BE_STALE").alias("warning"), F.when(unfinished, "TRANSACTION_RECOVERY_REQUIRED").alias("problem"), F.when(unfinished, F.col("ids")).alias("transaction_ids"))
