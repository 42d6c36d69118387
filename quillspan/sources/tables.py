"""The driver's tables read as the engine's inputs: documents as files, orders as batches, events as logs, nations as symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import digest

#: Documents of a batch's own pool: small, so that edits of one batch meet.
POOL = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(number) -> Column:
    return F.lpad(number.cast("string"), 8, "0")


def files(spark: SparkSession, sf_dir: str, terminators: bool = False) -> DataFrame:
    """Documents as files. ``terminators``: with every kind of line end (CRLF for ids that leave 1 by 3, CR for 2, and an end
    on even ids), which the texts themselves do not have."""
    d = table(spark, sf_dir, "documents")
    text = F.col("text")
    if terminators:
        k = F.col("doc_id") % 3
        text = F.when(k == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).when(k == 2, F.replace(text, F.lit("\n"), F.lit("\r"))).otherwise(text)
        text = F.concat(text, F.when(F.col("doc_id") % 2 == 0, "\n").otherwise(""))
    data = F.encode(text, "UTF-8")
    zero = F.lit(0).cast("decimal(20,0)")
    one = F.lit(1).cast("decimal(20,0)")
    return d.select(path_of(F.col("doc_id")).alias("path"), F.lit(True).alias("existed"), data.alias("bytes"), digest(data).alias("sha256"), one.alias("device"), (F.col("doc_id") % 900).cast("decimal(20,0)").alias("inode"), one.alias("parent_device"), zero.alias("parent_inode"), one.alias("link_count"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, sha``: what the batches below are made with; kept apart from the engine's own line functions."""
    d = table(spark, sf_dir, "documents")
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + F.when(F.col("text").endswith("\n") | (F.col("text") == ""), 0).otherwise(1)
    return d.select("doc_id", n.cast("long").alias("n_lines"), digest(F.encode("text", "UTF-8")).alias("sha"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edit requests: a batch a customer, lines moved (status F) or copied inside the customer's pool of documents."""
    from pyspark.sql.window import Window

    orders = table(spark, sf_dir, "orders")
    n_docs = F.broadcast(table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs")))
    index = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    o = orders.withColumn("operation_index", index).crossJoin(n_docs)
    o = o.withColumn("src", (F.col("o_custkey") * 11 + F.col("o_orderkey") % POOL) % F.col("n_docs")).withColumn("dst", (F.col("o_custkey") * 11 + F.floor(F.col("o_orderkey") / POOL) % POOL) % F.col("n_docs"))
    lines = line_counts(spark, sf_dir)
    s = lines.select(F.col("doc_id").alias("s_id"), F.col("n_lines").alias("s_lines"), F.col("sha").alias("s_sha"))
    d = lines.select(F.col("doc_id").alias("d_id"), F.col("n_lines").alias("d_lines"), F.col("sha").alias("d_sha"))
    o = o.join(s, F.col("src") == F.col("s_id")).join(d, F.col("dst") == F.col("d_id"))
    # A document without lines has none to name: a remainder by 0 is an error where Spark is strict, and null in SQL.
    s_count, d_count = F.nullif(F.col("s_lines"), F.lit(0)), F.nullif(F.col("d_lines"), F.lit(0))
    first = F.col("o_orderkey") % s_count + 1
    last = F.least(first + F.floor(F.col("o_orderkey") / 5) % 2, F.col("s_lines"))
    kind = F.element_at(F.array(*map(F.lit, ("file_start", "file_end", "before_line", "after_line", "byte_offset"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    line = F.when(kind.isin("before_line", "after_line"), F.floor(F.col("o_orderkey") / 7) % d_count + 1)
    u64 = "decimal(20,0)"
    return o.select(
        F.col("o_custkey").cast("string").alias("batch_id"),
        "operation_index",
        F.when(F.col("o_orderstatus") == "F", "move").otherwise("copy").alias("kind"),
        F.struct(path_of(F.col("src")).alias("path"), F.struct(F.lit("lines").alias("kind"), first.cast(u64).alias("start"), last.cast(u64).alias("end")).alias("selector"), F.struct(F.lit("sha256").alias("kind"), F.col("s_sha").alias("value")).alias("precondition")).alias("source"),
        F.struct(path_of(F.col("dst")).alias("path"), F.struct(kind.alias("kind"), line.cast(u64).alias("line"), F.when(kind == "byte_offset", F.lit(0)).cast(u64).alias("offset")).alias("anchor"), F.struct(F.lit("sha256").alias("kind"), F.col("d_sha").alias("value")).alias("precondition")).alias("destination"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logs: a transaction a user, numbered by time, each event type a global state, each state one target."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    state = F.expr("CASE event_type WHEN 'signup' THEN 'preparing' WHEN 'view' THEN 'prepared' WHEN 'click' THEN 'committing' WHEN 'error' THEN IF(event_id % 5 = 0, 'rolled_back', 'rolling_back') ELSE 'committed' END")
    own = F.concat(F.lit("sha256:"), F.sha2(F.col("event_id").cast("string"), 256))
    who = F.concat(F.lit("1:"), F.col("user_id").cast("string"))
    candidate = F.when((state == "preparing") & (F.col("event_id") % 4 == 0), "missing").otherwise("ready")
    commit = F.when(state.isin("preparing", "prepared"), "untouched").when(state == "committing", F.when(F.col("event_id") % 2 == 0, "backed_up").otherwise("installed")).otherwise("installed")
    rollback = F.when((state == "rolled_back") | ((state == "rolling_back") & (F.col("event_id") % 3 == 0)), "original_restored").otherwise("none")
    target = F.array(
        F.struct(
            F.lit(0).cast("long").alias("target_index"),
            candidate.alias("candidate"),
            F.when(candidate == "ready", who).alias("candidate_identity"),
            commit.alias("commit"),
            F.when(commit != "untouched", who).alias("commit_identity"),
            F.when(commit != "untouched", F.lit(420)).alias("preserved_mode"),
            rollback.alias("rollback"),
            F.when(rollback == "original_restored", who).alias("rollback_identity"),
        )
    )
    n = F.row_number().over(order) - 1
    df = e.select(F.col("user_id").cast("string").alias("transaction_id"), n.cast("long").alias("sequence"), "event_id", state.alias("global_state"), target.alias("targets"), own.alias("checksum"), F.lag(own).over(order).alias("prior"))
    # Every 50th event loses its link, so that there are forks to find.
    return df.select("transaction_id", "sequence", "global_state", "targets", F.concat(F.lit("m-"), "transaction_id").alias("manifest_checksum"), F.when(F.col("event_id") % 50 == 0, F.lit("sha256:lost")).otherwise(F.col("prior")).alias("prior_checksum"), "checksum")
