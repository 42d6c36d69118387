"""Transaction logs: record envelopes, manifests, states, transitions and chains, as set-oriented checks.

``states(transaction_id, sequence, global_state, targets, manifest_checksum, prior_checksum, checksum)``; ``targets`` is an array of
:data:`TARGET` structs: how far the candidate, the commit and the rollback of one target are, each with the identity that was
recorded for it. Each check gives rows with a ``problem``; a clean log gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import commit_rank, is_artifact_name, is_digest, is_transaction_id, path_problem
from .scan import running

MAX_STATES = 512
MAX_TARGETS = 1000
TARGET = "struct<target_index:bigint,candidate:string,candidate_identity:string,commit:string,commit_identity:string,preserved_mode:int,rollback:string,rollback_identity:string>"
# The states of a transaction, where each may go, what may be done in it and what may be seen of it.
EDGES = {
    "preparing": ("preparing", "prepared", "rolling_back"),
    "prepared": ("prepared", "committing", "rolling_back"),
    "committing": ("committing", "committed", "rolling_back"),
    "committed": (),
    "rolling_back": ("rolling_back", "rolled_back"),
    "rolled_back": (),
}
ACTIONS = {
    "preparing": ("status,rollback", "all_original"),
    "prepared": ("status,complete,rollback", "all_original"),
    "committing": ("status,complete,rollback", "mixed_old_new_possible"),
    "committed": ("status,cleanup", "all_planned"),
    "rolling_back": ("status,rollback", "mixed_old_new_possible"),
    "rolled_back": ("status,cleanup", "all_original"),
}


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, many in EDGES.items() for b in many], "from_state string, to_state string")


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, a, v) for s, (a, v) in ACTIONS.items()], "global_state string, actions string, visibility string")


def decode_envelopes(records: DataFrame, magic: bytes, version: int = 1, most: int = 64 << 20) -> DataFrame:
    """``records(name, data)``: magic, version, length, JSON and SHA-256 as ``payload``, or the first ``problem``."""
    n = F.length("data")
    m = len(magic)

    def number(at: int, size: int) -> Column:
        return F.conv(F.hex(F.substring("data", at + 1, size)), 16, 10).cast("decimal(20,0)")

    size = number(m + 4, 8)
    whole = F.lit(m + 12) + size + 32
    payload = F.substring(F.col("data"), F.lit(m + 13), F.when(size < most, size).otherwise(0).cast("int"))
    summed = F.unhex(F.sha2(F.substring(F.col("data"), F.lit(1), F.when(size < most, F.lit(m + 12) + size).otherwise(0).cast("int")), 256))
    stored = F.substring(F.col("data"), F.when(size < most, F.lit(m + 13) + size).otherwise(1).cast("int"), F.lit(32))
    problem = (
        F.when(n > most, "OVERSIZED")
        .when((n < m + 44) | (F.substring("data", 1, m) != F.lit(magic)), "MAGIC_OR_TRUNCATED")
        .when(number(m, 4) != version, "VERSION")
        .when(whole != n, "LENGTH")
        .when(stored != summed, "CHECKSUM")
        .when(~F.is_valid_utf8(payload.cast("string")) | F.expr("try_parse_json(string(payload))").isNull(), "PAYLOAD")
    )
    return records.withColumn("payload", payload).select("name", F.col("payload").cast("string").alias("payload"), problem.alias("problem"))


INPUT = "struct<path:string,existed:boolean,file_identity:string,sha256:string,length:bigint,link_count:bigint>"
SEGMENT = "struct<input_index:bigint,start:bigint,end:bigint,operation_index:bigint>"
MANIFEST_TARGET = f"struct<target_index:bigint,path:string,original_existed:boolean,original_identity:string,original_sha256:string,original_length:bigint,candidate_name:string,backup_name:string,candidate_sha256:string,candidate_length:bigint,metadata_policy:string,new_file_mode:int,segments:array<{SEGMENT}>>"
MANIFEST = f"transaction_id string, version int, plan_sha256 string, inputs array<{INPUT}>, targets array<{MANIFEST_TARGET}>"


def encode_envelopes(payloads: DataFrame, magic: bytes, version: int = 1, most: int = 64 << 20) -> DataFrame:
    """``payloads(name, payload)`` as ``data``, the records that :func:`decode_envelopes` reads; one that is too large is a problem."""
    body = F.encode("payload", "UTF-8")
    size = F.unhex(F.lpad(F.hex(F.length(body).cast("long")), 16, "0"))
    head = F.concat(F.lit(magic), F.lit(version.to_bytes(4, "big")), size, body)
    over = F.length(body) + len(magic) + 44 > most
    return payloads.select("name", F.when(~over, F.concat(head, F.unhex(F.sha2(head, 256)))).alias("data"), F.when(over, "OVERSIZED").alias("problem"))


def manifest_problems(manifests: DataFrame, disk_limit: int = 3 << 30, most: int = MAX_TARGETS, reserved: str = ".control") -> DataFrame:
    """``manifests`` of :data:`MANIFEST`; the first problem of each bad one, targets before inputs, each target whole before the next.

    Paths compare by their UTF-8 bytes. ``reserved``: the control folder, in any case, that no path may begin with.
    """
    t, i = F.col("targets"), F.col("inputs")

    def all_or_none(known: Column, *parts: Column) -> Column:
        full = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
        none = reduce(lambda a, b: a & b, [p.isNull() for p in parts])
        return (known & full) | (~known & none)

    def bad_path(path: Column) -> Column:
        return path.isNull() | path_problem(path, reserved).isNotNull() | (F.instr(path, "\0") > 0)

    def bad_digest(x: Column) -> Column:
        return ~F.coalesce(is_digest(x), F.lit(False))

    def segment(x: Column) -> Column:
        source = F.get(i, x["input_index"].cast("int"))
        return F.when(F.coalesce(x["start"] >= x["end"], F.lit(True)) | source.isNull(), "manifest_segment_invalid").when(source["length"].isNull() | (x["end"] > source["length"]), "manifest_segment_out_of_bounds")

    def one(x: Column, k: Column) -> Column:
        before = F.get(t, k - 1)["path"]
        mode = x["new_file_mode"]
        policy = F.when(x["metadata_policy"] == "preserve_existing_mode", x["original_existed"] & mode.isNull()).when(x["metadata_policy"] == "new_file_mode", ~x["original_existed"] & (mode <= 0o666) & (mode.bitwiseAND(0o111) == 0))
        return (
            F.when(bad_path(x["path"]), "manifest_path_invalid")
            .when(~F.coalesce(x["target_index"] == k, F.lit(False)), "manifest_target_index_invalid")
            .when((k > 0) & (before >= x["path"]), "manifest_targets_not_sorted")
            .when(~F.coalesce(is_artifact_name(x["candidate_name"], "candidate", k) & is_artifact_name(x["backup_name"], "backup", k), F.lit(False)), "generated_artifact_name_invalid")
            .when(bad_digest(x["candidate_sha256"]), "record_digest_invalid")
            .when(~F.coalesce(all_or_none(x["original_existed"], x["original_identity"], x["original_sha256"], x["original_length"]), F.lit(False)), "manifest_target_existence_fields_invalid")
            .when(x["original_sha256"].isNotNull() & bad_digest(x["original_sha256"]), "record_digest_invalid")
            .when(~F.coalesce(policy, F.lit(False)), "manifest_metadata_policy_invalid")
            .otherwise(first_of(F.transform(x["segments"], segment)))
        )

    def given(x: Column) -> Column:
        return (
            F.when(bad_path(x["path"]), "manifest_path_invalid")
            .when(~F.coalesce(all_or_none(x["existed"], x["file_identity"], x["sha256"], x["length"], x["link_count"]), F.lit(False)), "manifest_input_existence_fields_invalid")
            .when(x["sha256"].isNotNull() & bad_digest(x["sha256"]), "record_digest_invalid")
        )

    total = F.aggregate(t, F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + F.coalesce(x["candidate_length"], F.lit(0)) + F.coalesce(x["original_length"], F.lit(0))).cast("decimal(38,0)"))
    problem = (
        F.when(~F.coalesce(F.col("version") == 1, F.lit(False)), "manifest_version_unsupported")
        .when(~F.coalesce(is_transaction_id("transaction_id"), F.lit(False)), "transaction_id_invalid")
        .when(bad_digest(F.col("plan_sha256")), "record_digest_invalid")
        .when(F.coalesce(F.size(t), F.lit(0)) <= 0, "manifest_targets_empty")
        .when(F.size(t) > most, "transaction_targets")
        .otherwise(F.coalesce(first_of(F.transform(t, one)), F.when(total > disk_limit, "projected_transaction_disk_bytes"), first_of(F.transform(i, given))))
    )
    return manifests.select("transaction_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def target_problem(x: Column) -> Column:
    """A target on its own: each part has the identity that its kind calls for, and no other."""
    commit = (
        F.when(x["commit"] == "untouched", x["commit_identity"].isNull() & x["preserved_mode"].isNull())
        .when(x["commit"] == "backed_up", x["commit_identity"].isNotNull() & x["preserved_mode"].isNotNull())
        .when(x["commit"] == "installed", x["commit_identity"].isNotNull())
    )
    rollback = F.when(x["rollback"].isin("none", "absence_restored"), x["rollback_identity"].isNull()).when(x["rollback"] == "original_restored", x["rollback_identity"].isNotNull())
    candidate = F.when(x["candidate"] == "ready", x["candidate_identity"].isNotNull()).when(x["candidate"] == "missing", x["candidate_identity"].isNull())
    return (
        F.when(~F.coalesce(candidate, F.lit(False)), "candidate_identity_invalid")
        .when(~F.coalesce(commit, F.lit(False)), "commit_fields_invalid")
        .when(~F.coalesce(rollback, F.lit(False)), "rollback_fields_invalid")
    )


def first_of(problems: Column) -> Column:
    """The first problem of an array of them."""
    return F.get(F.filter(problems, lambda p: p.isNotNull()), F.lit(0))


def shape_problem() -> Column:
    """A state on its own: sequence, checksums, target numbers, each target's fields, and what its global state demands of all."""
    t = F.col("targets")
    each = F.transform(t, lambda x, k: F.when(~F.coalesce(x["target_index"] == k, F.lit(False)), "state_target_index_invalid").otherwise(target_problem(x)))
    ready = F.forall(t, lambda x: x["candidate"] == "ready")
    untouched = F.forall(t, lambda x: x["commit"] == "untouched")
    installed = F.forall(t, lambda x: x["commit"] == "installed")
    kept = F.forall(t, lambda x: x["rollback"] == "none")
    restored = F.forall(t, lambda x: x["rollback"] != "none")
    # A rollback may pass over a target that nothing was done to, or whose candidate is there to be put away.
    returning = F.forall(t, lambda x: (x["rollback"] != "none") | (x["commit"] == "untouched") | (x["candidate"] == "ready"))
    g = F.col("global_state")
    demand = (
        F.when(g == "preparing", untouched & kept)
        .when(g == "prepared", ready & untouched & kept)
        .when(g == "committing", ready & kept)
        .when(g == "committed", ready & installed & kept)
        .when(g == "rolling_back", returning)
        .when(g == "rolled_back", restored)
    )
    return (
        F.when((F.col("sequence") < 0) | (F.col("sequence") >= MAX_STATES), "state_records")
        .when((F.col("sequence") == 0) & F.col("prior_checksum").isNotNull(), "state_zero_prior_checksum_present")
        .when((F.col("sequence") != 0) & F.col("prior_checksum").isNull(), "state_prior_checksum_missing")
        .when(F.size(t) > MAX_TARGETS, "transaction_targets")
        .otherwise(F.coalesce(first_of(each), F.when(~F.coalesce(demand, F.lit(False)), "global_state_target_combination_invalid")))
    )


def state_problems(states: DataFrame) -> DataFrame:
    return states.select("transaction_id", "sequence", shape_problem().alias("problem")).filter(F.col("problem").isNotNull())


def state_manifest_problems(states: DataFrame, manifests: DataFrame) -> DataFrame:
    """States whose targets disagree with their manifest: their number, or a backup or restoration of what was not there."""
    m = manifests.select(F.col("transaction_id").alias("m_id"), F.transform("targets", lambda x: x["original_existed"]).alias("existed"))
    joined = states.join(m, F.col("transaction_id") == F.col("m_id"), "left")
    agree = F.zip_with("targets", "existed", lambda t, e: ((t["commit"] != "backed_up") | e) & ((t["rollback"] != "original_restored") | e) & ((t["rollback"] != "absence_restored") | ~e))
    problem = (
        F.when(F.col("m_id").isNull(), "manifest_missing")
        .when(F.size("targets") != F.size("existed"), "state_target_count_mismatch")
        .when(~F.forall(agree, lambda b: F.coalesce(b, F.lit(False))), "state_original_existence_mismatch")
    )
    return joined.select("transaction_id", "sequence", problem.alias("problem")).filter(F.col("problem").isNotNull())


def transition_problems(states: DataFrame, allowed: DataFrame) -> DataFrame:
    """Steps of a log that are not allowed: sequence, edge, targets, or the progress of one target."""
    log = Window.partitionBy("transaction_id").orderBy("sequence")
    step = states.withColumn("was", F.lag(F.struct("sequence", "global_state", "targets")).over(log)).filter(F.col("was").isNotNull())
    joined = step.join(F.broadcast(allowed), (F.col("was.global_state") == F.col("from_state")) & (F.col("global_state") == F.col("to_state")), "left")
    back = F.col("global_state").isin("rolling_back", "rolled_back")

    def same(a: Column, b: Column, *parts: str) -> Column:
        out = F.lit(True)
        for part in parts:
            out = out & a[part].eqNullSafe(b[part])
        return out

    def onward(a: Column, b: Column) -> Column:
        same_rollback = same(a, b, "rollback", "rollback_identity")
        # While rolling back nothing more is committed: the commit stays as it was, in every field.
        same_commit = same(a, b, "commit", "commit_identity", "preserved_mode")
        return (
            F.when(~F.coalesce(a["target_index"] == b["target_index"], F.lit(False)), "state_target_order_changed")
            .when(~same(a, b, "candidate", "candidate_identity") & ~((a["candidate"] == "missing") & (b["candidate"] == "ready")), "candidate_state_regressed")
            .when(~back & ~same_rollback, "rollback_progress_outside_rollback")
            .when((commit_rank(b["commit"]) < commit_rank(a["commit"])) | (back & ~same_commit), "commit_state_regressed")
            .when((a["rollback"] != "none") & ~same_rollback, "rollback_state_changed_after_restore")
        )

    problem = (
        F.when(F.col("sequence") != F.col("was.sequence") + 1, "state_sequence_not_contiguous")
        .when(F.col("to_state").isNull(), "invalid_global_state_transition")
        .when(F.size("targets") != F.size("was.targets"), "state_target_count_changed")
        .otherwise(first_of(F.zip_with(F.col("was.targets"), F.col("targets"), onward)))
    )
    return joined.select("transaction_id", "sequence", F.col("was.global_state").alias("from_state"), F.col("global_state").alias("to_state"), problem.alias("problem")).filter(F.col("problem").isNotNull())


def fold_chain(states: DataFrame, first_state: str = "preparing") -> DataFrame:
    """Of each transaction its last state, and what is wrong with the chain: a gap, a broken link, or a wrong beginning."""
    log = Window.partitionBy("transaction_id").orderBy("sequence")
    linked = states.withColumn("expected", F.lag("checksum").over(log))
    each = linked.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("states"),
        F.max("sequence").alias("last_sequence"),
        F.max_by("global_state", "sequence").alias("last_state"),
        F.min_by("global_state", "sequence").alias("begin"),
        F.count_distinct("manifest_checksum").alias("manifests"),
        F.count_if(~F.col("expected").eqNullSafe(F.col("prior_checksum"))).alias("forks"),
    )
    problem = F.when(F.col("last_sequence") + 1 != F.col("states"), "GAP").when(F.col("manifests") > 1, "MANIFEST_LINK").when(F.col("forks") > 0, "CHECKSUM_LINK").when(F.col("begin") != first_state, "BEGINNING")
    return each.select("transaction_id", "states", "last_sequence", "last_state", problem.alias("problem"))


def scan_control(active: DataFrame, completed: DataFrame, most: int = 100, most_bytes: int = 256 << 20) -> DataFrame:
    """Active and completed entries (``transaction_id, bytes``) together: ``transaction_id, place, duplicate``, and whether all of them
    exceed the number of entries or of bytes."""
    every = active.select("transaction_id", "bytes", F.lit("active").alias("place")).unionByName(completed.select("transaction_id", "bytes", F.lit("completed").alias("place")))
    each = every.groupBy("transaction_id").agg(F.array_join(F.array_sort(F.collect_set("place")), ",").alias("place"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    total = each.agg(F.sum("n").alias("total"), F.sum("bytes").alias("total_bytes"))  # one row
    excess = F.when(F.col("total") > most, "transaction_directories").when(F.col("total_bytes") > most_bytes, "transaction_bytes")
    return each.crossJoin(F.broadcast(total)).select("transaction_id", "place", (F.col("n") > 1).alias("duplicate"), excess.alias("exceeded"))


def classify_entries(entries: DataFrame, manifests: DataFrame, chains: DataFrame) -> DataFrame:
    """``entries(transaction_id, completed)``: orphan_record, manifest_only, cleanup_only or active."""
    m = manifests.select(F.col("transaction_id").alias("m_id")).distinct()
    c = chains.select(F.col("transaction_id").alias("c_id"), "last_state")
    joined = entries.join(m, F.col("transaction_id") == F.col("m_id"), "left").join(c, F.col("transaction_id") == F.col("c_id"), "left")
    kind = F.when(F.col("m_id").isNull(), "orphan_record").when(F.col("c_id").isNull(), "manifest_only").when(F.col("completed"), "cleanup_only").otherwise("active")
    return joined.select("transaction_id", "completed", kind.alias("entry"), "last_state")


def blocking(entries: DataFrame) -> DataFrame:
    """The entries that forbid a new transaction; cleanup-only ones do not."""
    return entries.filter("entry <> 'cleanup_only'").select("transaction_id", "entry")


def status(entries: DataFrame, known: DataFrame) -> DataFrame:
    """The listing: every entry with what may be done, and its place in id order."""
    joined = entries.join(F.broadcast(known), entries["last_state"] == known["global_state"], "left")  # six states
    # Kinds of entry are few and grow with the logs: places are running counts, not a window over a kind.
    listed = running(joined.select("transaction_id", "entry", "last_state", "actions", "visibility"), ["entry"], ["transaction_id"], {"place": F.lit(1)})
    return listed.withColumn("place", F.col("place").cast("int"))
