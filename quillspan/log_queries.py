"""Named queries on transaction logs and recovery. The SQL beside each is written out by hand, from no table of this package."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import schemas
from .functions.scalars import digest
from .named import query
from .operators import journal, recovery, reports
from .sources import sinks
from .sources import tables as T

EDGES = """ed(a, b) AS (VALUES ('preparing', 'preparing'), ('preparing', 'prepared'), ('preparing', 'rolling_back'), ('prepared', 'prepared'), ('prepared', 'committing'), ('prepared', 'rolling_back'),
('committing', 'committing'), ('committing', 'committed'), ('committing', 'rolling_back'), ('rolling_back', 'rolling_back'), ('rolling_back', 'rolled_back'))"""
LOG = f"""e AS (SELECT CAST(user_id AS VARCHAR) AS t, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS q, CASE event_type WHEN 'signup' THEN 'preparing' WHEN 'view' THEN 'prepared' WHEN 'click' THEN 'committing' WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'rolled_back' ELSE 'rolling_back' END ELSE 'committed' END AS g FROM events),
c AS (SELECT *, CASE WHEN g = 'preparing' AND event_id % 4 = 0 THEN 'missing' ELSE 'ready' END AS ca, CASE WHEN g IN ('preparing', 'prepared') THEN 0 WHEN g = 'committing' AND event_id % 2 = 0 THEN 1 ELSE 2 END AS rk, CASE WHEN g = 'rolled_back' OR (g = 'rolling_back' AND event_id % 3 = 0) THEN 'original_restored' ELSE 'none' END AS ro FROM e),
d AS (SELECT *, lag(g) OVER p AS pg, lag(ca) OVER p AS pc, lag(rk) OVER p AS pr, lag(ro) OVER p AS po FROM c WINDOW p AS (PARTITION BY t ORDER BY q)), {EDGES}"""


@query(f"""WITH {LOG}, s AS (SELECT t AS transaction_id, q AS sequence, pg AS from_state, g AS to_state, CASE WHEN (pg, g) NOT IN (SELECT (a, b) FROM ed) THEN 'invalid_global_state_transition' WHEN pc = 'ready' AND ca = 'missing' THEN 'candidate_state_regressed'
  WHEN g NOT IN ('rolling_back', 'rolled_back') AND po <> ro THEN 'rollback_progress_outside_rollback' WHEN rk < pr OR (g IN ('rolling_back', 'rolled_back') AND rk <> pr) THEN 'commit_state_regressed' WHEN po <> 'none' AND ro <> po THEN 'rollback_state_changed_after_restore' END AS problem FROM d WHERE pg IS NOT NULL)
SELECT * FROM s WHERE problem IS NOT NULL""")
def state_transitions(spark, sf_dir):
    return journal.transition_problems(T.journal(spark, sf_dir), journal.edges(spark))


@query(f"""WITH {LOG} SELECT t AS transaction_id, count(*) AS states, max(q) AS last_sequence, arg_max(g, q) AS last_state, CASE WHEN count(*) FILTER (WHERE event_id % 50 = 0) > 0 THEN 'CHECKSUM_LINK' WHEN arg_min(g, q) <> 'preparing' THEN 'BEGINNING' END AS problem FROM d GROUP BY 1""")
def last_state(spark, sf_dir):
    return journal.fold_chain(T.journal(spark, sf_dir))


@query("""SELECT CAST(conv_id AS VARCHAR) AS transaction_id, count(*) AS states, max(turn + CASE WHEN conv_id % 3 = 0 AND turn > 1 THEN 1 ELSE 0 END) AS last_sequence, max(turn + CASE WHEN conv_id % 3 = 0 AND turn > 1 THEN 1 ELSE 0 END) + 1 <> count(*) AS gap FROM conversations GROUP BY 1""")
def chain_gaps(spark, sf_dir):
    """Every third conversation skips a number behind its second turn."""
    c = T.table(spark, sf_dir, "conversations")
    null = F.lit(None).cast("string")
    number = F.col("turn") + F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") > 1), 1).otherwise(0)
    folded = journal.fold_chain(c.select(F.col("conv_id").cast("string").alias("transaction_id"), number.alias("sequence"), F.lit("preparing").alias("global_state"), F.lit("m").alias("manifest_checksum"), null.alias("prior_checksum"), null.alias("checksum")))
    return folded.select("transaction_id", "states", "last_sequence", (F.coalesce("problem", F.lit("")) == "GAP").alias("gap"))


@query(f"""WITH {LOG} SELECT t AS transaction_id, CAST(count(*) FILTER (WHERE event_id % 50 = 0) AS BIGINT) AS forks FROM d GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 50 = 0) > 0""")
def chain_forks(spark, sf_dir):
    log = Window.partitionBy("transaction_id").orderBy("sequence")
    s = T.journal(spark, sf_dir).withColumn("expected", F.lag("checksum").over(log))
    return s.groupBy("transaction_id").agg(F.count_if(~F.col("expected").eqNullSafe(F.col("prior_checksum"))).alias("forks")).filter("forks > 0")


ACTIONS = """(VALUES ('preparing', 'status,rollback', 'all_original'), ('prepared', 'status,complete,rollback', 'all_original'), ('committing', 'status,complete,rollback', 'mixed_old_new_possible'),
('committed', 'status,cleanup', 'all_planned'), ('rolling_back', 'status,rollback', 'mixed_old_new_possible'), ('rolled_back', 'status,cleanup', 'all_original')) t(global_state, actions, visibility)"""


@query(f"""WITH {LOG} SELECT t AS transaction_id, q AS sequence, g AS global_state, actions, visibility FROM e JOIN {ACTIONS} ON global_state = g""")
def state_actions_visibility(spark, sf_dir):
    """Of every state in every log what may be done in it and what may be seen."""
    states = T.journal(spark, sf_dir).select("transaction_id", "sequence", "global_state")
    return states.join(F.broadcast(journal.actions(spark)), "global_state").select("transaction_id", "sequence", "global_state", "actions", "visibility")


ENTRIES = """en AS (SELECT CAST(c_custkey AS VARCHAR) AS t, c_custkey % 3 = 0 AS completed FROM customer), ls AS (SELECT t, arg_max(g, q) AS s FROM d GROUP BY 1), cl AS (SELECT en.t AS transaction_id, completed, CASE WHEN CAST(en.t AS BIGINT) % 7 = 0 THEN 'orphan_record' WHEN s IS NULL THEN 'manifest_only' WHEN completed THEN 'cleanup_only' ELSE 'active' END AS entry, s AS last_state FROM en LEFT JOIN ls ON ls.t = en.t)"""


def _entries(spark, sf_dir):
    entries = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("transaction_id"), (F.col("c_custkey") % 3 == 0).alias("completed"))
    manifests = T.table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").cast("string").alias("transaction_id"))
    return journal.classify_entries(entries, manifests, journal.fold_chain(T.journal(spark, sf_dir)))


@query(f"""WITH {LOG}, {ENTRIES} SELECT * FROM cl""")
def entry_classification(spark, sf_dir):
    return _entries(spark, sf_dir)


@query(f"""WITH {LOG}, {ENTRIES} SELECT transaction_id, entry FROM cl WHERE entry <> 'cleanup_only'""")
def blocking_entries(spark, sf_dir):
    return journal.blocking(_entries(spark, sf_dir))


@query(f"""WITH {LOG}, {ENTRIES} SELECT transaction_id, entry, last_state, actions, visibility, CAST(row_number() OVER (PARTITION BY entry ORDER BY transaction_id) AS INTEGER) AS place FROM cl LEFT JOIN {ACTIONS} ON global_state = last_state""")
def recover_listing(spark, sf_dir):
    return journal.status(_entries(spark, sf_dir), journal.actions(spark))


@query("""WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS t, 'active' AS p, c_custkey * 10 AS b FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'completed', s_suppkey FROM supplier), g AS (SELECT t AS transaction_id, string_agg(p, ',' ORDER BY p) AS place, count(*) > 1 AS duplicate FROM a GROUP BY 1)
SELECT *, CASE WHEN (SELECT count(*) FROM a) > 5000 THEN 'transaction_directories' WHEN (SELECT sum(b) FROM a) > 5000000 THEN 'transaction_bytes' END AS exceeded FROM g""")
def control_scan(spark, sf_dir):
    active = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("transaction_id"), (F.col("c_custkey") * 10).alias("bytes"))
    completed = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("transaction_id"), F.col("s_suppkey").alias("bytes"))
    return journal.scan_control(active, completed, most=5000, most_bytes=5_000_000)


# --- States and manifests on their own ----------------------------------------------------------------------------------

STATES = ["preparing", "prepared", "committing", "committed", "rolling_back", "rolled_back"]


def _drawn(spark, sf_dir, parts: dict[str, list]) -> DataFrame:
    """Every event with a value for each part, drawn by its number so that events go through all combinations."""
    df, radix = T.table(spark, sf_dir, "events").select("event_id"), 1
    k = F.col("event_id") * 7919 % math.prod(map(len, parts.values()))
    for name, values in parts.items():
        df = df.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (F.floor(k / radix) % len(values) + 1).cast("int")))
        radix *= len(values)
    return df


def _drawn_sql(parts: dict[str, list]) -> str:
    total, radix, columns = math.prod(map(len, parts.values())), 1, []
    for name, values in parts.items():
        shown = ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in values)
        columns.append(f"[{shown}][(event_id * 7919 % {total}) // {radix} % {len(values)} + 1] AS {name}")
        radix *= len(values)
    return f"SELECT event_id, {', '.join(columns)} FROM events"


ROLLBACKS, COMMITS, PLACES = ["none", "original_restored", "absence_restored"], ["untouched", "backed_up", "installed"], ["original", "candidate", "absent", "unexpected"]
FIELDS = {"g": STATES, "ca": ["missing", "ready"], "ci": [False, True], "co": COMMITS, "cd": [False, True], "cm": [False, True], "ro": ROLLBACKS, "ri": [False, True], "sequence": [0, 1, 512], "prior": [False, True], "ti": [0, 1]}


@query(f"""WITH x AS ({_drawn_sql(FIELDS)}), y AS (SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(sequence AS BIGINT) AS sequence, CASE WHEN sequence >= 512 THEN 'state_records' WHEN sequence = 0 AND prior THEN 'state_zero_prior_checksum_present' WHEN sequence <> 0 AND NOT prior THEN 'state_prior_checksum_missing' WHEN ti <> 0 THEN 'state_target_index_invalid'
  WHEN (ca = 'ready') <> ci THEN 'candidate_identity_invalid' WHEN NOT ((co = 'untouched' AND NOT cd AND NOT cm) OR (co = 'backed_up' AND cd AND cm) OR (co = 'installed' AND cd)) THEN 'commit_fields_invalid' WHEN (ro = 'original_restored') <> ri THEN 'rollback_fields_invalid'
  WHEN NOT ((g = 'preparing' AND co = 'untouched' AND ro = 'none') OR (g = 'prepared' AND ca = 'ready' AND co = 'untouched' AND ro = 'none') OR (g = 'committing' AND ca = 'ready' AND ro = 'none') OR (g = 'committed' AND ca = 'ready' AND ro = 'none' AND co = 'installed') OR (g = 'rolling_back' AND (ro <> 'none' OR co = 'untouched' OR ca = 'ready')) OR (g = 'rolled_back' AND ro <> 'none')) THEN 'global_state_target_combination_invalid' END AS problem FROM x)
SELECT * FROM y WHERE problem IS NOT NULL""")
def state_shapes(spark, sf_dir):
    """Every event as a state of one target; events go through all combinations of its fields."""
    df = _drawn(spark, sf_dir, FIELDS)
    known = lambda flag: F.when(F.col(flag), "1:2")
    target = F.struct(F.col("ti").cast("long").alias("target_index"), F.col("ca").alias("candidate"), known("ci").alias("candidate_identity"), F.col("co").alias("commit"), known("cd").alias("commit_identity"), F.when(F.col("cm"), 420).alias("preserved_mode"), F.col("ro").alias("rollback"), known("ri").alias("rollback_identity"))
    return journal.state_problems(df.select(F.col("event_id").cast("string").alias("transaction_id"), F.col("sequence").cast("long"), F.col("g").alias("global_state"), F.array(target).alias("targets"), F.when(F.col("prior"), "sha256:x").alias("prior_checksum")))


@query(f"""WITH {LOG}, m AS (SELECT CAST(c_custkey AS VARCHAR) AS t, c_custkey % 2 = 0 AS existed, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS n FROM customer WHERE c_custkey % 7 <> 0), x AS (SELECT d.t AS transaction_id, q AS sequence, CASE WHEN m.t IS NULL THEN 'manifest_missing' WHEN n <> 1 THEN 'state_target_count_mismatch' WHEN NOT existed AND (rk = 1 OR ro = 'original_restored') THEN 'state_original_existence_mismatch' END AS problem FROM d LEFT JOIN m ON m.t = d.t)
SELECT * FROM x WHERE problem IS NOT NULL""")
def state_against_manifest(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0")
    one = F.struct((F.col("c_custkey") % 2 == 0).alias("original_existed"))
    manifests = c.select(F.col("c_custkey").cast("string").alias("transaction_id"), F.when(F.col("c_custkey") % 5 == 0, F.array(one, one)).otherwise(F.array(one)).alias("targets"))
    return journal.state_manifest_problems(T.journal(spark, sf_dir), manifests)


FAULTS = ["none", "manifest_version_unsupported", "transaction_id_invalid", "plan", "manifest_targets_empty", "path", "manifest_target_index_invalid", "manifest_targets_not_sorted", "candidate", "backup", "manifest_target_existence_fields_invalid", "mode", "policy", "manifest_segment_invalid", "input", "manifest_segment_out_of_bounds", "projected_transaction_disk_bytes", "manifest_input_existence_fields_invalid", "input_path", "input_digest"]


def _manifests(spark, sf_dir) -> DataFrame:
    """A manifest of two targets for each customer, every one with the fault that its key says."""
    c = T.table(spark, sf_dir, "customer").withColumn("f", F.element_at(F.array(*map(F.lit, FAULTS)), (F.col("c_custkey") % len(FAULTS) + 1).cast("int")))
    bad = lambda name: F.col("f") == name
    good, key = F.lit("sha256:" + "0" * 64), F.col("c_custkey").cast("string")
    null = F.lit(None)

    def target(k: int):
        second = F.lit(k == 1)
        path = F.when(bad("manifest_targets_not_sorted") & second, "a").when(bad("path") & second, "b/../c").otherwise(f"a{k}")
        segment = F.struct(F.when(bad("input") & second, 9).otherwise(0).cast("long").alias("input_index"), F.when(bad("manifest_segment_invalid") & second, 5).otherwise(1).cast("long").alias("start"), F.when(bad("manifest_segment_out_of_bounds"), 11).otherwise(5).cast("long").alias("end"), F.lit(0).cast("long").alias("operation_index"))
        return F.struct(
            F.when(bad("manifest_target_index_invalid") & second, 7).otherwise(k).cast("long").alias("target_index"), path.alias("path"), (~second).alias("original_existed"), F.when(~second, "1:2").alias("original_identity"), F.when(~second, good).alias("original_sha256"),
            F.when(~second & ~bad("manifest_target_existence_fields_invalid"), 10).cast("long").alias("original_length"), F.when(bad("candidate"), "candidate-1").otherwise(f"candidate-0000000{k}").alias("candidate_name"), F.when(bad("backup") & second, "backup-00000000").otherwise(f"backup-0000000{k}").alias("backup_name"), good.alias("candidate_sha256"),
            F.when(bad("projected_transaction_disk_bytes"), 3 << 30).otherwise(10).cast("long").alias("candidate_length"), F.when(second | bad("policy"), "new_file_mode").otherwise("preserve_existing_mode").alias("metadata_policy"), F.when(second, F.when(bad("mode"), 0o755).otherwise(0o644)).alias("new_file_mode"), F.array(segment).alias("segments"),
        )

    given = F.struct(F.when(bad("input_path"), "/x").otherwise("x").alias("path"), F.lit(True).alias("existed"), F.lit("1:2").alias("file_identity"), F.when(bad("input_digest"), "sha256:0").otherwise(good).alias("sha256"), F.lit(10).cast("long").alias("length"), F.when(~bad("manifest_input_existence_fields_invalid"), 1).cast("long").alias("link_count"))
    name = F.when(bad("transaction_id_invalid"), key).otherwise(F.lpad(key, 32, "0"))
    none = F.array().cast(f"array<{journal.MANIFEST_TARGET}>")
    df = c.select(name.alias("transaction_id"), F.when(bad("manifest_version_unsupported"), 2).otherwise(1).alias("version"), F.when(bad("plan"), null.cast("string")).otherwise(good).alias("plan_sha256"), F.array(given).cast(f"array<{journal.INPUT}>").alias("inputs"), F.when(bad("manifest_targets_empty"), none).otherwise(F.array(target(0), target(1)).cast(f"array<{journal.MANIFEST_TARGET}>")).alias("targets"))
    return df


@query("""WITH x AS (SELECT CASE WHEN c_custkey % 20 = 2 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 32, '0') END AS transaction_id, CASE c_custkey % 20 WHEN 1 THEN 'manifest_version_unsupported' WHEN 2 THEN 'transaction_id_invalid' WHEN 3 THEN 'record_digest_invalid' WHEN 4 THEN 'manifest_targets_empty' WHEN 5 THEN 'manifest_path_invalid' WHEN 6 THEN 'manifest_target_index_invalid' WHEN 7 THEN 'manifest_targets_not_sorted'
  WHEN 8 THEN 'generated_artifact_name_invalid' WHEN 9 THEN 'generated_artifact_name_invalid' WHEN 10 THEN 'manifest_target_existence_fields_invalid' WHEN 11 THEN 'manifest_metadata_policy_invalid' WHEN 12 THEN 'manifest_metadata_policy_invalid' WHEN 13 THEN 'manifest_segment_invalid' WHEN 14 THEN 'manifest_segment_invalid' WHEN 15 THEN 'manifest_segment_out_of_bounds' WHEN 16 THEN 'projected_transaction_disk_bytes'
  WHEN 17 THEN 'manifest_input_existence_fields_invalid' WHEN 18 THEN 'manifest_path_invalid' WHEN 19 THEN 'record_digest_invalid' END AS problem FROM customer) SELECT * FROM x WHERE problem IS NOT NULL""")
def manifest_checks(spark, sf_dir):
    return journal.manifest_problems(_manifests(spark, sf_dir))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS name, CASE c_custkey % 7 WHEN 1 THEN 'MAGIC_OR_TRUNCATED' WHEN 2 THEN 'VERSION' WHEN 3 THEN 'LENGTH' WHEN 4 THEN 'CHECKSUM' WHEN 5 THEN 'LENGTH' WHEN 6 THEN 'PAYLOAD' END AS problem, CASE WHEN c_custkey % 7 = 0 THEN '{"name":"' || c_name || '"}' END AS payload FROM customer""")
def envelope_round_trip(spark, sf_dir):
    """Customers written as records, six of seven damaged, and read again."""
    k = F.col("c_custkey") % 7
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.concat(F.when(k == 6, F.lit("{")).otherwise(F.lit("")), F.lit('{"name":"'), "c_name", F.lit('"}')).alias("payload"))
    d, n = F.col("data"), F.length("data")
    k = F.col("name").cast("long") % 7
    data = (
        F.when(k == 1, F.substring(d, F.lit(1), F.lit(20)))
        .when(k == 2, F.concat(F.substring(d, 1, 9), F.unhex(F.lit("02")), F.substring(d, F.lit(11), n)))
        .when(k == 3, F.substring(d, F.lit(1), n - 1))
        .when(k == 4, F.concat(F.substring(d, F.lit(1), n - 1), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(d, n, F.lit(1))), 16, 10).cast("long").bitwiseXOR(F.lit(1))), 2, "0"))))
        .when(k == 5, F.concat(d, F.unhex(F.lit("00"))))
        .otherwise(d)
    )
    read = journal.decode_envelopes(journal.encode_envelopes(c, b"QSREC\0").select("name", data.alias("data")), b"QSREC\0")
    return read.select("name", "problem", F.when(F.col("problem").isNull(), F.col("payload")).alias("payload"))


# --- Recovery -----------------------------------------------------------------------------------------------------------


SEEN = {"global_state": STATES, "original_existed": [True, False], "commit_kind": COMMITS, "rollback_kind": ROLLBACKS, "parent_matches": [True, True, True, False], "target": ["original", *PLACES], "candidate": ["candidate", *PLACES], "backup": ["absent", *PLACES]}
OBSERVED = f"""ob AS (SELECT *, substr(target, 1, 1) || substr(candidate, 1, 1) || substr(backup, 1, 1) AS w FROM ({_drawn_sql(SEEN)})),
k AS (SELECT *, CASE WHEN NOT parent_matches OR 'unexpected' IN (target, candidate, backup) THEN 'unexpected_location_or_parent'
  WHEN global_state = 'preparing' THEN CASE WHEN w NOT IN (CASE WHEN original_existed THEN 'oaa' ELSE 'aaa' END, CASE WHEN original_existed THEN 'oca' ELSE 'aca' END) THEN 'preparing_observation_invalid' END
  WHEN global_state = 'prepared' THEN CASE WHEN w <> CASE WHEN original_existed THEN 'oca' ELSE 'aca' END THEN 'prepared_observation_invalid' END
  WHEN global_state = 'committing' THEN CASE WHEN NOT CASE WHEN original_existed THEN CASE commit_kind WHEN 'untouched' THEN w IN ('oca', 'aco', 'cao') WHEN 'backed_up' THEN w IN ('aco', 'cao') ELSE w = 'cao' END ELSE CASE commit_kind WHEN 'untouched' THEN w IN ('aca', 'caa') WHEN 'backed_up' THEN false ELSE w = 'caa' END END THEN 'committing_observation_invalid' END
  WHEN global_state = 'committed' THEN CASE WHEN w <> CASE WHEN original_existed THEN 'cao' ELSE 'caa' END THEN 'committed_observation_invalid' END
  WHEN original_existed AND rollback_kind = 'original_restored' THEN CASE WHEN w <> 'oaa' THEN 'restored_original_observation_invalid' END
  WHEN NOT original_existed AND rollback_kind = 'absence_restored' THEN CASE WHEN w <> 'aaa' THEN 'restored_absence_observation_invalid' END
  WHEN global_state = 'rolled_back' THEN 'rolled_back_record_invalid' WHEN rollback_kind <> 'none' THEN 'rolling_back_record_invalid'
  WHEN NOT CASE WHEN original_existed THEN w IN ('oaa', 'oca', 'aao', 'aco', 'cao') ELSE w IN ('aaa', 'aca', 'caa') END THEN 'rolling_back_observation_invalid' END AS conflict_reason FROM ob),
rd AS (SELECT event_id, global_state, original_existed, commit_kind, rollback_kind, parent_matches, target, candidate, backup, conflict_reason IS NULL AND global_state IN ('prepared', 'committing') AS complete, conflict_reason IS NULL AND global_state IN ('preparing', 'prepared', 'committing', 'rolling_back') AS "rollback", conflict_reason IS NULL AND global_state IN ('committed', 'rolled_back') AS cleanup_only, conflict_reason FROM k)"""


@query(f"""WITH {OBSERVED} SELECT * FROM rd""")
def recovery_disposition(spark, sf_dir):
    """Every event as an observation of one target; events go through all combinations of what can be seen."""
    return recovery.classify(_drawn(spark, sf_dir, SEEN), recovery.truth_table(spark))


@query(f"""WITH {OBSERVED}, t AS (SELECT CAST(event_id // 3 AS VARCHAR) AS transaction_id, row_number() OVER (PARTITION BY event_id // 3 ORDER BY event_id) - 1 AS i, complete OR cleanup_only AS ok FROM rd WHERE parent_matches AND candidate <> 'unexpected')
SELECT transaction_id, bool_and(ok) AS permitted, CAST(min(i) FILTER (WHERE NOT ok) AS INTEGER) AS first_refusal FROM t GROUP BY 1""")
def recovery_permits(spark, sf_dir):
    """Three events in a row are the targets of a transaction."""
    seen = recovery.classify(_drawn(spark, sf_dir, SEEN), recovery.truth_table(spark)).filter("parent_matches and candidate <> 'unexpected'").withColumn("own", F.floor(F.col("event_id") / 3))
    index = F.row_number().over(Window.partitionBy("own").orderBy("event_id")) - 1
    return recovery.permits(seen.select(F.col("own").cast("string").alias("transaction_id"), index.alias("target_index"), "complete", "rollback", "cleanup_only"), "complete")


@query("""SELECT l_orderkey * 10 + l_linenumber AS query_id, CASE WHEN l_partkey % 4 = 0 THEN 'absent' WHEN l_suppkey % 2 = 0 AND l_partkey % 4 = 1 THEN 'original' WHEN l_suppkey % 3 = 0 AND l_partkey % 4 = 2 THEN 'candidate' WHEN l_suppkey % 5 = 0 THEN 'candidate' ELSE 'unexpected' END AS seen FROM lineitem""")
def recovery_locations(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    kind = F.col("l_partkey") % 4

    def there(n):
        return F.struct(F.lit(f"1:{n}").alias("identity"), F.lit(n).alias("length"), F.lit(f"sha256:{n}").alias("sha256"))

    none = F.struct(F.lit(None).cast("string").alias("identity"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("sha256"))
    seen = F.when(kind == 0, none).when(kind == 1, there(1)).when(kind == 2, there(2)).otherwise(there(3))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), seen.alias("s"), "l_suppkey").select("query_id", recovery.locate(F.col("s"), there(1), there(2), F.col("l_suppkey") % 2 == 0, F.col("l_suppkey") % 3 == 0, F.col("l_suppkey") % 5 == 0).alias("seen"))


@query("""WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS batch_id, CASE WHEN c_custkey % 11 <> 0 THEN 'sha256:' || sha256(CAST(c_custkey AS VARCHAR)) END AS expected, CASE WHEN c_custkey % 13 <> 0 THEN 'sha256:' || sha256(CAST(c_custkey + CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR)) END AS found FROM customer) SELECT * FROM x WHERE expected IS DISTINCT FROM found""")
def plan_recheck(spark, sf_dir):
    """Digests of a first and a second planning: what changed, what was lost and what is new."""
    c = T.table(spark, sf_dir, "customer")
    name = F.col("c_custkey").cast("string").alias("batch_id")
    first = c.filter("c_custkey % 11 <> 0").select(name, digest(F.col("c_custkey").cast("string").cast("binary")).alias("plan_sha256"))
    again = c.filter("c_custkey % 13 <> 0").select(name, digest((F.col("c_custkey") + F.when(F.col("c_custkey") % 9 == 0, 1).otherwise(0)).cast("string").cast("binary")).alias("plan_sha256"))
    return sinks.same_plan(first, again)


@query("""WITH e AS (SELECT c_nationkey AS w, CAST(c_custkey AS VARCHAR) AS t FROM customer WHERE c_custkey % 3 <> 0 AND c_nationkey % 5 <> 1) SELECT CAST(n_nationkey AS VARCHAR) AS workspace, CASE WHEN n_nationkey % 4 = 0 THEN 'OBSERVATION_MAY_BE_STALE' END AS warning, CASE WHEN n_nationkey % 4 <> 0 AND n > 0 THEN 'TRANSACTION_RECOVERY_REQUIRED' END AS problem, CASE WHEN n_nationkey % 4 <> 0 THEN ids END AS transaction_ids
FROM nation LEFT JOIN (SELECT w, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids FROM e GROUP BY 1) ON w = n_nationkey""")
def diagnostic_gates(spark, sf_dir):
    """A workspace a nation, a transaction a customer; every third one, and those of some nations, is done but for its cleanup."""
    workspaces = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("workspace"), (F.col("n_nationkey") % 4 != 0).alias("locked"))
    done = (F.col("c_custkey") % 3 == 0) | (F.col("c_nationkey") % 5 == 1)
    entries = T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("workspace"), F.col("c_custkey").cast("string").alias("transaction_id"), F.when(done, "cleanup_only").otherwise("active").alias("entry"))
    return reports.diagnostic_gate(workspaces, entries).withColumn("transaction_ids", F.array_join("transaction_ids", ","))


@query("""WITH x AS (SELECT c_custkey AS k FROM customer) SELECT CAST(k AS VARCHAR) AS name, CASE WHEN k % 3 = 2 OR k % 4 = 3 OR k % 5 = 4 THEN NULL ELSE ['utf-16', 'utf-8', 'utf-16', 'utf-32'][k % 5 + 1] END AS position_encoding, CASE WHEN k % 3 = 2 THEN 'LSP_CAPABILITY_UNAVAILABLE' WHEN k % 4 = 3 THEN 'LSP_DOCUMENT_SYNC_UNAVAILABLE' WHEN k % 5 = 4 THEN 'UNSUPPORTED_TEXT_ENCODING' END AS problem, 'n' || k AS server_name, CAST(NULL AS VARCHAR) AS server_version FROM x""")
def capabilities(spark, sf_dir):
    k = F.col("c_custkey")
    symbols = F.when(k % 3 == 0, "true").when(k % 3 == 1, '{"label":"x"}').otherwise("false")
    sync = F.when(k % 4 == 0, "1").when(k % 4 == 1, "2").when(k % 4 == 2, '{"openClose":true,"change":2}').otherwise('{"openClose":false,"change":2}')
    encoding = F.when(k % 5 == 0, "").when(k % 5 == 1, ',"positionEncoding":"utf-8"').when(k % 5 == 2, ',"positionEncoding":"utf-16"').when(k % 5 == 3, ',"positionEncoding":"utf-32"').otherwise(',"positionEncoding":"utf-7"')
    result = F.concat(F.lit('{"capabilities":{"documentSymbolProvider":'), symbols, F.lit(',"textDocumentSync":'), sync, encoding, F.lit('},"serverInfo":{"name":"n'), k.cast("string"), F.lit('"}}'))
    return reports.negotiate(T.table(spark, sf_dir, "customer").select(k.cast("string").alias("name"), result.alias("result")))


@query("""SELECT s_suppkey AS query_id, CASE s_suppkey % 7 WHEN 0 THEN 'mine' WHEN 1 THEN 'user-a' WHEN 2 THEN 'builtin-b' WHEN 4 THEN 'user-a' WHEN 5 THEN 'builtin-c' END AS program, CASE s_suppkey % 7 WHEN 3 THEN 'UNKNOWN_SERVER_ID' WHEN 6 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'AMBIGUOUS_EXTENSION' ELSE 'LSP_SERVER_NOT_CONFIGURED' END END AS problem FROM supplier""")
def server_resolution(spark, sf_dir):
    k = F.col("s_suppkey") % 7
    none = F.lit(None).cast("string")
    asked = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.when(k == 0, "mine").alias("program"), F.when(k == 1, "a").when(k == 2, "b").when(k == 3, "zz").otherwise(none).alias("id"), F.when(k == 4, ".RS").when(k == 5, "go").when(k == 6, F.when(F.col("s_suppkey") % 2 == 0, "py").otherwise("nope")).otherwise("rs").alias("extension"))
    user = spark.createDataFrame([("a", "rs", "user-a"), ("d", "py", "user-d"), ("e", "py", "user-e")], "id string, extension string, program string")
    builtin = spark.createDataFrame([("a", "rs", "builtin-a"), ("b", "rs", "builtin-b"), ("c", "go", "builtin-c"), ("d", "py", "builtin-d")], "id string, extension string, program string")
    return reports.resolve_server(asked, user, builtin)


# --- Registries ---------------------------------------------------------------------------------------------------------


@query("""WITH reg AS (SELECT *, row_number() OVER (ORDER BY registry, code) - 1 AS k FROM (VALUES ('error', 'INVALID_CLI', 'request', 2, false), ('error', 'INVALID_JSON', 'request', 2, false), ('error', 'UNSUPPORTED_PROTOCOL_VERSION', 'request', 2, false), ('error', 'INVALID_REQUEST', 'request', 2, false), ('error', 'INVALID_DIGEST', 'request', 2, false),
('error', 'PRECONDITION_FAILED', 'conflict', 3, true), ('error', 'FILE_CHANGED', 'conflict', 3, true), ('error', 'FILE_ALIAS', 'conflict', 3, false), ('error', 'EXPECTED_PLAN_REQUIRED', 'conflict', 3, false), ('error', 'EXPECTED_PLAN_MISMATCH', 'conflict', 3, true), ('error', 'PLAN_CHANGED_DURING_COMMIT', 'conflict', 3, true), ('error', 'EDIT_CONFLICT', 'conflict', 3, false), ('error', 'RECOVERY_CONFLICT', 'conflict', 3, false),
('error', 'RESOURCE_LIMIT_EXCEEDED', 'limit_or_support', 4, false), ('error', 'UNSUPPORTED_PLATFORM', 'limit_or_support', 4, false), ('error', 'UNSUPPORTED_FILESYSTEM', 'limit_or_support', 4, false), ('error', 'UNSUPPORTED_FILE_TYPE', 'limit_or_support', 4, false), ('error', 'SYMLINK_NOT_ALLOWED', 'limit_or_support', 4, false), ('error', 'HARD_LINK_NOT_SUPPORTED', 'limit_or_support', 4, false), ('error', 'CROSS_DEVICE_TRANSACTION', 'limit_or_support', 4, false), ('error', 'NO_REPLACE_UNAVAILABLE', 'limit_or_support', 4, false),
('error', 'TRANSACTION_BUSY', 'transaction', 5, true), ('error', 'TRANSACTION_RECOVERY_REQUIRED', 'transaction', 5, false), ('error', 'TRANSACTION_NOT_FOUND', 'transaction', 5, false), ('error', 'RECOVERY_ACTION_NOT_ALLOWED', 'transaction', 5, false), ('error', 'CONTROL_DIRECTORY_INVALID', 'corruption', 6, false), ('error', 'TRANSACTION_RECORD_CORRUPT', 'corruption', 6, false), ('error', 'IO_ERROR', 'internal', 8, false), ('error', 'INTERNAL_ERROR', 'internal', 8, false),
('outline', 'INVALID_OUTLINE_QUERY', 'request', 2, false), ('outline', 'LSP_SERVER_NOT_CONFIGURED', 'support', 4, false), ('outline', 'UNSUPPORTED_TEXT_ENCODING', 'support', 4, false), ('outline', 'LSP_CAPABILITY_UNAVAILABLE', 'support', 4, false), ('outline', 'LSP_FLAT_SYMBOLS_UNSUPPORTED', 'support', 4, false), ('outline', 'LSP_DOCUMENT_SYNC_UNAVAILABLE', 'support', 4, false), ('outline', 'LSP_RESOURCE_LIMIT_EXCEEDED', 'support', 4, false), ('outline', 'LSP_TIMEOUT', 'support', 4, true), ('outline', 'LSP_START_FAILED', 'support', 4, true), ('outline', 'LSP_EXITED', 'support', 4, true), ('outline', 'LSP_PROTOCOL_ERROR', 'support', 4, false), ('outline', 'LSP_REQUEST_FAILED', 'support', 4, true), ('outline', 'OUTLINE_INTERNAL_ERROR', 'internal', 8, false)) t(registry, code, category, exit_code, retryable)) SELECT event_id, registry, code, category, exit_code, retryable FROM events JOIN reg ON k = event_id * 7919 % (SELECT count(*) FROM reg)""")
def registry_categories(spark, sf_dir):
    """Every event has a code of one of the registries, which tells its category, exit code and whether to try again."""
    parts = {"error": schemas.error_codes(spark), "outline": schemas.outline_codes(spark)}
    known = reduce(DataFrame.unionByName, [df.withColumn("registry", F.lit(name)) for name, df in parts.items()])
    rows = sorted(known.select("registry", "code").collect())  # fixed values
    own = F.element_at(F.array(*(F.struct(F.lit(r.registry).alias("registry"), F.lit(r.code).alias("code")) for r in rows)), (F.col("event_id") * 7919 % len(rows) + 1).cast("int"))
    told = T.table(spark, sf_dir, "events").select("event_id", own.alias("own")).select("event_id", "own.*")
    return told.join(F.broadcast(known), ["registry", "code"]).select("event_id", "registry", "code", "category", "exit_code", "retryable")
