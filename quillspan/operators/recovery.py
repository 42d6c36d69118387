"""Recovery: where a target's files are, and what may be done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

O, C, A = "original", "candidate", "absent"

# What may be seen as (target, candidate, backup), for targets that existed and that did not. ``ANY`` stands for
# every recorded commit or rollback: preparing, prepared and committed look at neither, committing at the commit alone, the
# two rollback states at the rollback alone.
ANY = None
STAGED, BACKED, PLACED, BACK = (O, C, A), (A, C, O), (C, A, O), (O, A, A)
NEW, PUT, GONE = (A, C, A), (C, A, A), (A, A, A)
TABLE = {
    (True, "preparing", ANY, ANY): (BACK, STAGED),
    (True, "prepared", ANY, ANY): (STAGED,),
    (True, "committing", "untouched", ANY): (STAGED, BACKED, PLACED),
    (True, "committing", "backed_up", ANY): (BACKED, PLACED),
    (True, "committing", "installed", ANY): (PLACED,),
    (True, "committed", ANY, ANY): (PLACED,),
    (True, "rolling_back", ANY, "none"): (BACK, STAGED, (A, A, O), BACKED, PLACED),
    (True, "rolling_back", ANY, "original_restored"): (BACK,),
    (True, "rolled_back", ANY, "original_restored"): (BACK,),
    (False, "preparing", ANY, ANY): (GONE, NEW),
    (False, "prepared", ANY, ANY): (NEW,),
    (False, "committing", "untouched", ANY): (NEW, PUT),
    (False, "committing", "installed", ANY): (PUT,),
    (False, "committed", ANY, ANY): (PUT,),
    (False, "rolling_back", ANY, "none"): (GONE, NEW, PUT),
    (False, "rolling_back", ANY, "absence_restored"): (GONE,),
    (False, "rolled_back", ANY, "absence_restored"): (GONE,),
}
MODES = {"preparing": (False, True, False), "prepared": (True, True, False), "committing": (True, True, False), "committed": (False, False, True), "rolling_back": (False, True, False), "rolled_back": (False, False, True)}
COMMITS = ("untouched", "backed_up", "installed")
ROLLBACKS = ("none", "original_restored", "absence_restored")


def truth_table(spark: SparkSession) -> DataFrame:
    """Every state and sight that is accepted, one row each, with what may be done."""
    rows = [
        (state, existed, c, r, *seen, *MODES[state])
        for (existed, state, commit, rollback), sights in TABLE.items()
        for c in (COMMITS if commit is ANY else (commit,))
        for r in (ROLLBACKS if rollback is ANY else (rollback,))
        for seen in sights
    ]
    return spark.createDataFrame(rows, "t_global string, t_existed boolean, t_commit string, t_rollback string, t_target string, t_candidate string, t_backup string, complete boolean, rollback boolean, cleanup_only boolean")


def locate(seen: Column, original: Column, candidate: Column, existed: Column, ready: Column, staging: Column | None = None) -> Column:
    """What is found at a place: ``absent``, ``original``, ``candidate`` or ``unexpected``. Structs of identity, length and sha256.

    ``staging``: the place is the candidate's own and the transaction is still preparing, so that an unfinished candidate may
    stand there. For a backup's place ``ready`` is false.
    """
    out = F.when(seen["identity"].isNull(), A).when(existed & seen.eqNullSafe(original), O).when(ready & seen.eqNullSafe(candidate), C)
    return (out if staging is None else out.when(staging, C)).otherwise("unexpected")


def classify(observations: DataFrame, table: DataFrame) -> DataFrame:
    """``observations(global_state, original_existed, commit_kind, rollback_kind, parent_matches, target, candidate, backup)`` with what may be
    done, or why nothing may."""
    names = ("global_state", "original_existed", "commit_kind", "rollback_kind", "target", "candidate", "backup")
    fits = None
    for ours, theirs in zip(names, ("t_global", "t_existed", "t_commit", "t_rollback", "t_target", "t_candidate", "t_backup")):
        test = F.col(ours) == F.col(theirs)
        fits = test if fits is None else fits & test
    joined = observations.join(F.broadcast(table), fits, "left")
    known = F.col("t_global").isNotNull() & F.col("parent_matches")
    strange = F.exists(F.array("target", "candidate", "backup"), lambda x: x == "unexpected")
    back = F.when(F.col("original_existed"), "original_restored").otherwise("absence_restored")
    restored = F.col("rollback_kind") == back
    record = ((F.col("global_state") == "rolling_back") & ~restored & (F.col("rollback_kind") != "none")) | ((F.col("global_state") == "rolled_back") & ~restored)
    reason = (
        F.when(~F.col("parent_matches") | strange, "unexpected_location_or_parent")
        .when(record, F.concat("global_state", F.lit("_record_invalid")))
        .when(F.col("t_global").isNotNull(), F.lit(None))
        .when(F.col("global_state").isin("rolling_back", "rolled_back") & restored, F.concat(F.lit("restored_"), F.when(F.col("original_existed"), "original").otherwise("absence"), F.lit("_observation_invalid")))
        .otherwise(F.concat("global_state", F.lit("_observation_invalid")))
    )
    return joined.select(*observations.columns, *(F.coalesce(F.when(known, F.col(c)), F.lit(False)).alias(c) for c in ("complete", "rollback", "cleanup_only")), reason.alias("conflict_reason"))


def permits(classified: DataFrame, mode: str) -> DataFrame:
    """Of each transaction whether all of its targets permit a mode (``complete`` or ``rollback``), and the first that does not.

    What is left to clean up permits either.
    """
    fine = F.col(mode) | F.col("cleanup_only")
    return classified.groupBy("transaction_id").agg(F.bool_and(fine).alias("permitted"), F.min(F.when(~fine, F.col("target_index"))).alias("first_refusal"))
