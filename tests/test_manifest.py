"""Manifests of plans with absent paths, new files and both numberings of inputs."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import journal, manifest
from quillspan.plans.plan import plan
from quillspan.schemas import FILES, OPERATIONS

from .test_plan import file_row, op, sha

MAGIC = b"QSREC\0"


@pytest.fixture(scope="module")
def made(spark):
    files = {"m": b"0123456789", "z": b"abc", "gone": b"xy"}
    rows = [(p, True, bytearray(d), sha(d), 1, k, 1, 0, 1) for k, (p, d) in enumerate(files.items())]
    ops = [op("t", 0, "copy", "z", 0, 2, "a-new", 0, files), op("t", 1, "move", "gone", 0, 2, "m", 4, files), op("n", 0, "move", "z", 0, 3, "z", 0, files)]
    df = spark.createDataFrame([(*r[:4], *map(__import__("decimal").Decimal, r[4:])) for r in rows], FILES)
    p = plan(spark.createDataFrame(ops, OPERATIONS), df)
    ids = spark.createDataFrame([("t", "0" * 31 + "1"), ("n", "0" * 31 + "2")], "batch_id string, transaction_id string")
    return manifest.manifests(p, ids, new_file_mode=0o755)


def test_inputs_targets_and_segments(made):
    (row,) = made.collect()
    assert row.transaction_id == "0" * 31 + "1" and row.version == 1 and row.plan_sha256.startswith("sha256:")
    # Files that exist by path, then paths that do not: the new file comes last, though its path is the first.
    assert [(i.path, i.existed, i.file_identity, i.length, i.link_count) for i in row.inputs] == [("gone", True, "1:2", 2, 1), ("m", True, "1:0", 10, 1), ("z", True, "1:1", 3, 1), ("a-new", False, None, None, None)]
    assert [(t.target_index, t.path, t.original_existed, t.original_identity, t.original_length, t.candidate_length, t.metadata_policy, t.new_file_mode) for t in row.targets] == [
        (0, "a-new", False, None, None, 2, "new_file_mode", 0o644),
        (1, "gone", True, "1:2", 2, 0, "preserve_existing_mode", None),
        (2, "m", True, "1:0", 10, 12, "preserve_existing_mode", None),
    ]
    assert [[tuple(s) for s in t.segments] for t in row.targets] == [[(2, 0, 2, 0)], [], [(1, 0, 4, None), (0, 0, 2, 1), (1, 4, 10, None)]]
    assert [(t.candidate_name, t.backup_name) for t in row.targets][2] == ("candidate-00000002", "backup-00000002") and row.targets[0].candidate_sha256 == sha(b"ab")


def test_manifests_are_accepted_and_come_back(made):
    assert journal.manifest_problems(made).count() == 0
    read = manifest.loaded(manifest.stored(made, MAGIC), MAGIC)
    assert [tuple(r) for r in read.drop("record", "problem").collect()] == [tuple(r) for r in made.collect()] and read.first().problem is None
    torn = manifest.stored(made, MAGIC).withColumn("data", F.expr("substring(data, 1, length(data) - 1)"))
    assert manifest.loaded(torn, MAGIC).first().problem == "LENGTH"
    other = manifest.stored(made, MAGIC).withColumn("transaction_id", F.lit("0" * 32))
    assert manifest.loaded(other, MAGIC).first().problem == "PAYLOAD"
