"""The versioned sink: whole versions only, whatever happens to a task."""

import os

import pytest
from pyspark.sql import functions as F

from quillspan.operators import compose
from quillspan.plans.plan import plan
from quillspan.schemas import FILES, OPERATIONS
from quillspan.sources import sinks

from .test_plan import file_row, op


@pytest.fixture
def made(spark):
    files = {f"f{k}": bytes([65 + k]) * (10 * k + 1) + b"\n" for k in range(6)} | {"gone": b"x\n"}
    ops = [op(f"b{k}", 0, "copy", f"f{k}", 0, 5 if k else 2, f"f{(k + 1) % 6}", 0, files) for k in range(6)] + [op("b9", 0, "move", "gone", 0, 2, "f0", 0, files)]
    p = plan(spark.createDataFrame(ops, OPERATIONS), spark.createDataFrame([file_row(k, v) for k, v in files.items()], FILES))
    return compose.rendered(p.recipe, p.files), p.outputs


def test_a_version_holds_what_was_planned(spark, made, tmp_path):
    rendered, outputs = made
    version = sinks.write_version(rendered.repartition(5), outputs, str(tmp_path))
    assert sinks.versions(str(tmp_path)) == [version]
    stored = sinks.read_version(spark, str(tmp_path), version).select("batch_id", "path", F.length("bytes").alias("n"), F.concat(F.lit("sha256:"), F.sha2("bytes", 256)).alias("sha"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, outputs.select("batch_id", "path", "after_length", "after_sha256").collect()))
    assert any(r.n == 0 for r in stored.collect())


def test_other_bytes_than_planned_leave_no_version(spark, made, tmp_path):
    rendered, outputs = made
    torn = rendered.withColumn("bytes", F.when(F.col("path") == "f3", F.encode(F.lit("else"), "UTF-8")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="f3"):
        sinks.write_version(torn, outputs, str(tmp_path))
    assert sinks.versions(str(tmp_path)) == [] and list(tmp_path.iterdir()) == []


def test_a_task_that_dies_leaves_no_version(spark, made, tmp_path):
    rendered, outputs = made

    @F.udf("binary")
    def deadly(path, data):
        if path == "f3":
            os._exit(7)
        return bytes(data)

    with pytest.raises(Exception):  # noqa: B017  (whatever Spark says of a lost worker)
        sinks.write_version(rendered.withColumn("bytes", deadly("path", "bytes")), outputs, str(tmp_path))
    assert sinks.versions(str(tmp_path)) == []


def test_a_part_that_no_version_file_names_is_not_read(spark, made, tmp_path):
    rendered, outputs = made
    version = sinks.write_version(rendered, outputs, str(tmp_path))
    part = next((tmp_path / version).glob("part-*"))
    (tmp_path / version / "part-99999-9.parquet").write_bytes(part.read_bytes())
    assert sinks.read_version(spark, str(tmp_path), version).count() == outputs.count()


def test_an_empty_version(spark, made, tmp_path):
    rendered, outputs = made
    version = sinks.write_version(rendered.limit(0), outputs.limit(0), str(tmp_path))
    assert sinks.read_version(spark, str(tmp_path), version).count() == 0
