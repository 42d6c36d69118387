"""Frames of whole documents are written so that no reading task holds many of them at once."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillspan import staging


def test_wide_rows_are_read_in_small_groups(spark):
    text = F.concat_ws("", *(F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(40)))
    wide = spark.range(3000, numPartitions=1).select("id", text.alias("text"))
    with staging.scope(spark):
        read = staging.staged(wide, "wide", wide=True)
        [folder] = {f.removeprefix("file://").rsplit("/", 1)[0] for f in read.inputFiles()}
        files = [pq.ParquetFile(f) for f in glob.glob(f"{folder}/*.parquet")]
        groups = [f.metadata.row_group(k) for f in files for k in range(f.num_row_groups)]
        assert sum(g.num_rows for g in groups) == 3000 and len(groups) > 3  # one group without ``wide``
        assert max(sum(g.column(k).total_compressed_size for k in range(g.num_columns)) for g in groups) <= 2 * staging.WIDE
        assert read.exceptAll(wide).isEmpty() and wide.exceptAll(read).isEmpty()


def test_documents_and_trees_of_flattening_are_wide(spark, monkeypatch):
    from quillspan.operators import symbols

    told = {}

    def noted(df, label, codec="snappy", wide=False):
        told[label] = wide
        return staging.staged(df, label, codec, wide)

    monkeypatch.setattr(symbols, "staged", noted)
    span = '{"start":{"line":0,"character":0},"end":{"line":0,"character":1}}'
    tree = f'[{{"name":"a","kind":5,"range":{span},"selectionRange":{span}}}]'
    rows = spark.createDataFrame([("p", b"a", "utf-16", tree)], "path string, bytes binary, encoding string, symbols string")
    assert [r.name for r in symbols.flatten(rows).collect()] == ["a"]
    assert told["responses"] and told["level"]
