"""Requests that are made out of the driver's tables."""

from quillspan.plans.plan import plan
from quillspan.sources import tables as T


def test_documents_without_lines_are_asked_for_lines(spark, tmp_path):
    texts = ["a\nb\nc", "", "one", "x\ny\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    orders = [(k, k % 4, "F" if k % 2 else "O") for k in range(120)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    p = plan(T.operations(spark, str(tmp_path)), T.files(spark, str(tmp_path)))
    rows = p.placed.collect()
    assert len(rows) == len(orders)
    nothing = "00000001"
    asked = {(r.batch_id, r.operation_index): r.destination.anchor.kind for r in p.given.collect()}
    for r in rows:
        if r.source_path == nothing:
            assert r.problem == "SELECTOR_OUT_OF_RANGE"
        elif r.destination_path == nothing and asked[r.batch_id, r.operation_index] in ("before_line", "after_line"):
            assert r.problem == "ANCHOR_OUT_OF_RANGE"
        else:
            assert r.problem is None
    assert {r.source_path for r in rows if r.problem} >= {nothing}
