"""Previews: budgets below, at and above their limits, a review in what a response leaves, and sides that are no text."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.operators import preview, reports, review
from quillspan.plans.plan import plan
from quillspan.schemas import FILES, OPERATIONS

from .test_plan import file_row, op, sha

WORKSPACE = "sha256:" + "1" * 64


@pytest.fixture(scope="module")
def planned(spark):
    files = {"a": b'one\ntwo "quoted"\nthree\n', "b": "é‮\ttab\r\nlast".encode(), "bin": b"x\0y\n", "c": b"c\n", "same": b"k\nk\n"}
    ops = [op("t", 0, "copy", "a", 0, 4, "b", 0, files), op("t", 1, "move", "a", 4, 17, "b", 6, files), op("bin", 0, "copy", "bin", 0, 2, "c", 0, files), op("new", 0, "copy", "b", 0, 5, "made", 0, files), op("no", 0, "move", "c", 0, 2, "c", 0, files), op("same", 0, "move", "same", 0, 2, "same", 4, files)]
    return plan(spark.createDataFrame(ops, OPERATIONS), spark.createDataFrame([file_row(k, v) for k, v in files.items()], FILES))


def test_whole_chunks_up_to_each_limit(spark):
    texts = ["--- p\n", "+++ p\n", '@@ "x" @@\n', "-a\tb\n", "+c\n"]
    rows = [("b", "p", 0, None, 100, 0, 0)] + [("b", "p", k + 1, t, len(t), len(t), len(json.dumps(t)) - 2) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "batch_id string, path string, seq long, text string, work long, raw long, json long")

    def cut(most, work=10**6):
        r = preview.cut_to_budget(chunks, spark.createDataFrame([("b", most)], "batch_id string, most long"), work).first()
        return r.text, r.truncation

    whole, cost, used = "".join(texts), sum(r[6] for r in rows), sum(r[4] for r in rows)
    assert cost > len(whole)
    assert cut(cost + 1) == cut(cost) == (whole, None)
    assert cut(cost - 1) == ("".join(texts[:-1]), "output") and cut(0) == ("", "output")
    assert cut(cost, used) == (whole, None)
    assert cut(cost, used - 1) == ("".join(texts[:-1]), "work") and cut(cost, 99) == ("", "work")
    assert cut(cost - 1, used - 1) == ("".join(texts[:-1]), "work")


def test_chunks_escape_and_charge_their_text(planned):
    rows = sorted(preview.diff_chunks(planned.sides).filter("batch_id = 't'").collect(), key=lambda r: (r.path, r.seq))
    text = "".join(r.text or "" for r in rows)
    assert '-two "quoted" [LF]' in text and '+é\\u{202e}\\u{9}two "quoted" [LF]\n+tab [CRLF]' in text and "last" not in text
    for r in rows:
        if r.seq:
            assert (r.raw, r.work, r.json) == (len(r.text.encode()), len(r.text.encode()), len(json.dumps(r.text, ensure_ascii=False).encode()) - 2)
    sides = {r.path: len(r.before or b"") + len(r.after) for r in planned.sides.filter("batch_id = 't'").collect()}
    assert {r.path: r.work for r in rows if not r.seq} == sides


def test_modes_and_whole_responses(planned):
    rows = {r.batch_id: r for r in preview.preview(planned, WORKSPACE, with_review=False).collect()}
    assert {k: r["mode"] for k, r in rows.items()} == {"t": "text", "bin": "binary", "new": "text", "no": "unchanged", "same": "unchanged"}
    for r in rows.values():
        body = json.loads(r.response)
        assert list(body) == ["protocol_version", "plan_hash_version", "plan_sha256", "workspace_identity_hash", "resolved_operations", "outputs", "diff", "warnings"]
        assert body["diff"]["text"] == r.text and body["warnings"] == [] and r.response.endswith("}\n")
        if r["mode"] != "binary":
            assert body["diff"]["summary"] is None
    entry = json.loads(rows["bin"].response)["diff"]["summary"]["outputs"][0]
    assert list(entry) == sorted(entry) and entry["path"] == "c" and entry["before_sha256"] == sha(b"c\n") and entry["after_sha256"] == sha(b"x\0c\n") and entry["after_samples"] == {"head_base64": "eABjCg==", "tail_base64": "eABjCg=="}
    made = json.loads(rows["new"].response)["outputs"][0]
    assert made == {"path": "made", "change_kind": "created_new", "before_length": None, "before_sha256": None, "after_length": 5, "after_sha256": made["after_sha256"]}
    large = {r.batch_id: r for r in preview.preview(planned, WORKSPACE, side_bytes=5).collect()}
    body = json.loads(large["t"].response)
    assert large["t"]["mode"] == "too_large" and body["diff"]["text"] is None and body["diff"]["summary"]["reason"] == "detailed_input_limit" and body["warnings"][0]["context"] == {"reason": "detailed_input_limit"}
    omitted = {r.batch_id: json.loads(r.response)["diff"] for r in preview.preview(planned, WORKSPACE, diff=False, with_review=False).collect()}
    assert set(map(str, omitted.values())) == {str({"kind": "omitted", "text": None, "summary": None})}


def test_a_review_leaves_the_diff_the_rest_of_the_response(planned):
    def of(**kw):
        return {r.batch_id: r for r in preview.preview(planned, WORKSPACE, **kw).collect()}["t"]

    full = of()
    body = json.loads(full.response)
    found = body["diff"]["summary"]["review"]
    assert list(found) == ["operations", "outputs", "plan_hash_version", "plan_sha256", "version"] and found["plan_sha256"] == body["plan_sha256"]
    assert [o["output_index"] for o in found["outputs"]] == [0, 1] and [o["selected_byte_length"] for o in found["operations"]] == [4, 13]
    assert found["outputs"][1]["insertion_groups_in_output_order"] == [{"destination_offset": 0, "operation_indices": [0]}, {"destination_offset": 6, "operation_indices": [1]}]
    cost = len(json.dumps(full.text, ensure_ascii=False).encode()) - 2
    probe = of(response_bytes=100_000)
    reserved = 100_000 - probe.budget
    exact = of(response_bytes=reserved + cost)
    assert (exact.budget, exact.reason, exact.text, exact.response) == (cost, None, full.text, full.response)
    less = of(response_bytes=reserved + cost - 1)
    assert less.reason == "response_budget" and full.text.startswith(less.text) and len(less.text) < len(full.text)
    warned = json.loads(less.response)
    assert warned["warnings"][0]["context"] == {"reason": "response_budget"} and list(warned["diff"]["summary"]) == ["maximum_diff_bytes", "maximum_work_units", "reason", "review"]
    assert len(less.response.encode()) <= reserved + cost - 1
    none = of(response_bytes=reserved - 1)
    assert (none.problem, none.response) == ("RESOURCE_LIMIT_EXCEEDED", None)
    assert of(work=50).reason == "diff_budget"


def test_the_report_in_words(planned):
    shown = preview.preview(planned, WORKSPACE)
    text = {r.batch_id: r.text for r in review.human_report(planned.good, planned.outputs, shown).collect()}["t"]
    parts = [text.index(x) for x in ("resolved_operations:\n- [0] copy a[0..4) -> b@0 effect=changed", "- [1] move a[4..17) -> b@6", "outputs:\n- a change=modified_existing", "diff:\n--- a (before)\n", "warnings:\n")]
    assert parts == sorted(parts)


def test_whole_reports_of_commits(spark, planned):
    ids = spark.createDataFrame([("t", "0" * 31 + "1")], "batch_id string, transaction_id string")
    modes = spark.createDataFrame([("t", "b", 0o644), ("t", "a", 0o600)], "batch_id string, path string, mode int")
    told = spark.createDataFrame([("t", 1, "SECOND", "m", {}), ("t", 0, "FIRST", "m", {"reason": "x"})], "batch_id string, k int, code string, message string, context map<string,string>")
    rows = {r.batch_id: json.loads(r.response) for r in reports.commit_responses(planned, WORKSPACE, ids, modes, told).collect()}
    done, idle = rows["t"], rows["no"]
    assert list(done) == ["protocol_version", "plan_hash_version", "plan_sha256", "workspace_identity_hash", "resolved_operations", "outputs", "diff", "warnings", "transaction_id", "transaction_state", "files_changed", "preserved_permission_modes", "recoverability_status", "visibility"]
    assert list(done["resolved_operations"][0])[-2:] == ["selected_payload_sha256", "inserted_payload_sha256"] and done["resolved_operations"][1]["kind"] == "move"
    assert (done["transaction_state"], done["files_changed"], list(done["preserved_permission_modes"].items())) == ("committed", ["a", "b"], [("a", 0o600), ("b", 0o644)])
    assert [w["code"] for w in done["warnings"]] == ["FIRST", "SECOND"] and done["warnings"][0]["context"] == {"reason": "x"}
    assert (idle["transaction_id"], idle["transaction_state"], idle["files_changed"], idle["outputs"], idle["preserved_permission_modes"]) == (None, "no_op", [], [], {})
    assert idle["resolved_operations"][0]["inserted_payload_sha256"] is None


def test_chunks_behind_what_no_budget_holds_stay_out(planned):
    """Cut before and not, by budgets of every size: the same text and reason."""
    every = preview.diff_chunks(planned.sides)
    batches = every.select("batch_id").distinct()
    for most, work in ((40, 10**6), (60, 110)):
        budgets = batches.withColumn("most", F.lit(most).cast("long"))
        few = preview.diff_chunks(planned.sides, most, work)
        assert few.count() < every.count()
        a, b = ({r.batch_id: tuple(r) for r in preview.cut_to_budget(x, budgets, work).collect()} for x in (every, few))
        assert a == b
