"""Positions, requests, symbols, logs and recovery on small literal inputs."""

import json
import re

from pyspark.sql import functions as F

from quillspan.functions import positions as P
from quillspan.functions import scalars as S
from quillspan.operators import journal, recovery, requests, symbols


def test_units_there_and_back():
    line = "a🚀bé".encode()
    for encoding, width in (("utf-8", None), ("utf-16", None), ("utf-32", None)):
        for at in (0, 1, 5, 6, 8):
            unit = P.unit_of_byte(line, at, encoding)
            assert P.byte_of_unit(line, unit, encoding) == at
    assert P.unit_of_byte(line, 5, "utf-16") == 3 and P.unit_of_byte(line, 5, "utf-32") == 2
    assert P.byte_of_unit(line, 2, "utf-16") is None and P.unit_of_byte(line, 3, "utf-8") is None
    assert P.byte_of_unit(line, 99, "utf-16") == len(line)


def test_positions_of_a_document(spark):
    files = spark.createDataFrame([("p", bytearray("a🚀b\r\nc\n".encode()))], "path string, bytes binary")
    ask = spark.createDataFrame([("p", 0, 3, "utf-16"), ("p", 0, 2, "utf-16"), ("p", 1, 1, "utf-32"), ("p", 2, 0, "utf-8"), ("p", 3, 0, "utf-8")], "path string, line long, character long, encoding string")
    got = {(r.line, r.character): (r.offset, r.problem) for r in P.position_to_byte(ask, P.editor_lines(files)).collect()}
    assert got == {(0, 3): (5, None), (0, 2): (None, "SPLIT_CHARACTER"), (1, 1): (9, None), (2, 0): (10, None), (3, 0): (None, "NO_SUCH_LINE")}


def test_scalars(spark):
    row = spark.range(1).select(S.terminal_escape(F.lit("a\x07\u202eb")).alias("e"), S.redact_path(F.lit("C:\\x")).alias("r"), S.json_cost(F.lit('a"\n\x01')).alias("c"), S.is_digest(F.lit("sha256:" + "a" * 64 + "\n")).alias("d"), S.identity_hash(F.lit("18446744073709551615").cast("decimal(20,0)"), F.lit(1).cast("decimal(20,0)")).alias("h")).first()
    import hashlib

    assert (row.e, row.r, row.c, row.d) == ("a\\u{7}\\u{202e}b", "<path>", 11, False)
    assert row.h == "sha256:" + hashlib.sha256(b"\xff" * 8 + b"\0" * 7 + b"\1").hexdigest()


def body(**change):
    digest = "sha256:" + "0" * 64
    op = {"kind": "copy", "source": {"path": "a", "selector": {"kind": "lines", "start": 1, "end": 2}, "precondition": {"kind": "sha256", "value": digest}}, "destination": {"path": "b", "anchor": {"kind": "file_start"}, "precondition": {"kind": "must_not_exist"}}}
    return {"version": 1, "operations": [op]} | change


def test_requests_are_strict(spark):
    good = json.dumps(body())
    bad_range = body()
    bad_range["operations"][0]["source"]["selector"]["start"] = 3
    bad_path = body()
    bad_path["operations"][0]["destination"]["path"] = "../b"
    extra = body()
    extra["operations"][0]["source"]["selector"]["x"] = 1
    rows = {"good": good, "twice": good.replace('"version": 1', '"version": 1, "version": 1'), "broken": good[:-1], "extra": json.dumps(extra), "version": json.dumps(body(version=2)), "none": json.dumps(body(operations=[])), "range": json.dumps(bad_range), "path": json.dumps(bad_path), "deep": "[" * 70 + "]" * 70, "digest": good.replace("sha256:0", "sha256:x")}
    parsed = requests.parse(spark.createDataFrame(list(rows.items()), "batch_id string, body string"))
    got = {r.batch_id: r.problem for r in parsed.collect()}
    assert got == {"good": None, "twice": "INVALID_JSON", "broken": "INVALID_JSON", "extra": "INVALID_REQUEST", "version": "UNSUPPORTED_PROTOCOL_VERSION", "none": "INVALID_REQUEST", "range": "INVALID_REQUEST", "path": "INVALID_REQUEST", "deep": "RESOURCE_LIMIT_EXCEEDED", "digest": "INVALID_DIGEST"}
    assert requests.operations(parsed).count() == 1


def node(name, kind, a, b, children=()):
    r = {"start": {"line": a[0], "character": a[1]}, "end": {"line": b[0], "character": b[1]}}
    return {"name": name, "kind": kind, "range": r, "selectionRange": r, "children": list(children)}


def test_symbols(spark):
    text = b"mod\n  fn alpha\n  fn beta\n"
    tree = [node("mod", 2, (0, 0), (2, 9), [node("alpha", 12, (1, 2), (1, 10)), node("beta", 12, (2, 2), (2, 99)), node("beta", 12, (2, 2), (2, 99))])]
    bad = [node("x", 12, (9, 0), (9, 1))]
    rows = [("p", bytearray(text), "utf-16", json.dumps(tree)), ("q", bytearray(text), "utf-16", json.dumps(bad)), ("r", bytearray(text), "utf-16", "null"), ("s", bytearray(text), "utf-16", json.dumps([{"name": "f", "location": {}}]))]
    flat = symbols.flatten(spark.createDataFrame(rows, "path string, bytes binary, encoding string, symbols string"))
    assert {(r.path, r.problem) for r in flat.collect() if r.problem} == {("q", "NO_SUCH_LINE"), ("s", "FLAT_UNSUPPORTED")}
    rows = symbols.outline(flat).orderBy("path", "row").collect()
    assert [(r.name, r.level, r.start, r.end) for r in rows] == [("mod", 0, 0, 24), ("alpha", 1, 6, 14), ("beta", 1, 17, 24)]
    ask = spark.createDataFrame([(1, "p", 7, len(text)), (2, "p", 0, len(text)), (3, "p", len(text), len(text))], "query_id int, path string, offset long, length long")
    found = symbols.by_position(ask, flat)
    assert {(r.query_id, r.name) for r in found.collect()} == {(1, "alpha"), (2, "mod")}
    gate = {r.query_id: r.problem for r in symbols.gate(found, ask, unique=True).collect()}
    assert gate == {1: None, 2: None, 3: "SELECTION_NOT_FOUND"}
    assert "  function beta" in symbols.outline_text(symbols.outline(flat)).first().text


def test_envelopes(spark):
    import hashlib

    def record(payload, version=1, magic=b"QSREC\0"):
        raw = magic + version.to_bytes(4, "big") + len(payload).to_bytes(8, "big") + payload
        return raw + hashlib.sha256(raw).digest()

    good = record(b'{"a":1}')
    rows = {"good": good, "torn": good[:20], "version": record(b"{}", 2), "short": good[:-1], "sum": good[:-1] + b"\0", "json": record(b"{"), "more": good + b"x"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "name string, data binary")
    got = {r.name: r.problem for r in journal.decode_envelopes(df, b"QSREC\0").collect()}
    assert got == {"good": None, "torn": "MAGIC_OR_TRUNCATED", "version": "VERSION", "short": "LENGTH", "sum": "CHECKSUM", "json": "PAYLOAD", "more": "LENGTH"}


def test_recovery_table_rejects_a_changed_parent(spark):
    rows = [("prepared", True, "untouched", "none", True, "original", "candidate", "absent"), ("prepared", True, "untouched", "none", False, "original", "candidate", "absent"), ("prepared", True, "untouched", "none", True, "unexpected", "candidate", "absent"), ("committed", False, "installed", "none", True, "candidate", "absent", "absent")]
    df = spark.createDataFrame(rows, "global_state string, original_existed boolean, commit_kind string, rollback_kind string, parent_matches boolean, target string, candidate string, backup string")
    got = [(r.complete, r.rollback, r.cleanup_only, r.conflict_reason) for r in recovery.classify(df, recovery.truth_table(spark)).collect()]
    assert sorted(got, key=str) == sorted([(True, True, False, None), (False, False, False, "unexpected_location_or_parent"), (False, False, False, "unexpected_location_or_parent"), (False, False, True, None)], key=str)


def test_stream_of_states(spark, tmp_path):
    from quillspan.streaming.journal_stream import last_states

    schema = "transaction_id string, sequence long, global_state string"
    spark.createDataFrame([("t", 0, "preparing"), ("t", 2, "committing"), ("u", 0, "preparing")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = last_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("folded").start()
    q.processAllAvailable()
    q.stop()
    got = {r.transaction_id: (r.last_state, r.complete) for r in spark.table("folded").collect()}
    assert got == {"t": ("committing", False), "u": ("preparing", True)}


def test_positions_are_asked_on_all_lines_of_all_rows(spark):
    from quillspan import queries

    data = "/root/testdata/sf0.001"
    rows = queries.utf16_positions(spark, data).collect()
    texts = {f"{r.doc_id:08}": r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == spark.read.parquet(f"{data}/lineitem.parquet").count() and max(r.line for r in rows) > 0
    for r in rows:
        line = re.split(r"\r\n|\r|\n", texts[r.path])[r.line].encode("utf-16-le")
        if r.problem is None:
            before = "".join(re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", texts[r.path])[: r.line])
            assert r.offset == len(before.encode()) + len(line[: 2 * r.character].decode("utf-16-le").encode())


def _oracle(spark, name):
    import duckdb

    from quillspan import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("events", "customer", "supplier", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    return got, sorted(map(str, con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({queries.ORACLE_SQL[name]})").fetchall()))


def test_a_changed_table_is_noticed(spark, monkeypatch):
    """The SQL beside a query is no copy of the package's tables."""
    for name, module, table, key, value in [("state_transitions", journal, "EDGES", "prepared", ("committing", "rolling_back")), ("state_actions_visibility", journal, "ACTIONS", "preparing", ("rollback", "original")), ("recovery_disposition", recovery, "TABLE", (True, "prepared", None, None), ())]:
        got, want = _oracle(spark, name)
        assert got == want
        with monkeypatch.context() as m:
            m.setitem(getattr(module, table), key, value)
            got, want = _oracle(spark, name)
            assert got != want


def test_state_shapes_and_manifests_against_sql(spark):
    for name in ("state_shapes", "state_against_manifest", "manifest_checks", "envelope_round_trip", "recovery_permits"):
        got, want = _oracle(spark, name)
        assert got == want and got


def test_progress_of_a_target(spark):
    def target(candidate="ready", commit="untouched", rollback="none", who="1:2"):
        return (0, candidate, who if candidate == "ready" else None, commit, who if commit != "untouched" else None, 420 if commit != "untouched" else None, rollback, who if rollback == "original_restored" else None)

    logs = {
        "repeat": [("prepared", target()), ("prepared", target())],
        "swapped": [("prepared", target()), ("prepared", target(who="1:3"))],
        "early": [("committing", target(commit="installed")), ("committing", target(commit="installed", rollback="original_restored"))],
        "frozen": [("rolling_back", target()), ("rolling_back", target(commit="installed"))],
        "entering": [("committing", target(commit="backed_up")), ("rolling_back", target(commit="installed"))],
        "undone": [("rolling_back", target(rollback="original_restored")), ("rolled_back", target(rollback="absence_restored"))],
    }
    rows = [(name, k, g, [t]) for name, log in logs.items() for k, (g, t) in enumerate(log)]
    states = spark.createDataFrame(rows, f"transaction_id string, sequence long, global_state string, targets array<{journal.TARGET}>")
    got = {r.transaction_id: r.problem for r in journal.transition_problems(states, journal.edges(spark)).collect()}
    assert got == {"swapped": "candidate_state_regressed", "early": "rollback_progress_outside_rollback", "frozen": "commit_state_regressed", "entering": "commit_state_regressed", "undone": "rollback_state_changed_after_restore"}


def test_nesting_of_json(spark):
    rows = {'{"a":"[[[["}': (1, False), '{"a":[{"b":"\\"]"}]}': (3, False), '{} ': (1, False), "{}}": (1, True), "{}x": (1, True), "[1][2]": (1, True), '{"a\\\\":[]}\n': (2, False), '{"open': (1, True)}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    got = {r.t: (r.d, r.x) for r in df.select("t", requests.json_depth(F.col("t")).alias("d"), requests.trailing_json(F.col("t")).alias("x")).collect()}
    assert got == rows
