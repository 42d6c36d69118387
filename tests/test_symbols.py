"""Flattening against a plain walk over the tree, and bytes of files against a plain scan."""

import json
import random
import re

from quillspan.functions import positions as P
from quillspan.operators import symbols as S

PIECES = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


class Refused(Exception):
    pass


def walked(text, encoding, tree, limits):
    """(depth, name, start, end, selection start, selection end) in pre-order, or the first problem."""
    lines, at = [], 0
    for piece in PIECES.findall(text):
        lines.append((at, piece.rstrip(b"\r\n")))
        at += len(piece)
    if not lines or text[-1:] in (b"\n", b"\r"):
        lines.append((at, b""))

    def well_formed(node):
        def end(x):
            return isinstance(x, dict) and all(type(x.get(k)) is int and 0 <= x[k] < 2**32 for k in ("line", "character"))

        def span(x):
            return isinstance(x, dict) and end(x.get("start")) and end(x.get("end"))

        return isinstance(node, dict) and isinstance(node.get("name"), str) and type(node.get("kind")) is int and isinstance(node.get("detail"), str | None) and span(node.get("range")) and span(node.get("selectionRange")) and isinstance(node.get("children"), list | None) and all(map(well_formed, node.get("children") or []))

    def byte(p):
        if p["line"] >= len(lines):
            raise Refused("NO_SUCH_LINE")
        inside = P.byte_of_unit(lines[p["line"]][1], p["character"], encoding)
        if inside is None:
            raise Refused("SPLIT_CHARACTER")
        return lines[p["line"]][0] + inside

    def span(r):
        a, b = byte(r["start"]), byte(r["end"])
        if a >= b:
            raise Refused("INVALID_RANGE")
        return a, b

    try:
        if not all(map(well_formed, tree)):
            raise Refused("MALFORMED")
        if len(tree) > limits["nodes"]:
            raise Refused("TOO_MANY")
        out, storage, seen = [], 0, len(tree)
        todo = [(x, 0, 1) for x in reversed(tree)]
        while todo:
            node, above, depth = todo.pop()
            if len(out) >= limits["nodes"]:
                raise Refused("TOO_MANY")
            if depth > limits["depth"]:
                raise Refused("TOO_DEEP")
            numbers = [node[r][e][p] for r in ("range", "selectionRange") for e in ("start", "end") for p in ("line", "character")]
            if not node["name"] or max(numbers) > 2**31 - 1:
                raise Refused("MALFORMED")
            name, detail = len(node["name"].encode()), len((node.get("detail") or "").encode())
            path = above + name
            for value, limit, problem in ((name, "name_bytes", "NAME_TOO_LONG"), (detail, "detail_bytes", "DETAIL_TOO_LONG"), (path, "path_bytes", "PATH_TOO_LONG")):
                if value > limits[limit]:
                    raise Refused(problem)
            a, b = span(node["range"])
            c, d = span(node["selectionRange"])
            if c < a or d > b:
                raise Refused("SELECTION_OUTSIDE")
            storage += 2 * name + detail + path
            if storage > limits["storage_bytes"]:
                raise Refused("STORAGE_EXCEEDED")
            below = node.get("children") or []
            seen += len(below)
            if seen > limits["nodes"]:
                raise Refused("TOO_MANY")
            todo += [(x, path, depth + 1) for x in reversed(below)]
            out.append((depth, node["name"], a, b, c, d))
        return out
    except Refused as e:
        return str(e)


def random_tree(rng, text_lines, depth=0):
    out = []
    for _ in range(rng.randint(0, 3) if depth else rng.randint(1, 3)):
        line = rng.randrange(text_lines)
        a = rng.randint(0, 3)
        own = {"start": {"line": line, "character": a}, "end": {"line": min(text_lines - 1, line + rng.randint(0, 2)), "character": rng.choice([99] * 12 + [1])}}
        inner = own if rng.random() < 0.7 else {"start": {"line": line, "character": max(0, a + rng.choice([1, 1, 1, -1]))}, "end": own["end"]}
        node = {"name": rng.choice(["a", "bé", "c🚀", "long name"]), "kind": rng.randint(-1, 30), "range": own, "selectionRange": inner, "detail": rng.choice([None, "d", "detail"])}
        if rng.random() < 0.8 and depth < 5:
            node["children"] = random_tree(rng, text_lines, depth + 1)
        elif rng.random() < 0.5:
            node["children"] = rng.choice([None, []])
        fault = 4 * rng.random()
        if fault < 0.01:
            node["name"] = rng.choice(["", 5, None])
        elif fault < 0.02:
            node["range"] = rng.choice([None, {"start": {"line": -1, "character": 0}}, {"start": {"line": 0, "character": 1.5}, "end": {"line": 0, "character": 3}}])
        elif fault < 0.03:
            node["kind"] = rng.choice(["5", None, 2.5])
        elif fault < 0.04:
            node["selectionRange"] = {"start": {"line": 0, "character": 0}, "end": {"line": 2**31, "character": 1}}
        elif fault < 0.05:
            node["children"] = {"no": "list"}
        elif fault < 0.06:
            node["detail"] = 3
        out.append(node)
    return out


def test_random_trees_against_a_walk(spark):
    rng = random.Random(11)
    tight = [("nodes", 6), ("depth", 3), ("name_bytes", 8), ("detail_bytes", 5), ("path_bytes", 9), ("storage_bytes", 60)]
    limits = [S.LIMITS, *(S.LIMITS | dict([x]) for x in tight), S.LIMITS | dict(tight)]
    rows, expected = [], {}
    for k in range(260):
        lines = ["".join(rng.choice("ab é🚀日" if k % 3 == 0 else "ab ") for _ in range(rng.randint(6, 9))) for _ in range(6)]
        text = rng.choice(["\n", "\r\n", "\r"]).join(lines) + rng.choice(["", "\n"])
        tree = random_tree(rng, 9 if k % 20 == 0 else 6)
        encoding = rng.choice(["utf-8", "utf-16", "utf-32"])
        expected[f"p{k}"] = walked(text.encode(), encoding, tree, limits[k % 8])
        rows.append((f"p{k}", bytearray(text.encode()), encoding, json.dumps(tree), k % 8))
    df = spark.createDataFrame(rows, "path string, bytes binary, encoding string, symbols string, part int")
    got = {}
    for part, bounds in enumerate(limits):
        found = S.flatten(df.filter(df.part == part), bounds).orderBy("path", "ordinal").collect()
        for r in found:
            if r.problem:
                assert r.path not in got
                got[r.path] = r.problem
            else:
                got.setdefault(r.path, []).append((r.depth, r.name, r.start, r.end, r.selection_start, r.selection_end))
                assert len(r.symbol_path) == r.depth and r.symbol_path[-1] == r.name
    assert got == expected
    assert {"MALFORMED", "TOO_MANY", "TOO_DEEP", "NAME_TOO_LONG", "DETAIL_TOO_LONG", "PATH_TOO_LONG", "SPLIT_CHARACTER", "INVALID_RANGE", "SELECTION_OUTSIDE", "NO_SUCH_LINE", "STORAGE_EXCEEDED"} - {x for x in expected.values() if isinstance(x, str)} == set()


def test_shapes_of_responses_and_deep_trees(spark):
    def chain(n):
        node = None
        for k in range(n):
            node = {"name": "x", "kind": 2, "range": {"start": {"line": 0, "character": 0}, "end": {"line": 0, "character": 9}}, "selectionRange": {"start": {"line": 0, "character": 0}, "end": {"line": 0, "character": 1}}, "children": [node] if node else []}
        return node

    bodies = {"null": "null", "none": None, "empty": "[]", "blank": "", "torn": "[{", "object": "{}", "numbers": "[1]", "flat": '[{"name":"f","location":{}}]', "mixed": json.dumps([chain(1), {"name": "f", "location": {}}]), "deep": json.dumps([chain(9)]), "deeper": json.dumps([chain(10)])}
    df = spark.createDataFrame([(k, bytearray(b"abcdef"), "utf-16", b) for k, b in bodies.items()], "path string, bytes binary, encoding string, symbols string")
    rows = S.flatten(df, {"depth": 9}).collect()
    assert {r.path: r.problem for r in rows if r.problem} == {"torn": "MALFORMED", "object": "MALFORMED", "numbers": "MALFORMED", "flat": "FLAT_UNSUPPORTED", "mixed": "MALFORMED", "deeper": "TOO_DEEP"}
    assert [r.depth for r in sorted(rows, key=lambda r: r.ordinal) if r.path == "deep"] == list(range(1, 10)) and {r.path for r in rows if not r.problem} == {"deep"}
    assert S.flatten(df.limit(0)).count() == 0


def test_bytes_of_files_against_a_scan(spark):
    rng = random.Random(3)
    texts = ["", "\n", "abc", "\r\n\r\n", "é🚀\r日\n", "x" * 1500, "🚀" * 700 + "\r\n" + "é" * 600] + ["".join(rng.choice(["a", "é", "日", "🚀", "\n", "\r\n", "\r", " "]) for _ in range(rng.randint(1, 400))) for _ in range(25)]
    files = spark.createDataFrame([(f"f{k}", bytearray(t.encode())) for k, t in enumerate(texts)], "path string, bytes binary")
    asked = [(f"f{k}", o) for k, t in enumerate(texts) for o in range(-1, len(t.encode()) + 2)] + [("f5", 9)] * 3 + [("gone", 0)]
    got = P.bytes_to_positions(spark.createDataFrame(asked, "path string, offset long"), files).collect()
    assert len(got) == len(asked)
    for r in got:
        data = b"" if r.path == "gone" else texts[int(r.path[1:])].encode()
        if not data or not 0 <= r.offset <= len(data):
            assert (r.problem, r.line) == ("NO_SUCH_BYTE", None)
            continue
        ends, at = [], 0
        for piece in PIECES.findall(data):
            at += len(piece)
            ends.append((at, at - len(piece), len(piece.rstrip(b"\r\n"))))
        line = next((k for k, (e, _, _) in enumerate(ends) if e > r.offset), len(ends) - 1)
        _, start, size = ends[line]
        if r.offset < len(data) and data[r.offset] & 0xC0 == 0x80:
            assert (r.problem, r.line, r.column) == ("SPLIT_CHARACTER", None, None)
            continue
        assert (r.problem, r.line) == (None, line + 1)
        if r.offset > start + size:
            assert (r.column, r.character16) == (None, None)
        else:
            before = data[start : r.offset].decode()
            assert (r.column, r.character8, r.character16, r.character32) == (len(before) + 1, len(before.encode()), len(before.encode("utf-16-le")) // 2, len(before))


def test_units_of_lines_without_python(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(bytearray("".join(rng.choice("aé日🚀 b") for _ in range(rng.randint(0, 9))).encode()), c, e) for e in P.UNITS for c in range(25) for _ in range(6)]
    df = spark.createDataFrame(rows, "line binary, c long, e string")
    for r in df.select("*", P.units_to_byte(F.col("line"), F.col("c"), F.col("e")).alias("b"), P.byte_to_units(F.col("line"), F.col("c"), F.col("e")).alias("u")).collect():
        assert (r.b, r.u) == (P.byte_of_unit(bytes(r.line), r.c, r.e), P.unit_of_byte(bytes(r.line), r.c, r.e))


def test_a_type_is_not_that_of_all_below(spark, capsys):
    """The type of an array or of a tree would be worked out of everything in it."""
    df = spark.createDataFrame([('[{"children": [{"a": 1}]}]',)], "j string").selectExpr("parse_json(j) AS t")
    assert "schema_of_variant" not in str(S._children(df["t"], "$[0].children"))
    kinds = spark.createDataFrame([('{"x": [1]}',), ('{"x": null}',), ('{"x": {"y": 1}}',), ('{"x": "[1]"}',), ("{}",)], "j string").selectExpr("parse_json(j) AS t")
    found = kinds.select(S._children(kinds["t"], "$.x").isNotNull().alias("array"), S._has(kinds["t"], "$.x").alias("has")).collect()
    assert [(r.array, r.has) for r in found] == [(True, True), (False, True), (False, True), (False, True), (False, False)]


def test_lines_are_not_broadcast_and_bytes_are_counted_once(spark, capsys):
    files = spark.createDataFrame([("f", bytearray("aé🚀\nb\r\n".encode() + b"\x80\xf0")), ("g", bytearray())], "path string, bytes binary")
    asked = spark.createDataFrame([("f", 0, 1)], "path string, line long, character long").selectExpr("*", "'utf-16' AS encoding")
    P.position_to_byte(asked, P.editor_lines(files)).explain()
    assert "Broadcast" not in capsys.readouterr().out
    capsys.readouterr()
    P.bytes_to_positions(files.selectExpr("path", "1L AS offset"), files).explain("formatted")
    assert "x80-" not in capsys.readouterr().out  # what stands before a byte has been counted and is read by both ends
    rows = files.select(P.scalars_in(files["bytes"]).alias("s"), P.units_in(files["bytes"]).alias("u")).collect()
    assert [(r.s, r.u) for r in rows] == [(8, 10), (0, 0)]
