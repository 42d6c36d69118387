"""Diffs, lengths and kinds of outputs, against models on bytes; and what of them is never exchanged or split."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.functions.lines import text_pieces
from quillspan.operators import compose, review
from quillspan.plans.plan import plan
from quillspan.schemas import FILES, OPERATIONS

from .test_plan import file_row, op

LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
ENDS = {"\r\n": "CRLF", "\n": "LF", "\r": "CR"}


def hunk(before, after):
    a, b = LINE.findall(before or ""), LINE.findall(after)
    top = low = 0
    while top < min(len(a), len(b)) and a[top] == b[top]:
        top += 1
    a, b = a[top:], b[top:]
    while low < min(len(a), len(b)) and a[-1 - low] == b[-1 - low]:
        low += 1

    def shown(sign, pieces):
        return [f"{sign}{p.rstrip(chr(13) + chr(10))} [{ENDS.get(p[len(p.rstrip(chr(13) + chr(10))):], 'NONE')}]" for p in pieces[: len(pieces) - low]]

    removed, added = shown("-", a), shown("+", b)
    return top, low, f"@@ -{top + 1},{len(removed)} +{top + 1},{len(added)} @@", removed, added


def test_diff_tells_lines_by_bytes(spark):
    rnd = random.Random(12)

    def text(n):
        return "".join(rnd.choice(["a", "b", "é", "è", "\r", "\n", "\r\n"]) for _ in range(n))

    rows = [("none", None, "a\r\n\nb"), ("same", "a\r", "a\r"), ("longer", "a\r", "a\r\n"), ("empty", "", "")]
    for k in range(3000):
        before = text(rnd.randrange(10))
        at = rnd.randrange(len(before) + 1)
        rows.append((str(k), before, before[:at] + text(rnd.randrange(3)) + before[rnd.randrange(at, len(before) + 1) :]))
    sides = spark.createDataFrame([(k, a if a is None else a.encode(), b.encode()) for k, a, b in rows], "batch_id string, before binary, after binary")
    got = {r[0]: (r.prefix, r.suffix, r.header, r.removed, r.added) for r in review.prefix_suffix_diff(sides).collect()}
    assert got == {k: hunk(a, b) for k, a, b in rows}


def test_diff_splits_the_hunk_alone(spark):
    sides = spark.createDataFrame([("x", b"a\n", b"b\n")], "batch_id string, before binary, after binary")
    plan = review.prefix_suffix_diff(sides)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(" in plan and not re.search(r"regexp_extract_all\([^,]*(before|after)", plan)


def test_lines_of_texts(spark):
    texts = ["", "\n", "a", "a\n", "a\n\nb", "\n\n", "a\rb\r\nc", "\r\n\r"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_pieces(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in got} == {t: LINE.findall(t) for t in texts}


def test_own_payloads_are_not_exchanged(spark):
    recipe = spark.createDataFrame(
        [("x", "p", 0, "payload", "p", 2, 4), ("x", "p", 1, "original", "p", 0, 4), ("x", "p", 2, "payload", "q", 0, 1)], "batch_id string, path string, seg long, seg_class string, source_path string, start long, end long"
    )
    files = spark.createDataFrame([("p", True, b"abcd"), ("q", True, b"z")], "path string, existed boolean, bytes binary")
    (row,) = compose.parts_of(recipe, files).collect()
    assert [None if p.part is None else bytes(p.part) for p in row.parts] == [None, None, b"z"]
    assert bytes(compose.rendered(recipe, files).collect()[0].bytes) == b"cdabcdz"


@pytest.fixture
def batches(spark):
    rng = random.Random(19)
    files = {f"f{k}": bytes(rng.choice(b"ab\n") for _ in range(rng.randint(1, 6))) for k in range(5)}
    rows = []
    for n in range(150):
        for k in range(rng.randint(1, 3)):
            src, dst = rng.choice(list(files)), rng.choice([*files, "new"])
            dst = src if rng.random() < 0.4 else dst
            a, b = sorted(rng.sample(range(len(files[src]) + 1), 2))
            rows.append(op(str(n), k, rng.choice(["move", "copy"]), src, a, b, dst, rng.randint(0, len(files[dst])) if dst in files else 0, files))
    return plan(spark.createDataFrame(rows, OPERATIONS), spark.createDataFrame([file_row(k, v) for k, v in files.items()], FILES))


def test_changes_are_those_of_the_bytes(batches):
    columns = ["batch_id", "path", "change_kind", "before_length", "after_length"]
    got = sorted(map(tuple, batches.changes.select(*columns).collect()), key=str)
    assert "outputs" not in batches.__dict__
    assert got == sorted(map(tuple, batches.outputs.select(*columns).collect()), key=str)
    kinds = {r[2] for r in got}
    assert kinds == {"created", "unchanged", "emptied", "modified"}
    assert any(r[2] == "modified" and r[3] == r[4] for r in got)


def test_limits_put_no_output_together(batches):
    used = batches.usage().count()
    assert used == 150 and "outputs" not in batches.__dict__


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_sound_batches_are_those_without_conflicts(batches):
    bad = {r.batch_id for r in batches.conflicts.collect()} | {r.batch_id for r in batches.placed.filter("problem is not null").collect()} | {r.batch_id for r in batches.unread.collect()}
    got, given = batches.sound.collect(), [r for r in batches.placed.collect() if r.batch_id not in bad]
    assert bad and given and sorted(got, key=str) == sorted(given, key=str)
    assert exchanges(compose.unclashing(batches.placed)) == 1


def test_segments_are_dealt_out_once(batches):
    assert exchanges(compose.segments(batches.sound)) == 1
    made = {(r.batch_id, r.path): r.after_length for r in batches.changes.collect()}
    got = {}
    for r in batches.layout.orderBy("batch_id", "path", "seg").collect():
        got.setdefault((r.batch_id, r.path), []).append(r)
        assert r.seg == len(got[r.batch_id, r.path]) - 1 and r.start < r.end
    assert {k: sum(r.end - r.start for r in v) for k, v in got.items()} == {k: n for k, n in made.items() if n}
