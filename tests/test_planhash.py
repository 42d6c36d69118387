"""The plan's record: a fixed record of every variant and width, and the one in memory against the one of frames."""

import hashlib
import random
from decimal import Decimal as D

from quillspan.operators import planhash
from quillspan.plans.plan import plan
from quillspan.schemas import FILES, OPERATIONS

from .test_plan import file_row, op

# Fixed value: the record of the plan below.
RECORD = """
8601018219ffff1bffffffffffffffff828265612e6e657783001718ff82657a2e62696e87011bffffffffffffffff18181901001b0000000100000000035820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef
858d0001657a2e62696e8301010182015820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef00015820000000000000000000000000000000000000000000000000000000000000000065612e6e6577810181020001
8d0102657a2e62696e8302010282015820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef01025820010101010101010101010101010101010101010101010101010101010101010165612e6e6577810282015820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef0001
8d0201657a2e62696e8302020382015820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef02035820020202020202020202020202020202020202020202020202020202020202020265612e6e657782030182015820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef0201
8d0302657a2e62696e8302030482015820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef030458200303030303030303030303030303030303030303030303030303030303030303657a2e62696e82040182015820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef0302
8d1bffffffffffffffff01657a2e62696e8302041bffffffffffffffff82015820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef041bffffffffffffffff5820040404040404040404040404040404040404040404040404040404040404040465612e6e657782051bffffffffffffffff82015820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef1bffffffffffffffff01
8486686f75747075742d305820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef5820a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0010182840101000186021bffffffffffffffff01011bffffffffffffffff5820eeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeee
86686f75747075742d315820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef5820a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1020280
86686f75747075742d32f65820a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a2a203038086686f75747075742d335820ef192b7af54e943f206ab27075ec1805384c972c9959fc5820f1fa7d5268fcef5820a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3a3000480
"""
U64 = "decimal(20,0)"
TOP = D(2**64 - 1)


def frames(spark):
    """A plan of edge cases that no planner would make."""
    file = "sha256:" + hashlib.sha256(b"\xff\x00\x80").hexdigest()
    inputs = [("b", "z.bin", True, 3, file, D(256), D(2**32), TOP, D(24)), ("b", "a.new", False, None, None, None, None, D(23), D(255))]
    index = [D(0), D(1), D(2), D(3), TOP]
    anchors = [("file_start", None), ("file_end", None), ("before_line", D(1)), ("after_line", D(1)), ("byte_offset", TOP)]
    ends = [D(1), D(2), D(3), D(4), TOP]
    ops = [
        ("b", index[k], "move" if k % 2 == 0 else "copy", "z.bin", "lines" if k == 0 else "bytes", D(1) if k == 0 else D(k), ends[k], file, "z.bin" if k == 3 else "a.new", *anchors[k], "must_not_exist" if k == 0 else "sha256", None if k == 0 else file)
        for k in range(5)
    ]
    resolved = [("b", index[k], D(k), ends[k], "sha256:" + f"{k:02x}" * 32, TOP if k == 4 else D(0) if k == 1 else D(k), "no_op" if k == 3 else "changed") for k in range(5)]
    made = [("b", f"output-{k}", None if k == 2 else file, "sha256:" + f"a{k}" * 32, 0 if k == 3 else k + 1, c) for k, c in enumerate(("unchanged", "modified", "created", "emptied"))]
    recipe = [("b", "output-0", 0, None, "z.bin", D(0), D(1), None), ("b", "output-0", 1, TOP, "z.bin", D(1), TOP, "sha256:" + "ee" * 32)]
    return (
        spark.createDataFrame(inputs, f"batch_id string, path string, existed boolean, byte_length long, sha256 string, device {U64}, inode {U64}, parent_device {U64}, parent_inode {U64}"),
        spark.createDataFrame(ops, f"batch_id string, operation_index {U64}, kind string, source_path string, selector_kind string, selector_start {U64}, selector_end {U64}, source_value string, destination_path string, anchor_kind string, anchor_value {U64}, destination_state string, destination_value string"),
        spark.createDataFrame(resolved, f"batch_id string, operation_index {U64}, source_start {U64}, source_end {U64}, payload_sha256 string, destination_offset {U64}, effect string"),
        spark.createDataFrame(made, "batch_id string, path string, before_sha256 string, after_sha256 string, after_length long, change_kind string"),
        spark.createDataFrame(recipe, f"batch_id string, path string, seg long, operation_index {U64}, source_path string, start {U64}, end {U64}, payload_sha256 string"),
    )


def test_a_record_of_every_variant_and_width(spark):
    given = frames(spark)
    workspace = (65535, 2**64 - 1)
    expected = bytes.fromhex(RECORD)
    assert bytes(planhash.plan_records(*given, workspace=workspace).first().record) == expected
    assert planhash.plan_digests(*given, workspace=workspace, domain=b"domain\0").first().plan_sha256 == "sha256:" + hashlib.sha256(b"domain\0" + expected).hexdigest()


def test_heads_at_every_boundary(spark):
    values = [0, 23, 24, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(D(v),) for v in values], f"v {U64}")
    assert [bytes(r[0]) for r in df.select(planhash.number(df.v)).collect()] == [planhash.cbor(v) for v in values]


def test_frames_against_the_record_in_memory(spark):
    rng = random.Random(3)
    files = {f"f{k}": bytes(rng.choice(b"ab\n") for _ in range(rng.randint(0, 40))) for k in range(6)}
    ops = []
    for b in range(12):
        for k in range(rng.randint(1, 5)):
            src = rng.choice([p for p in files if files[p]])
            dst = rng.choice([*files, "new", "ny"])
            a = rng.randrange(len(files[src]))
            ops.append(op(f"b{b}", k, rng.choice(["move", "copy"]), src, a, rng.randint(a + 1, len(files[src])), dst, rng.randint(0, len(files.get(dst, b""))), files))
    p = plan(spark.createDataFrame(ops, OPERATIONS), spark.createDataFrame([file_row(k, v) for k, v in files.items()], FILES))
    got = {r.batch_id: r.plan_sha256 for r in p.digests().collect()}
    resolved = {(r.batch_id, r.operation_index): r for r in p.resolved.collect()}
    flat = {}
    for r in p.operations.collect():
        flat.setdefault(r.batch_id, []).append(r)
    outs, segs = {}, {}
    for r in p.recipe.collect():
        segs.setdefault((r.batch_id, r.path), []).append(r.asDict())
    for r in p.outputs.collect():
        outs.setdefault(r.batch_id, []).append(r.asDict() | {"segments": sorted(segs.get((r.batch_id, r.path), []), key=lambda x: x["seg"])})
    for b, rows in flat.items():
        paths = {r.source_path for r in rows} | {r.destination_path for r in rows}
        known = [{"path": x, "existed": x in files, "parent": (0, 0), "identity": (0, 0), "length": len(files.get(x, b"")), "sha256": "sha256:" + hashlib.sha256(files.get(x, b"")).hexdigest()} for x in paths]
        made = []
        for r in rows:
            x = resolved[b, r.operation_index]
            made.append(r.asDict() | {"index": r.operation_index, "selector": (r.selector_kind, r.selector_start, r.selector_end), "start": x.source_start, "end": x.source_end, "payload_sha256": x.payload_sha256, "anchor": (r.anchor_kind, r.anchor_value), "offset": x.destination_offset, "effect": x.effect})
        assert got[b] == planhash.digest_of(planhash.record((0, 0), known, made, outs.get(b, [])))
