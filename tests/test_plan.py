"""Planning against a byte model: random batches, the golden record digest, and chosen conflicts."""

import hashlib
import random
from decimal import Decimal as D

from quillspan.operators import planhash
from quillspan.plans.plan import plan
from quillspan.schemas import FILES, OPERATIONS


def sha(data):
    return "sha256:" + hashlib.sha256(data).hexdigest()


def file_row(path, data):
    return (path, True, bytearray(data), sha(data), None, None, None, None, D(1))


def op(batch, k, kind, src, a, b, dst, at, files):
    pre = {"kind": "sha256", "value": sha(files[src])}
    post = {"kind": "sha256", "value": sha(files[dst])} if dst in files else {"kind": "must_not_exist", "value": None}
    return (batch, k, kind, {"path": src, "selector": {"kind": "bytes", "start": D(a), "end": D(b)}, "precondition": pre}, {"path": dst, "anchor": {"kind": "byte_offset", "line": None, "offset": D(at)}, "precondition": post})


def compose(files, ops):
    """The byte model: what every path becomes, or None where edits clash."""
    cuts, puts = {}, {}
    for k, (kind, src, a, b, dst, at) in enumerate(ops):
        if kind == "move" and src == dst and at in (a, b):
            continue
        if kind == "move":
            cuts.setdefault(src, []).append((a, b))
        puts.setdefault(dst, []).append((at, k, files[src][a:b]))
    out = {}
    for path in {*cuts, *puts}:
        data, gone = files.get(path, b""), sorted(cuts.get(path, []))
        if any(x[1] > y[0] for x, y in zip(gone, gone[1:])) or any(s < at < e for s, e in gone for at, _, _ in puts.get(path, [])):
            return None
        made = b""
        for i in range(len(data) + 1):
            made += b"".join(p for at, _, p in sorted(puts.get(path, []), key=lambda x: x[1]) if at == i)
            if i < len(data) and not any(s <= i < e for s, e in gone):
                made += data[i : i + 1]
        out[path] = made
    return out


def test_random_batches_against_the_byte_model(spark):
    rng = random.Random(11)
    files = {f"f{k}": bytes(rng.choice(b"abc\r\n\xff") for _ in range(rng.randint(3, 12))) for k in range(4)}
    rows, model = [], {}
    for n in range(40):
        ops = []
        for _ in range(rng.randint(1, 4)):
            src, dst = rng.choice(list(files)), rng.choice([*files, "new"])
            a, b = sorted(rng.sample(range(len(files[src]) + 1), 2))
            ops.append((rng.choice(["move", "copy"]), src, a, b, dst, rng.randint(0, len(files[dst])) if dst in files else 0))
        model[str(n)] = compose(files, ops)
        rows += [op(str(n), k, *x, files) for k, x in enumerate(ops)]
    p = plan(spark.createDataFrame(rows, OPERATIONS), spark.createDataFrame([file_row(*x) for x in files.items()], FILES))
    got = {}
    for r in p.outputs.collect():
        got.setdefault(r.batch_id, {})[r.path] = (r.after_sha256, r.after_length, r.change_kind)
    clashed = {r.batch_id for r in p.problems().collect()}
    assert clashed == {k for k, v in model.items() if v is None}
    for batch, made in model.items():
        if made is not None:
            assert {path: x[:2] for path, x in got.get(batch, {}).items()} == {path: (sha(d), len(d)) for path, d in made.items()}
            assert all((x[2] == "created") == (path == "new") for path, x in got.get(batch, {}).items())
            assert all((x[2] == "unchanged") == (made[path] == files.get(path)) for path, x in got.get(batch, {}).items())


def test_first_problem_of_a_batch(spark):
    files = {"a": b"abcdef", "b": b"xyz"}
    rows = [op("late", 0, "move", "a", 1, 4, "b", 0, files), op("late", 1, "move", "a", 2, 5, "b", 0, files), op("gone", 0, "copy", "a", 0, 9, "b", 0, files), op("fine", 0, "copy", "a", 0, 2, "b", 3, files)]
    p = plan(spark.createDataFrame(rows, OPERATIONS), spark.createDataFrame([file_row(*x) for x in files.items()], FILES))
    assert {r.batch_id: r.problem for r in p.problems().collect()} == {"late": "OVERLAPPING_DELETIONS", "gone": "SELECTOR_OUT_OF_RANGE"}


def test_problems_before_any_operation(spark):
    files = {"a": b"abcdef", "b": b"xyz", "c": b"ccc"}
    rows = [op("alias", 0, "copy", "a", 0, 99, "b", 0, files), op("torn", 0, "copy", "a", 0, 1, "new", 0, files), op("torn", 1, "copy", "a", 0, 1, "new", 0, files | {"new": b""}), op("linked", 0, "copy", "a", 0, 1, "c", 0, files), op("source", 0, "copy", "c", 0, 1, "a", 0, files), op("twice", 0, "copy", "d", 0, 9, "a", 0, files | {"d": b"1"})]
    known = [("a", True, bytearray(b"abcdef"), sha(b"abcdef"), D(1), D(5), D(1), D(0), D(1)), ("b", True, bytearray(b"xyz"), sha(b"xyz"), D(1), D(5), D(1), D(0), D(1)), ("c", True, bytearray(b"ccc"), sha(b"ccc"), D(1), D(6), D(1), D(0), D(2)), ("d", True, bytearray(b"1"), sha(b"1"), D(1), D(7), D(1), D(0), D(1)), ("d", False, None, None, None, None, D(1), D(0), None)]
    p = plan(spark.createDataFrame(rows, OPERATIONS), spark.createDataFrame(known, FILES))
    got = {r.batch_id: r.problem for r in p.problems().collect()}
    assert got == {"alias": "FILE_ALIAS", "torn": "PRECONDITION_FAILED", "linked": "HARD_LINK_NOT_SUPPORTED", "twice": "EDIT_CONFLICT"}


def test_cbor_integers_of_every_width():
    for value, encoded in ((0, "00"), (23, "17"), (24, "1818"), (255, "18ff"), (256, "190100"), (65536, "1a00010000"), (1 << 32, "1b0000000100000000"), ((1 << 64) - 1, "1bffffffffffffffff")):
        assert planhash.cbor(value).hex() == encoded
    assert planhash.cbor(["a", None, b"\x01"]).hex() == "836161f64101"


def test_record_shape():
    """One copied slice into a new file, written out by hand."""
    d = bytes(range(32))
    s = "sha256:" + d.hex()
    got = planhash.record(
        (1, 2),
        [{"path": "b", "existed": False, "parent": (1, 2)}, {"path": "a", "existed": True, "parent": (1, 2), "identity": (1, 3), "length": 4, "sha256": s}],
        [{"index": 0, "kind": "copy", "source_path": "a", "selector": ("bytes", 0, 2), "source_value": s, "start": 0, "end": 2, "payload_sha256": s, "destination_path": "b", "anchor": ("file_start", None), "destination_state": "must_not_exist", "destination_value": None, "offset": 0, "effect": "changed"}],
        [{"path": "b", "before_sha256": None, "after_sha256": s, "after_length": 2, "change_kind": "created", "segments": [{"source_path": "a", "start": 0, "end": 2, "operation_index": 0, "payload_sha256": s}]}],
    )
    h = "5820" + d.hex()
    assert got.hex() == "8601018201028282616187010102010304" + h + "8261628300010281" + "8d0002616183020002" + "8201" + h + "0002" + h + "6162" + "8101" + "8102" + "0001" + "81" + "866162f6" + h + "0203" + "81" + "8602000000" + "02" + h


def test_outputs_are_not_exchanged_whole(spark):
    """One large file, edited by many batches: what is exchanged is the file and the edits, not an output a batch."""
    data = random.Random(3).randbytes(200_000)
    rows = [op(f"b{k}", 0, "copy", "a", k, k + 3, "a", 7 * k, {"a": data}) for k in range(40)]
    p = plan(spark.createDataFrame(rows, OPERATIONS), spark.createDataFrame([file_row("a", data)], FILES))
    sc = spark.sparkContext
    every = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    p.recipe
    before = {x.stageId() for x in map(every().apply, range(every().size()))}
    got = {r.batch_id: r.after_sha256 for r in p.outputs.collect()}
    assert got == {f"b{k}": sha(data[: 7 * k] + data[k : k + 3] + data[7 * k :]) for k in range(40)}
    now = every()
    assert sum(x.shuffleWriteBytes() for x in map(now.apply, range(now.size())) if x.stageId() not in before) < 3_000_000
