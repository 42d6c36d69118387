"""Running use and bounded acquisition against plain loops; line sums of large files."""

import random
import time

from pyspark.sql import functions as F

from quillspan.functions import lines as L
from quillspan.operators import scan, snapshot


def test_running_sums_of_groups_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randint(0, 9)) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(7)
    got = {r.k: (r.s, r.c) for r in scan.running(df, ["g"], ["k"], {"s": F.col("n"), "c": F.lit(1)}).collect()}
    seen = {}
    for g, k, n in sorted(rows, key=lambda r: r[1]):
        s, c = seen.get(g, (0, 0))
        seen[g] = (s + n, c + 1)
        assert got[k] == seen[g]
    assert len(got) == len(rows)


def model(wanted, files, limits):
    """(path, read, exceeded) of one batch's paths: the first excess ends the reading."""
    out, used, stopped = [], {"identities": 0, "bytes": 0, "lines": 0}, False
    for path in sorted(wanted):
        data = files.get(path)
        used["identities"] += 1
        exceeded = "identities" if used["identities"] > limits["identities"] else None
        if data is not None:
            left = limits["bytes"] - used["bytes"]
            used["bytes"] += len(data)
            used["lines"] += data.count(b"\n") + (data[-1:] not in (b"", b"\n"))
            if not exceeded:
                if len(data) > limits["file_bytes"] and limits["file_bytes"] <= left:
                    exceeded = "file_bytes"
                elif len(data) > left:
                    exceeded = "bytes"
        if not exceeded:
            exceeded = "lines" if used["lines"] > limits["lines"] else "index_bytes" if 8 * used["lines"] > limits["index_bytes"] else None
        stopped = stopped or exceeded is not None
        out.append((path, not stopped, exceeded))
    return out


def test_acquisition_stops_at_the_first_excess(spark):
    rng = random.Random(9)
    files = {f"f{k:02}": b"line\n" * rng.randint(0, 30) + b"x" * rng.randint(0, 20) for k in range(40)}
    limits = {"identities": 12, "file_bytes": 140, "bytes": 700, "lines": 140, "index_bytes": 1080}
    batches = {f"b{k}": {f"f{rng.randrange(46):02}" for _ in range(rng.randint(1, 16))} for k in range(60)}
    wanted = spark.createDataFrame([(b, p, "sha256") for b, paths in batches.items() for p in paths for _ in range(rng.randint(1, 2))], "batch_id string, path string, state string")
    known = spark.createDataFrame([(p, True, bytearray(d)) for p, d in files.items()], "path string, existed boolean, bytes binary")
    rows = snapshot.acquire(wanted, known, limits).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.path):
        got.setdefault(r.batch_id, []).append((r.path, r.read, r.exceeded))
    found = set()
    for b, paths in batches.items():
        expected = model(paths, files, limits)
        first = next((k for k, x in enumerate(expected) if x[2]), len(expected))
        assert [x[:2] for x in got[b]] == [x[:2] for x in expected] and got[b][: first + 1] == expected[: first + 1]
        found |= {x[2] for x in expected}
    assert {"identities", "file_bytes", "bytes", "lines", None} <= found
    ids = {(r.batch_id, r.path): r.file_id for r in rows}
    for b, paths in batches.items():
        there = [p for p in sorted(paths) if p in files]
        assert [ids[b, p] for p in there] == list(range(len(there))) and all(ids[b, p] is None for p in paths if p not in files)


def test_wishes_that_contradict_each_other_read_nothing(spark):
    wanted = spark.createDataFrame([("b", "x", "sha256"), ("b", "x", "must_not_exist"), ("b", "y", "sha256"), ("c", "y", "sha256")], "batch_id string, path string, state string")
    known = spark.createDataFrame([("y", True, bytearray(b"1"))], "path string, existed boolean, bytes binary")
    assert {(r.batch_id, r.path): (r.conflicting, r.read) for r in snapshot.acquire(wanted, known).collect()} == {("b", "x"): (True, False), ("b", "y"): (False, False), ("c", "y"): (False, True)}


def test_line_ends_of_a_large_file_take_linear_time(spark):
    seconds = []
    for n in (40_000, 640_000):
        df = spark.createDataFrame([("p", bytearray(b"some line of text\r\n" * n))], "path string, bytes binary")
        began = time.perf_counter()
        assert df.select(F.element_at(L.line_ends("bytes"), -1), F.size(L.line_ends("bytes"))).first()[:] == (19 * n, n)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 16 * max(seconds[0], 1) and seconds[1] < 40
