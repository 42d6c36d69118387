"""Line arithmetic against a plain byte model, on random and on chosen bytes."""

import random
import re

from pyspark.sql import functions as F

from quillspan.functions import lines as L

PIECES = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def model_ends(data):
    out, at = [], 0
    for p in PIECES.findall(data):
        at += len(p)
        out.append(at)
    return out


def cases(n=300):
    rng = random.Random(5)
    fixed = [b"", b"abcdef", b"alpha\r\nbeta\rgamma\n", bytes.fromhex("0d0a0d0a00ff"), bytes.fromhex("41ff00fe42"), b"\r", b"\n", b"\r\n"]
    return fixed + [bytes(rng.choice(b"ab\r\n\xff\x00 ") for _ in range(rng.randint(0, 24))) for _ in range(n)]


def test_line_ends_and_ranges(spark):
    rng = random.Random(6)
    rows = []
    for k, data in enumerate(cases()):
        a, b = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
        rows.append((k, bytearray(data), a, b))
    df = spark.createDataFrame(rows, "k int, bytes binary, a long, b long").withColumn("ends", L.line_ends("bytes"))
    got = df.select("k", "ends", L.range_terminators("bytes", "ends", F.col("a"), F.col("b")).alias("t"), L.range_lines("bytes", "ends", F.col("a"), F.col("b")).alias("n"), L.metrics("bytes").alias("m")).collect()
    for r in got:
        data, a, b = bytes(rows[r.k][1]), rows[r.k][2], rows[r.k][3]
        part = data[a:b]
        assert r.ends == model_ends(data)
        assert r.t == len(re.findall(rb"\r\n|\r|\n", part)), (data, a, b)
        assert r.n == len(model_ends(part))
        assert (r.m.byte_count, r.m.terminator_count) == (len(data), len(re.findall(rb"\r\n|\r|\n", data)))


def test_metrics_fold_is_that_of_the_whole(spark):
    rng = random.Random(7)
    rows = []
    for k, data in enumerate(cases(200)):
        cuts = sorted(rng.randint(0, len(data)) for _ in range(3))
        rows.append((k, *(bytearray(data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)])), bytearray(data)))
    df = spark.createDataFrame(rows, "k int, p binary, q binary, r binary, s binary, whole binary")
    both = df.select(L.fold_metrics(F.array(*(L.metrics(c) for c in "pqrs"))).alias("a"), L.metrics("whole").alias("b"))
    assert both.filter("a.terminator_count <> b.terminator_count or a.byte_count <> b.byte_count").count() == 0


def test_line_table_agrees_with_ends(spark):
    rows = [(str(k), bytearray(d)) for k, d in enumerate(cases(60))]
    df = spark.createDataFrame(rows, "path string, bytes binary")
    found = {}
    for r in L.line_table(df).collect():
        found.setdefault(r.path, []).append((r.line, r.line_end))
    for path, data in rows:
        assert [e for _, e in sorted(found.get(path, []))] == model_ends(bytes(data))


def test_extent(spark):
    rows = [(0, bytearray(b"  ab  \ncd"), 2, 4, 0, 7), (1, bytearray(b"x ab y"), 2, 4, 2, 4), (2, bytearray(b"ab\ncd"), 0, 3, 0, 3), (3, bytearray(b"\tab \r\n"), 1, 3, 0, 6)]
    df = spark.createDataFrame([r[:4] for r in rows], "k int, bytes binary, a long, b long")
    got = {r.k: (r.x.start, r.x.end) for r in df.select("k", L.declaration_extent("bytes", F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {r[0]: r[4:] for r in rows}


def test_ends_of_many_lines(spark):
    import random

    rng = random.Random(4)
    texts = {str(n): "".join("x" * rng.randint(0, 5) + rng.choice(["\n", "\r\n", "\r"]) for _ in range(n)) + rng.choice(["", "y"]) for n in (0, 1, 255, 256, 257, 1500)}
    files = spark.createDataFrame([(k, bytearray(t.encode())) for k, t in texts.items()], "path string, bytes binary")
    rows = {r.path: list(r.ends) for r in files.select("path", L.line_ends("bytes").alias("ends")).collect()}
    table = {}
    for r in L.line_table(files).orderBy("path", "line").collect():
        table.setdefault(r.path, []).append((r.line_start, r.line_end))
    for k, t in texts.items():
        expected, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and t[end] not in "\r\n":
                end += 1
            end += 2 if t[end : end + 2] == "\r\n" else 1 if end < len(t) else 0
            expected.append((at, end))
            at = end
        assert rows[k] == [e for _, e in expected] and table.get(k, []) == expected


def test_declaration_extent_of_long_blanks_and_long_files(spark):
    """Blanks beside a range, about as many as are looked at first and far more, against the rule on the whole file."""
    import re

    from pyspark.sql import functions as F

    from quillspan.functions.lines import declaration_extent

    rows = []
    for n in (0, 1, 62, 63, 64, 65, 66, 200):
        for ahead in (b"", b"x\n", b"x\r", b"x", b"y" * 500 + b"\n"):
            for behind in (b"", b"\n", b"\r\n", b"\r", b"z", b"\n\n" + b"w" * 500, b"\r" + b"w" * 500, b"\r\n" + b"w" * 500, b"z" * 500):
                for blank in (b" ", b"\t"):
                    data = ahead + blank * n + b"ab" + blank * n + behind
                    start = len(ahead) + n
                    rows.append((bytearray(data), start, start + 2))
    got = spark.createDataFrame(rows, "b binary, s long, e long").select("b", "s", "e", declaration_extent("b", F.col("s"), F.col("e")).alias("x")).collect()
    for r in got:
        lead = re.search(rb"(?:^|[\r\n])([ \t]*)\Z", bytes(r.b[: r.s]))
        trail = re.match(rb"[ \t]*(?:\r\n|\r|\n|\Z)", bytes(r.b[r.e :]))
        assert (r.x.start, r.x.end) == (r.s - len(lead.group(1) if lead else b""), r.e + len(trail.group(0) if trail else b"")), (bytes(r.b), r.s)
