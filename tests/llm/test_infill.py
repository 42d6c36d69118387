"""Operator 11 against cuts made over the whole list of units."""

import hashlib
import random
import re
import time

import pytest

from quillspan.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_version(doc_id, text):
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_every_place_is_found_by_unit_byte_and_code_point():
    rng = random.Random(5)
    text = "".join(rng.choice(["word", "É", "日", "🚀", " ", "\n", "x1"]) for _ in range(900))
    index, data = infill.Checkpoints(text.encode()), text.encode()
    units = UNIT.findall(text)
    assert index.end == (len(units), len(data), len(text)) and len(index.units) > 2
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        place = (k, len(before.encode()), len(before))
        assert index.at_unit(k) == place == index.at_byte(place[1]) == index.at_char(place[2])
    assert index.at_char(1).chars <= 1
    for bad in (-1, len(units) + 1):
        with pytest.raises(IndexError):
            index.at_unit(bad)


def test_texts_near_sentinels_come_back():
    for k, text in enumerate(["<P", "P>S><", "<" * 600, "a<S b>M>", "<<P>", "<M>x", "S>", "é" * 700, "ab" * 3000 + "<"] * 30):
        made = infill.transform_one(k, text.encode())
        assert (*made[:4], made[4].decode()) == plain_version(k, text)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_forms_cuts_and_restored_texts(spark, request, which):
    df = request.getfixturevalue(which)
    made = infill.transform(df)
    made = made.withColumn("back", infill.restored(made.output, made.form))
    expected = sorted(((str(r.doc_id), *plain_version(r.doc_id, r.text or ""), r.text or "") for r in df.select("doc_id", "text").collect()), key=repr)
    assert sorted(((str(r[0]), *r[1:]) for r in made.collect()), key=repr) == expected
    assert {x[2] for x in expected} == {"plain", "psm", "spm"} or which == "odd"


def test_long_texts_take_linear_time_and_an_empty_table_gives_nothing(spark):
    for text in ("x" * 8_000_000, "a b1 " * 1_600_000, "日" * 2_000_000):
        began = time.perf_counter()
        made = infill.transform_one(3, text.encode())
        assert made[0] == len(UNIT.findall(text)) and time.perf_counter() - began < 10
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string, form string")).count() == 0
