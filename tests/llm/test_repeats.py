"""Operator 13 against all windows of all documents."""

import hashlib
import random

import numpy as np
import pytest

from quillspan.llm import repeats as R

SPAN = 50


def plain_version(rows):
    """``rows``: (doc_id, text); one result a row, in order."""
    first = {}
    split = [(R.LAST_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - SPAN + 1):
            x = tuple(w[k : k + SPAN])
            first[x] = min(i, first.get(x, i))
    out = []
    for (doc_id, _), (i, w) in zip(rows, split):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - SPAN + 1):
            if first[tuple(w[k : k + SPAN])] < i:
                gone[k : k + SPAN] = True
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc_id, len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return sorted(out, key=repr)


def words(rng, n, of=4000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def planted(seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (49, 50, 51, 60, 75, 140, 400)]
    base = words(rng, 300)
    docs = []
    for _ in range(70):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, max(0, len(p) - 50)) if rng.random() < 0.4 else 0
            parts += rng.choice([p, p[a:], p[: len(p) - a], words(rng, rng.randint(0, 70))])
        docs.append(parts)
    for _ in range(30):  # near copies, each different somewhere
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = "edit"
        docs.append(copy[rng.randint(0, 30) :])
    docs += [["same"] * n for n in (49, 50, 80, 200)] + [["a", "b"] * 60, ["b", "a"] * 40, ["a", "b", "c"] * 40]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    spaced = [rng.choice([" ", "\n", "\t "]).join(d) for d in docs]
    rows = list(zip(ids, spaced))
    # Rows that share an id, rows told twice, rows without an id.
    return rows + [(ids[3], spaced[80]), (ids[5], spaced[5]), (ids[81], spaced[81]), (None, spaced[82]), (None, spaced[83]), (None, spaced[0]), (1000, None), (1001, ""), (1002, " \n")]


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, owner int, data string, node int")
    return sorted(map(tuple, R.dedup(df, with_text=True).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_passages_copies_and_odd_rows(spark, seed):
    rows = planted(seed)
    expected = plain_version(rows)
    assert result(spark, rows) == expected
    assert sum(x[2] > 0 for x in expected) > 40


def test_small_table_and_no_rows(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, R.dedup(docs).collect()), key=repr) == [x[:4] for x in plain_version(rows)]
    assert R.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_passage_of_all_documents_is_one_path(spark):
    rng = random.Random(8)
    shared = words(rng, 300)
    rows = [(k, " ".join(words(rng, 60) + shared + words(rng, 60))) for k in range(60)]
    given = R.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    found = R.repeated(given)
    edges = R.distinct_edges(found)
    long = R.paths(edges).filter("words > 150").collect()
    assert len(long) == 1
    marked = R.marks(found, edges).selectExpr("owner", "size(filter(marks, m -> m.kind = 'copy')) AS copies").collect()
    assert {r.owner: r.copies for r in marked} == {k: int(k > 0) for k in range(60)}
    assert result(spark, rows) == plain_version(rows)


def test_a_path_that_its_source_does_not_confirm_stays(spark):
    """Two documents whose paths carry one key but other words: the fingerprint keeps the second."""
    mark = {"lo": 0, "hi": 60, "s_owner": 1, "s_body": 5, "s_lo": 0}
    texts = {1: "a " * 60, 2: "a " * 60, 3: "b " * 60}
    rows = [(k, 5, [{"kind": "source" if k == 1 else "copy", **mark}], t.encode()) for k, t in texts.items()]
    df = spark.createDataFrame(rows, f"owner long, body long, marks array<{R.MARK}>, data binary")
    assert [r.owner for r in R.removable(df).collect()] == [2]


def test_parts_of_a_long_text_hold_each_window_once(monkeypatch):
    rng = random.Random(4)
    text = " ".join(words(rng, 5000)).encode()
    whole = R.word_hashes(text)
    monkeypatch.setattr(R, "PIECE", 100)
    monkeypatch.setattr(R, "WORDS", 700)
    assert (R.word_hashes(text) == whole).all()
    held = np.concatenate([np.arange(a, b + 1) for _, f in R.document_edges([text, b"short", text]) for a, b in zip(f["lo"], f["hi"])])
    assert sorted(held.tolist()) == sorted([*range(4951)] * 2)


def test_words_are_told_apart():
    rng = random.Random(6)
    text = "".join(rng.choice([" ", "\n", "a", "bé", "\t", "\x0b", "\r", "日", "\x1c", "\x85", "\0"]) for _ in range(30_000)).encode()
    split, hashes = text.split(), R.word_hashes(text)
    assert len(split) == len(hashes) and len(set(zip(split, hashes.tolist()))) == len(set(split)) == len(set(hashes.tolist()))


def test_what_grows_with_the_corpus_is_not_broadcast(spark, capsys):
    """Rows that are spread over salts are counted before they are spread: a broadcast of them would be 64 times its estimate."""
    text = " ".join(words(random.Random(7), 200))
    docs = R.keyed(spark.createDataFrame([(k, f"{text} {k}") for k in range(3)], "doc_id long, text string"))
    found = R.staged(R.repeated(docs), "repeated")
    edges = R.staged(R.distinct_edges(found), "edges")
    settled = R.staged(R.settled(docs, R.marks(found, edges)), "settled")
    capsys.readouterr()
    R.settled(docs, R.marks(found, edges)).explain()
    R.removable(settled.filter("data is not null")).explain()
    plans = capsys.readouterr().out
    assert "SortMergeJoin" in plans and "Broadcast" not in plans
