"""Operator 12 against whole numbers of any size on whole vocabularies."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_version(rows, min_docs=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall(text.translate(FOLD))
        counts[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang in {x[0] for x in counts}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 1)) // (n + v) for t in kept}

        whole = shares(sum(groups.values(), Counter()))
        p = {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in groups if o != s]
            terms = [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if groups[s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(df, **kw):
    return sorted(map(tuple, D.audit(df, **kw).collect()))


def test_small_table(docs):
    assert rows_of(docs) == plain_version(docs.select("text", "lang", "source").collect())


def test_many_blocks_and_ranges_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    monkeypatch.setattr(D, "CHUNK", 4)
    monkeypatch.setattr(D, "RANGE", 2)
    monkeypatch.setattr(D, "DISTINCT", 5)
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "abçdé" for b in "äxYzÀ日ﬀİ"]
    made = [(" ".join(rng.choice(words, rng.integers(0, 12))), str(rng.choice(["en", "de"])), f"s{int(rng.zipf(1.4)) % 11}") for _ in range(160)]
    made += [(None, None, None), ("", "en", "void"), ("1 2 3", "xx", "a"), ("only once", "xx", "b"), (None, "en", None), ("Same same SAME", "en", "s1"), ("Same same SAME", "en", "s1")]
    df = spark.createDataFrame([(*r, 9, "v", 3) for r in made], "text string, lang string, source string, n long, term string, block int")
    expected = plain_version(made)
    assert rows_of(df) == expected
    assert len({(x[0], x[1]) for x in expected}) > 12 and any(x[4] for x in expected)
    assert rows_of(df, min_docs=1, top=3) == plain_version(made, 1, 3)


def test_no_rows_and_no_kept_terms(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert rows_of(empty) == []
    bare = spark.createDataFrame([("a", "en", "x"), (None, "en", "y"), ("b", "en", "z")], "text string, lang string, source string")
    assert rows_of(bare) == plain_version([tuple(r) for r in bare.collect()]) and len(rows_of(bare)) == 6


def test_shares_of_large_counts_are_exact(spark):
    cases = [(c, n, v) for c, n, v in ((0, 0, 1), (7, 7, 1), (10**12, 10**15, 10**9), (8 * 10**15, 8 * 10**15 + 5, 10**6), (3, 10**15, 12345))]
    expected = [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    assert [r[0] for r in df.select(D.share(F.col("c"), F.col("n"), F.col("v"))).collect()] == expected
    for (c, n, v), e in zip(cases, expected):
        assert D.shares(np.array([[c]], np.int64), np.array([n], np.int64), v)[0, 0] == e


def test_terms_of_a_long_text_are_split_in_pieces(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 64)
    text = "Ab1é_x日 " * 500 + "z" * 300
    found = Counter(t.decode() for some in D.terms_of(text.encode()) for t in some)
    assert found == Counter(TERM.findall(text.translate(FOLD))) and len(list(D.terms_of(text.encode()))) > 20
