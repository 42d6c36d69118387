"""Operators 2, 3, 8 and 10 and the pipeline."""

import base64
import time
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quillspan.llm import decontaminate, near_duplicates, quality, toxicity

from .conftest import DATA


def same(df, sql, **views):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        source = views.get(name)
        if source is None:
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
        else:
            con.register(name, source)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))


def test_decontamination_against_sql(spark):
    same(decontaminate.query(spark, DATA), decontaminate.SQL)


def test_short_items_repeats_and_odd_texts(spark, odd):
    items = spark.createDataFrame([(1, "A b, c"), (1, "A b, c"), (2, None), (3, "..."), (4, "x b c d e f g h i j k l m n o p")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(odd, items).collect())
    assert [g for g in got if g[0] == "4"] == [("4", 6, 3, 1, True)] * 2
    assert all(g[2:] == (0, 0, False) for g in got if g[0] != "4")
    assert {g[0]: g[1] for g in got}["0"] == 0 and {g[0]: g[1] for g in got}["2"] == 0
    docs = spark.createDataFrame([(1, "z X b c d e f g h i j k l m q"), (2, "m l k j i h g f e d c b x")], "doc_id long, text string")
    kinds = {(r.doc_id, r.kind) for r in decontaminate.matches(docs, items.filter("item_id = 4")).collect()}
    assert (1, "exact") in kinds and (2, "near") in kinds and (2, "exact") not in kinds


def test_items_without_an_id_still_hit(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "x " + passage + " y"), (2, "nothing of it"), (3, " ".join(f"v{k}" for k in range(15)) + " " + passage)], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None, passage + " z"), (7, " ".join(f"v{k}" for k in range(15)))], "item_id long, text string")
    found = decontaminate.contamination(docs, items).drop("n_near")
    assert {r.doc_id: r.n_hit for r in found.collect()} == {1: 20, 2: 0, 3: 35}
    same(found, decontaminate.SQL, documents=docs.toArrow(), benchmark=items.toArrow())


def test_rows_that_share_an_id_have_their_own_hits(spark):
    one, two = " ".join(f"a{k}" for k in range(15)), " ".join(f"b{k}" for k in range(15))
    rows = [(7, one + " x"), (7, "y " + two), (None, one), (None, "nothing of it"), (7, one + " x"), (None, None)]
    found = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, one), (2, two)], "item_id long, text string"))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect())
    assert got == sorted([("7", 16, 15, 1, True)] * 3 + [("None", 15, 15, 1, True), ("None", 3, 0, 0, False), ("None", 0, 0, 0, False)])


def test_the_test_side_in_blocks(spark, monkeypatch):
    """Random texts of few words, so that everything meets everything; the test side is sent in many parts."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 5)
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(9)]
    items = [(k % 8, " ".join(rng.choice(words, int(rng.integers(1, 20))))) for k in range(12)]
    rows = []
    for k in range(60):
        own = list(rng.choice(words, int(rng.integers(0, 60))))
        if k % 2:
            own[len(own) // 2 : len(own) // 2] = items[k % 12][1].split()
        rows.append((k, " ".join(own)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench)
    assert found.filter("n_near > 0").count() and found.filter("n_hit > 13").count()
    same(found, decontaminate.SQL, documents=docs.toArrow(), benchmark=bench.toArrow())


def test_every_window_of_an_anchor_is_tried_for_proximity(spark):
    item = [f"i{k}" for k in range(30)]
    common = " ".join(f"{w} " + "gap " * 30 for w in item if w != "i10")
    rows = [(k, common) for k in range(3)] + [(10, " ".join(reversed(item[:13]))), (11, " ".join(reversed(item[5:18]))), (12, " ".join(reversed(item[1:13])))]
    found = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    near = {r.doc_id: r.n_near > 0 for r in found.collect()}
    assert near == {0: False, 1: False, 2: False, 10: True, 11: True, 12: False}


def test_quality_against_sql(spark):
    same(quality.query(spark, DATA), quality.SQL)


def test_quality_odd_rows_and_boilerplate(spark, odd):
    frame = odd.select("doc_id", "text", "source").toArrow()
    same(quality.judge(odd).drop("words_left"), quality.SQL, documents=frame)
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    passage = " ".join(f"p{j}" for j in range(80))
    df = spark.createDataFrame([(k, passage, "h") for k in range(30)] + [(100 + k, own(k) + "\n" + passage, "h") for k in range(5)] + [(200, own(99), "h")], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert not any(kept[k] for k in range(30)) and all(kept[100 + k] for k in range(5)) and kept[200]


def test_short_lines_are_boilerplate_too(spark):
    menu = "\n".join(f"Menu entry {'abcdefghijklmnopqrst'[k]}" for k in range(20))
    own = " ".join(f"own{j}" for j in range(60))
    df = spark.createDataFrame([(k, menu, "h") for k in range(30)] + [(50, own + "\nMenu entry a", "h"), (51, menu, "other")], "doc_id long, text string, source string")
    same(quality.judge(df).drop("words_left"), quality.SQL, documents=df.toArrow())
    got = {r.doc_id: (r.words_left, r.kept) for r in quality.judge(df).collect()}
    assert all(got[k] == (0, False) for k in range(30)) and got[50] == (60, True) and got[51] == (60, True)


def brute(rows):
    shingler = near_duplicates.Shingler()
    sets = [set(shingler(t or "").tolist()) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for h in s:
            holders[h].append(k)
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in {p for many in holders.values() for p in combinations(many, 2)}:
        common = len(sets[a] & sets[b])
        if 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
            links[a] += 1
            links[b] += 1
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return sorted((rows[k][0], rows[top(k)][0], links[k]) for k in range(len(rows)))


def test_near_duplicates_against_brute_force(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.join_near(docs).collect()) == brute(rows)


def test_a_group_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_DOCS", 8)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        mine = list(words)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            mine[at] = f"x{k}-{at}"
        rows.append((k, " ".join(mine)))
    rows += [(50, None), (51, ""), (52, "a b"), (53, "A, b!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.join_near(df).collect()) == brute(rows)


def test_a_chain_is_taken_apart_into_its_buckets(spark, monkeypatch):
    """Each text is like the next ones and unlike those far off; the same answer whichever way the group is compared."""
    rows = [(k, " ".join(f"w{j}" for j in range(8 * k, 8 * k + 100))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert {n for *_, n in expected} == {1, 2}
    apart = []
    plain = near_duplicates.units_of
    monkeypatch.setattr(near_duplicates, "units_of", lambda *a: apart.append(plain(*a).filter("band >= 0").count()) or plain(*a))
    for least, docs_of_a_block in ((1024, 256), (10, 256), (10, 3)):
        monkeypatch.setattr(near_duplicates, "APART", least)
        monkeypatch.setattr(near_duplicates, "BLOCK_DOCS", docs_of_a_block)
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.join_near(df).collect()) == expected
    assert apart[0] == 0 and min(apart[1:]) > 400


def test_components_against_a_search(spark):
    rng = np.random.default_rng(12)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(k, 400) for k in range(401, 480)] + [(500 + k, 501 + k) for k in range(40)]
    root = {}

    def top(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: top(k) for k in list(root)}


def test_near_duplicates_odd_rows(odd, docs):
    got = sorted((str(r.doc_id), r.n_links) for r in near_duplicates.join_near(odd).collect())
    assert len(got) == 9 and [g for g in got if g[0] == "4"] == [("4", 1)] * 2
    assert near_duplicates.join_near(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_told_by_their_text(spark):
    """Only the first row of a class stays, though its id is that of other rows."""
    a = " ".join(f"w{k}" for k in range(120))
    rows = [(1, a), (2, "b " * 80), (2, a + " tail"), (2, a + " tail"), (3, None), (3, None), (3, ""), (None, a), (4, "b " * 80)]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.keep_one_of_each(spark, df, DATA)
    assert sorted(((r.doc_id or 0), r.text) for r in kept.filter("text > ''").collect()) == [(0, a)] + [(2, "b " * 80)]
    assert kept.filter("doc_id = 3").count() == 2 and kept.columns == df.columns


def test_pruning_keeps_what_may_reach_the_threshold():
    least = near_duplicates.least_matches()
    assert list(least) == list(range(32, 193, 32)) and all(a < b for a, b in zip(least.values(), list(least.values())[1:]))
    assert least[32] < 0.8 * 32


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    clean = [f"c{a}{b}" for a in "bdfglmnprt" for b in ("ano", "ire", "olu", "emi", "usta")]
    bad = ["idiot", "stupid", "moron", "worthless"]
    texts, toxic = [], []
    for k in range(400):
        words = list(rng.choice(clean, 30))
        toxic.append(k % 4 == 0)
        if toxic[-1]:
            for w in rng.choice(bad, int(rng.integers(1, 4))):
                words.insert(int(rng.integers(0, 30)), w)
        texts.append(" ".join(words))
    return toxicity.fit(texts, np.array(toxic))


def test_insults_with_gaps_and_marks(model):
    scorer = toxicity.Scorer(model)
    bad = scorer.scores(["you are an idiot", "you i.d.i.o.t of cbano", "i d i o t cdire", "st-upid cfolu", "stuppid moronn"])
    good = scorer.scores(["cbano cdire cfolu", "", "the clear theory", "cgemi clusta."])
    assert min(bad) >= toxicity.CUT > max(good)


def test_the_kernel_against_its_definition():
    """Shared subsequences of three characters, edges included, discounted by the characters that they skip."""

    def features(word):
        w = f"^{word}$"
        out = defaultdict(float)
        for i, j, k in combinations(range(len(w)), 3):
            if k - i <= toxicity.REACH:
                out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    def kernel(a, b):
        x, y = features(a), features(b)
        return sum(v * y[t] for t, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    words = ["idiot", "stupid", "moron", "a1b", "naïveté", "onon", "réêou", "worthless"]
    ours = toxicity.Kernel(words)
    for word in words + ["idi0t", "stxuxpid", "mo-ron", "wort", "le"]:
        expected = np.array([kernel(word, w) for w in words])
        got = ours.values([word], 1e-6)[0]
        # The screen may pass over a word that has little in common with all of them.
        assert np.abs((np.zeros(len(words)) if got is None else got) - expected).max() < 1e-4 or (got is None and expected.max() < 0.6)
        assert (ours.values([word])[0] is None) == (expected.max() < toxicity.FLOOR)


def test_one_inserted_character_hides_no_insult(model):
    rng = np.random.default_rng(9)
    scorer = toxicity.Scorer(model)
    clean = "cbano cdire cfolu cgemi clusta"
    told = [w for w, x in zip(model.kernel.landmarks, model.weights) if x > 0 and scorer.scores([f"{clean} {w}"])[0] >= toxicity.CUT]
    assert set(told) >= {"idiot", "stupid", "moron", "worthless"}
    put, swapped = [], []
    for w in told * 10:
        at, c = int(rng.integers(1, len(w))), "abcdefghijklmnopqrstuvwxyz-.*"[int(rng.integers(0, 29))]
        put.append(f"{clean} {w[:at]}{c}{w[at:]}")
        swapped.append(f"{clean} {w[:at]}{rng.integers(0, 10)}{w[at + 1 :]}")
    assert np.mean(np.array(scorer.scores(put)) >= toxicity.CUT) >= 0.9
    assert np.mean(np.array(scorer.scores(swapped)) >= toxicity.CUT) >= 0.9
    assert max(scorer.scores([clean, "the stride of a motor, an idea, worth it", "studio idol moroccan"])) < toxicity.CUT


@pytest.mark.parametrize("word", ["idiot" * 200_000, "stupid-" * 140_000, "".join(f"{k % 7}id{'abc'[k % 3]}iot" for k in range(120_000)), "x" * 1_000_000])
def test_long_words_take_linear_time(model, word):
    began = time.perf_counter()
    toxicity.Scorer(model).scores([word])
    assert time.perf_counter() - began < 40


def test_pieces_cover_a_word():
    for n in (1, 64, 65, 96, 97, 200):
        word = "".join(chr(256 + k) for k in range(n))
        some = toxicity.pieces(word)
        assert {c for p in some for c in p} == set(word) and all(len(p) <= toxicity.PIECE for p in some)
        assert all(any(word[k : k + 32] in p for p in some) for k in range(max(1, n - 31)))


def test_held_out_documents(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    hit = (scored.predicted == 1) & (scored.toxic == 1)
    assert len(scored) > 900 and hit.sum() / (scored.toxic == 1).sum() >= 0.8 and hit.sum() / (scored.predicted == 1).sum() >= 0.7


def test_toxicity_of_an_empty_table(spark, docs, model):
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.kernel is None and toxicity.score(docs.limit(2), none).count() == 2


def test_toxicity_rows(spark, odd, model):
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.CUT) for r in rows)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_no_labels(spark, odd):
    m = toxicity.train(odd, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert {r.score < 0.01 for r in toxicity.score(odd, m).collect()} == {True}


def test_pipeline_keeps_columns_and_clean_documents(spark, docs):
    from quillspan.llm._common import staged

    last = docs.count()
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = staged(stage(spark, now, DATA), "test")
        if name != "byte_bpe":
            assert now.columns == docs.columns
        n = now.count()
        assert 0.8 * docs.count() <= n <= last
        last = n


def test_pipeline_against_brute_force(spark, tmp_path):
    """Planted toxic, copied, contaminated and secret-bearing documents, nulls and repeated ids, stage by stage."""
    import hashlib

    import public_tokenizers as P
    import tiktoken

    from quillspan.llm import secrets
    from quillspan.llm._common import staged

    rng = np.random.default_rng(21)
    vocabulary = [f"{a}{b}" for a in ("bal", "cor", "din", "fer", "gal", "hom") for b in ("ano", "ire", "olu", "emi", "usta", "ent", "ari")]
    plain = lambda n: " ".join(rng.choice(vocabulary, n))
    rows, labels = [], []
    for k in range(300):  # the labelled part
        toxic = k % 4 == 0
        labels.append((k, int(toxic)))
        rows.append((k, plain(25) + (" " + ("idiot", "moron", "stupid")[k // 4 % 3] if toxic else "") + " " + plain(15)))
    item = plain(40)
    first = plain(80)
    value = "Zk9fQ2xw7Rt1Lm4Vb8Nc"
    rows += [(1000, first), (1001, first), (1002, first + " tail"), (1003, "x " + first), (1010, plain(30) + " " + item + " " + plain(20)), (1011, item.upper()), (1020, f"{plain(40)} token = {value} {plain(5)}"), (1021, plain(60) + " idXiot"), (1030, None), (1031, ""), (None, plain(50)), (1000, plain(70))]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(k, t, ["en", "de"][n % 2], f"s{n % 7}", len(t or "")) for n, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    told = lambda df: sorted(((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect()))
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{folder}/documents.parquet")

    model = toxicity.train(now, spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    expected = [x for x in told(now) if scorer.scores([x[1]])[0] < toxicity.CUT]
    now = staged(stages["toxicity"](spark, now, folder), "test")
    assert told(now) == expected and "1021" not in {k for k, _ in expected}
    assert {k for k, _ in expected} >= {str(k) for k in range(300) if k % 4} and not {k for k, _ in expected} & {str(k) for k in range(0, 300, 4)}

    given = [(None if k == "None" else int(k), t) for k, t in told(now)]
    by_class = brute(sorted((10**9 if k is None else k, t) for k, t in given))
    now = staged(stages["near_duplicates"](spark, now, folder), "test")
    gone = set(told_before := [(str(k), t) for k, t in given]) - set(told(now))
    assert {k for k, _ in gone} == {str(k) for k, c, n in by_class if n and k != c} == {"1001", "1002", "1003"} and len(told_before) == len(told(now)) + 3

    before = told(now)
    now = staged(stages["decontamination"](spark, now, folder), "test")
    assert set(before) - set(told(now)) == {x for x in before if item in x[1].lower()} and len(before) == len(told(now)) + 2

    before = told(now)
    now = staged(stages["secrets"](spark, now, folder), "test")
    expected = []
    for k, t in before:
        for _, a, b, v in sorted((s for s in secrets.base_spans(t) if secrets.looks_live(s[3])), key=lambda s: -s[1]):
            t = t[:a] + "[SECRET]" + t[b:]
        expected.append((k, t))
    assert told(now) == sorted(expected) and sum("[SECRET]" in t for _, t in expected) == 1

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in stages["byte_bpe"](spark, now, folder).collect())
    assert rows == sorted((k, len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for k, t in told(now))


def test_near_duplicates_are_not_broadcast(spark, docs, capsys):
    found = near_duplicates.classes(docs)
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
