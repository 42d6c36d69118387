"""Operators 5, 7 and 9 against the libraries, on the small table and on odd texts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillspan.llm import bpe, chunks, token_counts, wavelet

BYTE_JSON, WORD_JSON, RANKS = (P.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merging_agrees_with_the_library(library):
    rng = random.Random(3)
    ours, encoder = bpe.load(RANKS, P.PATTERN)
    made = ["".join(rng.choice(" \n\t'sabcéñ12!.  ") for _ in range(rng.randint(1, 90))) for _ in range(800)] + ["", "x" * 3000, "  a", "é" * 500]
    for text, ids in zip(made, encoder(made)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()
    for _ in range(100):
        piece = bytes(rng.choice(b"etaoin shrdlu'") for _ in range(rng.randint(2, 64)))
        assert np.array(ours.merge_one(piece), "<u4").tobytes() == ours.encode_pieces([piece])[piece]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_byte_bpe_round_trip(spark, request, library, which):
    df = request.getfixturevalue(which)
    expected = sorted((str(r.doc_id), len(i := library.encode_ordinary(r.text or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, RANKS, P.PATTERN).collect()) == expected
    assert {bytes(r.decoded) for r in bpe.encode(df, RANKS, P.PATTERN).collect()} == {(r.text or "").encode() for r in df.collect()}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_wavelet_files(spark, request, which):
    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(BYTE_JSON)
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, expected = 0, []
    for r in rows:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((str(r.doc_id), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    shards = wavelet.write(df, BYTE_JSON, shard_ids=5000)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in wavelet.documents_of(shards).collect()) == sorted(expected)


def test_wavelet_queries():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 3000):
        a = rng.zipf(1.5, n).clip(0, 50256).astype(np.uint32)
        m = wavelet.WaveletMatrix(wavelet.pack(a, np.array([n])))
        assert (m.decode_all() == a).all()
        for i in range(0, n, 97):
            token, before = int(a[i]), int((a[:i] == a[i]).sum())
            assert (m.access(i), m.rank(token, i), m.select(token, before)) == (token, before, i)
        assert m.rank(65535) == 0
    with pytest.raises(IndexError):
        m.access(3000)


def test_wavelet_of_many_compressed_chunks():
    rng = np.random.default_rng(2)
    a = (rng.zipf(1.3, 300_000) % 50_257).astype(np.uint32)
    blob = wavelet.pack(a, np.array([len(a)]))
    assert len(blob) < 2 * len(a)  # smaller than plain 16-bit ids, ranks and all
    m = wavelet.WaveletMatrix(blob)
    assert (m.decode_all() == a).all()
    for i in rng.integers(0, len(a), 60).tolist():
        token, before = int(a[i]), int((a[:i] == a[i]).sum())
        assert (m.access(i), m.rank(token, i), m.select(token, before)) == (token, before, i)


def test_chunks_agree_with_the_library_and_forget(monkeypatch):
    rng = random.Random(5)
    t, encoder, _ = wavelet.load(BYTE_JSON)
    small = chunks.ChunkEncoder(encoder.encode_many, limit=60, longest=12)
    parts = [*"abé1'!.,;:? \n\t", " ", " ", "\n", "\n\n", " \n", "\u00a0", "\u2028", "\x1c", "\r\n", "the", "Word", "it's", "日本", "a" * 20]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(20)]
        expected = [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
        assert encoder(texts) == expected and small(texts) == expected
    assert small.n < 400 and small([]) == []


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    import json

    told = json.loads(Tokenizer.from_file(BYTE_JSON).to_str())
    told["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    open(path, "w").write(json.dumps(told))
    t = Tokenizer.from_file(path)
    assert wavelet.encode_texts(path, ["one two", ""]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ("one two", "")]
    with pytest.raises(ValueError):
        token_counts.WordVocabulary(path)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_counts(spark, request, which):
    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(WORD_JSON)
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in df.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, WORD_JSON).collect()) == expected


def test_empty_tables(docs):
    none = docs.limit(0)
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0
    assert wavelet.documents_of(wavelet.write(none, BYTE_JSON)).count() == 0
    assert token_counts.count_tokens(none, WORD_JSON).count() == 0
