"""Operator 7, token counts without token ids.

Texts are cut into blocks of documents. Each block gives, for every distinct pre-token in it, one row with the rows of the
block that hold it and how often. Rows are dealt by pre-token once; from that one exchange come both the vocabulary
(each distinct pre-token, whose pieces the tokenizer counts once) and the frequencies it is joined to. The products are
summed per document: first inside each task into one array a block, then once more by block.

A pre-token has one row a block that holds it, not one a document. Where a block finds it in a large share of its documents, the row goes to
one of ``SALTS`` partitions of that pre-token by the block's number, so that the words which all documents hold are dealt over many tasks; each of
these partitions counts the pieces of those few words for itself.

Defined cases: a null or empty text has no tokens and no bytes; strings that spell an added token count one each, as the
library does by default; repeated rows are counted each on its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import kept, table, texts

BLOCK_ROWS = 3000  #: documents of a block
BLOCK_CHARS = 24_000_000  #: a block is closed sooner when its texts are long
DIRECTORY = "\0block:"  #: marks the row that carries a block's own documents; no pre-token mixes such characters
SALTS = 16  #: partitions of a pre-token that a large share of documents hold
FREQUENT, LEAST_ROWS = 8, 64  #: such a share: one document of so many, in a block of so many documents
HELD_SUMS = 4_000_000  #: sums that a task holds before it hands them on


def split_pattern(path: str, told: dict) -> str:
    """The file's pattern of pre-tokens, if its other parts are those that :class:`WordVocabulary` takes apart: composing, white
    space as one space, lower case; pre-tokens cut out by a pattern and written as bytes."""
    normal = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", ())]
    cut = (told["pre_tokenizer"] or {}).get("pretokenizers", ())
    if normal != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cut] != ["Split", "ByteLevel"] or cut[0]["behavior"] != "Removed" or not cut[0]["invert"] or cut[1]["use_regex"] or cut[1]["add_prefix_space"]:
        raise ValueError(f"{path}: not a word-end vocabulary of the kind that is taken apart here")
    return cut[0]["pattern"]["Regex"]


class WordVocabulary:
    """The tokenizer of a word-end BPE file, taken apart into its normaliser, its split and its model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self.model = t.model
        self.special = sorted((x.content for x in t.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special_any = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.find = regex.compile(split_pattern(path, json.loads(t.to_str()))).findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_chars = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.chunks: dict[str, tuple[str, ...]] = {}

    def pre_tokens(self, chunk: str) -> tuple[str, ...]:
        """Of a run without white space: composed, each character lower-cased on its own, split."""
        if (v := self.chunks.get(chunk)) is None:
            low = chunk.lower() if chunk.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
            v = (low,) if low.isalpha() else tuple(self.find(low))
            if len(chunk) <= 64:
                self.chunks[chunk] = v
        return v

    def pieces(self, pre_token: str) -> int:
        return len(self.model.tokenize(pre_token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.byte_chars)))

    def chunk_counts(self, text: str) -> tuple[Counter, int]:
        """White-space separated runs of a text with their frequencies, and its added tokens."""
        if "<|" in text and (n := len(self.special_any.findall(text))):
            total: Counter = Counter()
            for part in self.special_any.split(text):
                total.update(part.split())
            return total, n
        return Counter(text.split()), 0


@kept
def load(path: str) -> WordVocabulary:
    return WordVocabulary(path)


def postings(docs: DataFrame, path: str) -> DataFrame:
    """``block``, ``token``, ``salt`` and packed (row of the block, frequency) pairs; and each block's directory of documents."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        v = load(path)
        block = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        chunk_of: dict[str, int] = {}
        cells: list[np.ndarray] = []
        chars = 0

        def close() -> pa.RecordBatch:
            token_of: dict[str, int] = {}
            lists = [[token_of.setdefault(p, len(token_of)) for p in v.pre_tokens(c)] for c in chunk_of]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((x for y in lists for x in y), np.int64, int(sizes.sum()))
            first = np.cumsum(sizes) - sizes
            row, chunk, n = (np.concatenate([c[k] for c in cells]) for k in range(3)) if cells else (np.zeros(0, np.int64),) * 3
            k = sizes[chunk]
            at = np.repeat(first[chunk] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            key = flat[at] << 20 | np.repeat(row, k)
            key, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse, np.repeat(n, k), len(key)).astype("<u4")
            pair = np.empty((len(key), 2), "<u4")
            pair[:, 0], pair[:, 1] = key & (1 << 20) - 1, n
            ends = np.searchsorted(key >> 20, np.arange(len(token_of)), side="right") * 8
            data = pair.tobytes()
            offsets = np.concatenate([[0], ends]).tolist()
            payload = [data[a:b] for a, b in zip(offsets, offsets[1:])]
            own = 1 + (block ^ block >> 32) % SALTS
            salts = [own if len(rows) >= LEAST_ROWS and len(p) // 8 * FREQUENT >= len(rows) else 0 for p in payload]
            names = list(token_of)
            names.append(f"{DIRECTORY}{block}")
            salts.append(0)
            payload.append(b"".join(struct.pack("<qqqq", doc is not None, doc or 0, size, special) for doc, size, special in rows))
            if len(v.chunks) > 150_000:
                v.chunks.clear()
            return pa.record_batch([pa.array([block] * len(names), pa.int64()), pa.array(names, pa.string()), pa.array(salts, pa.int32()), pa.array(payload, pa.binary())], names=["block", "token", "salt", "pairs"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                # str.split also splits at four control characters that the pattern takes for symbols
                counts, special = v.chunk_counts(text) if not CONTROLS.search(text) else exact_counts(v, text)
                ids = [chunk_of.setdefault(c, len(chunk_of)) for c in counts]
                cells.append((np.full(len(ids), len(rows)), np.array(ids, np.int64), np.fromiter(counts.values(), np.int64, len(ids))))
                rows.append((doc, len(text.encode("utf-8", "surrogatepass")), special))
                chars += len(text)
                if len(rows) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    yield close()
                    block, rows, chunk_of, cells, chars = block + 1, [], {}, [], 0
        if rows:
            yield close()

    return texts(docs).mapInArrow(run, "block long, token string, salt int, pairs binary")


CONTROLS = re.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\s+")


def exact_counts(v: WordVocabulary, text: str) -> tuple[Counter, int]:
    """As ``chunk_counts``, splitting at the pattern's own white space only."""
    total: Counter = Counter()
    for part in v.special_any.split(text):
        total.update(c for c in WHITE.split(part) if c)
    return total, len(v.special_any.findall(text))


def vocabulary(dealt: DataFrame, path: str) -> DataFrame:
    """Every distinct pre-token with its number of pieces, each counted once in its partition."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for b in batches:
            names = b.column("token").to_pylist()
            yield pa.record_batch([pa.array(names, pa.string()), b.column("salt"), pa.array([0 if t.startswith(DIRECTORY) else v.pieces(t) for t in names], pa.int64())], names=["known_token", "known_salt", "pieces"])

    # The aggregates read every column, so that this and the join below share one exchange.
    distinct = dealt.groupBy("token", "salt").agg(F.count("block").alias("blocks"), F.sum(F.octet_length("pairs")).alias("size"))
    return distinct.mapInArrow(run, "known_token string, known_salt int, pieces long")


def partial_sums(joined: DataFrame) -> DataFrame:
    """``block`` and either the block's directory or the tokens of its rows that this task has seen."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        held = 0

        def give(blocks: list[int], kind: int, data: list[bytes]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(blocks, pa.int64()), pa.array([kind] * len(blocks), pa.int32()), pa.array(data, pa.binary())], names=["block", "kind", "data"])

        for b in batches:
            blocks = np.array(b.column("block").to_pylist(), np.int64)
            pieces = np.array(b.column("pieces").to_pylist(), np.int64)
            pairs = b.column("pairs").to_pylist()
            lead = [i for i, t in enumerate(b.column("token").to_pylist()) if t.startswith(DIRECTORY)]
            if lead:
                yield give(blocks[lead].tolist(), 0, [pairs[i] for i in lead])
                for i in lead:
                    pairs[i] = b""
            size = np.fromiter(map(len, pairs), np.int64, len(pairs)) // 8
            cells = np.frombuffer(b"".join(pairs), "<u4").reshape(-1, 2)
            n = cells[:, 1] * np.repeat(pieces, size)
            names, which = np.unique(blocks, return_inverse=True)
            width = int(cells[:, 0].max()) + 1 if len(cells) else 0
            part = np.bincount(np.repeat(which, size) * width + cells[:, 0], n, len(names) * width).astype(np.int64).reshape(len(names), width)
            for name, row in zip(names.tolist(), part):
                old = sums.get(name)
                if old is None or len(old) < len(row):
                    held += len(row) - (0 if old is None else len(old))
                    row = row.copy()
                    if old is not None:
                        row[: len(old)] += old
                    sums[name] = row
                else:
                    old[: len(row)] += row
            if held > HELD_SUMS:
                yield give(list(sums), 1, [x.astype("<i4").tobytes() if x.max(initial=0) < 2**31 else x.astype("<i8").tobytes() + b"\0" for x in sums.values()])
                sums, held = {}, 0
        if sums:
            yield give(list(sums), 1, [x.astype("<i4").tobytes() if x.max(initial=0) < 2**31 else x.astype("<i8").tobytes() + b"\0" for x in sums.values()])

    return joined.select("block", "token", "pairs", "pieces").mapInArrow(run, "block long, kind int, data binary")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row."""

    def total(key, pdf):
        import pandas as pd

        lead = np.frombuffer(b"".join(pdf.loc[pdf.kind == 0, "data"]), "<i8").reshape(-1, 4)
        n = lead[:, 3].copy()
        for data in pdf.loc[pdf.kind == 1, "data"]:
            x = np.frombuffer(data, "<i4") if len(data) % 4 == 0 else np.frombuffer(data[:-1], "<i8")
            n[: len(x)] += x[: len(n)]  # a task's sums of a short block end in zeros
        ids = pd.array(lead[:, 1], dtype="Int64")
        ids[lead[:, 0] == 0] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_bytes": lead[:, 2], "n_tokens": n, "over_limit": n > limit})

    # The filter drops nothing; stated here, the join need not add it on one side and so split the shared exchange.
    dealt = postings(docs, path).filter(F.col("token").isNotNull() & F.col("salt").isNotNull()).repartition("token", "salt")
    known = vocabulary(dealt, path)
    joined = dealt.join(known, (dealt["token"] == known["known_token"]) & (dealt["salt"] == known["known_salt"]))
    return partial_sums(joined).groupBy("block").applyInPandas(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
