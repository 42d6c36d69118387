"""Operator 9, byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own. A segment tree over its byte positions holds, at position i, the
rank of the pair that starts there; the root is the leftmost pair of least rank. A merge of that pair joins two
neighbours in a linked list and updates three leaves (the pair before, the pair itself, the pair that vanished), each in
logarithmic time, so a piece of n bytes takes O(n log n) however long it is. Short pieces, which are nearly all, run
through the same trees many at a time as numpy rows; long ones through one tree in plain Python.

Defined cases: null and empty texts have no tokens (digests of nothing); text that spells a special token is ordinary
text; repeated rows each get their row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import kept, table, texts
from .chunks import PATTERN, ChunkEncoder

NONE = np.int64(2**62)
BATCHED = 64  #: pieces of up to so many bytes are merged many at a time


class ByteBpe:
    """A rank file's vocabulary with segment-tree merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None:
                    pairs[a << 20 | b] = rank
        self.codes = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[c] for c in self.codes.tolist()], np.int64)
        self.pieces: dict[bytes, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 20 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.merged[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece of any length by one segment tree."""
        n, ranks = len(piece), self.ranks
        size = 1 << max(1, (n - 1).bit_length())
        none = int(NONE)
        tree = [none] * (2 * size)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, key: int) -> None:
            i += size
            tree[i] = key
            while i > 1:
                i >>= 1
                key = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == key:
                    return
                tree[i] = key

        def rank_at(i: int) -> int:
            j = after[i]
            r = ranks.get(piece[i : end[j]]) if j < n else None
            return none if r is None else r * size + i

        while tree[1] < none:
            i = tree[1] % size
            j = after[i]
            end[i], after[i] = end[j], after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, rank_at(i))
            if before[i] >= 0:
                put(before[i], rank_at(before[i]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = after[i]
        return ids

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of 2 to ``size`` bytes (a power of two), a tree a row; ids as uint32 bytes."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        position = np.arange(size)
        token = self.byte_id[raw]
        after = np.broadcast_to(position + 1, (n, size)).copy()
        before = np.broadcast_to(position - 1, (n, size)).copy()
        live = position < lengths[:, None]
        tree = np.full((n, 2 * size), NONE)
        first = self.pair_ranks(token[:, :-1], token[:, 1:])
        first[~live[:, 1:]] = NONE
        tree[:, size : 2 * size - 1] = np.where(first < NONE, first * size + position[:-1], NONE)
        width = size
        while width > 1:
            level = tree[:, width : 2 * width]
            width //= 2
            tree[:, width : 2 * width] = np.minimum(level[:, ::2], level[:, 1::2])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while rows.size:
            key = tree[rows, 1]
            i = key % size
            j = after[rows, i]
            k = after[rows, j]
            token[rows, i] = key // size
            after[rows, i] = k
            live[rows, j] = False
            has = k < lengths[rows]
            before[rows[has], k[has]] = i[has]
            p = before[rows, i]
            right = np.where(has, self.pair_ranks(token[rows, i], token[rows, np.minimum(k, size - 1)]), NONE)
            left = np.where(p >= 0, self.pair_ranks(token[rows, np.maximum(p, 0)], token[rows, i]), NONE)
            tree[rows, size + j] = NONE
            tree[rows, size + i] = np.where(right < NONE, right * size + i, NONE)
            has = p >= 0
            tree[rows[has], size + p[has]] = np.where(left[has] < NONE, left[has] * size + p[has], NONE)
            for leaf, at in ((j, rows), (i, rows), (p[has], rows[has])):
                node = (leaf + size) >> 1
                while node.size and node[0]:
                    tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < NONE]
        flat = token[live].astype("<u4").tobytes()
        ends = 4 * np.cumsum(live.sum(1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_pieces(self, wanted: list[bytes]) -> dict[bytes, bytes]:
        out, by_size = {}, {}
        for p in wanted:
            if (r := self.ranks.get(p)) is not None:
                out[p] = r.to_bytes(4, "little")
            elif len(p) <= BATCHED:
                by_size.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(p)
            else:
                out[p] = np.array(self.merge_one(p), "<u4").tobytes()
        for size, group in by_size.items():
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192]
                out.update(zip(part, self.merge_many(part, size)))
        return out

    def encode_many(self, chunks: list[str]) -> list[bytes]:
        known, find = self.pieces, self.pattern.findall
        # A chunk of letters alone, with or without its space, is one piece.
        split = [c.encode() if (c[1:] if c[:1] == " " else c).isalpha() else tuple(p.encode("utf-8", "surrogatepass") for p in find(c)) for c in chunks]
        wanted: set[bytes] = set()
        for p in split:
            wanted.update(p) if type(p) is tuple else wanted.add(p)
        known.update(self.encode_pieces([p for p in wanted if p not in known]))
        out = [b"".join([known[q] for q in p]) if type(p) is tuple else known[p] for p in split]
        if len(known) > 150_000:
            self.pieces = {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@kept
def load(path: str, pattern: str) -> tuple[ByteBpe, Callable[[list[str]], list[bytes]]]:
    bpe = ByteBpe.from_file(path, pattern)
    # Other patterns may join what a chunk's end keeps apart: whole texts then.
    return bpe, ChunkEncoder(bpe.encode_many, limit=600_000) if pattern == PATTERN else bpe.encode_many


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian uint32 bytes) and ``decoded`` bytes of every whole text."""

    def run(batches):
        bpe, encoder = load(path, pattern)
        for b in batches:
            ids = encoder(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """What :func:`encode` gives, as counts and digests made beside the encoder so that ids never leave the worker."""

    def run(batches):
        bpe, encoder = load(path, pattern)
        for b in batches:
            ids = encoder(b.column("text").to_pylist())
            hexes = [hashlib.sha256(x).hexdigest() for x in ids]
            decoded = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(hexes), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
