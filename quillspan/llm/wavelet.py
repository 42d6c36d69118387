"""Operator 5, token-id output as one wavelet matrix per shard.

A shard is one self-contained compressed blob: a header, the lengths of its documents, and one bit-plane per bit of its largest
id, from the highest down. Each plane keeps the ids' bits in the order that the planes above put them into (zeros first,
stable). It is stored in chunks of ``CHUNK`` bits, each compressed where that makes it smaller, with the count of ones before
every 512-bit block beside it. From that single file :class:`WaveletMatrix` answers ``access``, ``rank`` (how often an id
occurs before a position) and ``select`` (where its k-th occurrence is) by walking the planes; it opens the chunks that it
walks through and no others, and finds a block by binary search. ``decode_all`` undoes the planes in one sweep.

Documents are dealt out in ascending ``doc_id`` order (ties by text), so every task writes consecutive shards; a task keeps
one shard's ids in memory at a time. Blobs are stored through Spark's writer and read through Spark's reader, hence in
whatever store the cluster shares.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` sorts first; repeated rows each get a place;
other columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import kept, staged, table, texts
from .chunks import PATTERN, ChunkEncoder

MAGIC = b"QWM2"
BLOCK = 512  #: bits between stored ranks
CHUNK = 1 << 16  #: bits of a plane that are compressed together
SHARD_IDS = 1 << 20  #: ids after which a shard is closed; a document is never split
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, doc_lengths: np.ndarray) -> bytes:
    """The shard of these ids (documents end to end)."""
    n = len(ids)
    levels = max(1, int(ids.max()).bit_length()) if n else 1
    x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    parts = [MAGIC, struct.pack("<IQI", levels, n, len(doc_lengths)), doc_lengths.astype("<u4").tobytes()]
    squeeze = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False).compress
    for level in range(levels - 1, -1, -1):
        bit = (x & x.dtype.type(1 << level)).astype(bool)
        plane = np.packbits(bit, bitorder="little")
        ones = np.flatnonzero(bit)
        zeros = np.flatnonzero(~bit)
        counts = ONES[np.pad(plane, (0, -len(plane) % (BLOCK // 8)))].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        chunks = []
        for raw in (plane[k : k + CHUNK // 8].tobytes() for k in range(0, len(plane), CHUNK // 8)):
            small = squeeze(raw)
            chunks.append(small if len(small) < len(raw) else raw)
        sizes = np.fromiter(map(len, chunks), "<u4", len(chunks))
        parts += [struct.pack("<Q", len(zeros)), ranks.tobytes(), sizes.tobytes(), *chunks]
        y = np.empty_like(x)
        x.take(zeros, out=y[: len(zeros)], mode="clip")
        x.take(ones, out=y[len(zeros) :], mode="clip")
        x = y
    return b"".join(parts)


class Plane:
    """One stored bit-plane; chunks are opened as they are asked for, the last ``OPEN`` of them stay open."""

    OPEN = 64

    def __init__(self, blob: bytes, n: int, at: int):
        self.n, self.size = n, (n + 7) // 8
        blocks = -(-self.size // (BLOCK // 8)) + 1
        (self.zeros,) = struct.unpack_from("<Q", blob, at)
        self.ranks = np.frombuffer(blob, "<u4", blocks, at + 8)
        at += 8 + 4 * blocks
        sizes = np.frombuffer(blob, "<u4", -(-self.size // (CHUNK // 8)), at).astype(np.int64)
        self.ends = at + 4 * len(sizes) + np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.end = int(self.ends[-1]) if len(sizes) else at
        self.blob = blob
        self.open: dict[int, np.ndarray] = {}

    def chunk(self, c: int) -> np.ndarray:
        if (found := self.open.get(c)) is None:
            raw = min(CHUNK // 8, self.size - c * (CHUNK // 8))
            data = self.blob[int(self.starts[c]) : int(self.ends[c])]
            found = np.frombuffer(data if len(data) == raw else zstandard.ZstdDecompressor().decompress(data, max_output_size=raw), np.uint8)
            if len(self.open) >= self.OPEN:
                del self.open[next(iter(self.open))]
            self.open[c] = found
        return found

    def whole(self) -> np.ndarray:
        """All bytes of the plane, without keeping its chunks open."""
        out = np.empty(self.size, np.uint8)
        for c, (a, b) in enumerate(zip(self.starts.tolist(), self.ends.tolist())):
            at = c * (CHUNK // 8)
            raw = min(CHUNK // 8, self.size - at)
            data = self.blob[a:b]
            out[at : at + raw] = np.frombuffer(data if len(data) == raw else zstandard.ZstdDecompressor().decompress(data, max_output_size=raw), np.uint8)
        return out

    def bytes_of(self, block: int) -> np.ndarray:
        """The bytes of a 512-bit block (a chunk is a whole number of blocks)."""
        c, at = divmod(block * BLOCK, CHUNK)
        return self.chunk(c)[at // 8 : (at + BLOCK) // 8]

    def bit(self, i: int) -> int:
        return int(self.bytes_of(i // BLOCK)[i % BLOCK // 8] >> i % 8 & 1)

    def ones(self, i: int) -> int:
        """Ones among the first i bits."""
        block, rest = divmod(i, BLOCK)
        n = int(self.ranks[block])
        if rest:
            own = self.bytes_of(block)
            n += int(ONES[own[: rest // 8]].sum()) + (int(ONES[own[rest // 8] & ((1 << rest % 8) - 1)]) if rest % 8 else 0)
        return n

    def find(self, bit: int, nth: int) -> int:
        """Position of the nth (from 0) such bit, its block by binary search."""
        before = (lambda b: int(self.ranks[b])) if bit else (lambda b: b * BLOCK - int(self.ranks[b]))
        block = bisect_right(range(len(self.ranks)), nth, key=before) - 1
        bits = np.unpackbits(self.bytes_of(block), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[nth - before(block)])


class WaveletMatrix:
    """Reads one shard."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        self.levels, self.n, docs = struct.unpack_from("<IQI", blob, 4)
        at = 20
        self.doc_lengths = np.frombuffer(blob, "<u4", docs, at)
        at += 4 * docs
        self.planes: list[Plane] = []
        for _ in range(self.levels):
            self.planes.append(Plane(blob, self.n, at))
            at = self.planes[-1].end

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            bit, ones = plane.bit(i), plane.ones(i)
            i = plane.zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        start, end = 0, i
        for k, plane in enumerate(self.planes):
            a, b = plane.ones(start), plane.ones(end)
            start, end = (plane.zeros + a, plane.zeros + b) if token >> (self.levels - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of ``token`` before position i (all, if i is not given)."""
        if token >> self.levels:
            return 0
        start, end = self._range(token, self.n if i is None else min(i, self.n))
        return end - start

    def select(self, token: int, nth: int) -> int:
        """Position of the nth occurrence of ``token``, from 0."""
        if nth < 0 or nth >= self.rank(token):
            raise IndexError(nth)
        i = self._range(token, 0)[0] + nth
        for k in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - k) & 1
            i = self.planes[k].find(bit, i - self.planes[k].zeros if bit else i)
        return i

    def decode_all(self) -> np.ndarray:
        x = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            zeros = self.planes[k].zeros
            bit = np.unpackbits(self.planes[k].whole(), count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(bit)] = x[zeros:] | x.dtype.type(1 << (self.levels - 1 - k))
            y[np.flatnonzero(~bit)] = x[:zeros]
            x = y
        return x


def in_pieces(t) -> bool:
    """Whether the file's parts are those that :func:`load` takes apart: no normaliser, the public split, plain merges."""
    told = json.loads(t.to_str())
    split, model = told["pre_tokenizer"] or {}, told["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return plain and told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")


@kept
def load(path: str) -> tuple[object, Callable[[list[str]], list[bytes]], list[str]]:
    """The tokenizer, what encodes whole texts by it, and its added tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    if not in_pieces(t):
        return t, lambda values: [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(values, add_special_tokens=False)], special

    # The pre-tokenizer splits by this pattern and writes each byte as a printable character; the model then encodes each piece.
    find, tokenize = regex.compile(PATTERN).findall, t.model.tokenize
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_chars = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    space, packed = chr(byte_chars[32]), [k.to_bytes(4, "little") for k in range(t.get_vocab_size())]

    def piece_ids(p: str) -> bytes:
        if (p[1:] if p[:1] == " " else p).isalnum() and p.isascii():
            shown = p.replace(" ", space)
        else:
            shown = p.encode("utf-8", "surrogatepass").decode("latin-1").translate(byte_chars)
        return b"".join([packed[x.id] for x in tokenize(shown)])

    def many(chunks: list[str]) -> list[bytes]:
        # A chunk of letters alone, with or without its space, is one piece.
        return [piece_ids(c) if (c[1:] if c[:1] == " " else c).isalpha() else b"".join(map(piece_ids, find(c))) for c in chunks]

    return t, ChunkEncoder(many), special


def encode_texts(path: str, values: list[str]) -> list[bytes]:
    """Ids of whole texts as the library gives them; a text that spells an added token goes to the library in one piece."""
    t, encoder, special = load(path)
    odd = {i for i, v in enumerate(values) if any(s in v for s in special)}
    out = encoder([v for i, v in enumerate(values) if i not in odd])
    rest = iter(out)
    return [np.array(t.encode(v, add_special_tokens=False).ids, "<u4").tobytes() if i in odd else next(rest) for i, v in enumerate(values)]


SHARD = "part int, seq long, first_id long, n_ids long, doc_ids binary, blob binary"


def write(docs: DataFrame, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards of all texts, each followed by ``end_id``, and return the stored shards.

    ``first_id`` counts ids before the shard within its task's run of documents; :func:`starts` adds the runs before it.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        ids: list[bytes] = []
        held = 0
        end = np.array([end_id], "<u4").tobytes()

        def close() -> pa.RecordBatch:
            lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            blob = pack(np.frombuffer(b"".join(ids), "<u4"), lengths)
            known = np.array([(0, 0) if k is None else (1, k) for k in keys], "<i8").tobytes()
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([known], pa.binary()), pa.array([blob], pa.binary())], names=["part", "seq", "first_id", "n_ids", "doc_ids", "blob"])

        for b in batches:
            for key, x in zip(b.column("doc_id").to_pylist(), encode_texts(path, b.column("text").to_pylist())):
                keys.append(key)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= shard_ids:
                    yield close()
                    seq, first, held, keys, ids = seq + 1, first + held, 0, [], []
        if keys:
            yield close()

    spark = docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(dealt.mapInArrow(run, SHARD), "wavelet")


def starts(shards: DataFrame) -> DataFrame:
    """``part`` and the ids in all runs before it; one row for each task of the writer, however many rows they wrote."""
    runs = shards.groupBy("part").agg(F.sum("n_ids").alias("run_ids"))
    before = F.sum("run_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return runs.select("part", F.coalesce(before, F.lit(0)).alias("run_start"))


def documents_of(shards: DataFrame) -> DataFrame:
    """Every document read back from the stored shards: its place, length and the crc32 of its ids."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, run_start, known, blob in zip(*(b.column(c).to_pylist() for c in ("first_id", "run_start", "doc_ids", "blob"))):
                m = WaveletMatrix(blob)
                ids = memoryview(m.decode_all().astype("<u4")).cast("B")
                known = np.frombuffer(known, "<i8").reshape(-1, 2)
                lengths = m.doc_lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.record_batch([pa.array(known[:, 1], mask=known[:, 0] == 0), pa.array(run_start + first + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(starts(shards)), "part")  # one row a writer task: bounded by the number of partitions
    return placed.select("first_id", "run_start", "doc_ids", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents")
    return documents_of(write(docs, P.path("byte_bpe_50k.json")))
