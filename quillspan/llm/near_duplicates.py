"""Operator 3, n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (a text of fewer words is one shingle); two are linked at a Jaccard similarity of
0.8 or more. Documents with the same shingles are copies: they are told apart by nothing here, so each class of copies
is one representative with a multiplicity, and only representatives are compared.

1. *Candidates*: MinHash bands put representatives into buckets. Each bucket links its members to its least member, and the
   connected components of these links are the candidate groups: every pair that shares a bucket is inside one, and those pairs are
   the candidates at every size. A large group whose buckets hold far fewer pairs than itself (a chain of texts each like the
   next) is dealt out by its buckets instead; there a pair counts in the first bucket that it shares.
2. *Pruning*: a group is cut into blocks by hash, and every pair of blocks is one unit of work (a document goes to as many
   units as its group has blocks; no pair is ever a row). Inside a unit MinHash values are compared a batch at a time, and
   a pair is dropped once the posterior probability (uniform prior) that its similarity reaches the threshold falls below
   ``TOLERANCE``.
3. *Verification*: the pairs that remain are verified exactly on their shingles.

A unit returns, for each document, the number of documents linked to it and one link of a spanning forest; summed and joined
over the units these are exact counts and classes.

Defined cases: null and empty texts (and texts without words) have no shingles and are linked to nothing; repeated rows are
copies of each other; a null ``doc_id`` is a value of its own; other columns are ignored; an empty table gives no rows. The
chance to miss a pair at exactly 0.8 is 6e-5 in the bands and 1e-6 in the pruning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import keep, staged, table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND = 32, 6
HASHES = BANDS * BAND
STEP = 32  #: MinHash values compared before the posterior is looked at again
TOLERANCE = 1e-6
BLOCK_DOCS = 256
BLOCK_SHINGLES = 200_000
APART = 1024  #: members from which a candidate group may be taken apart into its buckets
SALTS = 16  #: tasks over which the rows of one key are spread where they meet one row of that key
PRIME = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that separate words become spaces, A-Z become lower case; bytes of other letters stay.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@lru_cache(maxsize=1)
def hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 2**32, HASHES, np.uint32)


class Shingler:
    """Shingle hashes of texts; hashes of words are remembered, up to a bound."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, text: str) -> np.ndarray:
        """The sorted distinct 64-bit hashes of a text's shingles."""
        words = text.encode("utf-8", "surrogatepass").translate(BYTES).split()
        known = self.known
        hashes = [known.get(w) for w in words]
        if None in hashes:
            if len(known) > self.limit:
                known.clear()
            for k, (h, w) in enumerate(zip(hashes, words)):
                if h is None:
                    hashes[k] = known[w] = xxhash.xxh64_intdigest(w)
        x = np.array(hashes, np.uint64)
        n = max(1, len(x) - SHINGLE + 1) if len(x) else 0
        out = np.full(n, min(len(x), SHINGLE), np.uint64)
        for k in range(min(SHINGLE, len(x))):
            out *= PRIME
            out += x[k : k + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    a, b = hash_family()
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for k in range(0, len(low), 1024):
        x = low[k : k + 1024, None] * a
        x += b
        np.minimum(out, x.min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(sig[k * BAND : (k + 1) * BAND].tobytes(), k) - 2**63 for k in range(BANDS)]


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the least number of equal ones with which a pair is kept.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Bin(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def described(docs: DataFrame) -> DataFrame:
    """Every row: its key, the key of its text, the digest of its shingles, their number, and its bucket keys."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        shingler, key = keep(("shingler",), Shingler), TaskContext.get().partitionId() << 33
        for b in batches:
            copy, size, bands = [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                x = shingler(text)
                copy.append(hashlib.md5(x.tobytes()).hexdigest() if len(x) else f"empty:{key + k}")
                size.append(len(x))
                bands.append(band_keys(signature(x)) if len(x) else [])
            n = len(copy)
            yield pa.record_batch([pa.array(range(key, key + n), pa.int64()), b.column("doc_id"), b.column("text_key"), pa.array(copy), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["row_key", "doc_id", "text_key", "copy", "n_shingles", "bands"])
            key += n

    return staged(with_key(docs).mapInArrow(run, "row_key long, doc_id long, text_key long, copy string, n_shingles long, bands array<long>"), "shingled")


def with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def met(many: DataFrame, key: str, one: DataFrame, its_key: str, spread: str, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one`` row a key; the rows of each key are spread over ``SALTS`` tasks by ``spread``, however many they are.

    Both sides grow with the corpus and meet by a shuffle at every size; broadcasts of one small round after another would pile up.
    """
    salted = one.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), (F.col(key) == F.col(its_key)) & (F.col("salt") == F.col("salt_of")), how).drop("salt", "salt_of")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of the nodes of ``edges(a, b)``, by alternating large and small stars.

    Each round is two aggregations and two joins over the links; nothing is gathered in one place, and each round is written
    to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = staged(now, "links")
    before = None
    while True:
        # Large star: what hangs on b hangs on the least neighbour of b. The one that all hang on in the end has no lesser one.
        least = now.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        large = met(now, "b", least, "k", "a", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = met(large, "a", least, "k", "b")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now = staged(small, "links")
        sum_of = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sum_of == before:
            break
        before = sum_of
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def candidate_groups(reps: DataFrame) -> DataFrame:
    """``node, component`` of the representatives that share a bucket with another, directly or through others."""
    each = reps.select("rep", F.explode("bands").alias("key"))
    links = met(each, "key", buckets(reps), "bucket", "rep").filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    return components(links)


def buckets(reps: DataFrame) -> DataFrame:
    """``bucket, leader, n_bucket`` of the buckets with more than one member."""
    each = reps.select("rep", F.explode("bands").alias("key"))
    return each.groupBy(F.col("key").alias("bucket")).agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n_bucket")).filter("n_bucket > 1")


def units_of(reps: DataFrame, groups: DataFrame) -> DataFrame:
    """The candidates with the ``unit`` and ``band`` that each is compared in: its group (band -1), or each of its buckets."""
    wanted = reps.select("rep", "copies", "rep_doc", "rep_text", "n_shingles", "bands").join(groups.hint("merge"), F.col("rep") == F.col("node")).drop("node")
    sizes = groups.groupBy(F.col("component").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    known = buckets(reps)
    inside = known.join(groups.hint("merge"), F.col("leader") == F.col("node")).groupBy(F.col("component").alias("in")).agg(F.sum(F.col("n_bucket") * (F.col("n_bucket") - 1)).alias("pairs"))
    apart = sizes.join(inside.hint("merge"), F.col("of") == F.col("in")).filter((F.col("n") > APART) & (4 * F.col("pairs") < F.col("n") * (F.col("n") - 1))).select("of", F.lit(True).alias("apart"))
    marked = met(wanted, "component", apart, "of", "rep", "left")
    whole = marked.filter(F.col("apart").isNull()).select("rep", "copies", "rep_doc", "rep_text", "n_shingles", F.col("component").alias("unit"), F.lit(-1).alias("band"))
    taken = marked.filter("apart").select("rep", "copies", "rep_doc", "rep_text", "n_shingles", F.posexplode("bands").alias("band", "key"))
    taken = met(taken, "key", known, "bucket", "rep").select("rep", "copies", "rep_doc", "rep_text", "n_shingles", F.col("key").alias("unit"), "band")
    return whole.unionByName(taken)


def linked_pairs(sets: list[np.ndarray], sigs: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left[k], right[k]), those whose sets are similar enough."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    fit = np.minimum(size[left], size[right]) >= THRESHOLD * np.maximum(size[left], size[right])
    left, right = left[fit], right[fit]
    equal = np.zeros(len(left), np.int64)
    for n, least in least_matches().items():
        equal += (sigs[left, n - STEP : n] == sigs[right, n - STEP : n]).sum(1)
        keep = equal >= least
        left, right, equal = left[keep], right[keep], equal[keep]
        if not len(left):
            return left, right
    used = np.unique(np.concatenate([left, right]))
    if len(left) < 4 * len(used):
        common = np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())), np.int64, len(left))
    else:  # many pairs of few documents: count common shingles by products of 0/1 matrices, a strip of shingles at a time
        names, column = np.unique(np.concatenate([sets[k] for k in used.tolist()]), return_inverse=True)
        row = np.repeat(np.arange(len(used)), size[used])
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(used), len(used)), np.float32)
        for first in range(0, len(names), 2048):
            a, b = np.searchsorted(column, [first, first + 2048])
            strip = np.zeros((len(used), 2048), np.float32)
            strip[row[a:b], column[a:b] - first] = 1
            both += strip @ strip.T
        at = np.searchsorted(used, left), np.searchsorted(used, right)
        common = both[at].astype(np.int64)
    # J >= 0.8, in whole numbers: 10 * common >= 8 * (|a| + |b| - common)
    scale = round(THRESHOLD * 100)
    keep = (100 + scale) * common >= scale * (size[left] + size[right])
    return left[keep], right[keep]


def compare(reps: list[int], copies: list[int], sides: list[int], sets: list[np.ndarray], sigs: np.ndarray, crossed: bool, band: int = -1) -> Iterator[tuple[int, int, int]]:
    """(rep, links, root) of each document of one unit; ``crossed``: only pairs between the two sides count.

    ``band``: that of the bucket which the unit is; pairs that share a bucket of an earlier band count there. Below 0 the unit is a
    group, where pairs that share no bucket are passed over.
    """
    n, weight = len(reps), np.array(copies, np.int64)
    keys = np.array([band_keys(s) for s in sigs], np.int64).reshape(n, BANDS)
    side = np.array(sides)
    links = np.zeros(n, np.int64)
    root = list(range(n))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for first in range(0, n, 128):
        rows = np.arange(first, min(n, first + 128))
        left, right = (x.ravel() for x in np.meshgrid(rows, np.arange(n), indexing="ij"))
        wanted = (left < right) & (side[left] != side[right]) if crossed else left < right
        left, right = left[wanted], right[wanted]
        # The same pairs in a whole group and in its buckets: those that share a bucket, each once.
        wanted = (keys[left] == keys[right]).any(1) if band < 0 else ~(keys[left, :band] == keys[right, :band]).any(1)
        left, right = left[wanted], right[wanted]
        left, right = linked_pairs(sets, sigs, left, right)
        links += np.bincount(left, weight[right], n).astype(np.int64) + np.bincount(right, weight[left], n).astype(np.int64)
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = top(a), top(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    for k in range(n):
        yield reps[k], int(links[k]), reps[top(k)]


def verified(docs: DataFrame, reps: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rep, links`` of the candidates, and ``rep, label`` of their classes."""

    def describe(batches) -> Iterator[pa.RecordBatch]:
        shingler = keep(("shingler",), Shingler)
        for b in batches:
            sets = [shingler(t) for t in b.column("text").to_pylist()]
            columns = [b.column(c) for c in ("unit", "band", "blocks", "block", "rep", "copies")]
            yield pa.record_batch([*columns, pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([signature(x).tobytes() for x in sets], pa.binary())], names=["unit", "band", "blocks", "block", "rep", "copies", "shingles", "sig"])

    def units(batches) -> Iterator[pa.RecordBatch]:
        unit: list[tuple] = []
        key = None
        out: list[tuple[int, int, int, int]] = []

        def close() -> None:
            found: dict[int, tuple] = {x[0]: x for x in unit}  # repeated rows bring a representative twice
            rows = [found[k] for k in sorted(found)]
            sigs = np.frombuffer(b"".join(x[4] for x in rows), np.uint32).reshape(-1, HASHES)
            sets = [np.frombuffer(x[3], np.uint64) for x in rows]
            for r in compare([x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], sets, sigs, key[2] != key[3], key[1]):
                out.append((*r, key[4] if key[1] < 0 else 2))

        def give() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["rep", "links", "root", "blocks"])

        for b in batches:
            for name, band, i, j, blocks, rep, copies, block, shingles, sig in zip(*(b.column(c).to_pylist() for c in ("unit", "band", "i", "j", "blocks", "rep", "copies", "block", "shingles", "sig"))):
                if (name, band, i, j, blocks) != key:
                    if unit:
                        close()
                    key, unit = (name, band, i, j, blocks), []
                unit.append((rep, copies, block, shingles, sig))
            if out:
                yield give()
                out = []
        if unit:
            close()
        if out:
            yield give()

    wanted = staged(units_of(reps, groups), "units")
    sizes = wanted.groupBy(F.col("unit").alias("u"), F.col("band").alias("of_band")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")).select(F.xxhash64("u", "of_band").alias("c"), F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = met(wanted.withColumn("name", F.xxhash64("unit", "band")), "name", sizes, "c", "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = staged(placed.select("unit", "band", "blocks", "block", "rep", "copies", "rep_doc", "rep_text"), "candidates")
    text = with_key(docs)
    # The candidates grow with the corpus: texts meet them by a shuffle at every size, never by a broadcast.
    given = text.join(placed.hint("merge"), (F.col("text_key") == F.col("rep_text")) & F.col("doc_id").eqNullSafe(F.col("rep_doc"))).select("unit", "band", "blocks", "block", "rep", "copies", "text")
    payload = given.mapInArrow(describe, "unit long, band int, blocks int, block int, rep long, copies long, shingles binary, sig binary")
    dealt = payload.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    ordered = dealt.repartition("unit", "band", "i", "j").sortWithinPartitions("unit", "band", "i", "j", "rep")
    done = staged(ordered.mapInArrow(units, "rep long, links long, root long, blocks long"), "verified")
    links = done.groupBy("rep").agg(F.sum("links").alias("links"))
    # A group of one block has its classes already; those of several are joined over their units.
    single = done.filter("blocks = 1").select(F.col("rep").alias("r"), F.col("root").alias("label"))
    several = components(done.filter("blocks > 1").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return links, single.union(several.select(F.col("node"), F.col("component")))


def join_near(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``class_id`` (least ``doc_id`` of its class), ``n_links`` (other rows that are
    similar enough), ``copy_id`` and ``n_copies`` (rows with the same shingles)."""
    return classes(docs).select("doc_id", "class_id", "n_links", "copy_id", "n_copies")


def classes(docs: DataFrame) -> DataFrame:
    """:func:`join_near`, and ``text_key`` and ``class_text`` (that of the class's first row): with ids that repeat, a row is told by
    both."""
    rows = described(docs)
    best = F.min(F.struct("doc_id", "text_key", "row_key", "n_shingles", "bands"))
    reps = rows.groupBy("copy").agg(best.alias("x"), F.count(F.lit(1)).alias("copies"))
    reps = staged(reps.select("copy", F.col("x.row_key").alias("rep"), F.col("x.doc_id").alias("rep_doc"), F.col("x.text_key").alias("rep_text"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.bands").alias("bands"), "copies"), "representatives")
    links, labels = verified(docs, reps, candidate_groups(reps))
    labels = labels.select(F.col("r"), "label")
    known = reps.select("copy", "rep", "rep_doc", "rep_text", "copies")
    joined = known.join(labels.hint("merge"), F.col("rep") == F.col("r"), "left").drop("r").withColumn("label", F.coalesce("label", "rep"))
    names = joined.groupBy(F.col("label").alias("l")).agg(F.min(F.struct("rep_doc", "rep_text")).alias("first"))
    joined = met(joined, "label", names, "l", "rep").join(links.withColumnRenamed("rep", "k").hint("merge"), F.col("rep") == F.col("k"), "left")
    joined = joined.select(F.col("copy").alias("c"), F.col("first.rep_doc").alias("class_id"), F.col("first.rep_text").alias("class_text"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("rep_doc").alias("copy_id"), F.col("copies").alias("n_copies"))
    each = met(rows.select("row_key", "doc_id", "text_key", "copy"), "copy", joined, "c", "row_key")
    return each.select("doc_id", "text_key", "class_id", "class_text", "n_links", "copy_id", "n_copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near(table(spark, sf_dir, "documents"))
