"""Operator 12, source divergence audit by two-dimensional tiling of group blocks.

A group is a source of a language. How far its words are from those of every other source of that language, and which words it
uses more than the language does, are told in exact whole numbers: ``p = 1 + floor(10^9 (count + 1) / (N + V))`` of every kept
term, ``f = floor((p - q)^2 / q)``, summed over the terms.

1. *Counts*: tasks count terms of their own documents by (language, source, term) first, so a term that every document holds is a
   few rows of the shuffle. Terms of at least ``MIN_DOCS`` documents of their language are kept and numbered inside vocabulary
   chunks of a bounded size.
2. *Packing*: the counts of a block of ``BLOCK`` groups in one chunk are one packed row: slots and counts, no zeros.
3. *Tiling*: every packed row goes to the tiles of its block with each block of its language, so that a tile (block by block by
   range of chunks) is a task's unit of its own. It reads chunk after chunk and adds up the submatrix of its pairs in both
   directions; two chunks are all that it holds. Terms that neither block has are counted, not stored: they all have the same
   value in a pair.
4. Submatrices of ranges are added up, turned into one row a pair (the result itself), and ranked.

No task holds a whole vocabulary, a language or a source: a source that has a third of all documents is one line of a block.

Defined cases: null ``text``, ``lang`` and ``source`` are empty strings; repeated rows are documents of their own; a group whose
texts have no words takes part with counts of 0; a language without kept terms has distances of 0; other columns are ignored; an
empty table gives no rows. Whole numbers are exact while ``N + V`` of a group is below 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import staged, table

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
BLOCK = 16  #: groups of a block, about
CHUNK = 1024  #: terms of a vocabulary chunk, about
RANGE = 32  #: successive chunks of one tile
SALTS = 16  #: tasks over which the rows of one language are spread where they meet its one row
DISTINCT = 300_000  #: counted entries that a task holds before it passes them on
PIECE = 1 << 20  #: bytes of a text that are split at a time

#: Bytes between words become spaces, A-Z become lower case; every byte of other letters stays.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in UTF-8; a long one is split piece by piece, between words."""
    plain, at = data.translate(BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE) if len(plain) > at + PIECE else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n`` (occurrences), ``df`` (documents), one row or more each; a null term for every group that occurs."""
    names = ["lang", "source", "term", "n", "df"]

    def rows(lang: str, source: str, n: Counter, df: Counter) -> Iterator[pa.RecordBatch]:
        terms = [None, *n]
        for k in range(0, len(terms), 50_000):
            some = terms[k : k + 50_000]
            counts = [pa.array([c.get(t, 0) for t in some], pa.int64()) for c in (n, df)]
            yield pa.record_batch([pa.repeat(lang, len(some)), pa.repeat(source, len(some)), pa.array(some, pa.binary()), *counts], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in total.items():
                yield from rows(lang, source, n, df)
            total.clear()

        for b in batches:
            for lang, source, data in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("data")):
                n, df = total.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in terms_of(data.as_py()):
                    n.update(terms)
                    own.update(terms)
                df.update(own)
                held += len(n) - before
                if held > DISTINCT:
                    yield from flush()
                    held = 0
        yield from flush()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    given = docs.select(*blank, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    found = given.mapInArrow(run, "lang string, source string, term binary, n long, df long").withColumn("term", F.col("term").cast("string"))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SCALE (count + 1) / (n + v))`` by long division, three digits at a time: no step leaves 64 bits."""
    out, left = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + F.call_function("div", left, n + v), left % (n + v)
    return out + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """:func:`share` of a block's dense counts, a line a group."""
    whole = (n + v)[:, None]
    out, left = np.zeros_like(counts), counts + 1
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return out + 1


def beside(rows: DataFrame, few: DataFrame, on: str, by: str) -> DataFrame:
    """``rows`` with the one row that ``few`` has for each value of ``on``; the rows of one value are spread over salts."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [on, "salt"]).drop("salt")


def ceil_div(a: Column, b: int) -> Column:
    return F.greatest(F.ceil(a / b), F.lit(1)).cast("int")


def vocabulary(counts: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """``lang, term, total, chunk, slot`` of the kept terms, and ``lang, v, n_lang`` of every language that occurs."""
    terms = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).filter(F.col("df") >= min_docs).drop("df")
    terms = staged(terms, "terms")
    sums = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    every = counts.select("lang").distinct().join(sums, "lang", "left").na.fill(0)
    chunk = F.pmod(F.xxhash64("term"), ceil_div(F.col("v"), CHUNK)).cast("int")
    placed = beside(terms, sums, "lang", "term").withColumn("chunk", chunk)
    slot = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    return placed.select("lang", "term", "total", "chunk", slot.alias("slot")), every


def grouped(counts: DataFrame, kept: DataFrame, languages: DataFrame) -> DataFrame:
    """``lang, source, n_group, v, n_lang, blocks, block, line`` of every group; ``line`` is its place in its block."""
    every = counts.filter(F.col("term").isNull()).select("lang", "source")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    sizes = languages.join(every.groupBy("lang").agg(F.count(F.lit(1)).alias("g")), "lang")
    groups = beside(every.join(sums, ["lang", "source"], "left").na.fill(0, ["n_group"]), sizes, "lang", "source")
    groups = groups.withColumn("blocks", ceil_div(F.col("g"), BLOCK)).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    return groups.withColumn("line", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1).drop("g")


ENTRY = np.dtype([("line", "<i4"), ("slot", "<i4"), ("n", "<i8")])


def packed(placed: DataFrame) -> DataFrame:
    """One row for each block and chunk, its counts as bytes: line, slot and count of every pair that occurs."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        made = np.empty(rows.num_rows, ENTRY)
        for c in ENTRY.names:
            made[c] = rows.column(c).to_numpy()
        return pa.table({"lang": [key[0]], "block": pa.array([key[1]], pa.int32()), "blocks": pa.array([rows.column("blocks")[0].as_py()], pa.int32()), "chunk": pa.array([key[2]], pa.int32()), "packed": [made.tobytes()]})

    given = placed.select("lang", "block", "chunk", "blocks", "line", "slot", "n")
    return given.groupBy("lang", "block", "chunk").applyInArrow(pack, "lang string, block int, blocks int, chunk int, packed binary")


def dealt(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Packed rows, and a head for each block (its groups and sums), sent to all the tiles that they take part in."""
    heads = groups.groupBy("lang", "block", "blocks", "v").agg(F.array_sort(F.collect_list(F.struct("line", "source", "n_group"))).alias("lines"))
    parts = ceil_div(ceil_div(F.col("v"), CHUNK), RANGE)
    heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    heads = heads.select("lang", "block", "blocks", "part", F.lit(-1).alias("chunk"), F.lit(None).cast("binary").alias("packed"), "v", F.col("lines.source").alias("sources"), F.col("lines.n_group").alias("sums"))
    rows = vectors.withColumn("part", F.floor(F.col("chunk") / RANGE).cast("int")).select("lang", "block", "blocks", "part", "chunk", "packed")
    both = heads.unionByName(rows, allowMissingColumns=True).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.select("lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "part", "chunk", (F.col("block") > F.col("other")).cast("int").alias("side"), "packed", "v", "sources", "sums")


class Tile:
    """The sums of one block against another, both ways, while the chunks of its range go by."""

    def __init__(self, key: tuple):
        self.key, self.heads, self.chunk, self.held, self.v = key, {}, None, {}, 0

    def head(self, side: int, row: dict) -> None:
        self.v = row["v"]
        self.heads[side] = row["sources"], np.array(row["sums"], np.int64)

    def begin(self) -> None:
        nobody = [], np.zeros(0, np.int64)  # no group's hash fell into that block
        for side in (0, 1):
            self.heads.setdefault(side, self.heads.get(0, nobody) if self.key[1] == self.key[2] else nobody)
        n = [self.heads[k][1] for k in (0, 1)]
        self.sums = [np.zeros((len(n[0]), len(n[1])), np.int64), np.zeros((len(n[1]), len(n[0])), np.int64)]
        if self.v:
            none = [shares(np.zeros((len(k), 1), np.int64), k, self.v) for k in n]
            self.absent = [(none[k] - none[1 - k].T) ** 2 // none[1 - k].T for k in (0, 1)]
            if not self.key[3]:  # the first range answers for all terms that neither block has
                self.sums = [self.v * f for f in self.absent]

    def add(self, chunk: int, side: int, data: bytes) -> None:
        if self.chunk is None:
            self.begin()
        if chunk != self.chunk:
            self.close_chunk()
            self.chunk = chunk
        self.held[side] = np.frombuffer(data, ENTRY)

    def close_chunk(self) -> None:
        if not self.held:
            return
        slots = np.unique(np.concatenate([e["slot"] for e in self.held.values()]))
        p = []
        for side in (0, 1):
            n = self.heads[side][1]
            dense = np.zeros((len(n), len(slots)), np.int64)
            entries = self.held.get(0 if self.key[1] == self.key[2] else side)
            if entries is not None:
                dense[entries["line"], np.searchsorted(slots, entries["slot"])] = entries["n"]
            p.append(shares(dense, n, self.v))
        for side in (0, 1):
            own, other = p[side], p[1 - side]
            for g in range(len(own)):
                self.sums[side][g] += ((own[g] - other) ** 2 // other).sum(1)
            self.sums[side] -= len(slots) * self.absent[side]
        self.held = {}

    def close(self) -> dict:
        if self.chunk is None:
            self.begin()
        self.close_chunk()
        lang, x, y, _ = self.key
        return {"lang": lang, "x": x, "y": y, "own": self.heads[0][0], "other": self.heads[1][0], "forth": self.sums[0].tobytes(), "back": self.sums[1].tobytes()}


TILE = pa.schema([("lang", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("own", pa.list_(pa.string())), ("other", pa.list_(pa.string())), ("forth", pa.binary()), ("back", pa.binary())])


def tiles(rows: DataFrame) -> DataFrame:
    """The submatrix of every tile: rows come by tile and chunk, the head first, and go by one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for b in batches:
            done = []
            for row in b.to_pylist():
                key = row["lang"], row["x"], row["y"], row["part"]
                if tile is None or tile.key != key:
                    done += [tile.close()] if tile else []
                    tile = Tile(key)
                if row["chunk"] < 0:
                    tile.head(row["side"], row)
                else:
                    tile.add(row["chunk"], row["side"], row["packed"])
            yield pa.RecordBatch.from_pylist(done, TILE)
        if tile:
            yield pa.RecordBatch.from_pylist([tile.close()], TILE)

    spread = rows.repartition("lang", "x", "y", "part").sortWithinPartitions("lang", "x", "y", "part", "chunk", "side")
    return spread.mapInArrow(run, "lang string, x int, y int, own array<string>, other array<string>, forth binary, back binary")


def distances(found: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of groups: the submatrices of a tile's ranges added up and laid out."""

    def add_up(key: tuple, rows: pa.Table) -> pa.Table:
        own, other = rows.column("own")[0].as_py(), rows.column("other")[0].as_py()
        forth = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("forth")).reshape(len(own), len(other))
        back = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("back")).reshape(len(other), len(own))
        made = [(a, b, int(forth[i, j])) for i, a in enumerate(own) for j, b in enumerate(other) if a != b]
        if key[1] != key[2]:
            made += [(b, a, int(back[j, i])) for j, b in enumerate(other) for i, a in enumerate(own)]
        source, item, value = zip(*made) if made else ((), (), ())
        return pa.table({"lang": pa.array([key[0]] * len(made), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return found.groupBy("lang", "x", "y").applyInArrow(add_up, "lang string, source string, item string, value long")


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    rows = rows.withColumn("rank", rank)
    rows = rows if most is None else rows.filter(F.col("rank") <= most)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair``, every other source of the language, the most different first; part
    ``term``, the ``top`` terms that the source uses more than its language."""
    counts = staged(counted(docs), "counts")
    terms, languages = vocabulary(counts, min_docs)
    kept = staged(counts.filter(F.col("term").isNotNull()).drop("df").join(terms, ["lang", "term"]), "kept")
    groups = staged(grouped(counts, kept, languages), "groups")
    placed = staged(kept.join(groups, ["lang", "source"]), "placed")
    pairs = distances(tiles(dealt(packed(placed), groups)))
    p, q = share(F.col("n"), F.col("n_group"), F.col("v")), share(F.col("total"), F.col("n_lang"), F.col("v"))
    more = placed.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    return ranked(pairs, "pair").unionByName(ranked(more.select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value")), "term", top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT id, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term, count(*) AS total FROM x GROUP BY ALL HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS nl FROM k GROUP BY 1), s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS ng FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 1)) // (ng + v) AS HUGEINT) AS p, CAST(1 + (1000000000 * (CAST(total AS HUGEINT) + 1)) // (nl + v) AS HUGEINT) AS q
  FROM s JOIN l ON l.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
ap AS (SELECT a.lang, a.source, b.source AS item, coalesce(pr.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
t AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM ap
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM t) WHERE rank <= 200"""
