"""Operator 13, substring dedup by De Bruijn compaction.

A word is removed if a window of ``SPAN`` words that covers it stands in a document with a smaller id as well. Windows are judged
exactly and on the whole input, but only few of them become rows:

1. *Nodes and edges*: of the token k-mers (``NODE`` words) inside a window the one with the least hash is the window's node. The
   windows in a row that have the same node are an edge of the graph, told by its node and a hash of all its words; about one edge
   for 20 words. Equal passages have equal edges, but for those at their ends.
2. *Repeated edges*: nodes that stand in two documents at least are found by their least and greatest document, and only their
   edges go on. Each distinct edge has its first occurrence for a source: document, text and place.
3. *Compaction*: an edge that is always followed by one other, which always follows it, does not branch; these links are found by a
   join of the edges with their successors, and a run of linked edges is one path along its source. A document has one row for
   a path that it holds, however long.
4. *Verification*: a path's words are fingerprinted at its source and at each copy, by their coordinates, and a copy goes if the two
   agree.
5. *Branching nodes*: where a node has more than one edge, windows of two edges may be equal though the edges are not (where passages
   end, where copies differ). The windows of each distinct edge's first document, no others, become rows of their own, and those
   that stand in a smaller document go. The smallest document of a window is among them: no edge of it there is a copy.

Every shuffle is by hash of node, edge, window or document; what one key gathers is a least and a greatest value, or the marks of one
document. A passage that a third of all documents share is one path and one row a document. Whatever grows with the corpus meets by a
shuffle at every size: Spark counts what is spread over salts as if it were not, and would send it through the driver.

Defined cases: null texts, empty ones and those of fewer words than a window keep all words; documents are told by id and text, so
that repeated rows get the same result each, and rows that share an id remove nothing from each other; a null id counts as greater
than all others; other columns are ignored; an empty table gives no rows. A long text is hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import kept, staged, table

SPAN = 50  #: words of a window
NODE = 12  #: words of a k-mer that can be a node
PIECE = 1 << 20  #: bytes whose words are hashed at a time
WORDS = 1 << 18  #: words whose windows are looked at at a time
SALTS = 64  #: tasks over which the edges of one node are spread
LAST_ID = (1 << 63) - 1  #: stands for a null id

#: Odd multipliers of the rolling hashes: of bytes in a word, of words in a node, of words in an edge or window (two).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@kept
def powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The powers of every base and of its inverse modulo 2^64."""

    def upto(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return [(upto(b), upto(pow(b, -1, 1 << 64))) for b in BASES]


class Rolling:
    """Hashes of any ranges of a sequence, from one running sum."""

    def __init__(self, values: np.ndarray, base: int):
        size = 1 << max(20, len(values).bit_length())
        self.power, self.inverse = powers(size)[base]
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word; a long text is cut between words."""
    out, at = [], 0
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else _cut(data, at + PIECE)
        part = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~_blank[part]
        step = np.diff(inside)
        start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(start):
            h = Rolling(part.astype(np.uint64) + np.uint64(1), 0).of(start, stop)
            out.append(mixed(h ^ ((stop - start).astype(np.uint64) * np.uint64(BASES[1]))))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _cut(data: bytes, at: int) -> int:
    """The first place from ``at`` on that is between words."""
    found = min((k for k in (data.find(b" ", at), data.find(b"\n", at)) if k >= 0), default=len(data))
    return found


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` neighbours the place of the first least one."""
    at, size = np.arange(len(values)), 1
    while 2 * size <= width:
        left, right = at[:-size], at[size:]
        at, size = np.where(values[right] < values[left], right, left), 2 * size
    if rest := width - size:
        left, right = at[:-rest], at[rest:]
        at = np.where(values[right] < values[left], right, left)
    return at


def edges_of(words: np.ndarray, segments: list[tuple[int, int]]) -> dict[str, np.ndarray]:
    """The edges of segments (start, end) of a row of words: segment, node, edge hash, first and last window, neighbours' hashes."""
    n = len(words)
    names = ("segment", "node", "edge", "lo", "hi", "next", "prev")
    if n < SPAN:
        return {k: np.zeros(0, np.int64) for k in names}
    at = np.arange(n - NODE + 1)
    node = mixed(Rolling(words, 1).of(at, at + NODE))
    least = least_places(node, SPAN - NODE + 1)
    belongs = np.repeat(np.arange(len(segments)), [b - a for a, b in segments])
    window = np.flatnonzero(belongs[: n - SPAN + 1] == belongs[SPAN - 1 :])
    if not len(window):
        return {k: np.zeros(0, np.int64) for k in names}
    place = least[window]
    fresh = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)])
    lo, hi, place = window[fresh], window[np.r_[fresh[1:] - 1, len(window) - 1]], place[fresh]
    shape = ((place - lo) * 1024 + (hi - lo)).astype(np.uint64)
    edge = mixed(Rolling(words, 2).of(lo, hi + SPAN) ^ (shape * np.uint64(BASES[3])))
    met = hi[:-1] + 1 == lo[1:]
    nothing = np.zeros(1, np.int64)
    follows, leads = np.r_[met, False], np.r_[False, met]
    edge = edge.view(np.int64)
    return {"segment": belongs[lo], "node": node[place].view(np.int64), "edge": edge, "lo": lo, "hi": hi, "next": np.ma.array(np.r_[edge[1:], nothing], mask=~follows), "prev": np.ma.array(np.r_[nothing, edge[:-1]], mask=~leads)}


def _segments(count: int) -> list[tuple[int, int]]:
    """Parts of a document that hold each of its windows once."""
    return [(a, min(count, a + WORDS + SPAN - 1)) for a in range(0, max(1, count - SPAN + 1), WORDS)]


def document_edges(datas: list[bytes]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Edges of many texts, some at a time: index of the text, and its edges with places counted in its own words."""
    held, size = [], 0
    for k, data in enumerate(datas):
        words = word_hashes(data)
        if len(words) < SPAN:
            continue
        for a, b in _segments(len(words)):
            held.append((k, a, words[a:b]))
            size += b - a
            if size >= WORDS:
                yield _edges(held)
                held, size = [], 0
    if held:
        yield _edges(held)


def _edges(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    ends = np.cumsum([len(w) for _, _, w in held])
    starts = ends - [len(w) for _, _, w in held]
    found = edges_of(np.concatenate([w for _, _, w in held]), list(zip(starts.tolist(), ends.tolist())))
    segment = found.pop("segment")
    shift = np.array([a for _, a, _ in held])[segment] - starts[segment]
    return np.array([k for k, _, _ in held])[segment], found | {"lo": found["lo"] + shift, "hi": found["hi"] + shift}


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``owner`` (the id that counts), ``body`` (hash of the text) and ``data`` (its bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("owner"), F.xxhash64(text).alias("body"), text.cast("binary").alias("data"))


def _arrow(values: np.ndarray) -> pa.Array:
    if isinstance(values, np.ma.MaskedArray):
        return pa.array(values.data, mask=values.mask)
    return pa.array(values, pa.int64())


def nodes(docs: DataFrame) -> DataFrame:
    """``node, owner``, one row an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner = b.column("owner").to_numpy()
            for of, found in document_edges(b.column("data").to_pylist()):
                yield pa.record_batch([_arrow(found["node"]), _arrow(owner[of])], names=["node", "owner"])

    return docs.select("owner", "data").mapInArrow(run, "node long, owner long")


def occurrences(docs: DataFrame) -> DataFrame:
    """Every edge of every document: ``node, edge, owner, body, lo, hi, next, prev``; places are numbers of words."""
    names = ["node", "edge", "owner", "body", "lo", "hi", "next", "prev"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = {c: b.column(c).to_numpy() for c in ("owner", "body")}
            for of, found in document_edges(b.column("data").to_pylist()):
                rows = found | {c: v[of] for c, v in keys.items()}
                yield pa.record_batch([_arrow(rows[c]) for c in names], names=names)

    return docs.select("owner", "body", "data").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def repeated(docs: DataFrame) -> DataFrame:
    """The occurrences of nodes that two documents at least hold."""
    both = nodes(docs).groupBy("node").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).filter("a < b").select("node")
    # Written down, the few repeated nodes meet the edges in a join of two exchanges, whose large partitions Spark splits.
    return occurrences(docs).join(staged(both, "nodes").hint("merge"), "node", "left_semi")


SOURCE = ("s_owner", "s_body", "s_lo")


def distinct_edges(found: DataFrame) -> DataFrame:
    """Each edge once: its source (the first occurrence), its windows, whether it is in two documents, and its only neighbours."""

    def only(c: str) -> Column:
        return F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(c)

    each = found.groupBy("node", "edge").agg(F.min(F.struct("owner", "body", "lo")).alias("s"), F.min(F.col("hi") - F.col("lo") + 1).alias("windows"), F.count(F.lit(1)).alias("n"), (F.min("owner") < F.max("owner")).alias("shared"), only("next"), only("prev"))
    return each.select("node", "edge", F.col("s.owner").alias("s_owner"), F.col("s.body").alias("s_body"), F.col("s.lo").alias("s_lo"), "windows", "n", "shared", "next", "prev")


def paths(edges: DataFrame) -> DataFrame:
    """Nonbranching paths of shared edges by their first edge: ``node, edge``, source and ``words``.

    An edge goes on with another if each is the other's only neighbour; the two then stand side by side in their source, where runs
    of linked edges are told by running counts.
    """
    shared = edges.filter("shared")
    before = shared.filter("next is not null").select(F.col("edge").alias("b_edge"), F.col("next").alias("b_next"), F.col("n").alias("b_n"), F.col("s_owner").alias("b_owner"), F.col("s_body").alias("b_body"), (F.col("s_lo") + F.col("windows")).alias("b_end"))
    link = (F.col("prev") == F.col("b_edge")) & (F.col("edge") == F.col("b_next")) & (F.col("n") == F.col("b_n")) & (F.col("s_owner") == F.col("b_owner")) & (F.col("s_body") == F.col("b_body")) & (F.col("s_lo") == F.col("b_end"))
    linked = shared.join(before.hint("merge"), link, "left")
    along = Window.partitionBy("s_owner", "s_body").orderBy("s_lo")
    numbered = linked.withColumn("path", F.sum(F.col("b_edge").isNull().cast("int")).over(along))
    each = numbered.groupBy("s_owner", "s_body", "path").agg(F.min(F.struct("s_lo", "node", "edge")).alias("first"), F.max(F.col("s_lo") + F.col("windows")).alias("end"))
    return each.select("first.node", "first.edge", (F.col("end") - F.col("first.s_lo") + SPAN - 1).alias("words"))


MARK = "struct<kind:string,lo:long,hi:long,s_owner:long,s_body:long,s_lo:long>"


def marks(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``owner, body, marks``: of each document the paths that it holds (``copy``) or is the source of (``source``), as ranges of words,
    and the edges whose windows have to be looked at one by one (``open``), as ranges of windows."""
    many = edges.groupBy("node").agg((F.min("edge") < F.max("edge")).alias("branching")).filter("branching")
    # A node may have very many edges: they are spread over salts where they meet its one row.
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = edges.select("node", "edge", *SOURCE, F.pmod(F.xxhash64("edge"), F.lit(SALTS)).cast("int").alias("salt"))
    known = salted.join(many.hint("merge"), ["node", "salt"], "left").drop("salt").join(paths(edges).hint("merge"), ["node", "edge"], "left").filter("words is not null or branching")
    whole = F.struct(F.col("lo"), (F.col("lo") + F.col("words")).alias("hi"), *SOURCE)
    source = (F.col("owner") == F.col("s_owner")) & (F.col("body") == F.col("s_body")) & (F.col("lo") == F.col("s_lo"))

    def mark(kind: str, span: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), span["lo"].alias("lo"), span["hi"].alias("hi"), *SOURCE)

    every = F.array_compact(
        F.array(
            F.when(F.col("words").isNotNull() & (F.col("owner") > F.col("s_owner")), mark("copy", whole)),
            F.when(F.col("words").isNotNull() & source, mark("source", whole)),
            F.when(F.col("branching") & (F.col("owner") == F.col("s_owner")), mark("open", F.struct("lo", "hi"))),
        )
    )
    # Written down for the same reason as the repeated nodes: an edge may occur very often.
    each = found.select("node", "edge", "owner", "body", "lo", "hi").join(staged(known, "known").hint("merge"), ["node", "edge"]).select("owner", "body", F.explode(every).alias("mark"))
    return each.groupBy("owner", "body").agg(F.collect_set("mark").alias("marks"))


def hex_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def settled(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Every document: its digest where nothing of it is in question, else its bytes and marks."""
    names = ["doc_id", "owner", "body", "marks", "data", "n_words", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            open_ = b.column("marks").is_valid().to_pylist()
            split = [x.split() for x in b.column("data").to_pylist()]
            data = pa.array([x.as_py() if o else None for o, x in zip(open_, b.column("data"))], pa.binary())
            sha = pa.array([None if o else hex_of(w) for o, w in zip(open_, split)], pa.string())
            yield pa.record_batch([*(b.column(c) for c in names[:4]), data, pa.array([len(w) for w in split], pa.int64()), sha], names=names)

    joined = docs.join(marked.hint("merge"), ["owner", "body"], "left").select("doc_id", "owner", "body", "marks", "data")
    return joined.mapInArrow(run, f"doc_id long, owner long, body long, marks array<{MARK}>, data binary, n_words long, kept_sha256 string")


def _signed(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def fingerprints(open_docs: DataFrame) -> DataFrame:
    """A 128-bit digest of the words of every path, at its copies and at its source."""
    names = ["kind", "owner", "body", "lo", "hi", *SOURCE, "f1", "f2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for owner, body, found, data in zip(*(b.column(c).to_pylist() for c in ("owner", "body", "marks", "data"))):
                if wanted := [m for m in found if m["kind"] != "open"]:
                    words = data.split()
                    rows += [(m["kind"], owner, body, m["lo"], m["hi"], *(m[c] for c in SOURCE), *_signed(hashlib.blake2b(b" ".join(words[m["lo"] : m["hi"]]), digest_size=16).digest())) for m in wanted]
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=names)

    return open_docs.select("owner", "body", "marks", "data").mapInArrow(run, "kind string, " + ", ".join(f"{c} long" for c in names[1:]))


def open_windows(open_docs: DataFrame) -> DataFrame:
    """``w1, w2`` (a 128-bit hash), ``owner, body, lo`` of every window of the open edges."""
    names = ["w1", "w2", "owner", "body", "lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for owner, body, found, data in zip(*(b.column(c).to_pylist() for c in ("owner", "body", "marks", "data"))):
                if wanted := [np.arange(m["lo"], m["hi"] + 1) for m in found if m["kind"] == "open"]:
                    lo, words = np.unique(np.concatenate(wanted)), word_hashes(data)
                    for k in range(0, len(lo), WORDS):
                        part = lo[k : k + WORDS]
                        near = words[part[0] : part[-1] + SPAN]
                        at = part - part[0]
                        hashes = [mixed(Rolling(near, base).of(at, at + SPAN)).view(np.int64) for base in (2, 3)]
                        yield pa.record_batch([*map(_arrow, hashes), _arrow(np.full(len(part), owner)), _arrow(np.full(len(part), body)), _arrow(part)], names=names)

    return open_docs.select("owner", "body", "marks", "data").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def removable(open_docs: DataFrame) -> DataFrame:
    """``owner, body, spans``: the ranges of words that stand in a document of a smaller id too."""
    checked = fingerprints(open_docs)
    sources = checked.filter("kind = 'source'").select(*SOURCE, "f1", "f2")
    copies = checked.filter("kind = 'copy'").join(sources.hint("merge"), [*SOURCE, "f1", "f2"], "left_semi").select("owner", "body", "lo", "hi")
    windows = open_windows(open_docs)
    first = windows.groupBy("w1", "w2").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).filter("a < b")
    again = windows.join(staged(first, "windows").hint("merge"), ["w1", "w2"]).filter("owner > a").select("owner", "body", "lo", (F.col("lo") + SPAN).alias("hi"))
    return copies.unionByName(again).groupBy("owner", "body").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def left_over(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    """The words that no span covers."""
    if not spans:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, [s["lo"] for s in spans], 1)
    np.add.at(step, [s["hi"] for s in spans], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document; ``with_text``: the kept words too, joined by single spaces."""
    given = keyed(docs)
    found = staged(repeated(given), "repeated")
    edges = staged(distinct_edges(found), "edges")
    every = staged(settled(given, marks(found, edges)), "settled")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, data, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "data", "spans"))):
                words = data.split()
                left = left_over(words, spans)
                rows.append((doc_id, len(words), len(words) - len(left), hex_of(left), b" ".join(left)))
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t, _ in zip(zip(*rows), types, names)], names=names)

    in_question = every.filter(F.col("data").isNotNull())
    joined = in_question.join(removable(in_question).hint("merge"), ["owner", "body"], "left").select("doc_id", "data", "spans")
    judged = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text)
    if with_text:
        whole = given.join(every.filter(F.col("data").isNull()).select("owner", "body").distinct().hint("merge"), ["owner", "body"], "left_semi")
        return judged.unionByName(whole.withColumn("spans", F.lit(None).cast("array<struct<lo:long,hi:long>>")).select("doc_id", "data", "spans").mapInArrow(run, judged.schema)).withColumn("kept", F.col("kept").cast("string"))
    untouched = every.filter(F.col("data").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return judged.unionByName(untouched)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, len(w) AS n, w FROM d),
h AS (SELECT doc_id, i, word, CASE WHEN i + 49 <= n THEN md5(array_to_string(w[i : i + 49], ' ')) END AS m FROM x),
r AS (SELECT doc_id, i, word, m IS NOT NULL AND min(doc_id) OVER (PARTITION BY m) < doc_id AS again FROM h),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
