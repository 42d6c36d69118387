"""Operator 6, secret scanning with corpus-wide ownership frequency.

Every whole text is scanned for candidates: the three base patterns, and further shapes of credentials. The value of each
candidate is hashed, and over the whole corpus the distinct repositories and owners of each hash are counted. A value that
many owners hold is an example that was copied around (documentation keys, sample tokens); a value that stays with few
owners and looks random is taken for live. Base spans always stay; a further span is added only where its value is live.

The counts are made of distinct (hash, repository, owner) rows, pre-aggregated in each task, so a sample that a third of the
corpus copies costs a row a task. Only hashes that are widely copied go back to the candidates, spread over salts.

Runs of any length are matched whole; every pattern begins where its run begins, so that a long text is read in linear time.

Defined cases: a null or empty text has no spans (digest of the empty string); a null owner or repository counts as one of
its own; repeated rows each get their row, and rows that share an id (or have none) are each judged by their own text; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_spans, sha256_hex, staged, table

KINDS = {"assign": 0, "access": 1, "hex": 2, "vendor": 3, "jwt": 4, "pem": 5, "url": 6, "bearer": 7, "entropy": 8}
BASE = ("assign", "access", "hex")
SALTS = 16

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# The public shapes of credentials, by a literal that each must hold.
SHAPES: list[tuple[str, str, re.Pattern]] = [
    ("vendor", "gh", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{20,})")),
    ("vendor", "github_pat_", re.compile(r"github_pat_([A-Za-z0-9_]{22,})")),
    ("vendor", "glpat-", re.compile(r"glpat-([A-Za-z0-9_-]{16,})")),
    ("vendor", "xox", re.compile(r"(?<![A-Za-z0-9])xox[abeprs]-([A-Za-z0-9-]{10,})")),
    ("vendor", "sk", re.compile(r"(?<![A-Za-z0-9])sk[-_]([A-Za-z0-9_-]{20,})")),
    ("vendor", "AIza", re.compile(r"AIza([0-9A-Za-z_-]{30,})")),
    ("vendor", "ASIA", re.compile(r"(?<![A-Z0-9])ASIA([A-Z0-9]{12,})")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    ("pem", "PRIVATE KEY", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")),
    ("url", "://", re.compile(r"(?<=://)[^\s:/@]+:([^\s:/@]{6,})@")),
    ("bearer", "earer ", re.compile(r"[Bb]earer ([A-Za-z0-9+/_.=-]{20,})")),
]
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])([A-Za-z0-9+/_=-]{24,})")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str) -> bool:
    """Random-looking: enough distinct characters, digits among them, and no filler word."""
    low = value.lower()
    if any(w in low for w in ("example", "changeme", "placeholder", "dummy", "sample", "xxxx", "your", "123456", "test")):
        return False
    return any(c.isdigit() for c in value) and entropy(value) >= (3.0 if len(value) >= 16 else 2.5)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, range and value of the base finds: leftmost, non-overlapping per kind; failing matches are dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    out += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return out


def further_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Candidates of other shapes that no base span and no earlier shape covers, and whose value looks random."""
    out: list[tuple[str, int, int, str]] = []
    found = [(kind, m.start(), m.end(), m[1]) for kind, hint, shape in SHAPES if hint in text for m in shape.finditer(text)]
    found += [("entropy", m.start(), m.end(), m[1]) for m in LONG.finditer(text) if mixed(m[1])]
    # Places that are taken, as disjoint ranges in order.
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b, _ in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind, a, b, value in found:
        if kind != "pem" and not looks_live(value):
            continue
        at = bisect_right(ends, a)  # the first range that ends behind a
        if at == len(starts) or starts[at] >= b:
            out.append((kind, a, b, value))
            starts.insert(at, a)
            ends.insert(at, b)
    return out


def mixed(value: str) -> bool:
    """Upper, lower and digits, at the entropy of a random string."""
    return any(c.isdigit() for c in value) and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value) and entropy(value) >= 4.0


ROW = "row_key long, doc_id long, text_key long, owner string, repo string, found array<struct<kind:string,a:int,b:int,hash:string,live:boolean>>"


def candidates(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    """Every document with its candidates, written to the shared folder: the counts and the join both read it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        kind = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())]))
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                rows.append([{"kind": k, "a": s, "b": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "live": k == "pem" or looks_live(v)} for k, s, e, v in base + further_spans(text, base)])
            yield pa.record_batch([pa.array(range(key, key + len(rows)), pa.int64()), b.column("doc_id"), b.column("text_key"), b.column("owner"), b.column("repo"), pa.array(rows, kind)], names=["row_key", "doc_id", "text_key", "owner", "repo", "found"])
            key += len(rows)

    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"))
    return staged(given.mapInArrow(run, ROW), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """``hash``, ``n_repos`` and ``n_owners`` of every candidate value of the corpus."""
    each = found.select(F.explode("found.hash").alias("hash"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"))
    distinct = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("copies"))
    # Of distinct rows, at most one a repository: counting distinct owners by a second grouping keeps it in two exchanges.
    by_owner = distinct.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("copies").alias("copies"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("copies").alias("n_copies"))


def verdicts(docs: DataFrame, owner: str, repo: str, max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """Each row with its spans and whether each is ``live`` (few owners, random) or an example.

    ``max_owners`` and ``max_repos``: a value that more hold is widely copied.
    """
    found = candidates(docs, owner, repo)
    copied = ownership(found).filter((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)).select(F.col("hash").alias("copied"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_of"))
    span = found.select("row_key", F.explode("found").alias("s"), F.pmod("row_key", F.lit(SALTS)).cast("int").alias("salt"))
    judged = span.join(copied, (span["s.hash"] == copied["copied"]) & (span["salt"] == copied["salt_of"]), "left")
    entry = F.struct(F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.kind").alias("kind"), (F.col("s.live") & F.col("copied").isNull()).alias("live"))
    by_row = judged.groupBy(F.col("row_key").alias("key")).agg(F.array_sort(F.collect_list(entry)).alias("spans"))
    return found.select("row_key", "doc_id", "text_key").join(by_row, F.col("row_key") == F.col("key"), "left").select("row_key", "doc_id", "text_key", F.coalesce("spans", F.expr("array()").cast(by_row.schema["spans"].dataType)).alias("spans"))


def digest(judged: DataFrame) -> DataFrame:
    """The counts, digests and span lists of the rows of :func:`verdicts`."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in range(7)]
            for spans in b.column("spans").to_pylist():
                base = [(s["kind"], s["a"], s["b"]) for s in spans if s["kind"] in BASE]
                added = [(s["kind"], s["a"], s["b"]) for s in spans if s["kind"] not in BASE and s["live"]]
                n = Counter(k for k, _, _ in base)
                row = [*(n[k] for k in BASE), sha256_hex(join_spans(base, KINDS)), join_spans(base + added, KINDS), sum(s["live"] for s in spans), sum(not s["live"] for s in spans)]
                for column, x in zip(columns, row):
                    column.append(x)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, columns, kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example"])

    return judged.select("doc_id", "spans").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_example long")


def redact(docs: DataFrame, judged: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live span replaced by ``mark``; other documents stay as they are, and none is dropped.

    A row is known by its id and its text: rows that share an id, or have none, each lose the spans of their own text alone, and
    equal texts have equal spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    live = judged.select(F.col("doc_id").alias("__key"), F.col("text_key").alias("__text"), F.expr("filter(spans, s -> s.live)").alias("__live")).filter(F.size("__live") > 0)
    live = live.dropDuplicates(["__key", "__text"])
    # Pieces between the spans, folded from left to right: what is kept so far and where the next piece begins.
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    fold = F.aggregate("__live", start, lambda acc, s: F.when(s["a"] < acc["at"], F.struct(acc["kept"].alias("kept"), F.greatest(acc["at"], s["b"]).alias("at"))).otherwise(F.struct(F.concat(acc["kept"], F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit(mark)).alias("kept"), s["b"].alias("at"))), lambda acc: F.concat(acc["kept"], F.substring(text, acc["at"] + 1, F.length(text))))
    joined = docs.join(live, (F.xxhash64(text) == F.col("__text")) & F.col("doc_id").eqNullSafe(F.col("__key")), "left")
    changed = joined.withColumn("text", F.when(F.col("__live").isNull(), F.col("text")).otherwise(fold))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("__live").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` stands for the owner, ``source`` with ``lang`` for the repository."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repo"))
    return digest(verdicts(docs, "source", "repo"))
