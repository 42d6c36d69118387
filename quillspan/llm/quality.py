"""Operator 8, quality rules with cross-document line frequency. DataFrame functions only.

Base rules are counted inside each document. Besides, lines are normalised (lower case, digits as 0, white space as one
space) and hashed, the distinct documents that hold a line are counted per host, and a line that more than ``max_docs`` of one
host's documents hold is taken for boilerplate. What is left of a document decides the method's verdict: a document is
rejected if the boilerplate takes it below ``min_words`` words or leaves less than ``min_share`` of its words.

A line counts once a document, and each task counts first for itself, so a line that every document holds is a few rows. The
counts that pass the limit go back by (host, line), spread over salts; the text itself is never shuffled.

Defined cases: null and empty texts have no words and fail the base; repeated rows are documents of their own; a null host is
a host; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

SPACE = r"[\x20\x09-\x0D]+"
SALTS = 16
MIN_WORDS = 25  #: words that must be left
MAX_DOCS = 20  #: documents of one host that may hold a line
MIN_SHARE = 0.3  #: of a document's words that must be left


def spaced_words(text: Column) -> Column:
    """Words of a text; one empty word where it has none (see ``n_words``)."""
    return F.split(F.regexp_replace(text, rf"\A{SPACE}|{SPACE}\z", ""), SPACE)


def n_words(words: Column) -> Column:
    return F.when(F.element_at(words, 1) == "", F.lit(0)).otherwise(F.size(words)).cast("long")


def windows(words: Column) -> Column:
    """A 64-bit hash of every three consecutive words."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(hashes, 1, F.greatest(F.lit(0), F.size(words) - 2))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``, the words inside a 3-word window that stands twice or more in the text.

    Texts whose windows all differ, most short ones, need no more. Otherwise the hashes are sorted with their places, so that
    equal windows meet; the places of those that meet a neighbour are laid out in order and their words counted once each.
    """
    df = df.withColumn("windows", windows(F.col("words")))
    df = df.withColumn("placed", F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.col("placed")
    again = F.filter(at, lambda x, k: (x["h"] == F.get(at, k - 1)["h"]) | (x["h"] == F.get(at, k + 1)["h"]))
    df = df.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    counted = F.aggregate("again", start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", F.coalesce(counted, F.lit(0)).cast("long")).drop("windows", "placed", "again")


def measured(docs: DataFrame, host: str) -> DataFrame:
    """Every document with its base counts and its distinct lines (hash and words), written to the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("text")).withColumn("words", spaced_words(F.col("text")))
    df = with_repeats(df)
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    normal = F.transform("lines", lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[0-9]+", "0"), r"\s+", " "))
    entry = F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words")))
    return staged(
        df.select(
            F.monotonically_increasing_id().alias("row_key"),
            "doc_id",
            "host",
            n_words(F.col("words")).alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words",
            entry.alias("lines"),
        ),
        "quality",
    )


def frequent_lines(known: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``host``, ``line`` and ``docs`` of the lines that more than ``max_docs`` documents of a host hold."""
    lines = F.array_distinct(F.transform("lines", lambda x: x["line"]))
    each = known.select(F.coalesce("host", F.lit("\0")).alias("host"), F.explode(lines).alias("line"))
    return each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > max_docs)


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """Base counts, words left after boilerplate lines are taken out, and the verdict on every document."""
    known = measured(docs, host)
    frequent = frequent_lines(known, max_docs).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"))
    each = known.select("row_key", F.coalesce("host", F.lit("\0")).alias("host"), F.pmod("row_key", F.lit(SALTS)).cast("int").alias("salt"), F.inline("lines").alias("line", "line_words"))
    # A line that stands several times in a document is taken out each time.
    removed = each.join(frequent, (F.col("line") == F.col("f_line")) & (F.col("host") == F.col("f_host")) & (F.col("salt") == F.col("f_salt"))).groupBy(F.col("row_key").alias("key")).agg(F.sum("line_words").alias("gone"))
    out = known.drop("lines").join(removed, F.col("row_key") == F.col("key"), "left")
    left = F.greatest(F.lit(0), F.col("n_words") - F.coalesce("gone", F.lit(0)))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("gone").isNotNull() & ((left < min_words) | (left < min_share * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"), left.cast("long").alias("words_left"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("words_left")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT k, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 3)) AS p FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
l AS (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d),
l1 AS (SELECT k, x FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dl AS (SELECT k, count(*) - count(DISTINCT x) AS n FROM l1 GROUP BY 1),
nl AS (SELECT l1.k, coalesce(source, chr(0)) AS host, regexp_replace(regexp_replace(lower(trim(x, ' ')), '[0-9]+', '0', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g') AS y FROM l1 JOIN d ON d.k = l1.k),
nw AS (SELECT k, host, y, len(string_split(y, ' ')) AS n FROM nl),
f AS (SELECT host, y FROM nw GROUP BY 1, 2 HAVING count(DISTINCT k) > 20),
gone AS (SELECT k, sum(n) AS n FROM nw JOIN f ON nw.host = f.host AND nw.y = f.y GROUP BY 1),
o AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, gone.n AS gone
  FROM w LEFT JOIN r ON w.k = r.k LEFT JOIN dl ON w.k = dl.k LEFT JOIN gone ON w.k = gone.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND NOT (gone IS NOT NULL AND (greatest(0, n_words - gone) < 25 OR greatest(0, n_words - gone) < 0.3 * n_words)) AS kept
FROM o
"""
