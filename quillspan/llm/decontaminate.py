"""Operator 2, benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

Words are runs of characters other than ASCII punctuation, space and controls, with A-Z lower-cased. A window is 13
consecutive words of a test item (the whole item where it is shorter).

1. *Index*: one pass over the corpus stores the postings of every test term: document, position, term. The number of a
   document's words is a posting of its own, so no text is read a second time.
2. *Statistics*: the test terms are counted over the whole index.
3. *Anchors*: of every window, the rarest term; windows that overlap share most of their anchors. Beside each anchor stands
   the rarest other term of its windows, with its offset.
4. *Intersection*: the anchors' lists are met with the lists of the second terms, offsets adjusted, wherever both stand in a
   window's reach of each other. Where they do, the lists of all further terms are looked at around the place: the run of
   words that agree with the item through the anchor is measured to both sides. A run of a whole window or more is an exact
   phrase match; every window holds an anchor, so every occurrence is found. Where all words of one of the anchor's windows are
   within a window's reach of it but scattered, it is a proximity match.

Only the test side is ever broadcast, in blocks of ``BROADCAST_ROWS`` rows, each met with all postings: no word is a join key of a
shuffle, however common it is. What grows with the corpus is joined by document and place.

Defined cases: null and empty texts have no words, so nothing is hit and ``contaminated`` is false; an item without words has
no window; a row is known by its id and its text, so that rows which share an id, or have none, each have their own hits, and
repeated rows each get their row; repeated items count once per ``item_id``; items with a null ``item_id`` hit and count as one item
but are left out of the list of items; other columns are ignored; empty tables give no rows, or no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

WINDOW = 13
BROADCAST_ROWS = 200_000  #: rows that are sent to every executor at once
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  #: what separates words before A-Z are lower-cased
SEPARATING = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\0"  #: stands behind a document's last word; no word holds it
END_ID = -1
ROW = ("doc_id", "text_key")  #: what a row of the corpus is known by


def ascii_lower(word: Column) -> Column:
    """A-Z lower-cased, other letters as they are; words of ASCII alone take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def cased_words(text: str) -> Column:
    """The words of a text, in order, before lower-casing."""
    # Ends are trimmed first, so that no empty word arises.
    inner = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SEPARATING))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATORS))


def item_words(items: DataFrame) -> DataFrame:
    """``item_no`` (one for each item row with words), ``item_id`` and ``words``."""
    known = items.select("item_id", F.transform(cased_words("text"), ascii_lower).alias("words")).filter(F.size("words") > 0).distinct()
    return known.withColumn("item_no", F.xxhash64("item_id", F.array_join("words", " ")))


def blocks(df: DataFrame, rows: int) -> list[DataFrame]:
    """``df`` of ``rows`` rows in parts that are small enough to be sent to every executor."""
    n = -(-rows // BROADCAST_ROWS)
    return [F.broadcast(df)] if n <= 1 else [F.broadcast(df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == k)) for k in range(n)]


def renamed(df: DataFrame) -> DataFrame:
    """``df`` as the right side of a join on :func:`same_row`."""
    return df.withColumnsRenamed({"doc_id": "r_doc", "text_key": "r_key"})


def same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("text_key") == F.col("r_key"))


def build_index(docs: DataFrame, vocabulary: DataFrame, rows: int) -> DataFrame:
    """The stored index: ``doc_id, text_key, pos, term`` of every posting of the ``vocabulary(word, term)``.

    A posting of ``END_ID`` stands behind the last word of every row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    given = vocabulary.select(F.col("word").alias("known"), "term")
    last = docs.sparkSession.createDataFrame([(END, END_ID)], given.schema)
    for k, part in enumerate(blocks(given, rows)):
        words = cased_words("text")
        if k == 0:
            words, part = F.concat(words, F.array(F.lit(END))), F.broadcast(part.unionAll(last))
        each = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.posexplode(words).alias("pos", "cased"))
        each = each.withColumn("word", ascii_lower(F.col("cased")))
        parts.append(each.join(part, F.col("word") == F.col("known")).select(*ROW, "pos", "term"))
    return staged(reduce(DataFrame.unionAll, parts), "postings")


def anchors(positions: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The test positions that are looked up: of every window its rarest term (the first of equals).

    ``item_no, at, term``, ``low`` and ``high`` (starts of its first and last window), and ``second`` with its ``offset`` from the
    anchor: the rarest other position that all of the windows anchored here share (the anchor itself where there is none).
    """
    known = positions.join(counts, "term").select("item_no", "span", "at", "term", "postings")
    first = F.greatest(F.lit(0), F.col("at") - (window - 1))
    last = F.least(F.col("at"), F.greatest(F.lit(0), F.col("span") - window))
    # A position takes part in the windows that start from first to last.
    of = known.select("item_no", F.explode(F.sequence(first, last)).alias("start"), "at", "postings")
    best = of.groupBy("item_no", "start").agg(F.min(F.struct("postings", "at")).alias("best"))
    chosen = best.groupBy("item_no", F.col("best.at").alias("anchor")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    near = chosen.join(known, "item_no").filter((F.col("at") != F.col("anchor")) & (F.col("at") >= F.col("high")) & (F.col("at") < F.least("span", F.col("low") + window)))
    second = near.groupBy("item_no", "anchor").agg(F.min(F.struct("postings", "at", "term")).alias("second"))
    out = chosen.join(second, ["item_no", "anchor"], "left").join(known.drop("postings", "span"), "item_no").filter(F.col("at") == F.col("anchor"))
    return out.select("item_no", "at", "term", "low", "high", F.coalesce(F.col("second.at") - F.col("at"), F.lit(0)).alias("offset"), F.coalesce("second.term", "term").alias("second"))


def candidates(index: DataFrame, looked_up: DataFrame, rows: int, window: int = WINDOW) -> DataFrame:
    """The rarest terms' postings that have the second term in reach: ``doc_id, text_key, pos`` and the anchor's columns."""
    span = 2 * window
    lists = index.select(*ROW, "pos", F.col("term").alias("posted"))
    first = reduce(DataFrame.unionAll, [lists.join(part, F.col("posted") == F.col("term")).select(*ROW, "pos", *looked_up.columns) for part in blocks(looked_up, rows)])
    wanted = looked_up.select(F.col("second").alias("wanted")).distinct()
    others = reduce(DataFrame.unionAll, [lists.join(part, F.col("posted") == F.col("wanted")).select(*ROW, "pos", "posted") for part in blocks(wanted, rows)])
    others = others.select(*ROW, F.col("pos").alias("other"), F.col("posted").alias("other_term"), F.floor(F.col("pos") / span).alias("other_cell"))
    # A posting looks into its own cell of positions and, near an edge, into the next one.
    cells = F.array_distinct(F.array(F.floor((F.col("pos") - (window - 1)) / span), F.floor((F.col("pos") + window - 1) / span)))
    first = first.withColumn("cell", F.explode(cells))
    # Both grow with the corpus: they meet by a shuffle at every size.
    met = first.join(renamed(others).hint("merge"), same_row() & (F.col("cell") == F.col("other_cell")) & (F.col("second") == F.col("other_term")) & (F.abs(F.col("other") - F.col("pos")) < window))
    return staged(met.select(*ROW, "pos", *looked_up.columns).distinct(), "candidates")


def surroundings(index: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``found`` with ``around``: the terms from ``window - 1`` words before its place to as many behind it, null where no test term is."""
    span = 2 * window
    cells = F.array_distinct(F.array(F.floor((F.col("pos") - (window - 1)) / span), F.floor((F.col("pos") + window - 1) / span)))
    asked = found.select(*ROW, "pos", F.explode(cells).alias("cell")).distinct()
    here = renamed(asked.select(*ROW, "cell").distinct())
    lists = index.filter(F.col("term") != END_ID).withColumn("index_cell", F.floor(F.col("pos") / span))
    if here.count() <= BROADCAST_ROWS:  # otherwise every cell is put together, in its own task before the exchange
        lists = lists.join(F.broadcast(here), same_row() & (F.col("index_cell") == F.col("cell")), "left_semi")
    # At most a cell's positions; repeated rows bring the same ones.
    cell = lists.groupBy(*ROW, "index_cell").agg(F.collect_set(F.struct("pos", "term")).alias("held"))
    joined = asked.join(renamed(cell), same_row() & (F.col("cell") == F.col("index_cell")), "left").select(*ROW, "pos", "held")
    both = joined.groupBy(*ROW, F.col("pos").alias("place")).agg(F.flatten(F.collect_list("held")).alias("held"))
    step = F.sequence(F.lit(-(window - 1)), F.lit(window - 1))
    around = F.transform(step, lambda d: F.get(F.filter("held", lambda x: x["pos"] == F.col("place") + d), F.lit(0))["term"])
    both = renamed(both.select(*ROW, "place", around.alias("around")))
    return found.join(both, same_row() & (F.col("pos") == F.col("place"))).select(*found.columns, "around")


def verified(found: DataFrame, items: DataFrame, rows: int, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_key, item_no, item_id, kind, start, end`` of every match: ``exact`` runs (words start to end, end exclusive), ``near``."""
    coded = items.select(F.col("item_no").alias("no"), "item_id", "item")
    met = reduce(DataFrame.unionAll, [found.join(part, F.col("item_no") == F.col("no")).drop("no") for part in blocks(coded, rows)])
    length, reach = F.size("item"), F.lit(window - 1)

    def common(a: Column, b: Column) -> Column:
        """How many of the first elements are equal."""
        same = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        return F.when(same == 0, F.greatest(F.size(a), F.size(b))).otherwise(same - 1).cast("int")

    left = common(F.reverse(F.slice("around", 1, window - 1)), F.reverse(F.slice("item", F.greatest(F.lit(1), F.col("at") + 1 - reach), F.least(F.col("at"), reach))))
    right = common(F.slice("around", window + 1, window - 1), F.slice("item", F.col("at") + 2, window - 1))
    met = met.withColumns({"left": F.least(left, F.col("at")), "right": F.least(right, length - 1 - F.col("at"))})
    exact = F.col("left") + F.col("right") + 1 >= F.least(F.lit(window), length)
    # Words of the windows from low to high, and the longest run of them that stand around the posting.
    words = F.slice("item", F.col("low") + 1, F.col("high") - F.col("low") + window)
    none = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    held = F.filter("around", lambda x: x.isNotNull())
    run = F.aggregate(words, none, lambda acc, w: F.when(F.array_contains(held, w), F.struct((acc["run"] + 1).alias("run"), F.greatest(acc["best"], acc["run"] + 1).alias("best"))).otherwise(F.struct(F.lit(0).alias("run"), acc["best"].alias("best"))), lambda acc: acc["best"])
    near = run >= F.least(F.lit(window), length)
    kind = F.when(exact, "exact").when(near, "near")
    # A proximity match reaches from the first to the last of the windows' words around the posting.
    told = F.transform("around", lambda x: F.coalesce(F.array_contains(words, x), F.lit(False)))
    begin = F.col("pos") - (window - 1)
    start = F.when(exact, F.col("pos") - F.col("left")).otherwise(begin + F.array_position(told, True) - 1)
    end = F.when(exact, F.col("pos") + F.col("right") + 1).otherwise(begin + 2 * window - F.array_position(F.reverse(told), True))
    return met.select(*ROW, "item_no", "item_id", kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end")).filter(F.col("kind").isNotNull())


def indexed_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_key, n_words`` of every row, and the matches of the windows of all items in all of them."""
    known = staged(item_words(items), "items")
    terms = known.select(F.explode("words").alias("word")).distinct()
    vocabulary = staged(terms.withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    rows = known.select(F.sum(F.size("words"))).first()[0] or 0  # bounds every frame of the test side
    numbered = known.select("item_no", "item_id", F.size("words").alias("span"), F.posexplode("words").alias("at", "word")).join(vocabulary, "word")
    coded = staged(numbered.groupBy("item_no", "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("item")), "coded")
    index = build_index(docs, vocabulary, rows)
    seen = index.filter(F.col("term") != END_ID).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(vocabulary.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("postings")), "terms")
    looked_up = staged(anchors(numbered, counts, window), "anchors")
    found = candidates(index, looked_up, rows, window)
    ends = index.filter(F.col("term") == END_ID).select(*ROW, F.col("pos").cast("long").alias("n_words"))
    return ends, verified(surroundings(index, found, window), coded, rows, window)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact and proximity matches of the windows of all items in all documents: ``doc_id, text_key, item_id, kind, start, end``."""
    return indexed_matches(docs, items, window)[1].drop("item_no")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``n_near`` (items with a proximity match) of every document."""
    return contaminated_rows(docs, items, window).drop("text_key")


def contaminated_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """:func:`contamination` with ``text_key`` (the xxhash64 of the text, null as empty), which tells rows of one id apart."""
    base, found = indexed_matches(docs, items, window)
    exact = F.col("kind") == "exact"
    # Sets of one document: at most its own positions, and the same span found through several anchors once.
    hits = found.groupBy(*ROW).agg(
        F.collect_set(F.when(exact, F.struct("start", "end"))).alias("spans"),
        F.collect_set(F.when(exact, F.col("item_id").cast("string"))).alias("ids"),
        F.count_if(exact & F.col("item_id").isNull()).alias("unnamed"),
        F.count_distinct(F.when(~exact, F.col("item_no"))).alias("near"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    covered = F.aggregate(
        F.array_sort("spans"),
        start,
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["until"]))).alias("n"), F.greatest(acc["until"], s["end"]).alias("until")),
        lambda acc: acc["n"],
    )
    hits = hits.select(*ROW, covered.cast("long").alias("hit"), F.sort_array("ids").alias("ids"), (F.size("ids") + (F.col("unnamed") > 0).cast("int")).alias("items"), "near")
    joined = base.join(renamed(hits), same_row(), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        "text_key",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n AS n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY 1),
it AS (SELECT row_number() OVER () AS no, w, least(13, len(w)) AS n FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
dw1 AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
cnt AS (SELECT t, count(*) AS c FROM dw1 GROUP BY 1),
ip AS (SELECT no, w, n, s, unnest(range(s, s + n)) AS a FROM (SELECT no, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM it)),
anc AS (SELECT no, a, min(s) AS low, max(s) AS high FROM (SELECT no, s, arg_min(a, coalesce(c, 0) * 1000000 + a) AS a FROM (SELECT no, s, a, w[a] AS t FROM ip) LEFT JOIN cnt USING (t) GROUP BY no, s) GROUP BY no, a),
post AS (SELECT no, it.w AS iw, n, a, low, high, dw1.doc_id, p, d.w AS dw FROM anc JOIN it USING (no) JOIN dw1 ON dw1.t = it.w[a] JOIN d ON d.doc_id = dw1.doc_id),
near AS (SELECT doc_id, count(DISTINCT no) AS n_near FROM post WHERE len(list_filter(range(low, high + 1), lambda s: list_has_all(dw[greatest(1, p - 12) : p + 12], iw[s : s + n - 1]))) > 0
  AND len(list_filter(range(greatest(1, a - n + 1), least(a, len(iw) - n + 1) + 1), lambda s: p - a + s > 0 AND dw[p - a + s : p - a + s + n - 1] = iw[s : s + n - 1])) = 0 GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id LEFT JOIN near ON d.doc_id = near.doc_id
"""
