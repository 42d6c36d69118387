"""Named queries on flattened symbol trees and on bytes of files, each with the SQL that it is held against.

Nations with their suppliers, customers and orders are the symbols of documents, a line each: a document holds one block of keys of a nation. Its
editor response is JSON in UTF-16 units; blocks that leave 2 by 3 have a fault.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import positions as P
from .functions.scalars import digest
from .named import query
from .operators import symbols
from .sources import tables as T

KEYS = 500  #: customers (or suppliers) whose keys fall into one block
AHEAD = "é🚀"  #: stands before every name: 2 scalars, 3 UTF-16 units, 6 bytes
NUMBERS = {"module": 2, "class": 5, "method": 6, "field": 8, "constant": 14}

NODES = f"""mem AS (SELECT s_nationkey AS nk, s_suppkey // {KEYS} AS bl, printf('A/0/%09d', s_suppkey) AS key, s_name AS name, 'method' AS kind FROM supplier
  UNION ALL SELECT c_nationkey, c_custkey // {KEYS}, printf('A/1/%09d', c_custkey), c_name, 'field' FROM customer
  UNION ALL SELECT c_nationkey, c_custkey // {KEYS}, printf('A/1/%09d/%012d', c_custkey, o_orderkey), 'Order#' || o_orderkey, 'constant' FROM orders JOIN customer ON c_custkey = o_custkey),
nod AS (SELECT * FROM mem UNION ALL SELECT DISTINCT nk, bl, 'A', n_name, 'class' FROM mem JOIN nation ON n_nationkey = nk UNION ALL SELECT DISTINCT nk, bl, '', r_name, 'module' FROM mem JOIN nation ON n_nationkey = nk JOIN region ON r_regionkey = n_regionkey),
num AS (SELECT *, printf('n-%02d-%d', nk, bl) AS path, row_number() OVER (PARTITION BY nk, bl ORDER BY key) - 1 AS line, CAST(sum(strlen(name) + 7) OVER (PARTITION BY nk, bl ORDER BY key) AS BIGINT) - strlen(name) - 7 AS pos FROM nod),
sym AS (SELECT *, pos + 6 AS s, pos + 6 + strlen(name) AS se, CASE length(key) WHEN 0 THEN max(pos + 6 + strlen(name)) OVER d WHEN 1 THEN max(pos + 6 + strlen(name)) OVER d WHEN 13 THEN max(pos + 6 + strlen(name)) OVER u ELSE pos + 6 + strlen(name) END AS e,
  CASE length(key) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 13 THEN 3 ELSE 4 END AS depth,
  CASE WHEN length(key) = 0 THEN name WHEN length(key) = 1 THEN first(name) OVER d || '/' || name WHEN length(key) = 13 THEN first(name) OVER d || '/' || nth_value(name, 2) OVER d || '/' || name ELSE first(name) OVER d || '/' || nth_value(name, 2) OVER d || '/' || first(name) OVER u || '/' || name END AS symbol_path
  FROM num WINDOW d AS (PARTITION BY nk, bl ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), u AS (PARTITION BY nk, bl, substr(key, 1, 13) ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
good AS (SELECT * FROM sym WHERE bl % 3 <> 2), txt AS (SELECT path, string_agg('{AHEAD}' || name, chr(10) ORDER BY key) AS text FROM num GROUP BY 1)"""


def responses(spark, sf_dir):
    """``path, bytes, encoding, symbols, sha256``: the documents, and what an editor's server would say of them."""
    nation, region = T.table(spark, sf_dir, "nation"), T.table(spark, sf_dir, "region")
    sup = T.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nk"), F.col("s_suppkey").alias("k"), F.format_string("A/0/%09d", "s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("method").alias("kind"))
    customer = T.table(spark, sf_dir, "customer")
    cus = customer.select(F.col("c_nationkey").alias("nk"), F.col("c_custkey").alias("k"), F.format_string("A/1/%09d", "c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("field").alias("kind"))
    orders = T.table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    own = orders.select(F.col("c_nationkey").alias("nk"), F.col("c_custkey").alias("k"), F.format_string("A/1/%09d/%012d", "c_custkey", "o_orderkey").alias("key"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("constant").alias("kind"))
    members = sup.unionByName(cus).unionByName(own).withColumn("bl", F.floor(F.col("k") / KEYS)).drop("k")
    blocks = members.select("nk", "bl").distinct().join(nation, F.col("nk") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    above = blocks.select("nk", "bl", F.lit("A").alias("key"), F.col("n_name").alias("name"), F.lit("class").alias("kind")).unionByName(blocks.select("nk", "bl", F.lit("").alias("key"), F.col("r_name").alias("name"), F.lit("module").alias("kind")))
    whole = Window.partitionBy("nk", "bl")
    rows = members.unionByName(above).withColumn("line", F.row_number().over(whole.orderBy("key")) - 1)
    last = F.when(F.length("key") < 2, F.max("line").over(whole)).when(F.length("key") == 13, F.max("line").over(Window.partitionBy("nk", "bl", F.substring("key", 1, 13)))).otherwise(F.col("line"))
    number = F.element_at(F.create_map(*(F.lit(x) for kv in NUMBERS.items() for x in kv)), F.col("kind"))

    def span(line, last, end):
        return F.struct(F.struct(line.alias("line"), F.lit(3).alias("character")).alias("start"), F.struct(last.alias("line"), end.alias("character")).alias("end"))

    torn = (F.col("kind") == "module") & (F.col("bl") % 3 == 2) & (F.col("nk") % 2 == 1)
    line = F.when(torn, F.lit(1_000_000)).otherwise(F.col("line"))
    # An end far behind its line stands for the line's end.
    body = F.struct("name", F.lit("as told").alias("detail"), number.alias("kind"), span(F.col("line"), last, F.lit(9999)).alias("range"), span(line, line, F.length("name") + 3).alias("selectionRange"))
    plain = F.to_json(body)
    odd = (F.col("kind") == "class") & (F.col("bl") % 3 == 2) & (F.col("nk") % 2 == 0)
    rows = rows.withColumn("json", F.when(odd, F.regexp_replace(plain, r'"kind":\d+', '"kind":"five"')).otherwise(plain))

    def joined(c):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", c))), lambda x: x[c]), ",")

    def holding(inner):
        return F.concat(F.expr("substring(json, 1, length(json) - 1)"), F.lit(',"children":['), F.coalesce(inner, F.lit("")), F.lit("]}"))

    leaves = rows.filter("kind = 'constant'").groupBy("nk", "bl", F.substring("key", 1, 13).alias("key")).agg(joined("json").alias("inner"))
    fields = rows.filter("length(key) = 13").join(leaves, ["nk", "bl", "key"], "left").withColumn("json", holding(F.col("inner"))).groupBy("nk", "bl").agg(joined("json").alias("inner"))
    classes = rows.filter("key = 'A'").join(fields, ["nk", "bl"], "left").select("nk", "bl", holding(F.col("inner")).alias("inner"))
    trees = rows.filter("key = ''").join(classes, ["nk", "bl"]).select("nk", "bl", F.concat(F.lit("["), holding(F.col("inner")), F.lit("]")).alias("symbols"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("key", "name"))), lambda x: F.concat(F.lit(AHEAD), x["name"]))
    texts = rows.groupBy("nk", "bl").agg(F.encode(F.array_join(shown, "\n"), "UTF-8").alias("bytes"))
    return texts.join(trees, ["nk", "bl"]).select(F.format_string("n-%02d-%d", "nk", "bl").alias("path"), "bytes", F.lit("utf-16").alias("encoding"), "symbols", digest("bytes").alias("sha256"))


def _flat(spark, sf_dir):
    from .staging import staged

    given = staged(responses(spark, sf_dir), "responses", wide=True)
    return given, staged(symbols.flatten(given), "flat")


@query(f"""WITH {NODES} SELECT path, CAST(line AS BIGINT) AS ordinal, CAST(depth AS INTEGER) AS depth, name, kind, symbol_path, s AS start, e AS "end", s AS selection_start, se AS selection_end, CAST(NULL AS VARCHAR) AS problem FROM good
UNION ALL SELECT DISTINCT path, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN nk % 2 = 0 THEN 'MALFORMED' ELSE 'NO_SUCH_LINE' END FROM sym WHERE bl % 3 = 2""")
def symbol_flatten(spark, sf_dir):
    return _flat(spark, sf_dir)[1].select("path", "ordinal", "depth", "name", "kind", F.array_join("symbol_path", "/").alias("symbol_path"), "start", "end", "selection_start", "selection_end", "problem")


@query(f"""WITH {NODES}, ln AS (SELECT path, line, pos, name FROM num), x AS (SELECT good.path, good.line, good.name, kind, s, e, depth, ln.line AS last, ln.name AS last_name FROM good JOIN ln ON ln.path = good.path AND good.e = ln.pos + 6 + strlen(ln.name))
SELECT path, CAST(line + 1 AS INTEGER) AS "row", name, kind, CAST(depth - 1 AS INTEGER) AS level, line + 1 AS start_line, CAST(3 AS BIGINT) AS start_column, last + 1 AS end_line, CAST(3 + length(last_name) AS BIGINT) AS end_column FROM x""")
def outline_positions(spark, sf_dir):
    given, flat = _flat(spark, sf_dir)
    return symbols.with_lines(symbols.outline(flat), given).select("path", "row", "name", "kind", "level", "start_line", "start_column", "end_line", "end_column")


@query(f"""WITH {NODES}, q AS (SELECT o_orderkey AS query_id, printf('n-%02d-%d', c_nationkey, c_custkey // {KEYS}) AS path, o_orderkey * 7919 AS k FROM orders JOIN customer ON c_custkey = o_custkey), a AS (SELECT query_id, q.path, k % strlen(text) AS o FROM q JOIN txt ON txt.path = q.path),
m AS (SELECT query_id, good.path, name, s, e, rank() OVER (PARTITION BY query_id ORDER BY e - s) AS r FROM a JOIN good ON good.path = a.path AND s <= o AND o < e) SELECT query_id, path, name, s AS start, e AS "end" FROM m WHERE r = 1""")
def flattened_positions(spark, sf_dir):
    """Every order asks somewhere in its document, anywhere in its length; documents are several bins long."""
    given, flat = _flat(spark, sf_dir)
    sizes = given.select("path", F.length("bytes").cast("long").alias("length"))
    customer = T.table(spark, sf_dir, "customer").select("c_custkey", F.format_string("n-%02d-%d", "c_nationkey", F.floor(F.col("c_custkey") / KEYS)).alias("path"))
    ask = T.table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(sizes, "path")
    ask = ask.select(F.col("o_orderkey").alias("query_id"), "path", (F.col("o_orderkey") * 7919 % F.col("length")).alias("offset"), "length")
    return symbols.by_position(ask, flat, bin_bytes=1024).select("query_id", "path", "name", "start", "end")


@query(f"""WITH {NODES}, x AS (SELECT good.path, name, kind, s, least(e + 1, strlen(text)) AS e, text FROM good JOIN txt ON txt.path = good.path WHERE kind IN ('class', 'method'))
SELECT path, name, kind, s AS selected_start, CAST(e AS BIGINT) AS selected_end, CAST(e - s AS BIGINT) AS selected_byte_length, 'sha256:' || sha256(encode(text)[s + 1 : e]) AS selected_payload_sha256, '{{"path":"' || path || '","selector":{{"kind":"bytes","start":' || s || ',"end":' || e || '}},"precondition":{{"kind":"sha256","value":"sha256:' || sha256(text) || '"}}}}' AS request_source FROM x""")
def match_projection(spark, sf_dir):
    """Classes and methods, taken with their whole lines, and the source of a request that would move them."""
    given, flat = _flat(spark, sf_dir)
    found = symbols.project_matches(flat.filter("problem is null").filter(F.col("kind").isin("class", "method")), given, whole_lines=True)
    return found.select("path", "name", "kind", "selected_start", "selected_end", "selected_byte_length", "selected_payload_sha256", F.to_json("request_source").alias("request_source"))


BYTES = r"""dn AS (SELECT count(*) AS n FROM documents), mx AS (SELECT path, text, strlen(text) AS n FROM w), nlx AS (SELECT path, count(*) AS c, max(line_end) AS n FROM lt GROUP BY 1),
q AS (SELECT l_orderkey * 10 + l_linenumber AS query_id, lpad(CAST(l_orderkey % dn.n AS VARCHAR), 8, '0') AS path, l_partkey * 7919 + l_suppkey AS k FROM lineitem, dn), a AS (SELECT query_id, q.path, k % (mx.n + 2) AS o, mx.n AS n FROM q JOIN mx ON mx.path = q.path),
f AS (SELECT a.*, line, line_start, line_end, line_end - CASE terminator WHEN 'CRLF' THEN 2 WHEN 'NONE' THEN 0 ELSE 1 END AS ce, p FROM a LEFT JOIN lt ON lt.path = a.path AND line_start <= o AND (o < line_end OR (o = line_end AND o = a.n))),
g AS (SELECT f.*, CASE WHEN line IS NOT NULL THEN encode(p)[1 : o - line_start] END AS pre, line IS NOT NULL AND substr(hex(encode(p)[o - line_start + 1 : o - line_start + 1]), 1, 1) IN ('8', '9', 'A', 'B') AS split FROM f),
h AS (SELECT *, CASE WHEN line IS NOT NULL AND NOT split AND o <= ce THEN decode(pre) END AS pt FROM g)"""


def _byte_query():
    from .queries import MIXED

    return f"""WITH {MIXED}, {BYTES} SELECT query_id, path, CAST(o AS BIGINT) AS "offset", CASE WHEN NOT split THEN line END AS line, CAST(length(pt) + 1 AS BIGINT) AS "column", CAST(strlen(pt) AS BIGINT) AS character8, CAST(length(pt) + length(regexp_replace(pt, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS BIGINT) AS character16, CAST(length(pt) AS BIGINT) AS character32, CASE WHEN line IS NULL THEN 'NO_SUCH_BYTE' WHEN split THEN 'SPLIT_CHARACTER' END AS problem FROM h"""


def byte_positions(spark, sf_dir):
    """Every lineitem row asks for a byte of a document with every kind of line end, or for one behind it."""
    files = T.files(spark, sf_dir, terminators=True)
    n_docs = F.broadcast(T.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs")))  # one row
    sizes = files.select(F.col("path").alias("s_path"), F.length("bytes").alias("n"))
    every = T.table(spark, sf_dir, "lineitem").crossJoin(n_docs).withColumn("path", T.path_of(F.col("l_orderkey") % F.col("n_docs"))).join(sizes, F.col("path") == F.col("s_path"))
    ask = every.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), "path", ((F.col("l_partkey") * 7919 + F.col("l_suppkey")) % (F.col("n") + 2)).cast("long").alias("offset"))
    return P.bytes_to_positions(ask, files)


query(_byte_query())(byte_positions)
