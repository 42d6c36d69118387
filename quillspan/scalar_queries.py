"""Named queries on column expressions, positions and requests, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import lines as L
from .functions import positions as P
from .functions import scalars as S
from .named import query
from .operators import requests
from .sources import tables as T
from .staging import staged

FILES = """w AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, text, CAST(strlen(text) AS BIGINT) AS n FROM documents)"""


@query(f"""WITH {FILES}, o AS (SELECT path, text, n, doc_id * 31 % (n + 3) - 1 AS o FROM w) SELECT path, CAST(o AS BIGINT) AS "offset", o >= 0 AND o <= n AND (o = n OR substr(hex(encode(text)[o + 1 : o + 1]), 1, 1) NOT IN ('8', '9', 'A', 'B')) AS boundary FROM o""")
def boundary_checks(spark, sf_dir):
    f = T.files(spark, sf_dir).withColumn("offset", F.col("path").cast("long") * 31 % (F.length("bytes") + 3) - 1)
    return f.select("path", "offset", S.is_boundary("bytes", F.col("offset")).alias("boundary"))


@query(f"""WITH {FILES}, x AS (SELECT path, encode(text) AS b, least(doc_id * 37 % (n + 1), doc_id * 91 % (n + 1)) AS s, greatest(doc_id * 37 % (n + 1), doc_id * 91 % (n + 1)) AS e FROM w) SELECT path, 'sha256:' || sha256(b[s + 1 : e]) AS digest FROM x""")
def slice_digest(spark, sf_dir):
    f = T.files(spark, sf_dir).withColumn("id", F.col("path").cast("long")).withColumn("n", F.length("bytes"))
    p, q = F.col("id") * 37 % (F.col("n") + 1), F.col("id") * 91 % (F.col("n") + 1)
    return f.select("path", S.digest(L.cut("bytes", F.least(p, q), F.greatest(p, q))).alias("digest"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS name, 'sha256:' || sha256(unhex(printf('%016x%016x', 1, doc_id % 900))) AS identity FROM documents""")
def identity_hashes(spark, sf_dir):
    one = F.lit(1).cast("decimal(20,0)")
    return T.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), S.identity_hash(one, (F.col("doc_id") % 900).cast("decimal(20,0)")).alias("identity"))


@query(r"""SELECT c_custkey, c_name || '\u{' || printf('%x', c_custkey % 32) || '}' || CASE WHEN c_custkey % 3 = 0 THEN '\u{202e}' ELSE 'ä' END AS shown FROM customer""")
def terminal_escapes(spark, sf_dir):
    text = F.concat("c_name", F.char(F.col("c_custkey") % 32), F.when(F.col("c_custkey") % 3 == 0, "\u202e").otherwise("ä"))
    # char(0) is an empty string to Spark: the NUL is put in by its code.
    text = F.when(F.col("c_custkey") % 32 == 0, F.concat("c_name", F.lit("\0"), F.when(F.col("c_custkey") % 3 == 0, "\u202e").otherwise("ä"))).otherwise(text)
    return T.table(spark, sf_dir, "customer").select("c_custkey", S.terminal_escape(text).alias("shown"))


@query(r"""SELECT page_id, CASE WHEN page_id % 5 IN (0, 1, 2, 3) THEN '<path>' ELSE substr(url, 9) END AS shown FROM pages""")
def redacted_paths(spark, sf_dir):
    x, k = F.expr("substr(url, 9)"), F.col("page_id") % 5
    path = F.when(k == 0, F.concat(F.lit("/"), x)).when(k == 1, F.concat(F.lit("C:\\"), x)).when(k == 2, F.concat(F.lit("\\\\"), x)).when(k == 3, F.concat(F.lit("d:/"), x)).otherwise(x)
    return T.table(spark, sf_dir, "pages").select("page_id", S.redact_path(path).alias("shown"))


@query("""WITH x AS (SELECT n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '","missing":null}' AS j FROM nation) SELECT n_nationkey, j || chr(10) AS line, strlen(j) > 40 AS exceeded FROM x""")
def json_lines(spark, sf_dir):
    value = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("missing"))
    return T.table(spark, sf_dir, "nation").select("n_nationkey", S.json_line(value).alias("line"), S.exceeds_json(value, 40).alias("exceeded"))


@query("""WITH x AS (SELECT doc_id, text || chr(9) || chr(1) || chr(92) AS t FROM documents) SELECT doc_id, CAST(strlen(t) + 5 + length(t) - length(replace(t, chr(10), '')) + length(t) - length(replace(t, '"', '')) + length(t) - length(replace(t, chr(92), '')) + length(t) - length(replace(t, chr(9), '')) AS BIGINT) AS cost FROM x""")
def json_costs(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", S.json_cost(F.concat("text", F.lit("\t\1\\"))).alias("cost"))


@query("""SELECT c_custkey, c_custkey % 4 = 0 AS transaction, c_custkey % 5 IN (1, 2, 3) AS artifact, c_custkey % 5 = 1 AS own FROM customer""")
def name_checks(spark, sf_dir):
    k = F.col("c_custkey")
    good = F.lpad(F.lower(F.hex(k)), 32, "0")
    name = F.when(k % 4 == 0, good).when(k % 4 == 1, F.concat(good, F.lit("0"))).when(k % 4 == 2, F.concat(F.substring(good, 1, 31), F.lit("G"))).otherwise(F.concat(good, F.lit("\n")))
    number = F.lpad(k.cast("string"), 8, "0")
    artifact = F.when(k % 5 == 1, F.concat(F.lit("candidate-"), number)).when(k % 5 == 2, F.concat(F.lit("backup-"), number)).when(k % 5 == 3, F.concat(F.lit("state-"), number)).when(k % 5 == 4, F.concat(F.lit("candidate-"), k.cast("string"))).otherwise(F.concat(F.lit("other-"), number))
    return T.table(spark, sf_dir, "customer").select("c_custkey", S.is_transaction_id(name).alias("transaction"), S.is_artifact_name(artifact).alias("artifact"), S.is_artifact_name(artifact, "candidate", k).alias("own"))


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS query_id, l_partkey % 40 AS a, l_partkey % 40 + l_suppkey % 30 AS b, l_orderkey % 40 AS c, l_orderkey % 40 + l_linenumber AS d FROM lineitem) SELECT query_id, a <= c AND d <= b AS inside, (a <= c AND c < b) OR (c = 60 AND b = 60 AND a < b) AS holds FROM x""")
def range_containment(spark, sf_dir):
    a, c = F.col("l_partkey") % 40, F.col("l_orderkey") % 40
    b, d = a + F.col("l_suppkey") % 30, c + F.col("l_linenumber")
    return T.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), S.range_contains(a, b, c, d).alias("inside"), S.contains_position(a, b, c, F.lit(60)).alias("holds"))


LINES = f"""{FILES}, lp AS (SELECT path, n, k, strlen(p) + 1 AS len FROM (SELECT path, n, unnest(string_split(text, chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM w)),
l AS (SELECT path, k AS line, CAST(e - len AS BIGINT) AS line_start, CAST(least(n, e) AS BIGINT) AS line_end, e <= n AS ended FROM (SELECT path, n, k, len, sum(len) OVER (PARTITION BY path ORDER BY k) AS e FROM lp) WHERE e - len < n), c AS (SELECT path, count(*) AS c FROM l GROUP BY 1),
sp AS (SELECT l_orderkey * 10 + l_linenumber AS query_id, lpad(CAST(l_orderkey % (SELECT count(*) FROM documents) AS VARCHAR), 8, '0') AS path, l_partkey AS pk FROM lineitem),
f AS (SELECT query_id, pk, l.path, l.line, l.line_start, l.line_end, l.line_end - CASE WHEN ended THEN 1 ELSE 0 END AS content_end, encode(w.text) AS b FROM sp JOIN c ON c.path = sp.path JOIN l ON l.path = sp.path AND l.line = pk % c.c + 1 JOIN w ON w.path = sp.path)"""


def _spots(spark, sf_dir):
    """Every lineitem row asks on one line of its document: ``query_id, pk, path, line, line_start, line_end, content_end, bytes``."""
    files = T.files(spark, sf_dir)
    n_docs = F.broadcast(files.agg(F.count(F.lit(1)).alias("n_docs")))
    lines = L.line_table(files)
    counts = lines.groupBy(F.col("path").alias("c_path")).agg(F.max("line").alias("c"))
    asked = T.table(spark, sf_dir, "lineitem").crossJoin(n_docs).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), T.path_of(F.col("l_orderkey") % F.col("n_docs")).alias("path"), F.col("l_partkey").alias("pk"))
    asked = asked.join(counts, F.col("path") == F.col("c_path")).withColumn("line", F.col("pk") % F.col("c") + 1)
    known = lines.select(F.col("path").alias("l_path"), F.col("line").alias("l_line"), "line_start", "line_end", "terminator")
    found = asked.join(known, (F.col("path") == F.col("l_path")) & (F.col("line") == F.col("l_line")))
    found = found.join(files.select(F.col("path").alias("b_path"), "bytes"), F.col("path") == F.col("b_path"))
    return found.withColumn("content_end", F.col("line_end") - F.when(F.col("terminator") == "LF", 1).otherwise(0))


@query(f"""WITH {LINES}, g AS (SELECT *, decode(b[line_start + 1 : content_end]) AS t FROM f), h AS (SELECT *, pk % (length(t) + 2) + 1 AS k FROM g) SELECT query_id, path, CAST(k AS BIGINT) AS scalar_column, CASE WHEN k <= length(t) + 1 THEN CAST(line_start + strlen(t[1 : k - 1]) AS BIGINT) END AS byte_offset FROM h""")
def scalar_columns(spark, sf_dir):
    t = L.cut("bytes", F.col("line_start"), F.col("content_end")).cast("string")
    j = _spots(spark, sf_dir).withColumn("t", t).withColumn("scalar_column", F.col("pk") % (F.length("t") + 2) + 1)
    return j.select("query_id", "path", "scalar_column", P.column_to_byte(F.col("t"), F.col("line_start"), F.col("scalar_column")).alias("byte_offset"))


@query(f"""WITH {LINES}, g AS (SELECT *, line_start + pk % (line_end - line_start + 1) AS o FROM f) SELECT query_id, path, CAST(o AS BIGINT) AS "offset", CASE WHEN o <= content_end AND (o = octet_length(b) OR substr(hex(b[o + 1 : o + 1]), 1, 1) NOT IN ('8', '9', 'A', 'B')) THEN CAST(length(decode(b[line_start + 1 : o])) + 1 AS BIGINT) END AS scalar_column FROM g""")
def byte_columns(spark, sf_dir):
    j = _spots(spark, sf_dir).withColumn("offset", F.col("line_start") + F.col("pk") % (F.col("line_end") - F.col("line_start") + 1))
    return j.select("query_id", "path", "offset", P.byte_to_column(F.col("bytes"), F.col("line_start"), F.col("content_end"), F.col("offset")).alias("scalar_column"))


@query(f"""WITH {LINES} SELECT path, CAST(sum(length(decode(b[line_start + 1 : content_end]))) AS BIGINT) AS scalars, sum(length(decode(b[line_start + 1 : content_end]))) > 5000 AS exceeded FROM f GROUP BY 1""")
def conversion_work(spark, sf_dir):
    prefix = L.cut("bytes", F.col("line_start"), F.col("content_end")).cast("string")
    return P.work_excess(_spots(spark, sf_dir).select("path", prefix.alias("prefix")), 5000)


@query(f"""WITH {LINES} SELECT query_id, path, line_start AS start, line_end AS "end" FROM f""")
def extent_lines(spark, sf_dir):
    """A range that leaves only blanks of its line out grows to the line."""
    j = _spots(spark, sf_dir).withColumn("x", L.declaration_extent("bytes", F.col("line_start"), F.col("content_end")))
    return j.select("query_id", "path", "x.start", "x.end")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS batch_id, CASE c_custkey % 9 WHEN 1 THEN 'INVALID_JSON' WHEN 2 THEN 'UNSUPPORTED_PROTOCOL_VERSION' WHEN 3 THEN 'INVALID_REQUEST' WHEN 4 THEN 'INVALID_DIGEST' WHEN 5 THEN 'INVALID_REQUEST' WHEN 6 THEN 'INVALID_JSON' WHEN 7 THEN 'INVALID_REQUEST' END AS problem, CASE WHEN c_custkey % 9 IN (0, 8) THEN 1 ELSE 0 END AS operations FROM customer""")
def request_checks(spark, sf_dir):
    """One request a customer: cut short, of another version, with an empty range, a bad digest, a bad path, a field twice, an
    unknown field, or good."""
    k = F.col("c_custkey") % 9
    digest = F.concat(F.lit("sha256:"), F.repeat(F.lit("0"), F.when(k == 4, 63).otherwise(64)))
    body = F.concat(
        F.lit('{"version":'), F.when(k == 2, "2").otherwise("1"), F.when(k == 6, ',"version":1').otherwise(""), F.lit(',"operations":[{"kind":"copy",'), F.when(k == 7, '"extra":0,').otherwise(""),
        F.lit('"source":{"path":"a","selector":{"kind":"bytes","start":'), F.when(k == 3, "9").otherwise("1"), F.lit(',"end":2},"precondition":{"kind":"sha256","value":"'), digest,
        F.lit('"}},"destination":{"path":"'), F.when(k == 5, "../b").otherwise("b"), F.lit('","anchor":{"kind":"file_start"},"precondition":{"kind":"must_not_exist"}}}]}'), F.when(k == 1, "}").otherwise(""),
    )
    parsed = requests.parse(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("batch_id"), body.alias("body")))
    parsed = staged(parsed, "parsed")  # read twice
    found = requests.operations(parsed).groupBy(F.col("batch_id").alias("b")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return parsed.select("batch_id", "problem").join(found, F.col("batch_id") == F.col("b"), "left").select("batch_id", "problem", F.coalesce("n", F.lit(0)).alias("operations"))
