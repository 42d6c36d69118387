"""The engine's named queries on the driver's tables, and the DuckDB text that each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import lines as L
from .functions import positions as P
from .functions import scalars as S
from .named import ORACLE_SQL, QUERIES, query  # noqa: F401
from .operators import accounting, compose, reports, resolve, review, snapshot, symbols
from .plans.plan import plan
from .sources import tables as T
from .staging import staged

def _plan(spark, sf_dir):
    return plan(staged(T.operations(spark, sf_dir), "operations", "zstd"), T.files(spark, sf_dir))


# --- The tables as DuckDB sees them -------------------------------------------------------------------------------------

FILES = """w AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, text, CAST(strlen(text) AS BIGINT) AS n, 'sha256:' || sha256(text) AS sha FROM documents)"""
LINES = """lp AS (SELECT path, n, k, strlen(p) + 1 AS len FROM (SELECT path, n, unnest(string_split(text, chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM w)),
l AS (SELECT path, k AS line, CAST(e - len AS BIGINT) AS line_start, CAST(least(n, e) AS BIGINT) AS line_end, CASE WHEN e <= n THEN 'LF' ELSE 'NONE' END AS terminator FROM (SELECT path, n, k, len, sum(len) OVER (PARTITION BY path ORDER BY k) AS e FROM lp) WHERE e - len < n)"""
OPS = """nl AS (SELECT doc_id, path, n, sha, length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 0 ELSE 1 END AS c FROM w),
o1 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS operation_index, (o_custkey * 11 + o_orderkey % 3) % (SELECT count(*) FROM documents) AS src, (o_custkey * 11 + (o_orderkey // 3) % 3) % (SELECT count(*) FROM documents) AS dst FROM orders),
o AS (SELECT CAST(o_custkey AS VARCHAR) AS batch_id, operation_index, CASE WHEN o_orderstatus = 'F' THEN 'move' ELSE 'copy' END AS kind, s.path AS source_path, d.path AS destination_path, s.sha AS source_sha, d.sha AS destination_sha, d.n AS d_n,
  o_orderkey % s.c + 1 AS l1, least(o_orderkey % s.c + 1 + (o_orderkey // 5) % 2, s.c) AS l2, ['file_start', 'file_end', 'before_line', 'after_line', 'byte_offset'][o_orderkey % 5 + 1] AS anchor, (o_orderkey // 7) % d.c + 1 AS al
  FROM o1 JOIN nl s ON s.doc_id = src JOIN nl d ON d.doc_id = dst)"""
RESOLVED = """r1 AS (SELECT o.*, a.line_start AS source_start, b.line_end AS source_end, CASE anchor WHEN 'file_start' THEN 0 WHEN 'file_end' THEN d_n WHEN 'before_line' THEN c.line_start WHEN 'after_line' THEN c.line_end ELSE 0 END AS destination_offset
  FROM o JOIN l a ON a.path = source_path AND a.line = l1 JOIN l b ON b.path = source_path AND b.line = l2 LEFT JOIN l c ON c.path = destination_path AND c.line = al),
r AS (SELECT r1.*, CASE WHEN kind = 'move' AND source_path = destination_path AND destination_offset IN (source_start, source_end) THEN 'no_op' ELSE 'changed' END AS effect, 'sha256:' || sha256(encode(w.text)[source_start + 1 : source_end]) AS payload_sha256 FROM r1 JOIN w ON w.path = source_path)"""
EVENTS = """ev AS (SELECT batch_id, source_path AS path, operation_index, 'delete' AS event, source_start AS s, source_end AS e FROM r WHERE effect = 'changed' AND kind = 'move'
  UNION ALL SELECT batch_id, destination_path, operation_index, 'insert', destination_offset, destination_offset FROM r WHERE effect = 'changed')"""
CONFLICTS = """ov AS (SELECT batch_id, path, operation_index FROM (SELECT *, lag(e) OVER (PARTITION BY batch_id, path ORDER BY s, e, operation_index) AS pe FROM ev WHERE event = 'delete') WHERE s < pe),
ins AS (SELECT DISTINCT i.batch_id, i.path, i.operation_index, i.s AS off FROM ev i JOIN ev d ON i.batch_id = d.batch_id AND i.path = d.path AND i.event = 'insert' AND d.event = 'delete' AND d.s < i.s AND i.s < d.e),
g AS (SELECT * FROM r WHERE batch_id NOT IN (SELECT batch_id FROM ov UNION ALL SELECT batch_id FROM ins)), gev AS (SELECT * FROM ev WHERE batch_id NOT IN (SELECT batch_id FROM ov UNION ALL SELECT batch_id FROM ins))"""
SEGMENTS = """pt AS (SELECT DISTINCT batch_id, path, s AS p FROM gev UNION SELECT batch_id, path, e FROM gev UNION SELECT batch_id, gev.path, 0 FROM gev UNION SELECT batch_id, gev.path, n FROM gev JOIN w ON w.path = gev.path),
gap AS (SELECT *, lead(p) OVER (PARTITION BY batch_id, path ORDER BY p) AS q FROM pt),
kept AS (SELECT * FROM gap WHERE q > p AND NOT EXISTS (SELECT 1 FROM gev d WHERE d.batch_id = gap.batch_id AND d.path = gap.path AND d.event = 'delete' AND d.s <= gap.p AND gap.p < d.e)),
allseg AS (SELECT batch_id, path, p AS place, 1 AS rk, NULL AS operation_index, path AS source_path, p AS s, q AS e FROM kept UNION ALL SELECT batch_id, destination_path, destination_offset, 0, operation_index, source_path, source_start, source_end FROM g WHERE effect = 'changed'),
seg AS (SELECT *, row_number() OVER (PARTITION BY batch_id, path ORDER BY place, rk, operation_index) - 1 AS k FROM allseg)"""
OUTPUTS = """made AS (SELECT batch_id, seg.path, string_agg(hex(encode(w.text)[s + 1 : e]), '' ORDER BY k) AS h FROM seg JOIN w ON w.path = source_path GROUP BY ALL),
outs AS (SELECT t.batch_id, t.path, coalesce(h, '') AS h, w.sha AS before_sha256, w.n AS before_length, hex(encode(w.text)) AS bh FROM (SELECT DISTINCT batch_id, path FROM gev) t LEFT JOIN made ON made.batch_id = t.batch_id AND made.path = t.path JOIN w ON w.path = t.path),
out AS (SELECT batch_id, path, CASE WHEN h = bh THEN 'unchanged' WHEN h = '' THEN 'emptied' ELSE 'modified' END AS change_kind, before_length, before_sha256, CAST(length(h) // 2 AS BIGINT) AS after_length, 'sha256:' || sha256(unhex(h)) AS after_sha256 FROM outs)"""
UP_TO_R = f"WITH {FILES}, {LINES}, {OPS}, {RESOLVED}"
UP_TO_E = f"{UP_TO_R}, {EVENTS}, {CONFLICTS}"
UP_TO_S = f"{UP_TO_E}, {SEGMENTS}"
UP_TO_O = f"{UP_TO_S}, {OUTPUTS}"
MIXED = """w AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, CASE doc_id % 3 WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 2 THEN replace(text, chr(10), chr(13)) ELSE text END || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END AS text FROM documents),
pc AS (SELECT path, unnest(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+')) AS p, unnest(range(1, len(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+')) + 1)) AS line FROM w),
lt AS (SELECT path, CAST(line AS BIGINT) AS line, CAST(sum(strlen(p)) OVER (PARTITION BY path ORDER BY line) - strlen(p) AS BIGINT) AS line_start, CAST(sum(strlen(p)) OVER (PARTITION BY path ORDER BY line) AS BIGINT) AS line_end, CASE WHEN ends_with(p, chr(13) || chr(10)) THEN 'CRLF' WHEN ends_with(p, chr(10)) THEN 'LF' WHEN ends_with(p, chr(13)) THEN 'CR' ELSE 'NONE' END AS terminator, p FROM pc)"""

# --- Snapshot and lines -------------------------------------------------------------------------------------------------


@query(f"""WITH {MIXED} SELECT path, line, line_start, line_end, terminator FROM lt""")
def line_index(spark, sf_dir):
    return L.line_table(T.files(spark, sf_dir, terminators=True))


@query(f"""WITH {MIXED} SELECT terminator, count(*) AS lines, count(DISTINCT path) AS files FROM lt GROUP BY 1""")
def line_terminator_histogram(spark, sf_dir):
    return snapshot.terminator_histogram(L.line_table(T.files(spark, sf_dir, terminators=True)))


@query(f"""WITH {MIXED} SELECT path, n AS line_count, line, line_start, line_end FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM lt) WHERE line = CAST(path AS BIGINT) % n + 1""")
def line_bounds(spark, sf_dir):
    f = T.files(spark, sf_dir, terminators=True).withColumn("ends", L.line_ends("bytes"))
    f = f.withColumn("line_count", L.line_count("ends")).withColumn("line", F.col("path").cast("long") % F.col("line_count") + 1)
    return f.select("path", "line_count", "line", L.line_start("ends", F.col("line")).alias("line_start"), L.line_end("ends", F.col("line")).alias("line_end"))


@query(f"""WITH {MIXED}, x AS (SELECT path, doc_id, encode(text) AS b, strlen(text) AS n FROM w), y AS (SELECT path, n, doc_id * 37 % (n + 1) AS p, doc_id * 91 % (n + 1) AS q, b FROM x), z AS (SELECT path, least(p, q) AS s, greatest(p, q) AS e, hex(b[least(p, q) + 1 : greatest(p, q)]) AS h FROM y),
c AS (SELECT path, s, e, list_transform(range(0, length(h) // 2), lambda i: h[2 * i + 1 : 2 * i + 2]) AS v FROM z)
SELECT path, CAST(s AS BIGINT) AS range_start, CAST(e AS BIGINT) AS range_end, CAST(len(list_filter(range(1, len(v) + 1), lambda i: v[i] = '0A' OR (v[i] = '0D' AND coalesce(v[i + 1], '') <> '0A'))) AS BIGINT) AS terminators, CAST(len(list_filter(range(1, len(v) + 1), lambda i: v[i] = '0A' OR (v[i] = '0D' AND coalesce(v[i + 1], '') <> '0A'))) + CASE WHEN len(v) > 0 AND v[len(v)] NOT IN ('0A', '0D') THEN 1 ELSE 0 END AS BIGINT) AS line_count FROM c""")
def range_metrics(spark, sf_dir):
    f = T.files(spark, sf_dir, terminators=True).withColumn("ends", L.line_ends("bytes")).withColumn("id", F.col("path").cast("long")).withColumn("n", F.length("bytes"))
    p, q = F.col("id") * 37 % (F.col("n") + 1), F.col("id") * 91 % (F.col("n") + 1)
    f = f.withColumn("range_start", F.least(p, q)).withColumn("range_end", F.greatest(p, q))
    a, b = F.col("range_start"), F.col("range_end")
    return f.select("path", "range_start", "range_end", L.range_terminators("bytes", "ends", a, b).alias("terminators"), L.range_lines("bytes", "ends", a, b).cast("long").alias("line_count"))


@query(f"""WITH {MIXED} SELECT path, CAST(strlen(text) AS BIGINT) AS byte_count, CAST(len(regexp_extract_all(text, '\\r\\n|\\r|\\n')) AS BIGINT) AS terminator_count FROM w""")
def metrics_fold(spark, sf_dir):
    """Metrics of three pieces of every file, cut anywhere, folded in order: those of the whole."""
    f = T.files(spark, sf_dir, terminators=True).withColumn("n", F.length("bytes")).withColumn("id", F.col("path").cast("long"))
    a = F.col("id") * 13 % (F.col("n") + 1)
    b = a + F.col("id") * 7 % (F.col("n") - a + 1)
    m = L.fold_metrics(F.array(L.metrics(L.cut("bytes", F.lit(0), a)), L.metrics(L.cut("bytes", a, b)), L.metrics(L.cut("bytes", b, F.col("n")))))
    return f.withColumn("m", m).select("path", "m.byte_count", "m.terminator_count")


@query(f"""WITH {FILES} SELECT p.k AS request_id, CAST(p.j - 1 AS INTEGER) AS position, p.path, w.path IS NOT NULL AS exists, w.sha AS sha256, w.n AS byte_length, CASE WHEN w.path IS NOT NULL THEN CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 0 ELSE 1 END AS BIGINT) END AS line_count
FROM (SELECT o_custkey AS k, unnest([1, 2, 3]) AS j, lpad(CAST(unnest([o_orderkey % (SELECT count(*) + 500 FROM documents), o_orderkey % (SELECT count(*) + 500 FROM documents), o_custkey % (SELECT count(*) + 500 FROM documents)]) AS VARCHAR), 8, '0') AS path FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)) p LEFT JOIN w ON w.path = p.path""")
def inspect_files(spark, sf_dir):
    n = F.broadcast(T.table(spark, sf_dir, "documents").agg((F.count(F.lit(1)) + 500).alias("n")))  # 500 of the paths do not exist
    asked = T.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).crossJoin(n)
    a, b = T.path_of(F.col("k") % F.col("n")), T.path_of(F.col("o_custkey") % F.col("n"))
    return snapshot.inspect(asked.select(F.col("o_custkey").alias("request_id"), F.array(a, a, b).alias("paths")), T.files(spark, sf_dir)).drop("identity")


@query(f"""WITH {FILES}, i AS (SELECT path, doc_id % 900 AS inode FROM w) SELECT f.path AS first_path, i.path AS path FROM i JOIN (SELECT inode, min(path) AS path FROM i GROUP BY 1) f ON f.inode = i.inode AND f.path <> i.path""")
def alias_groups(spark, sf_dir):
    return snapshot.aliases(T.files(spark, sf_dir)).select("first_path", "path")


@query(f"""WITH {FILES}, x AS (SELECT path, source AS grp, w.n, length(w.text) - length(replace(w.text, chr(10), '')) + CASE WHEN ends_with(w.text, chr(10)) OR w.text = '' THEN 0 ELSE 1 END AS c FROM w JOIN documents d USING (doc_id)), u AS (SELECT grp, path, count(*) OVER q AS identities, CAST(sum(n) OVER q AS BIGINT) AS bytes, CAST(sum(c) OVER q AS BIGINT) AS lines FROM x WINDOW q AS (PARTITION BY grp ORDER BY path))
SELECT grp AS source, path, identities, bytes, lines, lines * 8 AS index_bytes, CASE WHEN identities > 30 THEN 'identities' WHEN bytes > 60000 THEN 'bytes' END AS exceeded FROM u""")
def snapshot_running_usage(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select(T.path_of(F.col("doc_id")).alias("path"), "source", F.encode("text", "UTF-8").alias("bytes"))
    return snapshot.running_usage(d, "source", {"identities": 30, "bytes": 60000})


@query("""WITH p AS (SELECT page_id, substr(url, 9) AS x FROM pages), q AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '/' || x WHEN 1 THEN x || '/' WHEN 2 THEN '' WHEN 3 THEN '.Control/' || x WHEN 4 THEN 'a/../' || x ELSE 'a/b' END AS path FROM p)
SELECT page_id, path, CASE WHEN strlen(path) > 4096 THEN 'too_long' WHEN path = '' THEN 'empty' WHEN starts_with(path, '/') THEN 'absolute' WHEN len(list_filter(string_split(path, '/'), lambda c: c IN ('', '.', '..'))) > 0 THEN 'component' WHEN lower(string_split(path, '/')[1]) = '.control' THEN 'reserved' END AS problem FROM q""")
def normalize_path_reasons(spark, sf_dir):
    x = F.expr("substr(url, 9)")
    k = F.col("page_id") % 7
    path = F.when(k == 0, F.concat(F.lit("/"), x)).when(k == 1, F.concat(x, F.lit("/"))).when(k == 2, "").when(k == 3, F.concat(F.lit(".Control/"), x)).when(k == 4, F.concat(F.lit("a/../"), x)).otherwise("a/b")
    return T.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("problem", S.path_problem("path"))


# --- Planning -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {FILES}, {OPS} SELECT batch_id, operation_index, 0 AS role, source_path AS path, 'sha256' AS state, source_sha AS value FROM o UNION ALL SELECT batch_id, operation_index, 1, destination_path, 'sha256', destination_sha FROM o""")
def requirements_expand(spark, sf_dir):
    return snapshot.requirements(T.operations(spark, sf_dir))


@query("""WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS batch_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS operation_index, CAST(o_orderkey % 3 AS VARCHAR) AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'must_not_exist' ELSE 'sha256' END AS state FROM orders), p AS (SELECT *, lag(state) OVER (PARTITION BY batch_id, path ORDER BY operation_index) AS before FROM c) SELECT batch_id, path, operation_index, 0 AS role FROM p WHERE before IS NOT NULL AND before <> state""")
def precondition_conflicts(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    index = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    wanted = o.select(F.col("o_custkey").cast("string").alias("batch_id"), index.alias("operation_index"), F.lit(0).alias("role"), (F.col("o_orderkey") % 3).cast("string").alias("path"), F.when(F.col("o_orderkey") % 4 == 0, "must_not_exist").otherwise("sha256").alias("state"), F.lit("").alias("value"))
    return resolve.precondition_conflicts(wanted)


@query(f"""{UP_TO_R} SELECT batch_id, operation_index, source_path, source_start, source_end, payload_sha256 FROM r""")
def resolve_selectors(spark, sf_dir):
    return _plan(spark, sf_dir).resolved.select("batch_id", "operation_index", "source_path", "source_start", "source_end", "payload_sha256")


@query(f"""{UP_TO_R} SELECT batch_id, operation_index, destination_path, CAST(destination_offset AS BIGINT) AS destination_offset, effect, CAST(NULL AS VARCHAR) AS problem FROM r""")
def resolve_anchors(spark, sf_dir):
    return _plan(spark, sf_dir).placed.select("batch_id", "operation_index", "destination_path", "destination_offset", "effect", "problem")


@query(f"""{UP_TO_R} SELECT batch_id, operation_index FROM r WHERE effect = 'no_op'""")
def noop_ops(spark, sf_dir):
    return _plan(spark, sf_dir).placed.filter("effect = 'no_op'").select("batch_id", "operation_index")


@query(f"""{UP_TO_R}, {EVENTS} SELECT batch_id, path, operation_index, event, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM ev""")
def edit_events(spark, sf_dir):
    return resolve.edit_events(_plan(spark, sf_dir).placed)


@query(f"""{UP_TO_E} SELECT batch_id, path, operation_index FROM ov""")
def overlap_conflicts(spark, sf_dir):
    return compose.overlapping_deletions(resolve.edit_events(_plan(spark, sf_dir).placed))


@query(f"""{UP_TO_E} SELECT batch_id, path, operation_index, CAST(off AS BIGINT) AS "offset" FROM ins""")
def insert_in_delete(spark, sf_dir):
    return compose.insertions_in_deletions(resolve.edit_events(_plan(spark, sf_dir).placed))


@query(f"""{UP_TO_S} SELECT batch_id, path, k AS seg, CASE WHEN rk = 0 THEN 'payload' ELSE 'original' END AS seg_class, operation_index, source_path, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM seg""")
def segments(spark, sf_dir):
    return _plan(spark, sf_dir).layout.drop("offset")


@query(f"""{UP_TO_O} SELECT batch_id, path, change_kind, before_length, before_sha256, after_length, after_sha256 FROM out""")
def outputs(spark, sf_dir):
    """The flagship: which documents each batch changes, and what they become."""
    return _plan(spark, sf_dir).outputs


@query(f"""{UP_TO_O} SELECT batch_id, string_agg(path, ',' ORDER BY path) AS paths FROM out WHERE change_kind <> 'unchanged' GROUP BY 1""")
def changed_paths(spark, sf_dir):
    return compose.changed_paths(_plan(spark, sf_dir).changes).filter(F.size("paths") > 0).select("batch_id", F.array_join("paths", ",").alias("paths"))


USAGE = f"""{UP_TO_O}, sc AS (SELECT batch_id, path, count(*) AS segs FROM seg GROUP BY ALL), po AS (SELECT out.batch_id, count(*) AS outputs, count(*) FILTER (WHERE change_kind <> 'unchanged') AS changed_targets, max(after_length) AS output_bytes, sum(after_length) AS total_output_bytes, max(coalesce(segs, 0)) AS output_segments, sum(coalesce(segs, 0)) AS total_segments, sum(512 + strlen(out.path) + 512 * coalesce(segs, 0)) AS ob FROM out LEFT JOIN sc ON sc.batch_id = out.batch_id AND sc.path = out.path GROUP BY 1),
pb AS (SELECT batch_id, count(*) AS operations, sum(1024 + strlen(source_path) + strlen(destination_path)) AS opb FROM r GROUP BY 1),
us AS (SELECT pb.batch_id, operations, coalesce(outputs, 0) AS outputs, coalesce(changed_targets, 0) AS changed_targets, coalesce(output_bytes, 0) AS output_bytes, CAST(coalesce(total_output_bytes, 0) AS BIGINT) AS total_output_bytes, coalesce(output_segments, 0) AS output_segments, CAST(coalesce(total_segments, 0) AS BIGINT) AS total_segments, CAST(512 * operations + 256 * coalesce(outputs, 0) + 96 * coalesce(total_segments, 0) AS BIGINT) AS planning_memory_bytes, CAST(1024 + opb + coalesce(ob, 0) AS BIGINT) AS response_bytes FROM pb LEFT JOIN po ON po.batch_id = pb.batch_id)"""


@query(f"{USAGE} SELECT * FROM us")
def plan_usage(spark, sf_dir):
    return _plan(spark, sf_dir).usage()


@query(f"{USAGE} SELECT batch_id, CASE WHEN changed_targets > 2 THEN 'changed_targets' ELSE 'total_segments' END AS limit_name, CAST(CASE WHEN changed_targets > 2 THEN 2 ELSE 12 END AS BIGINT) AS allowed, CAST(CASE WHEN changed_targets > 2 THEN changed_targets ELSE total_segments END AS BIGINT) AS actual FROM us WHERE changed_targets > 2 OR total_segments > 12")
def limit_violations(spark, sf_dir):
    return accounting.limit_violations(_plan(spark, sf_dir).usage(), {"changed_targets": 2, "total_segments": 12})


@query(f"""{UP_TO_E}, fp AS (SELECT batch_id, 0 AS rank, path, operation_index FROM ov UNION ALL SELECT batch_id, 1, path, operation_index FROM ins) SELECT batch_id, path AS "key", CASE min(rank) WHEN 0 THEN 'OVERLAPPING_DELETIONS' ELSE 'INSERTION_IN_DELETION' END AS problem FROM fp WHERE (batch_id, path) IN (SELECT (batch_id, min(path)) FROM fp GROUP BY batch_id) GROUP BY batch_id, path""")
def first_problems(spark, sf_dir):
    return _plan(spark, sf_dir).problems().select("batch_id", "key", "problem")


@query(f"""{UP_TO_O}, ino AS (SELECT path, doc_id - CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS inode, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS links FROM w), ask AS (SELECT batch_id, source_path AS path FROM o UNION SELECT batch_id, destination_path FROM o),
al AS (SELECT batch_id, min(path) AS path FROM (SELECT ask.batch_id, ask.path, row_number() OVER (PARTITION BY ask.batch_id, inode ORDER BY ask.path) AS k FROM ask JOIN ino ON ino.path = ask.path) WHERE k > 1 GROUP BY 1),
later AS (SELECT batch_id, path, 0 AS rank, 'OVERLAPPING_DELETIONS' AS problem FROM ov UNION ALL SELECT batch_id, path, 1, 'INSERTION_IN_DELETION' FROM ins UNION ALL SELECT out.batch_id, out.path, 2, 'HARD_LINK_NOT_SUPPORTED' FROM out JOIN ino ON ino.path = out.path WHERE links > 1 AND change_kind <> 'unchanged'),
firsts AS (SELECT batch_id, path, problem, row_number() OVER (PARTITION BY batch_id ORDER BY path, rank) AS k FROM later)
SELECT batch_id, '1' || path AS "key", 'FILE_ALIAS' AS problem FROM al UNION ALL SELECT batch_id, path, problem FROM firsts WHERE k = 1 AND batch_id NOT IN (SELECT batch_id FROM al)""")
def problems_by_phase(spark, sf_dir):
    """Files of which some are one file by two paths, and some have two links."""
    shared = F.col("inode_of") - F.when(F.col("inode_of") % 5 == 1, 1).otherwise(0)
    f = T.files(spark, sf_dir).withColumn("inode_of", F.col("path").cast("long"))
    f = f.withColumns({"inode": shared.cast("decimal(20,0)"), "link_count": F.when(F.col("inode_of") % 7 == 0, 2).otherwise(1).cast("decimal(20,0)")}).drop("inode_of")
    return plan(staged(T.operations(spark, sf_dir), "operations", "zstd"), f).problems().select("batch_id", "key", "problem")


def _head(major: int, n: str) -> str:
    """SQL for a CBOR head in hex."""
    m = major * 32
    return f"CASE WHEN {n} < 24 THEN printf('%02x', {m} + {n}) WHEN {n} < 256 THEN printf('%02x%02x', {m + 24}, {n}) WHEN {n} < 65536 THEN printf('%02x%04x', {m + 25}, {n}) WHEN {n} < 4294967296 THEN printf('%02x%08x', {m + 26}, {n}) ELSE printf('%02x%016x', {m + 27}, {n}) END"


def _text(s: str) -> str:
    return f"{_head(3, f'strlen({s})')} || lower(hex(encode({s})))"


def _sha(s: str) -> str:
    return f"'5820' || substr({s}, 8)"


@query(f"""{UP_TO_O}, ip AS (SELECT batch_id, source_path AS path FROM o UNION SELECT batch_id, destination_path FROM o),
pl AS (SELECT batch_id, path, row_number() OVER (PARTITION BY batch_id ORDER BY path) - 1 AS k FROM ip),
i1 AS (SELECT batch_id, {_head(4, "count(*)")} || string_agg('82' || {_text("ip.path")} || '87010100' || '01' || {_head(0, "(doc_id % 900)")} || {_head(0, "n")} || {_sha("sha")}, '' ORDER BY ip.path) AS x FROM ip JOIN w ON w.path = ip.path GROUP BY 1),
p1 AS (SELECT batch_id, {_head(4, "count(*)")} || string_agg('8d' || {_head(0, "operation_index")} || CASE kind WHEN 'move' THEN '01' ELSE '02' END || {_text("source_path")} || '8301' || {_head(0, "l1")} || {_head(0, "l2")} || '8201' || {_sha("source_sha")} || {_head(0, "source_start")} || {_head(0, "source_end")} || {_sha("payload_sha256")} || {_text("destination_path")}
  || CASE anchor WHEN 'file_start' THEN '8101' WHEN 'file_end' THEN '8102' WHEN 'before_line' THEN '8203' || {_head(0, "al")} WHEN 'after_line' THEN '8204' || {_head(0, "al")} ELSE '820500' END || '8201' || {_sha("destination_sha")} || {_head(0, "destination_offset")} || CASE effect WHEN 'changed' THEN '01' ELSE '02' END, '' ORDER BY operation_index) AS x FROM r GROUP BY 1),
s1 AS (SELECT seg.batch_id, seg.path, {_head(4, "count(*)")} || string_agg(CASE WHEN rk = 1 THEN '8401' || {_head(0, "pl.k")} || {_head(0, "s")} || {_head(0, "e")} ELSE '8602' || {_head(0, "seg.operation_index")} || {_head(0, "pl.k")} || {_head(0, "s")} || {_head(0, "e")} || {_sha("r.payload_sha256")} END, '' ORDER BY seg.k) AS x
  FROM seg JOIN pl ON pl.batch_id = seg.batch_id AND pl.path = seg.source_path LEFT JOIN r ON r.batch_id = seg.batch_id AND r.operation_index = seg.operation_index GROUP BY 1, 2),
u1 AS (SELECT out.batch_id, {_head(4, "count(*)")} || string_agg('86' || {_text("out.path")} || {_sha("before_sha256")} || {_sha("after_sha256")} || {_head(0, "after_length")} || CASE change_kind WHEN 'unchanged' THEN '01' WHEN 'modified' THEN '02' ELSE '04' END || coalesce(s1.x, '80'), '' ORDER BY out.path) AS x FROM out LEFT JOIN s1 ON s1.batch_id = out.batch_id AND s1.path = out.path GROUP BY 1)
SELECT p1.batch_id, 'sha256:' || sha256(unhex('860101820000' || i1.x || p1.x || coalesce(u1.x, '80'))) AS plan_sha256 FROM p1 JOIN i1 ON i1.batch_id = p1.batch_id LEFT JOIN u1 ON u1.batch_id = p1.batch_id""")
def plan_digest(spark, sf_dir):
    """Digests of the plans' records; a record of every variant and width is in the tests."""
    return _plan(spark, sf_dir).digests()


@query(f"""{UP_TO_O}, ops AS (SELECT batch_id, string_agg(operation_index || ':' || CASE WHEN effect = 'changed' THEN payload_sha256 ELSE '-' END, ',' ORDER BY operation_index) AS operations FROM r GROUP BY 1),
ou AS (SELECT batch_id, string_agg(path || ':' || CASE change_kind WHEN 'modified' THEN 'modified_existing' WHEN 'emptied' THEN 'emptied_existing' WHEN 'created' THEN 'created_new' ELSE change_kind END, ',' ORDER BY path) AS outputs, count(*) FILTER (WHERE change_kind <> 'unchanged') AS n_changed FROM out GROUP BY 1)
SELECT ops.batch_id, operations, coalesce(outputs, '') AS outputs, CAST(coalesce(n_changed, 0) AS INTEGER) AS n_changed FROM ops LEFT JOIN ou ON ou.batch_id = ops.batch_id""")
def commit_report(spark, sf_dir):
    p = _plan(spark, sf_dir)
    found = reports.commit_report(p.resolved, p.outputs)
    ops = F.array_join(F.transform("operations", lambda o: F.concat_ws(":", o["operation_index"].cast("string"), F.coalesce(o["inserted_payload_sha256"], F.lit("-")))), ",")
    outs = F.array_join(F.transform("outputs", lambda o: F.concat_ws(":", o["path"], o["change_kind"])), ",")
    return found.select("batch_id", ops.alias("operations"), F.coalesce(outs, F.lit("")).alias("outputs"), F.coalesce(F.size("files_changed"), F.lit(0)).alias("n_changed"))


# --- Review -------------------------------------------------------------------------------------------------------------


@query(f"""{UP_TO_R} SELECT batch_id, operation_index, CAST(source_end - source_start AS BIGINT) AS selected_byte_length, CAST(l2 - l1 + 1 AS BIGINT) AS selected_logical_line_count FROM r""")
def review_ops(spark, sf_dir):
    p = _plan(spark, sf_dir)
    return review.review_operations(p.placed, p.files)


@query(f"""{UP_TO_O}, tx AS (SELECT batch_id, path, decode(unhex(bh)) AS a, decode(unhex(h)) AS b FROM outs) SELECT batch_id, path, CAST(length(a) - length(replace(a, chr(10), '')) + CASE WHEN a = '' OR ends_with(a, chr(10)) THEN 0 ELSE 1 END AS BIGINT) AS before_logical_line_count, CAST(length(b) - length(replace(b, chr(10), '')) + CASE WHEN b = '' OR ends_with(b, chr(10)) THEN 0 ELSE 1 END AS BIGINT) AS after_logical_line_count FROM tx""")
def review_outputs(spark, sf_dir):
    p = _plan(spark, sf_dir)
    return review.review_outputs(p.outputs, p.layout, p.files)


@query(f"""{UP_TO_S}, q AS (SELECT *, CASE WHEN lag(k) OVER x = k - 1 AND lag(place) OVER x = place THEN 0 ELSE 1 END AS fresh FROM seg WHERE rk = 0 WINDOW x AS (PARTITION BY batch_id, path ORDER BY k)), z AS (SELECT *, sum(fresh) OVER (PARTITION BY batch_id, path ORDER BY k) - 1 AS g FROM q) SELECT batch_id, path, CAST(g AS BIGINT) AS "group", CAST(min(place) AS BIGINT) AS destination_offset, string_agg(CAST(operation_index AS VARCHAR), ',' ORDER BY k) AS operation_indices FROM z GROUP BY batch_id, path, g""")
def insertion_groups(spark, sf_dir):
    return review.insertion_groups(_plan(spark, sf_dir).layout).withColumn("operation_indices", F.array_join("operation_indices", ","))


def _sides(spark, sf_dir):
    return _plan(spark, sf_dir).sides.select("batch_id", "path", "change_kind", "before", "after")


@query(f"""{UP_TO_O}, s AS (SELECT batch_id, path, string_split(decode(unhex(bh)), chr(10)) AS a0, string_split(decode(unhex(h)), chr(10)) AS b0 FROM outs), t AS (SELECT batch_id, path, list_filter(list_transform(range(1, len(a0) + 1), lambda i: a0[i] || CASE WHEN i < len(a0) THEN chr(10) ELSE '' END), lambda x: x <> '') AS a, list_filter(list_transform(range(1, len(b0) + 1), lambda i: b0[i] || CASE WHEN i < len(b0) THEN chr(10) ELSE '' END), lambda x: x <> '') AS b FROM s),
u AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a)) AS p FROM t), v AS (SELECT *, a[p + 1 :] AS ra, b[p + 1 :] AS rb FROM u), x AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(ra), len(rb)) + 1), lambda i: CASE WHEN i <= len(ra) THEN ra[len(ra) + 1 - i] END IS DISTINCT FROM CASE WHEN i <= len(rb) THEN rb[len(rb) + 1 - i] END)) - 1, len(ra)) AS q FROM v)
SELECT batch_id, path, CAST(p AS BIGINT) AS prefix, CAST(q AS BIGINT) AS suffix, CAST(len(ra) - q AS BIGINT) AS n_removed, CAST(len(rb) - q AS BIGINT) AS n_added, sha256(array_to_string(list_transform(rb[: len(rb) - q], lambda y: rtrim(y, chr(10))), '|')) AS added FROM x""")
def prefix_suffix_diff(spark, sf_dir):
    d = review.prefix_suffix_diff(_sides(spark, sf_dir))
    return d.select("batch_id", "path", "prefix", "suffix", F.size("removed").cast("long").alias("n_removed"), F.size("added").cast("long").alias("n_added"), F.sha2(F.array_join(F.transform("added", lambda x: F.substring(x, F.lit(2), F.length(x) - F.length(F.substring_index(x, " [", -1)) - 3)), "|"), 256).alias("added"))


@query(f"""{UP_TO_O} SELECT batch_id, CASE WHEN bool_or(change_kind <> 'unchanged') THEN 'text' ELSE 'unchanged' END AS mode FROM out GROUP BY 1""")
def binary_mode(spark, sf_dir):
    return review.diff_mode(_sides(spark, sf_dir))


@query("""SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, to_base64(encode(text)[1 : 48]) AS head, to_base64(encode(text)[greatest(1, strlen(text) - 47) : strlen(text)]) AS tail FROM documents""")
def samples_base64(spark, sf_dir):
    return T.files(spark, sf_dir).select("path", S.head_sample("bytes").alias("head"), S.tail_sample("bytes").alias("tail"))


@query(f"""{UP_TO_O} SELECT batch_id, CAST(sum(after_length + before_length) AS BIGINT) AS disk_bytes, sum(after_length + before_length) > 3221225472 AS exceeded FROM out WHERE change_kind <> 'unchanged' GROUP BY 1""")
def projected_disk(spark, sf_dir):
    return accounting.projected_disk(_plan(spark, sf_dir).changes)


# --- Positions and symbols ----------------------------------------------------------------------------------------------

@query(r"""WITH ed AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, string_split(text, chr(10)) AS ls FROM documents), el AS (SELECT path, unnest(range(0, len(ls))) AS line, unnest(ls) AS content FROM ed),
es AS (SELECT *, CAST(sum(strlen(content) + 1) OVER (PARTITION BY path ORDER BY line) AS BIGINT) - strlen(content) - 1 AS line_start, count(*) OVER (PARTITION BY path) AS n FROM el), dn AS (SELECT count(*) AS n FROM documents),
q AS (SELECT l_orderkey * 10 + l_linenumber AS query_id, lpad(CAST(l_orderkey % dn.n AS VARCHAR), 8, '0') AS path, l_partkey AS k FROM lineitem, dn), a AS (SELECT query_id, q.path, k % len(ls) AS line, k % 40 AS ch FROM q JOIN ed ON ed.path = q.path),
f AS (SELECT a.*, line_start, content, list_transform(range(1, least(length(content), 41) + 1), lambda i: CASE WHEN unicode(substr(content, i, 1)) > 65535 THEN 2 ELSE 1 END) AS us, length(content) + length(regexp_replace(content, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units FROM a JOIN es ON es.path = a.path AND es.line = a.line),
g AS (SELECT *, list_transform(range(0, len(us) + 1), lambda i: coalesce(list_sum(us[1 : i]), 0)) AS cum FROM f)
SELECT query_id, path, CAST(line AS BIGINT) AS line, CAST(ch AS BIGINT) AS "character", 'utf-16' AS encoding, CAST(CASE WHEN ch >= units THEN line_start + strlen(content) WHEN list_contains(cum, ch) THEN line_start + strlen(substr(content, 1, list_position(cum, ch) - 1)) END AS BIGINT) AS "offset", CASE WHEN ch < units AND NOT list_contains(cum, ch) THEN 'SPLIT_CHARACTER' END AS problem FROM g""")
def utf16_positions(spark, sf_dir):
    """UTF-16 positions on any line of every row's document; unit tests hold them against Python's own codecs too."""
    lines = P.editor_lines(T.files(spark, sf_dir))
    n_lines = lines.groupBy(F.col("path").alias("n_path")).agg(F.max("line").alias("n_lines"))
    n_docs = F.broadcast(T.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs")))
    # Every lineitem row asks, for any line of its document.
    every = T.table(spark, sf_dir, "lineitem").crossJoin(n_docs).withColumn("path", T.path_of(F.col("l_orderkey") % F.col("n_docs"))).join(n_lines, F.col("path") == F.col("n_path"))
    ask = every.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), "path", (F.col("l_partkey") % F.col("n_lines")).cast("long").alias("line"), (F.col("l_partkey") % 40).cast("long").alias("character"), F.lit("utf-16").alias("encoding"))
    return P.position_to_byte(ask, lines)


def _tree(spark, sf_dir):
    """Regions, nations, suppliers and customers as symbols of one text: ranges by pre-order numbers."""
    region, nation = T.table(spark, sf_dir, "region"), T.table(spark, sf_dir, "nation")
    sup, cus = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "customer")
    leaf = sup.select(F.col("s_nationkey").alias("k"), F.lit(0).alias("g"), F.col("s_suppkey").alias("i"), F.col("s_name").alias("n"), F.lit("method").alias("kind")).unionByName(cus.select(F.col("c_nationkey").alias("k"), F.lit(1).alias("g"), F.col("c_custkey").alias("i"), F.col("c_name").alias("n"), F.lit("field").alias("kind")))
    leaf = leaf.join(F.broadcast(nation), F.col("k") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    own = leaf.select(F.format_string("%02d/%02d/%d/%09d", "r_regionkey", "n_nationkey", "g", "i").alias("key"), F.array("r_name", "n_name", "n").alias("symbol_path"), F.col("n").alias("name"), "kind")
    mid = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.format_string("%02d/%02d", "r_regionkey", "n_nationkey").alias("key"), F.array("r_name", "n_name").alias("symbol_path"), F.col("n_name").alias("name"), F.lit("class").alias("kind"))
    top = region.select(F.format_string("%02d", "r_regionkey").alias("key"), F.array("r_name").alias("symbol_path"), F.col("r_name").alias("name"), F.lit("module").alias("kind"))
    every = own.unionByName(mid).unionByName(top)
    numbered = every.withColumn("region", F.substring("key", 1, 2)).withColumn("start", F.row_number().over(Window.partitionBy("region").orderBy("key")).cast("long"))
    inner = numbered.withColumn("nation", F.when(F.length("key") >= 5, F.substring("key", 1, 5)))
    last_region = F.max("start").over(Window.partitionBy("region"))
    last_nation = F.max("start").over(Window.partitionBy("region", "nation"))
    end = F.when(F.length("key") == 2, last_region + 1).when(F.length("key") == 5, last_nation + 1).otherwise(F.col("start") + 1)
    number = F.when(F.col("kind") == "module", 2).when(F.col("kind") == "class", 5).when(F.col("kind") == "method", 6).otherwise(8)
    span = F.struct(F.lit(0).alias("start_line"), F.col("start").cast("int").alias("start_character"), F.lit(0).alias("end_line"), F.col("end").cast("int").alias("end_character"))
    out = inner.withColumn("end", end).withColumn("lsp_range", span)
    return out.select(F.concat(F.lit("region-"), "region").alias("path"), F.col("start").alias("ordinal"), F.size("symbol_path").alias("depth"), "name", F.lit(None).cast("string").alias("detail"), number.alias("kind_number"), "kind", "symbol_path", "lsp_range", F.col("lsp_range").alias("lsp_selection_range"), "start", "end", F.col("start").alias("selection_start"), F.col("end").alias("selection_end"), F.lit(None).cast("string").alias("problem"))


TREE = """lf AS (SELECT s_nationkey AS k, 0 AS g, s_suppkey AS i, s_name AS n, 'method' AS kind FROM supplier UNION ALL SELECT c_nationkey, 1, c_custkey, c_name, 'field' FROM customer),
al AS (SELECT printf('%02d/%02d/%d/%09d', r_regionkey, n_nationkey, g, i) AS key, r_name || '/' || n_name || '/' || n AS symbol_path, n AS name, kind FROM lf JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT printf('%02d/%02d', r_regionkey, n_nationkey), r_name || '/' || n_name, n_name, 'class' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT printf('%02d', r_regionkey), r_name, r_name, 'module' FROM region),
nm AS (SELECT *, substr(key, 1, 2) AS region, CASE WHEN length(key) >= 5 THEN substr(key, 1, 5) END AS nation, row_number() OVER (PARTITION BY substr(key, 1, 2) ORDER BY key) AS start FROM al),
tr AS (SELECT 'region-' || region AS path, name, kind, symbol_path, start, CASE WHEN length(key) = 2 THEN max(start) OVER (PARTITION BY region) + 1 WHEN length(key) = 5 THEN max(start) OVER (PARTITION BY region, nation) + 1 ELSE start + 1 END AS stop FROM nm)"""


@query(f"""WITH {TREE} SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY start, stop, kind, symbol_path, name) AS INTEGER) AS "row", name, kind, symbol_path, CAST(len(string_split(symbol_path, '/')) - 1 AS INTEGER) AS level, start, stop AS "end" FROM tr""")
def outline(spark, sf_dir):
    return symbols.outline(_tree(spark, sf_dir)).withColumn("symbol_path", F.array_join("symbol_path", "/")).select("path", "row", "name", "kind", "symbol_path", "level", "start", "end")


@query(f"""WITH {TREE} SELECT path, name, kind, start FROM tr WHERE kind IN ('module', 'class')""")
def outline_kind_filter(spark, sf_dir):
    return symbols.outline(_tree(spark, sf_dir), ["module", "class"]).select("path", "name", "kind", "start")


@query(f"""WITH {TREE} SELECT path, name, start FROM tr""")
def adjacent_dedup(spark, sf_dir):
    """Every symbol twice: the second of each pair goes."""
    t = _tree(spark, sf_dir)
    return symbols.distinct_adjacent(t.unionByName(t.withColumn("ordinal", F.col("ordinal") + 1_000_000))).select("path", "name", "start")


@query(f"""WITH {TREE} SELECT n_nationkey AS query_id, path, name, kind, start FROM nation JOIN tr ON name = n_name""")
def name_lookup(spark, sf_dir):
    ask = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.format_string("region-%02d", "n_regionkey").alias("path"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("kind"))
    return symbols.by_name(ask, _tree(spark, sf_dir)).select("query_id", "path", "name", "kind", "start")


ASK = """q AS (SELECT s_suppkey AS query_id, path, s_suppkey * 7919 % n + 1 AS off FROM supplier JOIN (SELECT path, count(*) AS n FROM tr GROUP BY 1) z ON path = printf('region-%02d', s_suppkey % 5))"""


def _ask(spark, sf_dir):
    """Every supplier asks somewhere in its region's whole range."""
    sizes = _tree(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    asked = T.table(spark, sf_dir, "supplier").withColumn("path", F.format_string("region-%02d", F.col("s_suppkey") % 5)).join(sizes, "path")
    return asked.select(F.col("s_suppkey").alias("query_id"), "path", (F.col("s_suppkey") * 7919 % F.col("n") + 1).alias("offset"), F.lit(1 << 40).alias("length"))


@query(f"""WITH {TREE}, {ASK}, m AS (SELECT query_id, tr.path, name, start, stop, rank() OVER (PARTITION BY query_id ORDER BY stop - start) AS r FROM q JOIN tr ON q.path = tr.path AND start <= off AND off < stop) SELECT query_id, path, name, start, stop AS "end" FROM m WHERE r = 1""")
def position_smallest(spark, sf_dir):
    return symbols.by_position(_ask(spark, sf_dir), _tree(spark, sf_dir)).select("query_id", "path", "name", "start", "end")


@query(f"""WITH {TREE}, {ASK} SELECT query_id, tr.path, name, start, stop AS "end" FROM q JOIN tr ON q.path = tr.path AND start <= off AND off < stop""")
def position_all(spark, sf_dir):
    return symbols.by_position(_ask(spark, sf_dir), _tree(spark, sf_dir), smallest=False).select("query_id", "path", "name", "start", "end")


@query(f"""WITH {TREE}, {ASK}, m AS (SELECT query_id, count(*) AS n FROM q JOIN tr ON q.path = tr.path AND start <= off AND off < stop GROUP BY 1) SELECT q.query_id, coalesce(n, 0) AS matches, CASE WHEN coalesce(n, 0) = 0 THEN 'SELECTION_NOT_FOUND' WHEN n > 1 THEN 'SELECTION_AMBIGUOUS' END AS problem FROM q LEFT JOIN m ON m.query_id = q.query_id""")
def ambiguity(spark, sf_dir):
    ask = _ask(spark, sf_dir)
    return symbols.gate(symbols.by_position(ask, _tree(spark, sf_dir), smallest=False), ask, unique=True).drop("candidates")


from . import log_queries, preview_queries, scalar_queries, symbol_queries  # noqa: E402, F401  (they add their own names)
