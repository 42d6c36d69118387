"""Named queries on previews and manifests, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from .named import query
from .operators import journal, manifest, preview, reports
from .queries import UP_TO_O, _plan

#: Small, so that batches end below, at and above them.
WORK, BYTES = 30_000, 2_500

LINES = f"""{UP_TO_O}, sd AS (SELECT batch_id, path, strlen(decode(unhex(bh))) + strlen(decode(unhex(h))) AS rd, string_split(decode(unhex(bh)), chr(10)) AS a0, string_split(decode(unhex(h)), chr(10)) AS b0 FROM outs WHERE h <> bh),
t AS (SELECT batch_id, path, rd, list_filter(list_transform(range(1, len(a0) + 1), lambda i: a0[i] || CASE WHEN i < len(a0) THEN chr(10) ELSE '' END), lambda x: x <> '') AS a, list_filter(list_transform(range(1, len(b0) + 1), lambda i: b0[i] || CASE WHEN i < len(b0) THEN chr(10) ELSE '' END), lambda x: x <> '') AS b FROM sd),
u AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a)) AS p FROM t), v AS (SELECT *, a[p + 1 :] AS ra, b[p + 1 :] AS rb FROM u),
x AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(ra), len(rb)) + 1), lambda i: CASE WHEN i <= len(ra) THEN ra[len(ra) + 1 - i] END IS DISTINCT FROM CASE WHEN i <= len(rb) THEN rb[len(rb) + 1 - i] END)) - 1, len(ra)) AS q FROM v),
y AS (SELECT batch_id, path, rd, list_concat(['--- ' || path || ' (before)', '+++ ' || path || ' (after)', '@@ -' || (p + 1) || ',' || (len(ra) - q) || ' +' || (p + 1) || ',' || (len(rb) - q) || ' @@'], list_concat(list_transform(ra[: len(ra) - q], lambda z: '-' || rtrim(z, chr(10)) || CASE WHEN ends_with(z, chr(10)) THEN ' [LF]' ELSE ' [NONE]' END), list_transform(rb[: len(rb) - q], lambda z: '+' || rtrim(z, chr(10)) || CASE WHEN ends_with(z, chr(10)) THEN ' [LF]' ELSE ' [NONE]' END))) AS ls FROM x),
ck AS (SELECT batch_id, path, 0 AS seq, NULL AS text, rd AS work FROM y UNION ALL SELECT batch_id, path, seq, t, strlen(t) FROM (SELECT batch_id, path, unnest(range(1, len(ls) + 1)) AS seq, unnest(ls) || chr(10) AS t FROM y)),
cs AS (SELECT *, coalesce(strlen(text), 0) AS raw, coalesce(strlen(text) + 1 + length(text) - length(replace(text, '"', '')) + length(text) - length(replace(text, chr(92), '')) + length(text) - length(replace(text, chr(9), '')), 0) AS json FROM ck),
up AS (SELECT *, sum(work) OVER o AS wu, sum(raw) OVER o AS ru, sum(json) OVER o AS ju FROM cs WINDOW o AS (PARTITION BY batch_id ORDER BY path, seq)),"""


def _cut(work: int, most: int) -> str:
    return f"""{LINES} mk AS (SELECT *, CASE WHEN wu > {work} THEN 'work' WHEN ru > {most} OR ju > {most} THEN 'output' END AS spent FROM up),
ct AS (SELECT batch_id, count(*) FILTER (WHERE spent IS NULL AND seq > 0) AS chunks, coalesce(string_agg(text, '' ORDER BY path, seq) FILTER (WHERE spent IS NULL AND seq > 0), '') AS text, arg_min(spent, (path, seq)) FILTER (WHERE spent IS NOT NULL) AS truncation FROM mk GROUP BY 1)"""


@query(f"""{_cut(WORK, BYTES)} SELECT batch_id, chunks, sha256(text) AS text_sha256, CAST(strlen(text) AS BIGINT) AS raw_bytes, truncation FROM ct""")
def diff_budget(spark, sf_dir):
    """Diffs cut by a small budget: by the work of reading, by their text, or not at all."""
    p = _plan(spark, sf_dir)
    chunks = preview.diff_chunks(p.sides, BYTES, WORK)
    budgets = p.outputs.filter("change_kind <> 'unchanged'").select("batch_id").distinct().withColumn("most", F.lit(BYTES).cast("long"))
    cut = preview.cut_to_budget(chunks, budgets, WORK)
    return cut.select("batch_id", "chunks", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("raw_bytes"), "truncation")


def _preview_sql() -> str:
    from .queries import ORACLE_SQL

    digests = ORACLE_SQL["plan_digest"]
    head = digests[: digests.rindex("SELECT p1.batch_id")]
    assert head.startswith(UP_TO_O)
    rest = head[len(UP_TO_O) :].rstrip()
    sql = _cut(preview.DIFF_WORK, preview.DIFF_BYTES)[len(UP_TO_O) :]
    json_ops = """'{"operation_index":' || operation_index || ',"kind":"' || kind || '","source_path":"' || source_path || '","source_start":' || source_start || ',"source_end":' || source_end || ',"destination_path":"' || destination_path || '","destination_offset":' || destination_offset || ',"effect":"' || effect || '","selected_payload_sha256":"' || payload_sha256 || '"}'"""
    json_outs = """'{"path":"' || path || '","change_kind":"' || CASE change_kind WHEN 'modified' THEN 'modified_existing' WHEN 'emptied' THEN 'emptied_existing' ELSE change_kind END || '","before_length":' || before_length || ',"before_sha256":"' || before_sha256 || '","after_length":' || after_length || ',"after_sha256":"' || after_sha256 || '"}'"""
    return f"""{UP_TO_O}{rest}{sql}, dg AS (SELECT p1.batch_id, 'sha256:' || sha256(unhex('860101820000' || i1.x || p1.x || coalesce(u1.x, '80'))) AS plan_sha256 FROM p1 JOIN i1 ON i1.batch_id = p1.batch_id LEFT JOIN u1 ON u1.batch_id = p1.batch_id),
jo AS (SELECT batch_id, '[' || string_agg({json_ops}, ',' ORDER BY operation_index) || ']' AS ops FROM g GROUP BY 1), ju AS (SELECT batch_id, '[' || string_agg({json_outs}, ',' ORDER BY path) || ']' AS outs FROM out GROUP BY 1),
pv AS (SELECT jo.batch_id, CASE WHEN ct.batch_id IS NULL THEN 'unchanged' ELSE 'text' END AS mode, ct.truncation, '{{"protocol_version":1,"plan_hash_version":1,"plan_sha256":"' || plan_sha256 || '","workspace_identity_hash":"{WORKSPACE}","resolved_operations":' || ops || ',"outputs":' || coalesce(outs, '[]') || ',"diff":{{"kind":"text","text":"' || replace(replace(replace(replace(coalesce(ct.text, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '","summary":null}},"warnings":[]}}' || chr(10) AS response
  FROM jo JOIN dg ON dg.batch_id = jo.batch_id LEFT JOIN ju ON ju.batch_id = jo.batch_id LEFT JOIN ct ON ct.batch_id = jo.batch_id)
SELECT batch_id, mode, truncation AS reason, CAST(strlen(response) AS BIGINT) AS n_bytes, sha256(response) AS response_sha256 FROM pv"""


WORKSPACE = "sha256:" + "0" * 64


def previews(spark, sf_dir):
    """Every batch's whole response without a review."""
    made = preview.preview(_plan(spark, sf_dir), WORKSPACE, with_review=False)
    return made.select("batch_id", "mode", "reason", F.octet_length("response").cast("long").alias("n_bytes"), F.sha2("response", 256).alias("response_sha256"))


query(_preview_sql())(previews)


def _commit_sql() -> str:
    sql = _preview_sql()
    digests = sql[sql.index("dg AS (") : sql.index("jo AS (")].rstrip().rstrip(",")
    from .queries import ORACLE_SQL

    plans = ORACLE_SQL["plan_digest"]
    base = plans[: plans.rindex("SELECT p1.batch_id")].rstrip()
    outs = sql[sql.index("ju AS (") : sql.index("pv AS (")].rstrip().rstrip(",")
    ops = sql[sql.index("jo AS (") : sql.index(", ju AS (")]
    ops = ops.replace("""|| payload_sha256 || '"}'""", """|| payload_sha256 || '","inserted_payload_sha256":' || CASE WHEN effect = 'changed' THEN '"' || payload_sha256 || '"' ELSE 'null' END || '}'""")
    assert "inserted_payload_sha256" in ops
    return f"""{base}, {digests}, {ops}, {outs}, fc AS (SELECT batch_id, '[' || string_agg('"' || path || '"', ',' ORDER BY path) || ']' AS changed, '{{' || string_agg('"' || path || '":420', ',' ORDER BY path) || '}}' AS modes FROM out WHERE change_kind <> 'unchanged' GROUP BY 1)
SELECT jo.batch_id, sha256('{{"protocol_version":1,"plan_hash_version":1,"plan_sha256":"' || plan_sha256 || '","workspace_identity_hash":"{WORKSPACE}","resolved_operations":' || ops || ',"outputs":' || coalesce(outs, '[]') || ',"diff":{{"kind":"omitted","text":null,"summary":null}},"warnings":[],"transaction_id":' || CASE WHEN changed IS NULL THEN 'null,"transaction_state":"no_op"' ELSE '"' || lpad(jo.batch_id, 32, '0') || '","transaction_state":"committed"' END
  || ',"files_changed":' || coalesce(changed, '[]') || ',"preserved_permission_modes":' || CASE WHEN CAST(jo.batch_id AS BIGINT) % 2 = 0 THEN coalesce(modes, '{{}}') ELSE '{{}}' END || ',"recoverability_status":"complete","visibility":"recoverable_not_atomic"}}' || chr(10)) AS response_sha256 FROM jo JOIN dg ON dg.batch_id = jo.batch_id LEFT JOIN ju ON ju.batch_id = jo.batch_id LEFT JOIN fc ON fc.batch_id = jo.batch_id"""


def commit_responses(spark, sf_dir):
    """Every batch's whole report; batches of even number tell the modes of what they changed."""
    p = _plan(spark, sf_dir)
    changed = p.outputs.filter("change_kind <> 'unchanged'")
    transactions = changed.select("batch_id").distinct().withColumn("transaction_id", F.lpad("batch_id", 32, "0"))
    modes = changed.filter(F.col("batch_id").cast("long") % 2 == 0).select("batch_id", "path", F.lit(420).alias("mode"))
    return reports.commit_responses(p, WORKSPACE, transactions, modes).select("batch_id", F.sha2("response", 256).alias("response_sha256"))


query(_commit_sql())(commit_responses)


MAGIC = b"QSREC\0"


@query(f"""{UP_TO_O}, ip AS (SELECT batch_id, source_path AS path FROM o UNION SELECT batch_id, destination_path FROM o), pl AS (SELECT batch_id, path, row_number() OVER (PARTITION BY batch_id ORDER BY path) - 1 AS k FROM ip),
sg AS (SELECT seg.batch_id, seg.path, string_agg(pl.k || ':' || s || ':' || e || ':' || coalesce(CAST(operation_index AS VARCHAR), '-'), ';' ORDER BY seg.k) AS x FROM seg JOIN pl ON pl.batch_id = seg.batch_id AND pl.path = seg.source_path GROUP BY 1, 2),
tg AS (SELECT out.*, row_number() OVER (PARTITION BY out.batch_id ORDER BY out.path) - 1 AS t FROM out WHERE change_kind <> 'unchanged'),
al AS (SELECT tg.batch_id, string_agg(t || ' ' || tg.path || ' ' || before_length || '>' || after_length || ' ' || printf('candidate-%08d', t) || ' ' || coalesce(x, ''), ',' ORDER BY t) AS targets, count(*) AS n_targets FROM tg LEFT JOIN sg ON sg.batch_id = tg.batch_id AND sg.path = tg.path GROUP BY 1),
il AS (SELECT ip.batch_id, string_agg(ip.path || ' 1:' || (doc_id % 900) || ' ' || n, ',' ORDER BY ip.path) AS inputs FROM ip JOIN w ON w.path = ip.path GROUP BY 1)
SELECT lpad(al.batch_id, 32, '0') AS transaction_id, inputs, targets, CAST(n_targets AS INTEGER) AS n_targets, CAST(NULL AS VARCHAR) AS problem FROM al JOIN il ON il.batch_id = al.batch_id""")
def manifest_build(spark, sf_dir):
    """Every batch's manifest, written as a record, read again and checked."""
    from .staging import staged

    p = _plan(spark, sf_dir)
    made = manifest.manifests(p, p.sound.select("batch_id").distinct().withColumn("transaction_id", F.lpad("batch_id", 32, "0")))
    read = staged(manifest.loaded(manifest.stored(made, MAGIC), MAGIC), "manifests")
    wrong = journal.manifest_problems(read.filter("problem is null").drop("problem", "record")).select(F.col("transaction_id").alias("w_id"), F.col("problem").alias("w_problem"))
    checked = read.join(wrong, F.col("transaction_id") == F.col("w_id"), "left")
    inputs = F.array_join(F.transform("inputs", lambda i: F.concat_ws(" ", i["path"], i["file_identity"], i["length"].cast("string"))), ",")
    segment = lambda s: F.concat_ws(":", s["input_index"].cast("string"), s["start"].cast("string"), s["end"].cast("string"), F.coalesce(s["operation_index"].cast("string"), F.lit("-")))
    targets = F.array_join(F.transform("targets", lambda t: F.concat(t["target_index"].cast("string"), F.lit(" "), t["path"], F.lit(" "), t["original_length"].cast("string"), F.lit(">"), t["candidate_length"].cast("string"), F.lit(" "), t["candidate_name"], F.lit(" "), F.array_join(F.transform(t["segments"], segment), ";"))), ",")
    return checked.select("transaction_id", inputs.alias("inputs"), targets.alias("targets"), F.size("targets").alias("n_targets"), F.coalesce("problem", "w_problem").alias("problem"))
