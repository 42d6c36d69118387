"""A corpus pipeline over ``documents``: five stages, each on all rows that the one before it kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents`` (further columns of ``docs`` are kept); null and empty texts pass the filters, since no
stage has anything against them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bpe, decontaminate, near_duplicates, secrets, toxicity
from quillspan.llm._common import shared_dir, staged, table
from quillspan.staging import scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine predicts toxic go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    marked = docs.withColumn("__score", toxicity.score_column(model)(F.col("text")))
    return marked.filter(F.col("__score") < toxicity.CUT).drop("__score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays, of those that share it the one of one text.

    Documents are told by id and text; of rows that are equal in both, one stays.
    """
    table(spark, sf_dir, "documents")  # sets the session up for Arrow batches
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_text"))
    kept = near_duplicates.classes(docs).filter(first).groupBy(F.col("doc_id").alias("__key"), F.col("text_key").alias("__text")).agg(F.count(F.lit(1)).alias("__rows"))
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    kept = staged(kept, "kept")
    out = docs.join(kept.drop("__rows").hint("merge"), (text == F.col("__text")) & F.col("doc_id").eqNullSafe(F.col("__key")), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if kept.filter("__rows > 1").limit(1).count() else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, by the operator's rule, go; of rows that share an id, those whose own text does."""
    found = decontaminate.contaminated_rows(docs, table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("__key"), F.col("text_key").alias("__text")).distinct()
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bad, (text == F.col("__text")) & F.col("doc_id").eqNullSafe(F.col("__key")), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials of few owners are cut out of their texts; widely copied examples and all documents stay."""
    given = docs.select("doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repo"))
    return secrets.redact(docs, secrets.verdicts(given, "source", "repo"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what is left."""
    import public_tokenizers as P

    return bpe.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]

#: Trained scores cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage wrote besides goes when it has ended."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/quillspan/pipeline-{name}-{uuid.uuid4().hex}"
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
