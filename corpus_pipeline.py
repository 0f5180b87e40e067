"""From raw documents to sampled token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. The quality and the de-duplication stage drop
documents, decontamination and sanitisation change texts, the last encodes.

Defined cases are those of the operators. De-duplication knows rows by id (null too)
and text: rows equal in both come once, the one whose other columns are first as JSON;
other rows of one id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.llm import decontam, jaccard, pieces, pii, quality
from relgraph.llm.runtime import crc_mod, materialise, prepare, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from two thirds of the labels."""
    prepare(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=lambda c: crc_mod(c, 3) != 1)
    return quality.keep(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies; rows equal in id and text come once."""
    prepare(spark)
    groups = materialise(jaccard.groups(docs), "pipeline-classes")
    gone = groups.where("not leads").select(F.col("doc_id").alias("__id"), F.col("th").alias("__gone")).distinct()
    if gone.count() <= jaccard.BROADCAST_ROWS:  # 16 bytes a row
        gone = F.broadcast(gone)
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (th == F.col("__gone")), "left_anti")
    repeated = groups.where("leads").groupBy("doc_id", "th").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    rest = [F.col(f"`{c}`") for c in kept.columns if c not in ("doc_id", "text")]
    by = F.to_json(F.struct(*rest)) if rest else F.lit("")
    row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in kept.columns)), by)
    return kept.groupBy("doc_id", th.alias("__th"), F.col("text").isNull().alias("__none")).agg(row.alias("__row")).select("__row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that are little else go."""
    prepare(spark)
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and words that disclose it, replaced."""
    prepare(spark)
    return pii.sanitise(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and sampled pieces of every text."""
    prepare(spark)
    return pieces.encode(docs)


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("sentencepiece", encoded),
]

#: A learned classifier and sampled segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
