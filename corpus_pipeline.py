"""The corpus pipeline: documents in, packed sequences out, one written table between stages.

Every stage takes all that the one before kept. The first four return the columns of
`documents`, in order; a stage that changes texts counts `n_chars` anew. Columns that a table has besides are carried
along under names that no operator uses. Tables without rows give tables without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapscan.llm import decontaminate, minhash, packing, pii, toxicity
from gapscan.llm.common import known_to_workers, written
from gapscan.llm.queries import table, tokenizer_paths

USED = ("doc_id", "text", "lang")


def _carried(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage on columns under safe names; its result under the names of `docs` again."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        known_to_workers(spark)
        names = docs.columns
        safe = [c if c in USED else f"carried_{k}" for k, c in enumerate(names)]
        out = stage(spark, docs.toDF(*safe), sf_dir).select(*safe).toDF(*names)
        if "n_chars" in names:
            counted = F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
            out = out.withColumn("n_chars", counted)
        return out.select(*names)

    return run


@_carried
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier flags go; it learns from the labelled ones among `docs`."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("not flagged")


@_carried
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest id stays; of rows with equal id and text, one. Null ids stay."""
    classes, _ = minhash.near_duplicates(docs.select("doc_id", "text"))
    kept = classes.where(minhash.is_kept(classes)).groupBy(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    kept = written(kept.agg(F.count("*").alias("n")))
    named = docs.where("doc_id is not null").withColumn("digest", minhash.digest("text"))
    named = named.join(kept, (F.col("doc_id") == F.col("kept_id")) & F.col("digest").eqNullSafe(F.col("kept_digest")), "left_semi")
    if not kept.where("n > 1").isEmpty():
        order = Window.partitionBy("doc_id", "digest").orderBy("text")
        named = named.withColumn("kept_row", F.row_number().over(order)).where("kept_row = 1").drop("kept_row")
    return named.drop("digest").unionByName(docs.where("doc_id is null"))


@_carried
def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


@_carried
def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.mask_personal_data(docs, pii.train(pii.labelled_table(spark)))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    known_to_workers(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer_paths())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("personal_data", mask_pii),
    ("packing", pack_documents),
]

#: SQL cannot express a trained classifier; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
