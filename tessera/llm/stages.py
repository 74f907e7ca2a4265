"""Stages of the corpus pipeline; each calls one operator and works on all the documents it is given.

All of them take documents with doc_id and text and any other columns, which pass through unchanged, whatever their names (a clash
with a name that an operator uses inside does no harm). Null and empty texts are clean and alone: no stage drops them. A text of any
length is judged whole. Repeated rows are judged each, and near duplicates keep one of them. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, near_dedup, packing, secrets, toxicity
from .tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below a half, by a model fitted on these documents' labels. A null doc_id has no label;
    without labels of both classes nothing is dropped."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text")
    return toxicity.score(whole, model).filter("score < 0.5").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group by doc_id (a null doc_id comes last); documents without words all stay."""
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark windows. Without benchmark items all stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked; n_chars, if there is such a column, follows the text. A null source
    is an owner of its own, a null doc_id a repository of its own; without a source column all have one owner."""
    named = docs if "source" in docs.columns else docs.withColumn("source", F.lit(None).cast("string"))
    masked = secrets.redact(named).select(*(F.col(f"`{c}`") for c in docs.columns))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut and placed in training sequences; a null text gives the end id alone."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 1)
