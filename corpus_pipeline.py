"""From raw documents to token ids: stages that each apply one operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe, decontaminate, neardup, quality, secrets
from panelcast.llm.queries import tokenizer_path
from panelcast.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, labels, keep=COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; rows without an id stay."""
    gone = cut(neardup.near_duplicates(docs, k=5, percent=80).filter("not kept").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    leaks = decontaminate.passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = cut(leaks.filter("doc_id is not null").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` is counted again where the text changed."""
    told = secrets.redact(secrets.scan(docs, keep=("lang", "source", "n_chars")))
    n_chars = F.when(F.col("n_spans") > 0, F.length("text").cast("long")).otherwise(F.col("kept.n_chars"))
    return told.select("doc_id", "text", F.col("kept.lang").alias("lang"), F.col("kept.source").alias("source"), n_chars.alias("n_chars"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the checksums of ids and decoded text."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding and decoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs


ORACLE_SQL = None  # near-duplicate search and edit distances go beyond SQL; tests/llm compares the stages with brute force
