"""The corpus pipeline: toxicity, line de-duplication, near-duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last
return the columns of documents. Null and empty texts pass every stage unless one rejects them; rows
that repeat a doc_id share its fate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, trained on these documents' labels, predicts to be toxic go."""
    from pagewarden.llm.toxicity import score_toxicity

    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing else is left."""
    from pagewarden.llm.lines import line_dedup as dedup

    out = dedup(docs)
    out = out.filter((F.col("lines_deleted") == 0) | (F.length("text_kept") > 0))
    changed = F.col("lines_deleted") > 0
    return out.select("doc_id", F.col("text_kept").alias("text"), "lang", "source", F.when(changed, F.length("text_kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near-duplicates (five words, similarity 0.8) the smallest doc_id stays."""
    from pagewarden.llm.neardup import near_duplicates

    gone = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by probabilities calibrated to tempered source, language and topic shares."""
    from pagewarden.llm.mixing import mix

    return mix(docs).filter("kept").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded; each row says whether decoding gives the text back."""
    import public_tokenizers

    from pagewarden.llm.bpe import round_trip

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = round_trip(docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)), path, pattern, drop=True)
    same = F.sha2("decoded", 256) == F.col("digest")
    return out.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("decodes"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokens", tokens)]

#: Training a network and doubling ranks can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    from pagewarden.llm.common import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
