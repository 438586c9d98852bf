"""From documents to token files: the corpus operators one after the other.

Each stage takes (spark, docs, sf_dir), reads what its predecessor wrote and returns the documents it keeps; the last
returns a row for each document of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartotek.llm import decontamination, mixing, simhash, token_files, toxicity
from kartotek.llm.common import table
from kartotek.llm.queries import END_ID, WORD_TOKENIZER, tokenizer_path
from kartotek.sizing import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    return simhash.simhash_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found in any form."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), all_forms=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each pass over a document, cut where blocks end, with its own n_chars."""
    return mixing.mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the token files."""
    folder = scratch_path(spark, "pipeline-tokens")
    token_files.write_tokens(docs, folder, tokenizer_path(WORD_TOKENIZER), END_ID)
    return token_files.read_digests(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
