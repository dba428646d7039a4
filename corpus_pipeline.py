"""A training corpus from documents in five stages: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the columns of documents. Its decisions take effect: documents
that break a rule go, one document of each near-duplicate group stays, personal data becomes its kind in brackets (n_chars follows), documents are repeated or left out as the mix asks, and the rest is packed.
Columns of other names, whatever they are called, pass through all stages but the last. An empty table gives an empty one at every stage; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import mixing, neardup, packing, pii, quality
from citeweave.llm.common import dropped, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule, all columns as they are. A null or empty text is too short and goes; repeated rows are judged each on its own; an empty table stays empty."""
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (80 per cent of shingles of five words), the one with the smallest doc_id; rows that share it are cut to the one with the least text, so reruns agree. Null, empty and blank texts and rows without doc_id stay."""
    return neardup.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text with its personal data as kinds in brackets; n_chars follows. Null texts stay null, their n_chars too; repeated rows are each redacted; no row goes. docs needs the columns text and n_chars."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks, in whole copies. A null source is one of its own; texts without words have no size and are emitted by their source's rate; repeated rows of one doc_id share their draw."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of 1,024 ids. Null and empty texts have the end id alone; repeated rows are packed each on its own."""
    return packing.packed(docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Packing runs a tokenizer, which SQL can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one returns is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
            if before is not None:
                dropped(before)
            before = docs
    return docs
