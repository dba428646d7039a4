"""Readers and writers for run artifacts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed

PLAN = "topic string, generated_at timestamp, search_queries array<string>, angles array<struct<argument: string, search_queries: array<string>>>"
RAW_PAGE = "pageid long, title string, extract string, revisions array<struct<revid: long, timestamp: string, content: string, slots: struct<main: struct<`*`: string, content: string>>>>"
_BAD = "_bad"


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, with file; files that can't be read are left out."""
    rows = spark.read.schema(f"{schema}, {_BAD} string").option("multiLine", True).option("columnNameOfCorruptRecord", _BAD).json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file")).where(f"{_BAD} is null").drop(_BAD)


def write_json(df: DataFrame, path: str, by: str = "slug") -> None:
    """One folder of JSON lines for each value of a column."""
    df.write.partitionBy(by).json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are neither blank nor comments."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias("line")).where("line <> '' and not startswith(line, '#')")


def yaml_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """YAML files as rows of the schema, with file, where the yaml library is installed; bad files are left out."""
    import importlib.util

    if importlib.util.find_spec("yaml") is None:
        raise ImportError("reading YAML needs the yaml library")

    def load(batches):
        import json

        import yaml

        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                try:
                    found = yaml.safe_load(text)
                    out.append(json.dumps(found, default=str) if isinstance(found, dict) else None)
                except yaml.YAMLError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], names=["json", "file"])

    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return whole.mapInArrow(load, "json string, file string").where("json is not null").select(F.from_json("json", schema).alias("x"), "file").select("x.*", "file")


def write_yaml(df: DataFrame, path: str, by: str = "slug") -> None:
    """One folder of YAML text for each value of a column: a row is a document, its fields in flow style (JSON is YAML)."""
    rest = [c for c in df.columns if c != by]
    df.select(by, F.concat(F.lit("--- "), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("value")).write.partitionBy(by).text(path)


def pages(raw: DataFrame) -> DataFrame:
    """Raw search answers as pages: source is the main slot's text under either name, else the revision's, trimmed; none is empty."""
    r = F.get("revisions", F.lit(0))
    source = F.coalesce(r["slots"]["main"]["*"], r["slots"]["main"]["content"], r["content"], F.lit(""))
    return raw.select("pageid", "title", "extract", trimmed(source).alias("source"), r["revid"].alias("revision_id"), F.to_timestamp(r["timestamp"]).alias("last_modified"))


def bucket_lines(report: DataFrame) -> DataFrame:
    """bucket, rank, line: count, origin and, where there is an issue, the issue with its detail, parted by tabs."""
    issue = F.trim(F.concat_ws(" ", F.when(F.col("bucket").isin("invalid", "forbidden", "timeout"), F.coalesce("issue_type", F.lit("unknown"))), F.nullif("detail", F.lit(""))))
    issue = F.when(F.col("bucket").isin("invalid", "forbidden", "timeout"), issue)
    return report.select("bucket", "rank", F.concat_ws("\t", F.col("n").cast("string"), "origin", issue).alias("line"))


def write_buckets(report: DataFrame, path: str) -> None:
    """One folder of bucket_lines() a bucket, in order of rank; a bucket's files follow one another, so no task holds a whole one."""
    bucket_lines(report).repartitionByRange("bucket", "rank").sortWithinPartitions("bucket", "rank").select("bucket", F.col("line").alias("value")).write.partitionBy("bucket").text(path)


def folder_name(low_pass: int | None = None, full_url: bool = False, limit: int | None = None) -> str:
    """Name of a report's folder from its settings."""
    parts = [f"low-pass-{low_pass}" if low_pass else "", "full-url" if full_url else "", f"limit-{limit}" if limit else ""]
    return "_".join(p for p in parts if p) or "base"
