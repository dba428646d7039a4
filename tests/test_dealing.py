"""Slow rows of tables that are small on disk go to all cores."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from citeweave import queries
from citeweave.functions import text


@pytest.mark.parametrize("name", ["feed_arguments", "feed_articles"])
def test_answers_are_dealt(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) >= min(8, spark.sparkContext.defaultParallelism) and max(tasks) < 2 * sum(tasks) / len(tasks)


def test_slugs_name_their_characters(spark):
    assert not re.search("[a-z0-9]-[a-z0-9]", text.NOT_SLUG)
    cases = {" A  b-c ": "a-b-c", "don't--stop!": "dont-stop", "\u2003x\u00a0y_z": "x-yz", "-!-": "untitled", "": "untitled", "\u00e9\u0130 9": "i-9", None: "untitled"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.slug(F.col("t"))).collect()} == cases
