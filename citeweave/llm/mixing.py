"""Mixing sources to target weights: each document is emitted floor(rate) times, plus one hash-seeded Bernoulli copy.

A source's rate is its target over its size. Sources stand in code-point order, null last, and weigh 3, 1, 2, repeating.
Targets share a budget by weight; none exceeds max_repeat times its source's size, and what it can't take is shared again by
weight among the others, which ends at min(cap, weight * level) with one level for all: prefix sums in order of cap / weight
find that level.

Defined results: a null source is a source of its own, last in order; null texts have size 0; repeated rows with one doc_id
share their draw; a null doc_id draws as the text 'null' would; an empty table gives an empty table; a source without
words has target 0 and rate 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import SUM, scanned
from .common import dropped, sent, staged, words

WEIGHTS = (3, 1, 2)
#: Up to so many sources, their rates (some 50 bytes a row) are sent to every executor; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _running(rows: DataFrame, *order, **sums) -> DataFrame:
    """rows with the sum of each column of sums over the rows before. Rows are dealt by range, so no task sorts all; order must leave no ties."""
    out = scanned(rows, (), order, before=True, **{n: (SUM, c) for n, c in sums.items()})
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})


def targets(sized: DataFrame, weights=WEIGHTS, percent: int = 150, max_repeat: int = 2) -> DataFrame:
    """One row a source: source, source_size, target, rate, as a staged table. sized has source and size."""
    by_source = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    name = F.col("source").asc_nulls_last()
    placed = _running(by_source, name, place=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    capped = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeat).alias("cap")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = staged(_running(capped, F.col("ratio").asc(), name, held=F.lit(1), held_cap=F.col("cap"), held_weight=F.col("weight")))
    size, heavy = (F.lit(x or 0).cast("long") for x in s.agg(F.sum("source_size"), F.sum("weight")).first())
    # the level if exactly the sources before this one are held at their caps; the first that fits counts
    level = (size * percent / 100 - F.col("held_cap")) / (heavy - F.col("held_weight"))
    found = s.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", "held")).first()[0]
    target = F.col("cap").cast("double") if found is None else F.least(F.col("cap").cast("double"), F.lit(found) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = staged(s.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate")))
    dropped(by_source, placed, s)
    return out


def copies(rate, doc_id, seed: int = 0):
    """Column: how often a document is emitted. The draw is a hash of seed and id, so reruns agree."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / float(1 << 48)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def planned(docs: DataFrame, weights=WEIGHTS, percent: int = 150, max_repeat: int = 2, seed: int = 0) -> DataFrame:
    """One row a document: mix_row (its columns), mix_size, source_size, target, mix_copies."""
    base = docs.select(F.col("source"), F.size(words(F.col("text"))).cast("long").alias("size"))
    rates = targets(base, weights, percent, max_repeat).select(F.col("source").alias("m_source"), "source_size", "target", "rate")
    rates = sent(rates, BROADCAST_SOURCES)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), F.size(words(F.col("text"))).cast("long").alias("mix_size"))
    return rows.join(rates, F.col("mix_row.source").eqNullSafe(F.col("m_source"))).withColumn("mix_copies", copies(F.col("rate"), F.col("mix_row.doc_id"), seed)).drop("m_source", "rate")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of docs, each document as often as planned."""
    out = planned(docs, **how).where("mix_copies > 0").withColumn("mix_nth", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return out.select(*[F.col("mix_row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = planned(docs)
    return out.select(F.col("mix_row.doc_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 2 AS cap FROM s),
l AS (SELECT *, coalesce(count(cap) OVER b, 0) AS held,
        ((sum(source_size) OVER ())::BIGINT * 150 / 100 - coalesce(sum(cap) OVER b, 0)::BIGINT) / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, held) FROM l WHERE level * weight <= cap) AS lev FROM l),
t AS (SELECT source, source_size, CASE WHEN lev IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, lev * weight) END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
