"""Query fan-out, union of hits, and the filter of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def first_by(df: DataFrame, key: str | list[str], *order) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def required(df: DataFrame, what: str) -> DataFrame:
    """df, which must have rows."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def arguments(angles: DataFrame) -> DataFrame:
    """Angles with an argument; there must be some."""
    return required(angles.where(F.coalesce("argument", F.lit("")) != ""), "arguments")


def united(hits: DataFrame, payload: tuple[str, ...]) -> DataFrame:
    """pageid, payload, queries: pages of all queries once, in order of first hit; the first hit's payload wins."""
    row = F.struct(*payload)
    out = hits.groupBy("pageid").agg(
        F.min_by(row, F.struct("query_ord", "hit_ord")).alias("p"),
        F.transform(F.array_sort(F.collect_set(F.struct("query_ord", "query"))), lambda x: x["query"]).alias("queries"),
        F.min(F.struct("query_ord", "hit_ord")).alias("first"),
    )
    return out.select("pageid", "p.*", "queries", F.col("first.query_ord").alias("first_query"), F.col("first.hit_ord").alias("first_hit"))


def with_argument(queries: DataFrame, angles: DataFrame) -> DataFrame:
    """queries (query_ord, query) with argument: that of the first angle whose own queries hold it exactly, else ''."""
    own = angles.select("angle_ord", "argument", F.explode("search_queries").alias("query"))
    return queries.join(first_by(own, "query", "angle_ord").select("query", "argument"), "query", "left").select("query_ord", "query", F.coalesce("argument", F.lit("")).alias("argument"))


def hit_pages(hits: DataFrame, pages: DataFrame, last_wins: bool = False) -> DataFrame:
    """Hits joined to pages by title. Of pages that share a title the first one counts, as the filter takes them, or the last, as the extraction does."""
    order = F.col("page_ord").desc() if last_wins else F.col("page_ord")
    return hits.join(first_by(pages, "title", order), "title")


def filtered(queries: DataFrame, hits: DataFrame, pages: DataFrame, fields: tuple[str, ...], **how) -> tuple[DataFrame, DataFrame]:
    """(kept hits with position, kept pages): each query's hits ranked by its words and its argument's, pruned to the best; pages that no query kept are gone. Texts meet no hits, only their ids do."""
    found = hit_pages(hits.select("query_ord", "hit_ord", "title"), pages.select("pageid", "page_ord", "title"))
    terms = queries.select("query_ord", F.array("query", "argument").alias("terms"))
    best = ranked(pages.select(F.col("pageid").alias("doc_id"), *fields), found.select("query_ord", F.col("pageid").alias("doc_id"), F.col("hit_ord").alias("doc_ord")), terms, fields, **how)
    kept = found.join(best.select("query_ord", F.col("doc_ord").alias("hit_ord"), "position"), ["query_ord", "hit_ord"])
    return kept, pages.join(kept.select("pageid").distinct(), "pageid", "left_semi")


def pruned(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """query_ord, titles (best first): the hits that the filter left of each query. A query without hits isn't there, one whose pages all failed has none."""
    best = kept.groupBy("query_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: x["title"]).alias("titles"))
    return hits.select("query_ord").distinct().join(best, "query_ord", "left").select("query_ord", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))


def looked_up(rows: DataFrame, table: DataFrame, key: str, made: dict) -> DataFrame:
    """rows with the table's columns by exact key; where it has none, those of made (columns over rows)."""
    wanted = [c for c in table.columns if c != key]
    found = first_by(table, key, *wanted).withColumn("_has", F.lit(True))
    kept = [c for c in rows.columns if c not in wanted]
    return rows.join(found.withColumnsRenamed({c: f"_{c}" for c in wanted}), key, "left").select(*kept, *[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(made[c]).alias(c) for c in wanted])
