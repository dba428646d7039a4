"""From search terms to cited paragraphs: matching, probing, acceptance in two rounds, and the flat list for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import WS, citation_key, clean_content
from ..staging import sent, staged
from .grams import containing
from .retrieval import first_by

TYPES = ("web", "news", "journal", "magazine", "report", "dictionary", "encyclopedia")


#: Up to so many terms are sent to every executor; more are joined by a shuffle.
BROADCAST_TERMS = 10_000


def matched(terms: DataFrame, hits: DataFrame | None, pages: DataFrame, types=TYPES, patterns=urls.EXCLUDED, min_length: int = 5, indexed: bool = False) -> DataFrame:
    """Candidates: term_ord, term, hit_ord, para_ord, cite_ord, link, title, content, article_title, section.

    terms: term_ord, query_ord, term. A paragraph matches if it holds one of the term's longer words; a term without such words matches nothing. pages as wikitext.with_paragraphs() gives them.
    hits: query_ord, hit_ord, pageid; without them (None), pages have a column hits, an array of (query_ord, hit_ord), and paragraphs meet the terms where they are, unshuffled.
    ``indexed`` gives the same rows for many terms: a page's paragraphs and its terms' words meet by grams, and only those that share one are searched.
    """
    if indexed and hits is None:
        raise ValueError("an index takes hits as a table")
    words = F.filter(F.split(F.lower(F.trim(F.coalesce("term", F.lit("")))), f"{WS}+"), lambda w: F.length(w) >= min_length)
    known = terms.withColumn("words", words).where(F.size("words") > 0)
    # citations that can't be candidates go before anything is joined
    each = F.transform("cites", lambda c, i: F.struct(i.alias("cite_ord"), c["type"].alias("type"), c["url"].alias("link"), c["blurb"].alias("title")))
    fit = F.filter(each, lambda c: c["type"].isin(*types) & c["link"].startswith("http") & ~urls.excluded(c["link"], patterns))
    own = ["hits"] if hits is None else []
    paras = pages.select("pageid", F.col("title").alias("article_title"), *own, F.explode("paragraphs").alias("p")).select("pageid", "article_title", *own, "p.para_ord", "p.section", "p.text", "p.content", "p.cites")
    paras = paras.select("pageid", "article_title", *own, "para_ord", "section", "content", F.lower("text").alias("low"), fit.alias("cites")).where(F.size("cites") > 0)
    if hits is None:
        paras = paras.withColumn("h", F.explode("hits")).select("*", "h.*").drop("h", "hits")
        asked = known.select("query_ord", "term_ord", "term", "words")
    else:
        asked = known.join(hits.select("query_ord", "hit_ord", "pageid"), "query_ord")
    if indexed:
        each = asked.select("pageid", "term_ord", "term", "hit_ord", F.explode(F.array_distinct("words")).alias("word"))
        pairs = containing(paras, each, "low", "word", ("pageid", "para_ord"), on=("pageid",))
        found = pairs.select("t.*", "n.term_ord", "n.term", "n.hit_ord").dropDuplicates(["term_ord", "hit_ord", "pageid", "para_ord"])
    elif hits is None:
        found = paras.join(sent(asked, BROADCAST_TERMS), "query_ord").where(F.exists("words", lambda w: F.contains(F.col("low"), w)))
    else:
        found = asked.join(paras, "pageid").where(F.exists("words", lambda w: F.contains(F.col("low"), w)))
    out = found.select("term_ord", "term", "hit_ord", "para_ord", F.explode("cites").alias("c"), "content", "article_title", "section")
    return out.select("term_ord", "term", "hit_ord", "para_ord", "c.cite_ord", "c.type", "c.link", "c.title", "content", "article_title", "section")


def batch(candidates: DataFrame, top: int = 6) -> DataFrame:
    """The first candidates of each term in page and paragraph order, with their rank."""
    order = Window.partitionBy("term_ord").orderBy("hit_ord", "para_ord", "cite_ord")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def accepted(batches: DataFrame, assessments: DataFrame) -> DataFrame:
    """Candidates whose link passed, each citation once: the first round, then the first term, then the best rank keeps it."""
    good = assessments.where(F.col("link_status").isin("probably_valid", "whitelisted")).select(F.col("url").alias("link")).distinct()
    return first_by(batches.withColumn("key", citation_key(F.col("link"), F.col("title"))).join(good, "link", "left_semi"), "key", "round", "term_ord", "rank")


def extracted(candidates: DataFrame, assessments: DataFrame, top: int = 6, least: int = 0) -> DataFrame:
    """Accepted citations of two rounds. Terms that got fewer than least in the first are given their next candidates that neither round has tried or accepted."""
    one = batch(candidates, top).withColumn("round", F.lit(1))
    if least <= 0:
        return accepted(one, assessments)
    one = staged(one)  # top rows a term at most, as what is made of them
    got = staged(accepted(one, assessments))
    short = candidates.select("term_ord").distinct().join(got.groupBy("term_ord").agg(F.count("*").alias("n")), "term_ord", "left").where(F.coalesce("n", F.lit(0)) < least).select("term_ord")
    key = citation_key(F.col("link"), F.col("title"))
    few = lambda df: sent(df, top * BROADCAST_TERMS)  # noqa: E731, candidates stay where they are: a term may have most of them
    rest = candidates.join(few(staged(short)), "term_ord", "left_semi").withColumn("key", key)
    rest = rest.join(few(one.select("term_ord", key.alias("key")).distinct()), ["term_ord", "key"], "left_anti").join(few(got.select("key")), "key", "left_anti").drop("key")
    tried = one.groupBy("term_ord").agg(F.count("*").alias("tried"))
    two = batch(rest, top).join(tried, "term_ord").withColumn("rank", F.col("rank") + F.col("tried").cast("int")).drop("tried").withColumn("round", F.lit(2))
    return accepted(one.unionByName(two), assessments)


def flat(citations: DataFrame, most: int = 80, any_link: bool = False, run: tuple[str, ...] = ()) -> DataFrame:
    """id (from 1), text, link, title: citations once by link and title in term order, the first ones; only http links unless any_link. With run, a numbering for each value of its columns."""
    rows = citations.withColumns({"title": F.coalesce("title", F.lit("")), "content": F.coalesce(clean_content(F.col("content")), F.lit(""))})
    once = first_by(rows if any_link else rows.where(F.col("link").startswith("http")), [*run, "link", "title"], "term_ord", "rank")
    if run:
        first = once.withColumn("id", F.row_number().over(Window.partitionBy(*run).orderBy("term_ord", "rank"))).where(F.col("id") <= most)
    else:
        first = once.orderBy("term_ord", "rank").limit(most).withColumn("id", F.row_number().over(Window.orderBy("term_ord", "rank")))  # at most so many rows
    return first.select(*run, "id", F.coalesce(F.nullif("content", F.lit("")), F.col("title")).alias("text"), "link", "title")


def counts(candidates: DataFrame, got: DataFrame) -> DataFrame:
    """One row: citations accepted, and candidates before the choice."""
    return got.agg(F.count("*").alias("extracted")).join(F.broadcast(candidates.agg(F.count("*").alias("raw_extracted"))))  # a row each


def shown_numbers(flat_citations: DataFrame, most: int = 50, run: tuple[str, ...] = ()) -> DataFrame:
    """link, number: the first position of each link among the first ones."""
    return flat_citations.where(F.col("id") <= most).groupBy(*run, "link").agg(F.min("id").alias("number"))
