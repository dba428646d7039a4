"""Ranking by words and reciprocal rank fusion.

Texts are tokenised once, whatever the number of searches that found them; what a document says about the words asked for is a few numbers a row, and only these rows meet searches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS
from ..staging import few, sent, staged
from .scan import numbered

K1, B, DELTA = 1.2, 0.75, 1.0
SPLIT = r"[^\p{L}\p{N}]+"
#: Up to so many different words of all searches are part of the plan; of more, documents' words are joined to them.
MOST_ASKED = 2000


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), SPLIT), "")


def search_words(queries: DataFrame, min_length: int = 3) -> DataFrame:
    """query_ord, word: distinct lower-cased words of each query's terms (array), punctuation kept."""
    words = F.flatten(F.transform("terms", lambda t: F.split(F.lower(F.coalesce(t, F.lit(""))), f"{WS}+")))
    return queries.select("query_ord", F.explode(F.array_distinct(F.filter(words, lambda w: F.length(w) >= min_length))).alias("word"))


def postings(docs: DataFrame, asked: DataFrame, fields: tuple[str, ...], most_asked: int = MOST_ASKED) -> DataFrame:
    """doc_id, field, dl (tokens), found (array of token, tf): what each document says about the tokens in asked."""
    wanted = asked.select("token").distinct()
    long = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("toks")) for f in fields])).alias("x")).select("doc_id", "x.*")
    if few(wanted, most_asked):
        listed = F.array(*map(F.lit, sorted(r["token"] for r in wanted.collect()))).cast("array<string>")  # most_asked rows at most
        tf = F.transform(F.array_intersect("toks", listed), lambda t: F.struct(t.alias("token"), (F.size("toks") - F.size(F.array_remove("toks", t))).cast("long").alias("tf")))
        return long.select("doc_id", "field", F.size("toks").alias("dl"), tf.alias("found"))
    size = long.select("doc_id", "field", F.size("toks").alias("dl"))
    tf = long.select("doc_id", "field", F.explode("toks").alias("token")).join(wanted, "token", "left_semi").groupBy("doc_id", "field", "token").agg(F.count("*").alias("tf"))
    found = tf.groupBy("doc_id", "field").agg(F.collect_list(F.struct("token", "tf")).alias("found"))  # no more than a document's own words
    return size.join(found, ["doc_id", "field"], "left").select("doc_id", "field", "dl", F.coalesce("found", F.array().cast("array<struct<token:string,tf:bigint>>")).alias("found"))


def word_ranks(docs: DataFrame, hits: DataFrame, words: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """query_ord, doc_ord, word, score, rank. docs: doc_id (once each) and fields; hits: query_ord, doc_id, doc_ord; words: query_ord, word. Statistics are those of each query's own hits.

    Scores are rounded so that equal ones tie; ties go to the smaller doc_ord.
    """
    asked = words.withColumn("token", F.explode(F.array_distinct(tokens(F.col("word")))))
    seen = staged(postings(docs, asked, fields).join(hits.select("query_ord", "doc_id", "doc_ord"), "doc_id").select("query_ord", "doc_ord", "field", "dl", "found"))
    stats = seen.groupBy("query_ord", "field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = seen.where(F.size("found") > 0).select("query_ord", "doc_ord", "field", "dl", F.inline("found")).join(sent(asked.select("query_ord", "token").distinct(), 100_000), ["query_ord", "token"], "left_semi")
    df = tf.groupBy("query_ord", "field", "token").agg(F.count("*").alias("df"))
    scored = tf.join(df, ["query_ord", "field", "token"]).join(stats, ["query_ord", "field"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = scored.withColumn("s", idf * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) + DELTA))
    by_word = scored.join(asked, ["query_ord", "token"]).groupBy("query_ord", "word", "doc_ord").agg(F.round(F.sum("s"), 9).alias("score"))
    return numbered(by_word, ("query_ord", "word"), F.col("score").desc(), F.col("doc_ord"))


def fused(ranks: DataFrame, min_terms: int = 2, top_k: int = 10, rrf_k: int = 60) -> DataFrame:
    """query_ord, doc_ord, rrf, matched, position: documents that enough words found, by the sum of 1 / (rrf_k + rank)."""
    sums = ranks.groupBy("query_ord", "doc_ord").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("rrf"), F.count("*").alias("matched")).where(F.col("matched") >= min_terms)
    return sums.withColumn("position", F.row_number().over(Window.partitionBy("query_ord").orderBy(F.col("rrf").desc(), "doc_ord"))).where(F.col("position") <= top_k)


def ranked(docs: DataFrame, hits: DataFrame, queries: DataFrame, fields: tuple[str, ...], min_length: int = 3, **how) -> DataFrame:
    """query_ord, doc_ord, rrf, matched, position. Pages by title, extract and section titles (PAGE_FIELDS), or citations by blurb and sentence (CITATION_FIELDS): the fields decide."""
    return fused(word_ranks(docs, hits, search_words(queries, min_length), fields), **how)


PAGE_FIELDS = ("title", "extract", "section_titles")
CITATION_FIELDS = ("blurb", "sentence")


def ranked_citations(citations: DataFrame, queries: DataFrame, min_length: int = 5, min_terms: int = 2, top_k: int = 50, rrf_k: int = 60) -> DataFrame:
    """query_ord, doc_ord, rrf, matched, position: citations (query_ord, doc_ord, blurb, sentence) of each query by its words in blurb and sentence."""
    rows = citations.withColumn("doc_id", F.struct("query_ord", "doc_ord"))
    return ranked(rows.select("doc_id", *CITATION_FIELDS), rows.select("query_ord", "doc_id", "doc_ord"), queries, CITATION_FIELDS, min_length, min_terms=min_terms, top_k=top_k, rrf_k=rrf_k)
