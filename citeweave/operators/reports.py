"""Run reports: types of citations, lineage, costs, critiques."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, cite_phrase, link_ids, trimmed
from .citations import shown_numbers
from .scan import numbered


#: Fixed value: a cite template up to its first bar, with a small or a capital first letter and no blank before it.
CITE_PHRASE = rf"\{{\{{[Cc]ite{WS}+[A-Za-z0-9_-]+{WS}*\|"


def cite_types_by_file(files: DataFrame) -> DataFrame:
    """type, file, n, pos: how often each cite phrase of (file, source) occurs in each file, and where first."""
    found = files.select("file", F.posexplode(F.regexp_extract_all("source", F.lit(CITE_PHRASE), 0)).alias("pos", "m"))
    return found.groupBy(cite_phrase(F.col("m")).alias("type"), "file").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))


def cite_types(files: DataFrame, listed: bool = False) -> DataFrame:
    """type, n, n_files, rank: cite phrases in (file, source), the most frequent ones first, ties as first seen. With ``listed`` also files, the sorted names of all files that a type occurs in; cite_types_by_file() has them as rows."""
    by_file = cite_types_by_file(files)
    more = [F.array_sort(F.collect_list("file")).alias("files")] if listed else []
    out = by_file.groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("n_files"), *more, F.min(F.struct("file", "pos")).alias("first"))
    return numbered(out, (), F.col("n").desc(), F.col("first")).drop("first")


def costed(usage: DataFrame, prices: DataFrame, default_model: str) -> DataFrame:
    """usage (model, tokens in and out) with cost: by the model's price, else the default model's, else 0. The price sheet is a configuration table."""
    p = prices.select(F.col("model"), "input_per_million", "output_per_million")
    d = prices.where(F.col("model") == default_model).agg(F.first("input_per_million").alias("di"), F.first("output_per_million").alias("do"))
    rate = lambda a, b: F.coalesce(a, b, F.lit(0.0)) / 1e6
    out = usage.join(p, "model", "left").join(F.broadcast(d))  # d is one row
    return out.withColumn("cost", F.col("input_tokens") * rate("input_per_million", "di") + F.col("output_tokens") * rate("output_per_million", "do")).drop("input_per_million", "output_per_million", "di", "do")


def stage_totals(stats: DataFrame) -> DataFrame:
    """Sums by run and stage, by run (stage null) and overall (both null)."""
    return stats.rollup("slug", "stage").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost", "time_ms")])


def deltas(counters: DataFrame) -> DataFrame:
    """What each stage used, from counters that only grow within a run."""
    w = Window.partitionBy("slug").orderBy("stage")
    return counters.select("slug", "stage", *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")])


#: The part that stands for an article's parts together.
ALL_PARTS = "all"


def used_refs(parts: DataFrame, flat_citations: DataFrame, most: int = 50) -> DataFrame:
    """slug, part, id, link: citations that an article's parts (slug, part, text) point to, each once a part and once for all parts together; ids without a citation among the first ones keep a null link."""
    used = parts.select("slug", F.col("part").cast("string").alias("p"), F.explode(F.array_distinct(link_ids(F.col("text")))).alias("id"))
    used = used.select("slug", F.explode(F.array("p", F.lit(ALL_PARTS))).alias("part"), "id").distinct()
    return used.join(flat_citations.where(F.col("id") <= most).select("id", "link"), "id", "left").select("slug", "part", "id", "link")


def angle_counts(refs: DataFrame) -> DataFrame:
    """argument, total, valid, used of refs (argument, valid, used); angles without any don't show."""
    return refs.groupBy("argument").agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if("used").alias("used")).where("total > 0")


#: What dead links that no term has are shown under.
NO_TERM = "(no term)"


def with_dead(extracted: DataFrame, dead: DataFrame) -> DataFrame:
    """term, link, title, content, rank, dead, reason, place: rows of extracted terms, live and dead, by rank (none: 999; live ones first); dead links without a term form a group of their own, numbered from 1."""
    columns = ("term", "link", "title", "content", "rank", "dead", "reason")
    row = lambda df, dead_, reason: df.select("term", "link", "title", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("rank", F.lit(999)).alias("rank"), F.lit(dead_).alias("dead"), reason.alias("reason"))
    lost = row(dead.withColumn("title", F.coalesce("title", "link")), True, F.col("reason"))
    stray = numbered(lost.where("term is null").drop("term").withColumnRenamed("rank", "own_rank"), (), F.col("own_rank"), F.col("link"), F.col("title")).select(F.lit(NO_TERM).alias("term"), *columns[1:])
    both = row(extracted, False, F.lit(None).cast("string")).unionByName(lost.join(extracted.select("term").distinct(), "term", "left_semi").select(*columns)).unionByName(stray)
    return numbered(both.withColumnRenamed("rank", "own_rank"), ("term",), F.col("own_rank"), F.col("dead"), F.col("link"), F.col("title")).withColumnsRenamed({"rank": "place", "own_rank": "rank"})


def orphans(refs_per_term: DataFrame, shown: DataFrame) -> DataFrame:
    """Terms that were asked for and not shown."""
    return refs_per_term.select("term").distinct().join(shown.select("term").distinct(), "term", "left_anti")


def title_queries(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """title, queries (in order), kept: which queries found a page and whether the filter kept it."""
    by = hits.groupBy("title").agg(F.transform(F.array_sort(F.collect_set(F.struct("query_ord", "query"))), lambda x: x["query"]).alias("queries"), F.min("query_ord").alias("first"))
    return by.join(kept.select("title").distinct().withColumn("kept", F.lit(True)), "title", "left").select("title", "queries", F.col("first").alias("first_query"), F.coalesce("kept", F.lit(False)).alias("kept"))


def critiqued(sections: DataFrame, critiques: DataFrame) -> DataFrame:
    """Sections with their critique by position; a failed one leaves an empty row."""
    return sections.join(critiques, ["slug", "section_ord"], "left").select("slug", "section_ord", "heading", *[F.coalesce(c, F.lit("")).alias(c) for c in ("blurb", "analysis")])


def refutations(rows: DataFrame, articles: DataFrame, no_belief: str, no_expert: str) -> DataFrame:
    """Rows (feed, article_title, issue, correction) beside the feed's articles (feed, ord, title, snippet, url) by trimmed lower-cased title, with belief, expert and place.

    Of equal titles the last article counts; place is the title's position among the feed's different ones in order of first sight, from 0, -1 without one. no_belief and no_expert stand where there is nothing to say.
    """
    key = F.lower(trimmed(F.col("title")))
    by = articles.withColumn("k", key).where("k <> ''").groupBy("feed", "k").agg(F.max_by(F.struct("title", "snippet", "url"), "ord").alias("a"), F.min("ord").alias("first"))
    by = by.withColumn("place", F.row_number().over(Window.partitionBy("feed").orderBy("first")) - 1)
    out = rows.withColumn("k", F.lower(F.coalesce(trimmed(F.col("article_title")), F.lit("")))).join(by, ["feed", "k"], "left")
    full = lambda c: F.nullif(c, F.lit(""))
    belief = F.concat_ws(" — ", F.coalesce(full(F.col("a.title")), full(trimmed(F.col("article_title")))), full(F.col("a.snippet")))
    expert = F.concat_ws(" ", F.concat(F.lit("Issue: "), full(F.col("issue")), F.lit(".")), full(F.col("correction")))
    return out.select("feed", "article_title", "issue", "correction", F.col("a.url").alias("url"), F.coalesce("place", F.lit(-1)).alias("place"), F.coalesce(full(belief), F.lit(no_belief)).alias("belief"), F.coalesce(full(expert), F.lit(no_expert)).alias("expert"))


def trials(rows: DataFrame) -> DataFrame:
    """Least, mean, most and rounded mean of recorded trials, and the safe budget one below the least."""
    return rows.agg(F.min("n").alias("low"), F.avg("n").alias("mean"), F.max("n").alias("high"), F.round(F.avg("n")).cast("long").alias("rounded"), (F.min("n") - 1).alias("safe"))


def numbered_refs(refs: DataFrame, numbers: DataFrame, used: DataFrame) -> DataFrame:
    """refs of with_dead() with number (null for dead ones and links beyond the first) and used (whether the article points to the number). numbers: link, number; used: id."""
    out = refs.join(numbers, "link", "left").withColumn("number", F.when(~F.col("dead"), F.col("number")))
    marks = used.select(F.col("id").alias("number")).where("number is not null").distinct().withColumn("used", F.lit(True))
    return out.join(marks, "number", "left").withColumn("used", F.coalesce("used", F.lit(False)))


#: The tables that a run's report has.
TABLES = ("titles", "refs", "angles", "angle_sums", "orphans", "stages", "overview")


def run_report(angles: DataFrame, hits: DataFrame, kept: DataFrame, extracted: DataFrame, dead: DataFrame, results: DataFrame, flat_citations: DataFrame, used: DataFrame, stats: DataFrame, raw_extracted: DataFrame, wanted: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables of a run's report, from its artifacts; of these, the wanted ones.

    angles: argument, search_queries; hits: query_ord, query, title; kept: title; extracted: term, link, title, content, rank; dead: term, link, title, content, rank, reason; results: link_status;
    flat_citations as citations.flat() gives them; used as used_refs() does; stats: slug, stage, tokens, cost, time_ms; raw_extracted: a row for each citation before the choice.

    titles: which queries found a page, and whether it was kept; refs: every reference of every term with number and use; angles: references, valid and used ones by argument and term, angle_sums: the same by argument, those without any left out;
    orphans: terms of no angle; stages: sums; overview: one row of counts.
    """
    terms = angles.select("argument", F.explode("search_queries").alias("term"))
    titles = title_queries(hits, kept)
    out = {"titles": titles, "stages": stage_totals(stats)}
    if {"refs", "angles", "angle_sums", "orphans"} & set(wanted):
        refs = numbered_refs(with_dead(extracted, dead), shown_numbers(flat_citations), used)
        by = lambda *keys: terms.join(refs, "term").groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(~F.col("dead")).alias("valid"), F.count_if(~F.col("dead") & F.col("used")).alias("used"))
        out |= {"refs": refs, "angles": by("argument", "term"), "angle_sums": by("argument"), "orphans": orphans(refs, terms)}
    s = F.col("link_status")
    one = lambda df, *c: F.broadcast(df.agg(*c))
    out["overview"] = (
        results.agg(F.count("*").alias("checked"), F.count_if(s.isin("probably_valid", "whitelisted")).alias("valid"), F.count_if(s == "invalid").alias("invalid"), F.count_if(s.isin("forbidden", "unknown")).alias("forbidden"), F.count_if(s == "timeout").alias("timeout"), F.count_if(s == "whitelisted").alias("whitelisted"))
        .join(one(titles, F.count("*").alias("titles"), F.count_if("kept").alias("titles_kept")))
        .join(one(used, F.count_distinct("id").alias("used_links")))
        .join(one(angles, F.count("*").alias("arguments")))
        .join(one(terms, F.count_distinct("term").alias("queries")))
        .join(one(raw_extracted, F.count("*").alias("raw_extracted")))
    )  # each side is one row
    return {name: out[name] for name in wanted}
