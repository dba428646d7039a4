"""What is read out of recorded model answers: angles, articles, refutations, article parts and their links. Answers are strings in input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escaped, parsed_json, replaced, safe_text, section_text, without_fence
from .citations import flat
from .retrieval import required

ANGLE = "struct<argument: string, search_queries: array<string>>"


def angles(answer: Column) -> Column:
    """array of (argument, search_queries): a bare array or the field angles of an object; missing queries are none. Null if the answer is no JSON; an answer without angles is an empty array."""
    x = without_fence(answer)
    bare, held = F.from_json(x, f"array<{ANGLE}>"), F.from_json(x, f"struct<angles: array<{ANGLE}>>")["angles"]
    found = F.when(x.startswith("["), bare).otherwise(F.coalesce(held, F.array().cast(f"array<{ANGLE}>")))
    none = F.array().cast("array<string>")
    full = F.transform(found, lambda a: F.struct(a["argument"].alias("argument"), F.coalesce(a["search_queries"], none).alias("search_queries")))
    return F.when(F.try_parse_json(x).isNotNull(), full)


def angle_rows(answers: DataFrame) -> DataFrame:
    """slug, angle_ord, argument, search_queries of answers (slug, answer). Every answer must hold some: one that doesn't fails the query with its slug."""
    a = answers.withColumn("a", angles(F.col("answer")))
    ok = F.when(F.coalesce(F.size("a"), F.lit(0)) > 0, F.col("a")).otherwise(F.raise_error(F.concat(F.lit("no angles: "), F.col("slug"))).cast(f"array<{ANGLE}>"))
    return a.select("slug", F.posexplode(ok).alias("angle_ord", "x")).select("slug", "angle_ord", "x.*")


#: What stands for fields that an article lacks, and how many articles count.
ARTICLE_DEFAULTS = {"title": "Untitled cherry-picked headline", "source": "Echo Chamber Gazette", "url": "#", "snippet": "Cherry-picked summary unavailable."}
CONFIRMATION, MOST_ARTICLES = "Supports belief", 5


def feed_articles(answer: Column) -> Column:
    """array of (title, source, url, snippet, confirmation): the first articles of an answer, missing fields by default. Null without an array of articles."""
    found = parsed_json(answer, "articles array<struct<title: string, source: string, url: string, summary: string>>")["articles"]
    field = lambda a, out, own: F.coalesce(a[own], F.lit(ARTICLE_DEFAULTS[out])).alias(out)
    return F.transform(F.slice(found, 1, MOST_ARTICLES), lambda a: F.struct(field(a, "title", "title"), field(a, "source", "source"), field(a, "url", "url"), field(a, "snippet", "summary"), F.lit(CONFIRMATION).alias("confirmation")))


#: What stands for fields that an argument lacks.
ARGUMENT_DEFAULTS = {"heading": "Questionable supporting point", "body": "Additional biased reasoning unavailable, but assume overwhelming evidence in favor."}


def feed_arguments(answer: Column) -> Column:
    """array of (heading, body), trimmed: the first arguments of an answer, missing fields by default; empty ones stay empty. Null without an array of arguments."""
    found = parsed_json(answer, "arguments array<struct<heading: string, body: string>>")["arguments"]
    return F.transform(F.slice(found, 1, MOST_ARTICLES), lambda a: F.struct(*[safe_text(F.coalesce(a[f], F.lit(d))).alias(f) for f, d in ARGUMENT_DEFAULTS.items()]))


def refutation(answer: Column) -> Column:
    """struct(summary, experts, refutations), all trimmed: experts need an insight, refutations a title or a correction; missing lists are empty."""
    x = parsed_json(answer, "summary string, expert_examples array<struct<name: string, title: string, insight: string, confidence: string>>, refutations array<struct<article_title: string, issue: string, correction: string>>")

    def cleaned(rows: Column, fields: tuple[str, ...], keep) -> Column:
        clean = F.transform(rows, lambda r: F.struct(*[safe_text(r[f]).alias(f) for f in fields]))
        return F.coalesce(F.filter(clean, keep), F.array().cast("array<struct<" + ", ".join(f"{f}: string" for f in fields) + ">>"))

    experts = cleaned(x["expert_examples"], ("name", "title", "insight", "confidence"), lambda r: r["insight"] != "")
    rows = cleaned(x["refutations"], ("article_title", "issue", "correction"), lambda r: (r["article_title"] != "") | (r["correction"] != ""))
    return F.when(x.isNotNull(), F.struct(safe_text(x["summary"]).alias("summary"), experts.alias("experts"), rows.alias("refutations")))


def paragraph_text(raw: Column) -> Column:
    """A paragraph is a string, or an object with its text."""
    held = F.from_json(raw, "text string")["text"]
    return F.when(F.trim(raw).startswith("{") & F.try_parse_json(raw).isNotNull(), F.coalesce(held, F.lit(""))).otherwise(raw)


def _paragraphs(raw: Column) -> Column:
    """One paragraph or an array of them."""
    many = F.when(F.trim(raw).startswith("[") & F.try_parse_json(raw).isNotNull(), F.from_json(raw, "array<string>"))
    return F.transform(F.coalesce(many, F.array_compact(F.array(raw))), paragraph_text)


_SECTIONS = "array<struct<heading: string, paragraphs: array<string>>>"


def article_parts(answers: DataFrame) -> DataFrame:
    """slug, part, heading, paragraphs of articles in answers (slug, answer): intro, each section in order (section 0, ...), conclusion. The article may be a field of that name. Answers that are no JSON have none."""
    x = answers.select("slug", parsed_json(F.col("answer"), f"article struct<intro: string, sections: {_SECTIONS}, conclusion: string>, intro string, sections {_SECTIONS}, conclusion string").alias("x"))
    a = x.select("slug", F.coalesce("x.article", F.struct("x.intro", "x.sections", "x.conclusion")).alias("a")).where("x is not null")
    part = lambda name, heading, paragraphs: F.struct(name.alias("part"), heading.alias("heading"), paragraphs.alias("paragraphs"))
    sections = F.transform(F.col("a.sections"), lambda s, i: part(F.concat(F.lit("section "), i.cast("string")), F.coalesce(s["heading"], F.lit("")), F.transform(s["paragraphs"], paragraph_text)))
    none = F.array().cast("array<struct<part: string, heading: string, paragraphs: array<string>>>")
    whole = F.concat(F.array(part(F.lit("intro"), F.lit(""), _paragraphs(F.col("a.intro")))), F.coalesce(sections, none), F.array(part(F.lit("conclusion"), F.lit(""), _paragraphs(F.col("a.conclusion")))))
    return a.select("slug", F.inline(F.filter(whole, lambda p: p["part"].startswith("section") | (F.size(p["paragraphs"]) > 0))))


def part_texts(parts: DataFrame) -> DataFrame:
    """slug, part, text: each part's paragraphs in one line."""
    return parts.select("slug", "part", section_text(F.coalesce("paragraphs", F.array().cast("array<string>"))).alias("text"))


#: Fixed value: a link in an article's text, to a citation's number or a URL.
LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def linked(text: Column, ids: Column, numbers: Column | None = None, notes_url: str | None = None) -> Column:
    """Text with its links as HTML. ids: map of citation number to URL; numbers: map of URL to the number shown, which follows the link if there is a notes_url.

    A number that no citation has, or a target that is no address, leaves the anchor as plain text; all text is escaped.
    """
    between = F.transform(F.split(text, LINK, -1), lambda x: html_escaped(x))
    anchors, targets = F.regexp_extract_all(text, F.lit(LINK), 1), F.regexp_extract_all(text, F.lit(LINK), 2)

    def link(anchor: Column, target: Column) -> Column:
        number = F.when(F.regexp_like(target, F.lit("^[0-9]+$")), F.try_to_number(target, F.lit("999999999")).cast("int"))
        url = F.coalesce(F.try_element_at(ids, F.coalesce(number, F.lit(-1))), target)
        shown = html_escaped(anchor)
        out = F.when(url.startswith("http") | url.startswith("//"), F.concat(F.lit('<a href="'), html_escaped(url), F.lit('" target="_blank" rel="noopener">'), shown, F.lit("</a>"))).otherwise(shown)
        if numbers is None or not notes_url:
            return out
        n = F.try_element_at(numbers, url).cast("string")
        base = notes_url.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
        note = F.concat(F.lit(f'<a href="{base}#ref-'), n, F.lit('" class="ref-num" title="See reference '), n, F.lit('">['), n, F.lit("]</a>"))
        return F.concat(out, F.coalesce(note, F.lit("")))

    links = F.zip_with(anchors, targets, link)
    return F.array_join(F.zip_with(between, links, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def regenerated(answers: DataFrame, extracted: DataFrame, plans: DataFrame, filtered: DataFrame, most: int = 80) -> DataFrame:
    """slug, topic, article (JSON), citations (array of id, text, link, title): what an article is built from again, out of stored artifacts.

    answers: slug, answer; extracted: slug, term_ord, rank, link, title, content. Both must be there: a slug of answers without extracted rows, or whose answer isn't JSON, fails the query.
    The topic is the plan's; without a plan (slug, topic) the filtered set's (slug, query); else, or if that is empty, the slug's words. A plan without a topic doesn't fall back to the filtered set.
    """
    required(answers, "answers")
    own = flat(extracted, most, run=("slug",)).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("id", "text", "link", "title"))).alias("citations"))  # most entries a slug
    has = extracted.select("slug").distinct().withColumn("_has", F.lit(True))
    plan = plans.groupBy("slug").agg(F.first("topic", ignorenulls=True).alias("plan_topic"), F.lit(True).alias("_plan"))
    fetched = filtered.groupBy("slug").agg(F.first("query", ignorenulls=True).alias("filtered_topic"))
    x = answers.join(has, "slug", "left").join(own, "slug", "left").join(plan, "slug", "left").join(fetched, "slug", "left")
    words = replaced(F.col("slug"), ("-", " "))
    topic = F.coalesce(F.nullif(F.when(F.col("_plan"), F.col("plan_topic")).otherwise(F.col("filtered_topic")), F.lit("")), words)
    body = without_fence(F.col("answer"))
    json = F.when(F.col("_has").isNull(), F.raise_error(F.concat(F.lit("nothing extracted: "), F.col("slug"))).cast("string")).when(F.try_parse_json(body).isNull(), F.raise_error(F.concat(F.lit("no JSON: "), F.col("slug"))).cast("string")).otherwise(body)
    article = F.coalesce(F.get_json_object(json, "$.article"), json)
    return x.select("slug", topic.alias("topic"), article.alias("article"), F.coalesce("citations", F.array().cast("array<struct<id:int,text:string,link:string,title:string>>")).alias("citations"))
