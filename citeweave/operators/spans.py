"""Places of references, sections and paragraphs in markup, as tables that join by place.

A page's references, sections and paragraphs are what the parser finds in its row; what they have to do with each other is joined: by place (asof) and by interval. Places are code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import wikitext
from .asof import asof
from .intervals import WITHIN, joined


def references(pages: DataFrame, source: str = "source") -> DataFrame:
    """pageid, ref_ord (from 0), name, content, start, end of every reference, as wikitext.refs() has them."""
    return wikitext.with_refs(pages, source).select("pageid", F.inline("refs"))


def sections(pages: DataFrame, source: str = "source") -> DataFrame:
    """pageid, section_ord, section, start, end. A page without any has an empty Introduction."""
    return wikitext.with_spans(pages, source).select("pageid", F.inline("sections"))


def paragraphs(pages: DataFrame, source: str = "source") -> DataFrame:
    """pageid, para_ord, section, start, end of paragraphs with 20 visible characters."""
    return wikitext.with_spans(pages, source).select("pageid", F.inline("paragraphs"))


def placed(pages: DataFrame, *wanted: str, source: str = "source") -> list[DataFrame]:
    """The wanted ones of refs (pageid, ref_ord, start, end), sections and paragraphs as above. Pages are parsed once for all of them, and what is joined reads their places, without texts, from a staged table."""
    places = staged(wikitext.with_places(pages, source).select("pageid", *wanted))
    return [places.select("pageid", F.inline(w)) for w in wanted]


def in_sections(refs: DataFrame, parts: DataFrame) -> DataFrame:
    """References with the section that they stand in: the last one that starts before them and ends after they start; outside all, the page's last one."""
    last = parts.groupBy("pageid").agg(F.max_by("section", "section_ord").alias("last"))
    found = asof(refs, parts.select("pageid", "start", "end", "section"), ("pageid",), "start")
    found = found.withColumn("inside", F.when(F.col("found.end") > F.col("start"), F.col("found.section"))).drop("found")
    return found.join(last, "pageid", "left").withColumn("section", F.coalesce("inside", "last", F.lit(wikitext.INTRODUCTION))).drop("inside", "last")


def first_in(parts: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """pageid, key, ref_ord, n: the first reference within each part that has any, and how many it has. key names a page's parts."""
    pairs = joined(parts, refs, ("pageid",), WITHIN)
    return pairs.groupBy("l.pageid", f"l.{key}").agg(F.min("r.ref_ord").alias("ref_ord"), F.count("*").alias("n"))


def touching(parts: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """pageid, key, n, first_ref, last_ref: the references that overlap each part."""
    pairs = joined(parts, refs, ("pageid",))
    return pairs.groupBy("l.pageid", f"l.{key}").agg(F.count("*").alias("n"), F.min("r.ref_ord").alias("first_ref"), F.max("r.ref_ord").alias("last_ref"))
