"""Text scalars as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that browsers' \s and trim() know; Java's \s is ASCII only.
WS_CHARS = "\t\n\x0b\f\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
#: The same as a class of a regular expression: singles that Java keeps as bits, and ranges, as a class of many odd singles is tested one by one.
WS = "[\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def replaced(c: Column, *steps: tuple[str, str]) -> Column:
    """Regular expressions applied one after another."""
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def safe_text(c: Column) -> Column:
    """Trimmed; null is empty."""
    return F.coalesce(trimmed(c), F.lit(""))


def or_null(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


#: Fixed value: what a slug leaves out. Its characters are named one by one, which Java keeps as bits; ranges of a negated class with many parts are tested one by one for each character.
NOT_SLUG = "[^abcdefghijklmnopqrstuvwxyz0123456789-]+"


def slug(c: Column) -> Column:
    """Lower-case letters and digits, words joined by single hyphens."""
    dashed = F.array_join(F.split(F.lower(c), f"[-{WS[1:-1]}]+"), "-")
    words = F.array_remove(F.split(F.regexp_replace(dashed, NOT_SLUG, ""), "-+"), "")
    return F.coalesce(or_null(F.array_join(words, "-")), F.lit("untitled"))


#: Fixed value: reference tags with what they enclose; the lazy form also starts at a self-closing tag.
ANY_REF = r"(?i)<ref[\s\S]*?</ref\s*>|<ref[^>]*/\s*>"


def without_refs(c: Column) -> Column:
    return trimmed(replaced(c, (ANY_REF, "")))


def refs_marked(c: Column) -> Column:
    return replaced(c, (ANY_REF, "[REF]"))


#: Links as their text, quotes, tags; then templates, from the innermost out.
MARKUP = ((r"\[\[([^\]|]+\|)?([^\]]+)\]\]", "$2"), ("''([^']*)''", "$1"), ("'{2,3}([^']*)'{2,3}", "$1"), ("<[^>]+>", ""))
TEMPLATE = r"\{\{[^{}]*\}\}"


def without_markup(c: Column) -> Column:
    """Links as their text, quotes and tags gone, templates gone however deeply they nest.

    Each round takes at least two opening braces, so half their number of rounds is enough; rounds after the first that changes nothing cost nothing.
    """
    state = lambda t, more: F.struct(t.alias("t"), more.alias("more"))
    step = lambda a, _: F.when(a["more"], state(F.regexp_replace(a["t"], TEMPLATE, ""), F.regexp_like(a["t"], F.lit(TEMPLATE)))).otherwise(a)

    def bare(text: Column) -> Column:
        rounds = F.array_repeat(F.lit(0), F.when(F.contains(text, F.lit("{{")), F.floor((F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))) / 2)).otherwise(0).cast("int"))
        return F.aggregate(rounds, state(text, F.lit(True)), step, lambda a: a["t"])

    return trimmed(F.get(F.transform(F.array(replaced(c, *MARKUP)), bare), F.lit(0)))  # bound once, used often


def section_titles(c: Column) -> Column:
    """Header lines' titles, templates dropped and links resolved, in one string."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^\s*(={2,6})\s*(.+?)\s*\1\s*$"), 2)
    clean = F.transform(found, lambda t: trimmed(replaced(t, (r"\{\{[^}]*\}\}", ""), (r"\[\[([^|\]]*\|)?([^\]]+)\]\]", "$2"))))
    return F.array_join(F.filter(clean, lambda t: F.length(t) > 0), " ")


def clean_content(c: Column) -> Column:
    return trimmed(replaced(F.replace(F.replace(c, F.lit("[REF]"), F.lit("")), F.lit("''"), F.lit("'")), (f"{WS}+", " ")))


def html_escaped(c: Column, quote: bool = False) -> Column:
    """The four signs that HTML needs escaped, with ``quote`` the apostrophe too."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")) + ((("'", "&#39;"),) if quote else ()):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def script_safe(c: Column) -> Column:
    return replaced(c, ("(?i)</script>", r"<\\/script>"))


def citation_key(link: Column, title: Column) -> Column:
    link, title = or_null(link), or_null(title)
    return F.coalesce(F.concat(link, F.lit("|"), title), link, title, F.lit("no-link"))


def cite_phrase(c: Column) -> Column:
    return F.lower(trimmed(replaced(c, (r"\{\{|\|", ""), (f"{WS}+", " "))))


def link_ids(c: Column) -> Column:
    """Numbers that markdown links point to."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]\((\d+)\)"), 1), lambda x: x.cast("int"))


def two_places(x: Column) -> Column:
    """A number of 0 or more with two digits, rounded by its exact binary value; ties, which only odd eighths are, go up."""
    tie = F.pmod(x * 8, F.lit(2.0)) == 1
    return F.call_function("format_number", F.when(tie, x + 0.001).otherwise(x), F.lit("0.00"))


def shown_ms(ms: Column) -> Column:
    return F.when(ms >= 1000, F.concat(two_places(ms / 1000), F.lit("s"))).otherwise(F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms")))


def shown_cents(cost: Column) -> Column:
    return F.concat(two_places(cost * 100), F.lit("¢"))


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMMM d, yyyy")


def wiki_url(title: Column, base: str = "https://en.wikipedia.org/wiki/") -> Column:
    x = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), x)


def image_extension(url: Column) -> Column:
    return F.coalesce(or_null(F.lower(F.regexp_extract(url, r"\.([A-Za-z]{3,4})(?:\?|$)", 1))), F.lit("jpg"))


def percent(part: Column, whole: Column) -> Column:
    """Per cent of a whole, 100 at most; 0 of nothing."""
    return F.when(whole > 0, F.least(F.lit(100.0), 100.0 * part / whole)).otherwise(0.0)


def section_text(paragraphs: Column) -> Column:
    """A section's paragraphs (strings) in one line, empty ones left out."""
    return F.array_join(F.filter(paragraphs, lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def shortened(c: Column, most: int = 80) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("…"))).otherwise(c)


def without_fence(c: Column) -> Column:
    """What one fence (with the mark json or none) around a whole answer encloses; else the answer, trimmed."""
    x = trimmed(c)
    inner = F.regexp_extract(x, r"^```(?:json)?\s*([\s\S]*?)```\s*$", 1)
    return F.when(F.regexp_like(x, F.lit(r"^```(?:json)?\s*[\s\S]*?```\s*$")), trimmed(inner)).otherwise(x)


def parsed_json(c: Column, schema: str) -> Column:
    """An answer as JSON; failing that, its widest braces; failing that, null."""
    x = without_fence(c)
    braces = F.regexp_extract(x, r"\{[\s\S]*\}", 0)
    fits = lambda t: F.try_parse_json(t).isNotNull()
    return F.when(fits(x), F.from_json(x, schema)).when((braces != "") & fits(braces), F.from_json(braces, schema))


def first_queries(queries: Column, most: int = 8) -> Column:
    """The first ones, then those of them that aren't blank."""
    return F.filter(F.slice(queries, 1, most), lambda q: q.isNotNull() & (F.length(trimmed(q)) > 0))


def queries_or_fallback(consolidated: Column, angles: Column) -> Column:
    own = F.filter(F.flatten(F.transform(angles, lambda a: F.coalesce(a["search_queries"], F.array().cast("array<string>")))), lambda q: F.coalesce(q, F.lit("")) != "")
    return F.when(F.coalesce(F.size(consolidated), F.lit(0)) > 0, consolidated).otherwise(own)
