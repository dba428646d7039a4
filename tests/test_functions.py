"""Scalars on literal inputs (FIXTURES.md, F3)."""

from __future__ import annotations

import datetime
import time

import pytest
from pyspark.sql import functions as F

from citeweave.functions import text, urls


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string" if value is None or isinstance(value, str) else ["x"]).select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "want"), [("  Foo  Bar!! ", "foo-bar"), ("---", "untitled"), ("", "untitled")])
def test_slug(spark, raw, want):
    assert one(spark, raw, text.slug) == want


def test_trimmed_knows_unicode_blanks_and_is_linear(spark):
    assert one(spark, "   a b﻿\n", text.trimmed) == "a b"
    began = time.time()
    assert one(spark, "x" + " " * 2_000_000 + "x", text.trimmed).startswith("x ")
    assert time.time() - began < 5


def test_refs_swallow_the_prose_between_a_self_closing_tag_and_the_next_end(spark):
    assert one(spark, "<ref name=x/> keep me <ref>c</ref> tail", text.without_refs) == "tail"
    assert one(spark, "a<ref>c</ref>b<ref name=x />", text.refs_marked) == "a[REF]b[REF]"


@pytest.mark.parametrize(("raw", "want"), [("'''bold'''", "'bold'"), ("{{a{{b}}c}}z", "z"), ("[[a|b]] [[c]]", "b c"), ("{{" * 30 + "x" + "}}" * 30 + "y", "y"), ("{{{x}}{ y}}w", "w"), ("{{open", "{{open"), ("{{a{b}}", "{{a{b}}")])
def test_markup(spark, raw, want):
    assert one(spark, raw, text.without_markup) == want


def test_section_titles(spark):
    assert one(spark, "intro\n== One {{x}} ==\ntext\n=== [[a|Two]] ===\n==== ====\n", text.section_titles) == "One Two"


@pytest.mark.parametrize(("raw", "want"), [("a''''b  c", "a''b c"), (" [REF]x\n\ty ", "x y")])
def test_clean_content(spark, raw, want):
    assert one(spark, raw, text.clean_content) == want


@pytest.mark.parametrize(("ms", "want"), [(12.0, "12ms"), (1125.0, "1.13s"), (3135.0, "3.13s"), (2000.0, "2.00s")])
def test_shown_time(spark, ms, want):
    assert one(spark, ms, text.shown_ms) == want


def test_first_queries_drop_blanks_after_the_cut(spark):
    df = spark.createDataFrame([(["a", "b", " ", "d", "e", "f", "g", "h", "i", "j"],)], ["q"])
    assert len(df.select(text.first_queries(F.col("q"), 8).alias("q")).first()["q"]) == 7


@pytest.mark.parametrize("raw", ['{"a": 1}', '```json\n{"a": 1}\n```', '```{"a": 1}```  ', 'prose {"a": 1} more'])
def test_fenced_json(spark, raw):
    assert one(spark, raw, lambda c: text.parsed_json(c, "a int"))["a"] == 1


def test_a_fence_with_another_mark_stays(spark):
    assert one(spark, "```js\n{}\n```", text.without_fence) == "js\n{}"


def test_link_ids(spark):
    assert one(spark, "see [a](1) and [b](99) and [c](http://u)", text.link_ids) == [1, 99]


def test_shown_values(spark):
    assert one(spark, 0.0025, text.shown_cents) == "0.25¢"
    assert one(spark, "a</SCRIPT>b", text.script_safe) == "a<\\/script>b"
    assert one(spark, "Café (x)!", text.wiki_url) == "https://en.wikipedia.org/wiki/Caf%C3%A9_(x)!"
    assert one(spark, datetime.datetime(2024, 3, 5), text.long_date) == "March 5, 2024"
    assert [one(spark, u, text.image_extension) for u in ("http://a/b.PNG?x", "http://a/b.webp", "http://a/b")] == ["png", "webp", "jpg"]
    assert one(spark, None, text.safe_text) == ""


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://X.com", "https://x.com/"), ("https://x.com/", "https://x.com/"), ("https://x.com:8080/A/?q=1#f", "https://x.com/A?q=1"), ("http://x.com/a//", "http://x.com/a/"), ("http://x.com/a?", "http://x.com/a"), ("no url", None)],
)
def test_comparable_urls(spark, url, want):
    assert one(spark, url, urls.comparable) == want


@pytest.mark.parametrize(("url", "want"), [("http://x.com", True), ("http://x.com/index.html/", True), ("http://x.com/INDEX", False), ("http://x.com/index.htm", True), ("http://x.com/a", False), ("x", False)])
def test_home(spark, url, want):
    assert one(spark, url, urls.is_home) is want


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("The operation timed out", "connection_timeout"), ("Temporary failure in name resolution", "dns_failed"), ("getaddrinfo ENOTFOUND x", "dns_failed"), ("nodename nor servname", "dns_failed"),
        ("Connection refused", "connection_refused"), ("connect ECONNREFUSED 1.2.3.4", "connection_failed"), ("SSL error", "ssl_error"), ("certificate has expired", "ssl_error"), ("uncertain state", "connection_failed"), ("", "connection_failed"),
    ],
)
def test_issue_of_error(spark, message, want):
    assert one(spark, message, urls.issue_of_error) == want


@pytest.mark.parametrize(("url", "want"), [("HTTP://x.com/a", "HTTP://x.com/a"), ("javascript:alert(1)", "#"), ("ftp://x", "#"), (None, "#"), ("", "#"), ("/a", "#")])
def test_safe_url(spark, url, want):
    assert one(spark, url, urls.safe_url) == want
    assert one(spark, "/a/b", lambda c: urls.safe_url(c, "https://s.org/")) == "https://s.org/a/b"


def test_probe_truth_table(spark):
    rows = [
        ("https://www.nytimes.com/a", 404, None, None, None, False, "whitelisted", None, ""),
        ("https://archive.nytimes.com/a", 404, "Not Found", None, None, False, "invalid", "http_404", "HTTP 404 Not Found"),
        ("http://x.com/", 200, "", "https://x.com/", None, False, "invalid", "redirect_to_home", "redirects to site home (page likely gone): https://x.com/"),
        ("http://x.com/a", 200, "", "http://m.x.com/b", None, False, "probably_valid", "redirect", "redirects to different URL: http://m.x.com/b"),
        ("http://x.com/a", 200, "", "http://x.com:80/a/#f", None, False, "probably_valid", None, ""),
        ("http://x.com/a", 304, None, None, None, False, "invalid", "http_5xx", "HTTP 304"),
        ("http://x.com/a", 429, "T", None, None, False, "invalid", "http_429", "HTTP 429 T"),
        ("http://x.com/a", 451, "T", None, None, False, "invalid", "http_4xx", "HTTP 451 T"),
        ("http://x.com/a", 403, "T", None, None, False, "forbidden", "http_403", "HTTP 403 T"),
        ("http://x.com/a", None, None, None, "socket timed out", False, "forbidden", "connection_timeout", "connection timeout"),
        ("http://x.com/a", None, None, None, "aborted", True, "timeout", "connection_timeout", "connection timeout"),
        ("http://x.com/a", None, None, None, "certificate", False, "invalid", "ssl_error", "ssl error"),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "url string, status int, status_text string, final_url string, error string, aborted boolean").coalesce(1)
    got = [tuple(r["x"]) for r in df.select(urls.classified(*(F.col(c) for c in df.columns)).alias("x")).collect()]
    assert got == [r[6:] for r in rows]
