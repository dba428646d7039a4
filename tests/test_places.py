"""Scans, as-of joins, joins of intervals, exact percentiles, the gram index and spans in markup, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from citeweave import queries
from citeweave.operators import asof, citations, grams, intervals, scan, selection, spans, wikitext
from citeweave.staging import staged


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_parts(spark):
    """Adaptive plans would join small ranges to one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans(spark, many_parts):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), n, rng.choice([None, *range(-9, 10)])) for n in range(800)]
    df = spark.createDataFrame(rows, "k string, n int, v int").repartition(7)
    columns = {"total": (scan.SUM, F.col("v")), "top": (scan.MAX, F.col("v")), "low": (scan.MIN, F.col("v")), "seen": (scan.LAST, F.col("v")), "n_v": (scan.COUNT, F.col("v"))}
    for before in (False, True):
        got = {r["n"]: tuple(r[c] for c in columns) for r in scan.scanned(df, ("k",), (F.col("n"),), before=before, **columns).collect()}
        for k, n, _ in rows:
            own = [v for kk, m, v in rows if kk == k and (m < n or m == n and not before) and v is not None]
            want = (sum(own), max(own), min(own), own[-1], len(own)) if own else (None, None, None, None, 0)
            assert got[n] == want or before and not own and got[n][:4] == want[:4] and not got[n][4]
    parts = {r[0] for r in scan.scanned(df.where("k = 'hot'").withColumn("p", F.lit(0)), ("k",), (F.col("n"),), total=(scan.SUM, F.col("v"))).select(F.spark_partition_id()).collect()}
    assert parts


def test_numbering_in_falling_order_and_without_keys(spark, many_parts):
    df = spark.createDataFrame([(n % 3, n) for n in range(200)], "k int, n int").repartition(5)
    got = scan.numbered(df, ("k",), F.col("n").desc()).collect()
    assert {(r["k"], r["n"]): r["rank"] for r in got} == {(k, n): 1 + sum(1 for m in range(n + 1, 200) if m % 3 == k) for k, n in ((n % 3, n) for n in range(200))}
    assert {r["n"]: r["rank"] for r in scan.numbered(df, (), F.col("n")).collect()} == {n: n + 1 for n in range(200)}
    assert scan.numbered(df.limit(0), ("k",), F.col("n")).collect() == []


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, many_parts, strict):
    rng = random.Random(2)
    left = [(rng.choice([*"xxxxxxab", None]), rng.choice([None, *range(50)]), n) for n in range(300)]
    right = [(rng.choice([*"xxxxxxac", None]), rng.choice([None, *range(50)]), n) for n in range(120)]
    names = "k string, t int, n int"
    out = asof.asof(spark.createDataFrame(left, names).repartition(4), spark.createDataFrame(right, names), ("k",), "t", ties=("n",), strict=strict)
    got = {r["n"]: r["found"] and tuple(r["found"]) for r in out.collect()}
    for k, t, n in left:
        own = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t or r[1] == t and not strict)]
        assert got[n] == (max(own, key=lambda r: (r[1], r[2])) if own else None)
    assert len(got) == 300


@pytest.mark.parametrize("how", [intervals.OVERLAP, intervals.WITHIN])
def test_intervals(spark, how):
    rng = random.Random(3)

    def made(n):
        out = []
        for k in range(n):
            a = rng.randrange(-300, 300)
            out.append((rng.choice(["p", "p", "q", None]), a, a + rng.choice([0, 1, 1, 2, 3, 8, 64, 65, 1000, 10**12]), k))
        return [*out, ("p", None, 5, n), ("p", 5, None, n + 1), ("p", 9, 3, n + 2), out[0]]

    left, right = made(150), made(130)
    names = "k string, start long, end long, n int"
    df = intervals.joined(spark.createDataFrame(left, names), spark.createDataFrame(right, names), ("k",), how)
    got = sorted((r["l"]["n"], r["r"]["n"]) for r in df.collect())
    full = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and r[1] < r[2]
    met = (lambda a, b: a[1] <= b[1] and b[2] <= a[2]) if how == intervals.WITHIN else (lambda a, b: a[1] < b[2] and b[1] < a[2])
    assert got == sorted((a[3], b[3]) for a in left for b in right if full(a) and full(b) and a[0] == b[0] and met(a, b))
    assert "Cartesian" not in plan_of(df) and "NestedLoop" not in plan_of(df)


def test_long_intervals_take_few_bins(spark):
    long = spark.createDataFrame([("p", 0, 2**60)], "k string, start long, end long")
    short = spark.range(2000).select(F.lit("p").alias("k"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 2).alias("end"))
    rows = intervals._binned(intervals._prepared(short, ("k",), ("start", "end"), "r"), "r", "l", intervals._levels(intervals._prepared(long, ("k",), ("start", "end"), "l")))
    assert rows.count() < 3 * 2000 + 2000
    assert intervals.joined(long, short, ("k",), intervals.WITHIN).count() == 2000


def test_what_small_tables_grow_to_is_not_broadcast(spark):
    """A table of few bytes holds lists of many spans; what is made of them must not pass through the driver."""
    pages = staged(spark.range(20).select(F.col("id").alias("pageid"), F.transform(F.sequence(F.lit(0), F.lit(499)), lambda k: F.struct(k.alias("ref_ord"), (10 * k).alias("start"), (10 * k + 5).alias("end"))).alias("refs")))
    refs = pages.select("pageid", F.inline("refs"))
    parts = pages.select("pageid", F.inline(F.array(F.struct(F.lit(0).alias("section_ord"), F.lit(0).alias("start"), F.lit(2500).alias("end")))))
    for df in (spans.first_in(parts, refs, "section_ord"), spans.touching(parts, refs, "section_ord")):
        assert {tuple(r)[:4] for r in df.select("pageid", "section_ord", "n").collect()} == {(n, 0, 250) for n in range(20)}
        assert "Broadcast" not in plan_of(df)


def want_percentile(values, fraction):
    values = sorted(values)
    place = fraction * (len(values) - 1)
    low, high = int(place), int(-(-place // 1))
    return values[low] if low == high or values[low] == values[high] else values[low] * (1 - (place - low)) + values[high] * (place - low)


@pytest.mark.parametrize("few", [10, 10_000])
def test_percentiles(spark, few):
    rng = random.Random(4)
    rows = [("flat", 7.0)] * 300 + [("two", float(n % 2)) for n in range(301)] + [("wide", rng.gauss(0, 1) * 10 ** rng.randrange(-9, 9)) for _ in range(700)] + [("one", -1.5), ("none", None), ("none", float("nan")), (None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    fractions = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {(r["k"], r["fraction"]): r["value"] for r in selection.percentiles(df, "v", fractions, ("k",), few=few).collect()}
    keys = {k for k, v in rows if v is not None and v == v}
    assert got == {(k, f): pytest.approx(want_percentile([v for kk, v in rows if kk == k], f), rel=1e-12) for k in keys for f in fractions}
    flat = selection.percentiles(df, "v", (0.5,), few=few).collect()
    assert [tuple(r) for r in flat] == [(0.5, pytest.approx(want_percentile([v for _, v in rows if v is not None and v == v], 0.5), rel=1e-12))]
    assert selection.percentiles(df.limit(0), "v", (0.5,), few=few).collect() == []


def test_texts_that_hold_needles(spark):
    rng = random.Random(5)
    letters = "abcé😀 "
    texts = [(n, rng.choice(["x", "y", None]), "".join(rng.choices(letters, k=rng.randrange(0, 30)))) for n in range(150)] + [(150, "x", None), (151, "x", "abc" * 20_000)]
    needles = [(rng.choice(["x", "y", None]), "".join(rng.choices(letters, k=rng.randrange(0, 6)))) for _ in range(200)] + [("x", None), ("x", "abc"), ("x", "abc")]
    t, n = spark.createDataFrame(texts, "id int, k string, text string"), spark.createDataFrame(needles, "k string, word string")
    df = grams.containing(t, n, "text", "word", ("id",), ("k",))
    got = sorted((r["t"]["id"], r["n"]["word"]) for r in df.collect())
    assert got == sorted((i, w) for i, k, x in texts for kk, w in needles if k is not None and k == kk and x is not None and w and w in x)
    got = sorted((r["t"]["id"], r["n"]["word"]) for r in grams.containing(t, n.where("length(word) > 3"), "text", "word", ("id",)).collect())
    assert got == sorted((i, w) for i, _, x in texts for _, w in needles if x is not None and w and len(w) > 3 and w in x)
    assert "NestedLoop" not in plan_of(df)
    assert grams.containing(t.limit(0), n, "text", "word", ("id",), ("k",)).collect() == []
    assert grams.containing(t, n.limit(0), "text", "word", ("id",), ("k",)).collect() == []


def test_many_terms_meet_paragraphs_by_grams(spark, sf_dir):
    pages = staged(wikitext.with_paragraphs(queries._wiki(spark, sf_dir)))
    docs = queries._documents(spark, sf_dir)
    words = docs.select("doc_id", F.explode(F.slice(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+")), 1, 12)).alias("term"))
    terms = staged(words.select(F.monotonically_increasing_id().alias("term_ord"), (F.col("doc_id") % 40).alias("query_ord"), "term"))
    hits = docs.select((F.col("doc_id") % 40).alias("query_ord"), F.col("doc_id").alias("hit_ord"), F.col("doc_id").alias("pageid"))
    assert terms.count() > 1500
    columns = ("term_ord", "hit_ord", "para_ord", "cite_ord", "link", "title")
    plain, indexed = (citations.matched(terms, hits, pages, min_length=4, indexed=way).select(*columns) for way in (False, True))
    assert "gram#" in plan_of(indexed) and "NestedLoop" not in plan_of(indexed)
    assert sorted(map(tuple, indexed.collect())) == sorted(map(tuple, plain.collect())) != []


PARTS = ["<ref>", "<ref name=a>", "</ref>", "<ref name=a/>", "<ref name='b' />", '<REF NAME="b">', "</ref >", "x. ", "é😀", "\n== H ==\n", "\n\n", "<ref name=c/>", "a longer line of words to fill a paragraph"]


def random_pages(n=250):
    rng = random.Random(6)
    return ["".join(rng.choices(PARTS, k=rng.randrange(0, 25))) for _ in range(n)] + ["", "<ref>a <ref>b</ref> c</ref>", "</ref><ref>a</ref>", "== Only a header<ref>{{cite web|title=x}}</ref> =="]


def test_references_are_those_of_the_parser(spark, many_parts):
    pages = [*random_pages(), None]
    df = spark.createDataFrame(list(enumerate(pages)), "pageid long, source string")
    got: dict = {}
    for r in spans.references(df).orderBy("pageid", "ref_ord").collect():
        got.setdefault(r["pageid"], []).append((r["name"], r["content"], r["start"], r["end"]))
    want = {n: [(r["name"], r["content"], r["start"], r["end"]) for r in wikitext.refs(p or "")] for n, p in enumerate(pages)}
    assert got == {n: v for n, v in want.items() if v}
    assert sum(map(len, got.values())) > 300


def test_places_of_references(spark):
    pages = random_pages(120)
    df = spark.createDataFrame(list(enumerate(pages)), "pageid long, source string")
    refs, sections, paras = spans.references(df), spans.sections(df), spans.paragraphs(df)
    want_refs = {n: wikitext.refs(p) for n, p in enumerate(pages)}
    parts = {n: [(r["section"], r["start"], r["end"]) for r in wikitext.spans(p)["sections"]] for n, p in enumerate(pages)}
    own = {n: [(r["para_ord"], r["start"], r["end"]) for r in wikitext.spans(p)["paragraphs"]] for n, p in enumerate(pages)}
    got = {(r["pageid"], r["ref_ord"]): r["section"] for r in spans.in_sections(refs, sections).collect()}
    assert got == {(n, k): next((s for s, a, b in parts[n] if a <= r["start"] < b), parts[n][-1][0]) for n, rs in want_refs.items() for k, r in enumerate(rs)}
    got = {(r["pageid"], r["para_ord"]): (r["ref_ord"], r["n"]) for r in spans.first_in(paras, refs, "para_ord").collect()}
    inside = {(n, p): [k for k, r in enumerate(want_refs[n]) if a <= r["start"] and r["end"] <= b] for n, ps in own.items() for p, a, b in ps}
    assert got == {k: (v[0], len(v)) for k, v in inside.items() if v}
    got = {(r["pageid"], r["section_ord"]): (r["n"], r["first_ref"], r["last_ref"]) for r in spans.touching(sections, refs, "section_ord").collect()}
    over = {(n, s): [k for k, r in enumerate(want_refs[n]) if r["start"] < b and a < r["end"]] for n, ps in parts.items() for s, (_, a, b) in enumerate(ps)}
    assert got == {k: (len(v), v[0], v[-1]) for k, v in over.items() if v}


def test_a_page_that_is_but_a_header(spark):
    page = "== Head<ref>{{cite web|url=http://a.b/c|title=T}}</ref> =="
    got = wikitext.sentences(page)
    assert [(c["type"], c["url"], c["section"], c["sentence"]) for c in got] == [("web", "http://a.b/c", "Introduction", "")]
    df = spark.createDataFrame([(1, page)], "pageid long, source string")
    assert [tuple(r) for r in spans.in_sections(spans.references(df), spans.sections(df)).select("ref_ord", "section").collect()] == [(0, "Introduction")]
