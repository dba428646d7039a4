"""Operators that no SQL checks, on small tables, and streams that are run."""

from __future__ import annotations

import json
import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citeweave.operators import answers, ranking, reports, retrieval
from citeweave.sources import files
from citeweave.streaming import progress


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_angles(spark):
    raw = ['[{"argument": "a", "search_queries": ["q"]}, {"argument": "b"}]', '```json\n{"angles": [{"argument": "c"}]}\n```', '{"other": 1}', "prose", None]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raw)], "slug string, answer string")
    got = {r["slug"]: r["a"] for r in df.select("slug", answers.angles(F.col("answer")).alias("a")).collect()}
    assert [(x["argument"], x["search_queries"]) for x in got["0"]] == [("a", ["q"]), ("b", [])]
    assert [(x["argument"], x["search_queries"]) for x in got["1"]] == [("c", [])]
    assert (got["2"], got["3"], got["4"]) == ([], None, None)
    assert answers.angle_rows(df.where("slug < 2")).count() == 3
    with pytest.raises(PySparkException, match="no angles: "):
        answers.angle_rows(df).collect()


def test_arguments_must_be_there(spark):
    df = spark.createDataFrame([("",), (None,), ("a",)], "argument string")
    assert rows(retrieval.arguments(df)) == [("a",)]
    with pytest.raises(ValueError, match="no arguments"):
        retrieval.arguments(df.where("argument = ''"))


def test_feed_articles(spark):
    raw = 'Sure: {"articles": [{"title": "t", "source": "", "url": null, "summary": "s"}, {}, {}, {}, {}, {"title": "sixth"}]} done'
    df = spark.createDataFrame([(raw,), ("none",), ('{"articles": 3}',)], "answer string")
    got = [r["a"] for r in df.coalesce(1).select(answers.feed_articles(F.col("answer")).alias("a")).collect()]
    assert len(got[0]) == 5
    assert tuple(got[0][0]) == ("t", "", "#", "s", "Supports belief")
    assert got[0][1]["title"] == answers.ARTICLE_DEFAULTS["title"]
    assert got[1] is None and got[2] is None


def test_refutation(spark):
    raw = {"summary": " s ", "expert_examples": [{"name": " n ", "insight": " i "}, {"name": "x"}], "refutations": [{"article_title": " T "}, {"issue": "i"}, {"correction": " c "}]}
    got = spark.createDataFrame([(json.dumps(raw),)], "a string").select(answers.refutation(F.col("a")).alias("x")).first()["x"]
    assert got["summary"] == "s"
    assert [tuple(e) for e in got["experts"]] == [("n", "", "i", "")]
    assert [tuple(r) for r in got["refutations"]] == [("T", "", ""), ("", "", "c")]
    empty = spark.createDataFrame([("{}",)], "a string").select(answers.refutation(F.col("a")).alias("x")).first()["x"]
    assert (empty["summary"], empty["experts"], empty["refutations"]) == ("", [], [])


def test_links_in_articles(spark):
    df = spark.createDataFrame([("see [a <b>](1) & [b](99) and [c](http://u) [d](//v) [e](no)", {1: "http://x?a&b"}, {"http://x?a&b": 7})], "t string, ids map<int,string>, nums map<string,int>")
    got = df.select(answers.linked(F.col("t"), F.col("ids")).alias("x"), answers.linked(F.col("t"), F.col("ids"), F.col("nums"), "d.html").alias("y")).first()
    link = lambda u, a: f'<a href="{u}" target="_blank" rel="noopener">{a}</a>'
    first = link("http://x?a&amp;b", "a &lt;b&gt;")
    rest = f" &amp; b and {link('http://u', 'c')} {link('//v', 'd')} e"
    assert got["x"] == f"see {first}{rest}"
    assert got["y"] == f'see {first}<a href="d.html#ref-7" class="ref-num" title="See reference 7">[7]</a>{rest}'


def test_article_parts_and_used_refs(spark):
    article = {"intro": "one [a](1)", "sections": [{"heading": "H", "paragraphs": ["p [b](2) [c](2)", {"text": "q [d](60)"}]}, {}], "conclusion": [{"text": "[e](1)"}, "x"]}
    df = spark.createDataFrame([("s", json.dumps(article)), ("t", json.dumps({"article": {"sections": []}})), ("u", "no json")], "slug string, answer string")
    parts = answers.part_texts(answers.article_parts(df))
    assert rows(parts) == [("s", "conclusion", "[e](1) x"), ("s", "intro", "one [a](1)"), ("s", "section 0", "p [b](2) [c](2) q [d](60)"), ("s", "section 1", "")]
    flat = spark.createDataFrame([(i, f"http://l/{i}") for i in range(1, 70)], "id int, link string")
    got = rows(reports.used_refs(parts, flat))
    assert [(p, i, link is not None) for _, p, i, link in got] == [("all", 1, True), ("all", 2, True), ("all", 60, False), ("conclusion", 1, True), ("intro", 1, True), ("section 0", 2, True), ("section 0", 60, False)]


def test_regenerated_needs_its_artifacts(spark):
    raw = spark.createDataFrame([("a-b", "{}"), ("c", "{}")], "slug string, answer string")
    extracted = spark.createDataFrame([("a-b", 0, 1, "http://x", "t", "''c''")], "slug string, term_ord int, rank int, link string, title string, content string")
    plans = spark.createDataFrame([], "slug string, topic string")
    filtered = spark.createDataFrame([], "slug string, query string")
    got = answers.regenerated(raw.where("slug = 'a-b'"), extracted, plans, filtered).first()
    assert (got["topic"], [tuple(c) for c in got["citations"]]) == ("a b", [(1, "'c'", "http://x", "t")])
    with pytest.raises(PySparkException, match="nothing extracted: c"):
        answers.regenerated(raw, extracted, plans, filtered).collect()
    with pytest.raises(PySparkException, match="no JSON: a-b"):
        answers.regenerated(raw.where("slug = 'a-b'").withColumn("answer", F.lit("x")), extracted, plans, filtered).collect()
    with pytest.raises(ValueError, match="no answers"):
        answers.regenerated(raw.where("slug = ''"), extracted, plans, filtered)


def test_first_and_last_page_of_a_title(spark):
    hits = spark.createDataFrame([(0, "T"), (0, "U")], "query_ord int, title string")
    pages = spark.createDataFrame([("T", 1, 10), ("T", 2, 20)], "title string, page_ord int, pageid int")
    assert retrieval.hit_pages(hits, pages).select("pageid").collect()[0][0] == 10
    assert retrieval.hit_pages(hits, pages, last_wins=True).select("pageid").collect()[0][0] == 20


def test_queries_whose_pages_all_fail_keep_an_empty_list(spark):
    hits = spark.createDataFrame([(0, "T"), (1, "U")], "query_ord int, title string")
    kept = spark.createDataFrame([(0, "T", 1)], "query_ord int, title string, position int")
    assert rows(retrieval.pruned(hits, kept)) == [(0, ["T"]), (1, [])]


def test_dead_links_join_their_terms(spark):
    extracted = spark.createDataFrame([("t", "http://a", "A", None, 2), ("t", "http://b", "B", "x", None)], "term string, link string, title string, content string, rank int")
    dead = spark.createDataFrame([("t", "http://d", None, None, 1, "http_404"), ("other", "http://e", "E", None, 1, "r"), (None, "http://f", "F", None, 9, "r")], "term string, link string, title string, content string, rank int, reason string")
    got = rows(reports.with_dead(extracted, dead).select("term", "place", "link", "title", "rank", "dead"))
    assert got == [("(no term)", 1, "http://f", "F", 1, True), ("t", 1, "http://d", "http://d", 1, True), ("t", 2, "http://a", "A", 2, False), ("t", 3, "http://b", "B", 999, False)]


@pytest.mark.parametrize("most", [1, 2000])
def test_postings_by_plan_and_by_join_agree(spark, most):
    docs = spark.createDataFrame([(1, "a b a", None), (2, "", "b-c a"), (3, "z", "")], "doc_id int, x string, y string")
    asked = spark.createDataFrame([("a",), ("b",), ("q",)], "token string")
    got = ranking.postings(docs, asked, ("x", "y"), most).select("doc_id", "field", "dl", F.array_sort("found").alias("f")).collect()
    assert {(r["doc_id"], r["field"]): (r["dl"], [tuple(f) for f in r["f"]]) for r in got} == {
        (1, "x"): (3, [("a", 2), ("b", 1)]), (1, "y"): (0, []), (2, "x"): (0, []), (2, "y"): (3, [("a", 1), ("b", 1)]), (3, "x"): (1, []), (3, "y"): (0, []),
    }


def test_numbered_is_row_number(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("score"), "id")
    got = {(r["k"], r["id"]): r["rank"] for r in ranking.numbered(df, ("k",), F.col("score").desc(), F.col("id")).collect()}
    for k in range(3):
        own = sorted(((-(i % 7), i) for i in range(5000) if i % 3 == k))
        assert [got[k, i] for _, i in own] == list(range(1, len(own) + 1))


def test_tokens_once_in_the_plan(spark, sf_dir):
    from citeweave import queries

    pages, hits, _ = queries._ranked(spark, sf_dir)
    asked = spark.createDataFrame([("a",)], "token string")
    plan = ranking.postings(pages, asked, ranking.PAGE_FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1
    assert "Exchange" not in plan


# sources


def test_json_documents_leave_bad_files_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"topic": "t"\n}')
    (tmp_path / "b.json").write_text("{broken")
    assert rows(files.json_documents(spark, str(tmp_path), "topic string")) == [("t", "a.json")]
    files.write_json(spark.createDataFrame([("s", 1)], "slug string, n int"), f"{tmp_path}/out")
    assert rows(spark.read.schema("n int, slug string").json(f"{tmp_path}/out")) == [(1, "s")]


def test_yaml_documents(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("topic: t\nangles:\n- argument: x\n")
    (tmp_path / "b.yaml").write_text("a: [")
    got = files.yaml_documents(spark, f"{tmp_path}/*.yaml", "topic string, angles array<struct<argument: string>>").collect()
    assert [(r["topic"], r["angles"][0]["argument"], r["file"]) for r in got] == [("t", "x", "a.yaml")]
    files.write_yaml(spark.createDataFrame([("s", "a: 'b'\n", None)], "slug string, t string, u string"), f"{tmp_path}/out")
    assert [(r["t"], r["u"]) for r in files.yaml_documents(spark, f"{tmp_path}/out/*/*.txt", "t string, u string").collect()] == [("a: 'b'\n", None)]


def test_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" a \n\n# c\n\tb\n")
    assert rows(files.lines(spark, str(tmp_path))) == [("a",), ("b",)]


def test_raw_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps({"pageid": i, "title": "t", "revisions": r}) for i, r in enumerate([[{"slots": {"main": {"*": " a\n"}}, "revid": 5, "timestamp": "2024-01-01T00:00:00Z"}], [{"slots": {"main": {"content": "b"}}}], [{"content": "c"}], []])))
    got = files.pages(spark.read.schema(files.RAW_PAGE).json(str(tmp_path))).orderBy("pageid").collect()
    assert [(r["source"], r["revision_id"]) for r in got] == [("a", 5), ("b", None), ("c", None), ("", None)]


def test_bucket_files(spark, tmp_path):
    report = spark.createDataFrame([("invalid", 1, "http://b", "http_404", "HTTP 404", 2), ("invalid", 3, "http://a", "http_5xx", "", 1), ("whitelisted", 2, "http://c", None, None, 1)], "bucket string, n long, origin string, issue_type string, detail string, rank int")
    files.write_buckets(report, f"{tmp_path}/out")
    got = [r["value"] for r in spark.read.text(f"{tmp_path}/out/bucket=invalid").collect()]
    assert got == ["3\thttp://a\thttp_5xx", "1\thttp://b\thttp_404 HTTP 404"]
    assert spark.read.text(f"{tmp_path}/out/bucket=whitelisted").first()["value"] == "2\thttp://c"
    assert [files.folder_name(), files.folder_name(10, True, 5)] == ["base", "low-pass-10_full-url_limit-5"]


# streams

EVENT = "run_id long, seq long, type string, step int"


def _stream(spark, events, folder):
    spark.createDataFrame(events, EVENT).repartition(3).write.parquet(folder)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_the_stream_ends_where_the_batch_does(spark, tmp_path):
    events = [(r, s, "error" if s == 9 and r == 1 else "ready" if s == 9 and r == 2 else "stepComplete", s) for r in range(4) for s in range(3 + 2 * r)]
    source = _stream(spark, events, f"{tmp_path}/in")
    progress.stream(source, "folded_now", f"{tmp_path}/c").awaitTermination()
    assert rows(spark.table("folded_now")) == rows(progress.folded(spark.createDataFrame(events, EVENT)))
    progress.logged(source, f"{tmp_path}/log", f"{tmp_path}/c2").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log")
    assert [r["seq"] for r in progress.replayed(log, 3, after=4).collect()] == [5, 6, 7, 8]


def test_replay_ends_with_the_terminal_event(spark):
    log = spark.createDataFrame([(1, 2, "done", 0), (1, 0, "progress", 1), (1, 1, "stepComplete", 1), (1, 3, "progress", 2)], EVENT)
    assert [r["type"] for r in progress.replayed(log, 1).collect()] == ["progress", "stepComplete", "done"]


def _lived(spark, events, keep_ms, name, until):
    """Rows of lived() over a running stream, once until(rows) holds."""
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(events, EVENT).coalesce(1).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(EVENT).parquet(f"{folder}/in")
    query = progress.lived(source, keep_ms).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            got = rows(spark.table(name))
            if until(got):
                return got
        return got
    finally:
        query.stop()


def test_runs_open_finish_and_drop_later_events(spark):
    events = [(1, 0, "progress", 1), (1, 1, "done", 1), (1, 2, "progress", 1), (2, 0, "progress", 1)]
    got = _lived(spark, events, 3_600_000, "lived_now", lambda r: len(r) >= 3)
    assert got == [(1, 0, "progress", "opened"), (1, 1, "done", "finished"), (2, 0, "progress", "opened")]


def test_state_goes_after_its_time(spark):
    got = _lived(spark, [(1, 0, "done", 1)], 100, "gone_now", lambda r: any(x[3] == "gone" for x in r))
    assert [x[3] for x in got] == ["finished", "gone"]


def test_windows_and_sessions_as_streams(spark, tmp_path):
    events = [("2024-01-01 00:00:00", "a", 1.0, 1), ("2024-01-01 00:20:00", "a", 2.0, 1), ("2024-01-01 02:00:00", "a", 4.0, 1), ("2024-01-02 00:00:00", "b", 1.0, 2)]
    df = spark.createDataFrame(events, "t string, event_type string, value double, user_id long").select(F.to_timestamp("t").alias("ts"), "event_type", "value", "user_id")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for k, make in enumerate([progress.windowed, lambda s: progress.windowed(s, "1 hour", "30 minutes"), progress.sessions]):
        query = make(source()).writeStream.outputMode("append").format("memory").queryName(f"windows_{k}").option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start()
        query.awaitTermination()
        closed = make(df).where("start < '2024-01-01 12:00:00'")  # the watermark has passed these
        assert rows(spark.table(f"windows_{k}")) == rows(closed)
