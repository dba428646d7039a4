"""Stage counts, runs written anew, table functions and subscribers."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from citeweave import queries
from citeweave.observing import Stages, StreamProgress, observed
from citeweave.operators import citations, tables, wikitext
from citeweave.sources import runs
from citeweave.staging import staged
from citeweave.streaming import fanout, lives

EVENT = "run_id long, seq long, type string"


def test_stages_are_counted_on_the_way(spark, sf_dir):
    stages = Stages()
    c = staged(stages.watched(queries._candidates(spark, sf_dir), "raw_extracted", last_term=F.max("term_ord")))
    got = staged(stages.watched(citations.extracted(c, queries._assess(c), least=4), "extracted"))
    want = queries.extraction_counts(spark, sf_dir).first()
    counts = stages.counts()
    assert {s: r["rows"] for s, r in counts.items()} == {"raw_extracted": want["raw_extracted"], "extracted": want["extracted"]}
    assert counts["extracted"]["rows"] == got.count()
    with pytest.raises(ValueError, match="watched already"):
        stages.watched(c, "extracted")


def test_streams_call_back(spark, tmp_path):
    spark.createDataFrame([(1, k, "progress") for k in range(5)], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    listener = StreamProgress(lambda name, batch, rows, stages: seen.append((name, batch, rows, stages)))
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        query = observed(source.where("seq > 1"), "late_ones").writeStream.format("noop").queryName("called").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(60)
        for _ in range(100):
            if seen:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert ("called", 0, 5, {"late_ones": {"rows": 3}}) in seen


def files_of(path):
    return {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_one_run_is_written_anew(spark, tmp_path):
    path = f"{tmp_path}/runs"
    df = spark.createDataFrame([(s, n) for s in ("a", "b", "it's") for n in range(3)], "slug string, n int")
    runs.write_runs(df, path)
    before = files_of(path)
    runs.replace_runs(spark.createDataFrame([("b", 9)], "slug string, n int"), path)
    after = files_of(path)
    kept = set(before) & set(after)
    assert all(before[f] == after[f] for f in kept) and kept == {f for d, _, names in os.walk(path) for f in names if f in before}
    own = {s: sorted(r["n"] for r in runs.read_run(spark, path, s).collect()) for s in ("a", "b", "it's", "none")}
    assert own == {"a": [0, 1, 2], "b": [9], "it's": [0, 1, 2], "none": []}
    plan = runs.read_run(spark, path, "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slug" in plan and "= b)" in plan


def test_cites_in_sql(spark):
    tables.register(spark)
    texts = ["{{cite web|url=http://a.b/c|title=T}} {{Cite news|title=N|quote=Q}}", "none", None, "{{cite book|title={{x|y}}}}"]
    spark.createDataFrame(list(enumerate(texts)), "pageid int, content string").createOrReplaceTempView("cited_pages")
    got = spark.sql("SELECT p.pageid, c.* FROM cited_pages p, LATERAL cites(p.content) c").collect()
    want = [(k, n, c["type"], c["url"], c["blurb"]) for k, t in enumerate(texts) for n, c in enumerate(wikitext.cites(t or ""))]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3


def test_first_rows_in_sql(spark, sf_dir):
    tables.register(spark)
    c = staged(queries._candidates(spark, sf_dir))
    c.createOrReplaceTempView("all_candidates")
    got = spark.sql("SELECT term_ord, hit_ord, para_ord, cite_ord, rank FROM first_rows(TABLE(all_candidates) PARTITION BY term_ord ORDER BY (hit_ord, para_ord, cite_ord), 6)")
    want = citations.batch(c, 6).select("term_ord", "hit_ord", "para_ord", "cite_ord", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_subscribers_get_every_event_once(spark, tmp_path):
    source, log, check = f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/c"
    put = lambda rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
    publish = lambda: fanout.published(spark.readStream.schema(EVENT).parquet(source), log, check).awaitTermination(120)
    early = fanout.Subscriber(spark, log, f"{tmp_path}/cursors", "early", EVENT)
    assert early.take().collect() == []
    put([(1, 0, "progress"), (1, 1, "stepComplete"), (2, 0, "progress")])
    publish()
    first = early.take().collect()
    assert [(r["run_id"], r["seq"]) for r in sorted(first)] == [(1, 0), (1, 1), (2, 0)]
    early.done()
    put([(1, 2, "done"), (1, 3, "progress"), (2, 1, "progress")])
    publish()
    # the last batch is run again, as after a crash before its commit
    shutil.rmtree(f"{check}/commits/1", ignore_errors=True)
    os.remove(f"{check}/commits/1") if os.path.exists(f"{check}/commits/1") else None
    for f in os.listdir(f"{check}/commits"):
        if f.startswith(".1"):
            os.remove(f"{check}/commits/{f}")
    publish()
    assert spark.read.parquet(log).count() == 6
    again = fanout.Subscriber(spark, log, f"{tmp_path}/cursors", "early", EVENT)
    second = [(r["run_id"], r["seq"]) for r in again.take().collect()]
    assert sorted(second) == [(1, 2), (1, 3), (2, 1)]
    assert sorted((r["run_id"], r["seq"]) for r in fanout.Subscriber(spark, log, f"{tmp_path}/cursors", "early", EVENT).take().collect()) == sorted(second)  # not done yet
    again.done()
    assert fanout.Subscriber(spark, log, f"{tmp_path}/cursors", "early", EVENT).take().collect() == []
    late = fanout.Subscriber(spark, log, f"{tmp_path}/cursors", "late", EVENT, run_id=1)
    assert [(r["seq"], r["type"]) for r in late.take().collect()] == [(0, "progress"), (1, "stepComplete"), (2, "done")]


def test_a_run_is_closed_and_then_gone(spark, tmp_path):
    rocks, key = lives.ROCKSDB, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    events = [(1, 0, "progress"), (1, 1, "done"), (1, 2, "progress"), (2, 0, "progress")]
    spark.createDataFrame(events, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
    query = lives.lives(source, close_ms=250, keep_ms=1500).writeStream.outputMode("append").format("memory").queryName("lives_now").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
    try:
        got = []
        for _ in range(60):
            query.awaitTermination(1)
            got = [tuple(r) for r in spark.table("lives_now").collect()]
            if any(r[3] == "gone" for r in got):
                break
    finally:
        query.stop()
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    own = [r[1:] for r in got if r[0] == 1]
    assert own == [(0, "progress", "opened"), (1, "done", "finished"), (None, None, "closed"), (None, None, "gone")]
    assert [r for r in got if r[0] == 2] == [(2, 0, "progress", "opened")]
