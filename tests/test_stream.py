import shutil

from pyspark.sql import functions as F

from sigtrace.operators.hits import recent_hits
from sigtrace.plans.hits import scan
from sigtrace.plans.update import current_feeds, current_indicators, publish_feed, save_feeds, unload_feeds
from sigtrace.sources.logs import finish_batch, read_log_lines, read_log_stream
from sigtrace.sources.tail import register_tail
from sigtrace.streaming.scan import FeedHolder, running_counters, scan_stream, stored_alerts, stored_hits

from .helpers import feed, rows, tlds

PLAIN = ("matched_text", "match_type", "source", "database_id", "matched_indicators", "data")


def no_feeds(spark, root):
    return current_feeds(spark, root)


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_publish_replaces_and_unload_removes(spark, tmp_path):
    root = str(tmp_path)
    assert current_indicators(spark, root).count() == 0
    a = publish_feed(feed(spark, ["a.com", "10.0.0.0/8"]), no_feeds(spark, root), "auto-1", "v1", root, sha256="h1")
    b = publish_feed(feed(spark, ["mine.com"]), a, "mine", "v1", root, auto_updated=False)
    assert rows(current_indicators(spark, root), "feed_id", "entry") == [("auto-1", "10.0.0.0/8"), ("auto-1", "a.com"), ("mine", "mine.com")]
    c = publish_feed(feed(spark, ["b.com"]), b, "auto-1", "v2", root, sha256="h2")
    assert rows(c, "feed_id", "is_auto_updated", "sha256") == [("auto-1", True, "h2"), ("mine", False, None)]
    assert rows(current_indicators(spark, root), "entry") == [("b.com",), ("mine.com",)]
    save_feeds(unload_feeds(c, spark.createDataFrame([("mine",)], "feed_id string")), root)
    assert rows(current_feeds(spark, root), "feed_id") == [("auto-1",)]


def test_stream_equals_batch_over_restart_and_reload(spark, tmp_path):
    logs, out, state, root = (str(tmp_path / n) for n in ("logs", "out", "state", "root"))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "conn.log").write_text("10.1.1.1 evil.com\n\nnothing\n")
    feeds = publish_feed(feed(spark, ["10.0.0.0/8"]), no_feeds(spark, root), "nets", "1", root, auto_updated=False)

    def run():
        stream = read_log_stream(spark, logs, "m", "*.log")
        q = scan_stream(stream, lambda: current_indicators(spark, root), tlds(spark), out, state, {"availableNow": True})
        finish(q)
        return q

    first = run()
    progress = [p for p in first.recentProgress if p.observedMetrics.get("lines")]
    assert sum(p.observedMetrics["lines"]["lines"] for p in progress) == 2
    assert rows(stored_hits(spark, out), "matched_text") == [("10.1.1.1",)]

    publish_feed(feed(spark, [("evil.com", '{"a":1}')]), feeds, "names", "1", root, auto_updated=False)
    (tmp_path / "logs" / "dns.log").write_text("10.2.2.2 evil.com\n\nevil.com\nevil.com\n")
    run()
    (tmp_path / "both").mkdir()
    shutil.copy(tmp_path / "logs" / "dns.log", tmp_path / "both" / "dns.log")
    batch = scan(read_log_lines(spark, str(tmp_path / "both"), "m", capture=True), current_indicators(spark, root), tlds(spark))
    assert batch.count() == 4
    assert rows(stored_hits(spark, out).where("source = 'Zeek:dns'"), *PLAIN) == rows(batch, *PLAIN)
    assert rows(running_counters(spark, out), "monitor_id", "lines_processed", "items_extracted", "hits_found") == [("m", 5, 6, 5)]
    assert stored_alerts(spark, out).where(F.col("title") == "Intelligence Hit: IPv4").count() == 2
    assert recent_hits(stored_hits(spark, out), stored_hits(spark, out), n=3).count() == 3


def test_batches_of_closed_files_number_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / name).write_text("".join(f"{name}{i}\n" if i % 3 else "\n" for i in range(1, 2001)))
    got = []

    def collect(batch, _):
        got.extend(rows(finish_batch(batch.persist()), "line", "line_number"))

    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        stream = read_log_stream(spark, str(tmp_path / "in"), "m")
        finish(stream.writeStream.foreachBatch(collect).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted((f"{n}{i}", i) for n in "ab" for i in range(1, 2001) if i % 3)


def test_tail_stream_with_disabled_monitor_and_no_feed(spark, tmp_path):
    register_tail(spark)
    (tmp_path / "logs").mkdir()
    log = tmp_path / "logs" / "a.log"
    log.write_text("evil.com\n")

    def run(name, monitors=None, entries=("evil.com",)):
        lines = spark.readStream.format("tail").option("path", str(tmp_path / "logs")).option("monitorId", "m").option("startingPosition", "earliest").load()
        indicators = feed(spark, ["evil.com"]).where(F.col("entry").isin(*entries) if entries else F.lit(False))
        out = str(tmp_path / name)
        finish(scan_stream(lines, lambda: indicators, tlds(spark), out, out + "-state", {"availableNow": True}, monitors, include_line=True))
        return out

    on, off, empty = run("on"), run("off", spark.createDataFrame([("m", False)], "monitor_id string, enabled boolean")), run("empty", entries=())
    assert rows(stored_hits(spark, on), "matched_text", "log_line") == [("evil.com", "evil.com")]
    assert stored_hits(spark, off).count() == 0 and stored_hits(spark, empty).count() == 0
    assert rows(running_counters(spark, empty), "lines_processed", "items_extracted", "hits_found") == [(1, 1, 0)]


def test_failed_reload_keeps_the_last_feeds(spark):
    good = feed(spark, ["evil.com"])
    answers = iter([good, ValueError("broken")])

    def load():
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    holder = FeedHolder(load)
    assert holder.refresh()[0] is good and holder.refresh()[0] is good and holder.profile.rows == 1


def test_two_streams_on_one_folder_keep_all_hits(spark, tmp_path):
    out, root = str(tmp_path / "out"), str(tmp_path / "root")
    publish_feed(feed(spark, ["10.0.0.0/8"]), no_feeds(spark, root), "nets", "1", root)
    for name in "ab":
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.log").write_text(f"10.1.1.{ord(name)}\n")
        stream = read_log_stream(spark, str(tmp_path / name), name, "*.log")
        finish(scan_stream(stream, lambda: current_indicators(spark, root), tlds(spark), out, str(tmp_path / f"state-{name}"), {"availableNow": True}))
    assert rows(stored_hits(spark, out), "matched_text") == [("10.1.1.97",), ("10.1.1.98",)]
    assert rows(running_counters(spark, out), "monitor_id", "hits_found") == [("a", 1), ("b", 1)]
    assert stored_alerts(spark, out).count() == 2


def test_the_last_feed_can_be_unloaded_and_another_published(spark, tmp_path):
    root = str(tmp_path)
    only = publish_feed(feed(spark, ["a.com"]), no_feeds(spark, root), "auto", "v1", root)
    held = current_indicators(spark, root)
    save_feeds(unload_feeds(only, only.select("feed_id")), root)
    assert current_feeds(spark, root).count() == 0 and current_indicators(spark, root).count() == 0
    (tmp_path / "feeds" / "snapshot=9" / "write=broken" / "_temporary").mkdir(parents=True)
    again = publish_feed(feed(spark, ["b.com"]), current_feeds(spark, root), "auto", "v1", root)
    assert rows(again, "feed_id") == [("auto",)]
    assert rows(current_indicators(spark, root), "entry") == [("b.com",)]
    assert rows(held, "entry") == [("a.com",)]  # readers of the version before are undisturbed


def test_two_monitors_on_one_path_get_their_own_hits(spark, tmp_path):
    lines = spark.createDataFrame(
        [(m, "s", "p", 1, "GET evil.com") for m in "ab"], "monitor_id string, source string, path string, line_number long, line string"
    )
    hits = scan(lines, feed(spark, ["evil.com"]), tlds(spark))
    assert [r.matched_indicators for r in hits.collect()] == [["pattern_0"]] * 2
    assert hits.select("id").distinct().count() == 2


def run_once(spark, tmp_path, *texts, **options):
    """One run of a stream over a folder to which a file with ``texts`` is added."""
    logs = tmp_path / "logs"
    logs.mkdir(exist_ok=True)
    if texts:
        (logs / f"{len(list(logs.iterdir()))}.log").write_text("\n".join(texts) + "\n")
    out, indicators = str(tmp_path / "out"), feed(spark, ["evil.com", "10.0.0.0/8"])
    stream = read_log_stream(spark, str(logs), "m", "*.log", max_files=1)
    finish(scan_stream(stream, lambda: indicators, tlds(spark), out, str(tmp_path / "state"), {"availableNow": True}, **options))
    return out


def test_alerts_of_a_failed_write_come_once_after_a_restart(spark, tmp_path, monkeypatch):
    from sigtrace.streaming import scan as body

    def broken(hits):
        raise OSError("no space")

    with monkeypatch.context() as patch:
        patch.setattr(body, "alerts", broken)
        out = run_once(spark, tmp_path, "evil.com", "10.1.1.1")
        run_once(spark, tmp_path, "evil.com again")
    assert stored_alerts(spark, out) is None and stored_hits(spark, out).count() == 3
    run_once(spark, tmp_path)  # nothing new: the start of the query alone brings them
    assert rows(stored_alerts(spark, out), "title") == [("Intelligence Hit: Domain",)] * 2 + [("Intelligence Hit: IPv4",)]
    run_once(spark, tmp_path, "evil.com")
    assert stored_alerts(spark, out).count() == stored_hits(spark, out).count() == 4


def test_last_activity_over_midnight(spark, tmp_path):
    from sigtrace.operators.counters import monitor_counts, shown_counts, summed_counts

    lines = spark.createDataFrame([("a",), ("b",)], "monitor_id string")
    batches = []
    for moment in ("2024-05-01 23:59:50", "2024-05-02 00:00:10"):
        hits = spark.sql(f"SELECT 'a' AS monitor_id, TIMESTAMP '{moment}' AS timestamp")
        batches.append(monitor_counts(lines, lines, hits))
    both = shown_counts(summed_counts(batches[0].union(batches[1]), "monitor_id"))
    assert rows(both, "monitor_id", "lines_processed", "hits_found", "last_activity") == [("a", 2, 2, "00:00:10"), ("b", 2, 0, None)]


def test_batches_are_folded_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    from sigtrace.streaming import store

    monkeypatch.setattr(store, "FOLD", 3)
    folder = f"{tmp_path}/hits/stream=s"
    most = 0
    for n in range(40):
        spark.range(n, n + 1).write.mode("overwrite").parquet(f"{folder}/batch_id={n}")
        if n % 3 == 2:
            store.fold(spark, folder, n, waiting=lambda batch: batch == 4 and n < 12)
        most = max(most, len(store.children(spark, folder)))
        if n % 7 == 0:
            assert rows(spark.read.parquet(*store.live(spark, f"{tmp_path}/hits")), "id") == [(i,) for i in range(n + 1)]
    assert rows(spark.read.parquet(*store.live(spark, f"{tmp_path}/hits")), "id") == [(i,) for i in range(40)]
    assert most <= 18 and len(store.live(spark, f"{tmp_path}/hits")) <= 8
    # a batch that was folded and is run again changes nothing; one that broke off does not count
    spark.range(37, 38).write.mode("overwrite").parquet(f"{folder}/batch_id=37")
    (tmp_path / "hits" / "stream=s" / "batch_id=40").mkdir()
    assert rows(spark.read.parquet(*store.live(spark, f"{tmp_path}/hits")), "id") == [(i,) for i in range(40)]


def test_a_stream_folds_its_tables(spark, tmp_path, monkeypatch):
    from sigtrace.streaming import store

    monkeypatch.setattr(store, "FOLD", 2)
    for i in range(5):
        out = run_once(spark, tmp_path, f"10.0.0.{i}")
    assert rows(stored_hits(spark, out), "matched_text") == [(f"10.0.0.{i}",) for i in range(5)]
    assert stored_alerts(spark, out).count() == 5
    assert rows(running_counters(spark, out), "monitor_id", "lines_processed", "hits_found") == [("m", 5, 5)]
    assert all(len(store.live(spark, f"{out}/{t}")) == 2 for t in ("hits", "alerts", "counters"))
