import os

import pytest

from sigtrace.sources.tail import TailReader, register_tail


def reader(path, **options):
    return TailReader({"path": str(path), **{k.lower(): str(v) for k, v in options.items()}})


def lines_between(r, start, end):
    out = []
    for part in r.partitions(start, end):
        for batch in r.read(part):
            out += [(d["path"].rsplit("/", 1)[-1], d["line_number"], d["line"]) for d in batch.to_pylist()]
    return sorted(out)


def append(path, data):
    with open(path, "ab") as f:
        f.write(data)


def test_latest_starts_behind_the_last_newline(tmp_path):
    log = tmp_path / "a.log"
    append(log, b"old\nhalf")
    r = reader(tmp_path)
    first = r.latestOffset()
    assert r.initialOffset() == first and lines_between(r, first, first) == []
    append(log, b" line\nnext\nopen")
    second = r.latestOffset()
    assert lines_between(r, first, second) == [("a.log", 4, "half line"), ("a.log", 14, "next")]
    append(tmp_path / "b.log", b"new file\n")
    third = r.latestOffset()
    assert lines_between(r, second, third) == [("b.log", 0, "new file")]


def test_rotation_and_truncation_restart_the_file(tmp_path):
    log = tmp_path / "a.log"
    append(log, b"one\ntwo\n")
    r = reader(tmp_path, startingPosition="earliest")
    a = r.latestOffset()
    assert len(lines_between(r, {}, a)) == 2
    os.rename(log, tmp_path.parent / "gone")
    append(log, b"another file that is longer\n")
    b = r.latestOffset()
    assert lines_between(r, a, b) == [("a.log", 0, "another file that is longer")]
    with open(log, "wb") as f:
        f.write(b"x\n")
    c = r.latestOffset()
    assert lines_between(r, b, c) == [("a.log", 0, "x")]


def test_replaced_after_planning_fails_the_batch(tmp_path):
    log = tmp_path / "a.log"
    append(log, b"one\n")
    r = reader(tmp_path, startingPosition="earliest")
    end = r.latestOffset()
    parts = r.partitions({}, end)
    with open(log, "wb") as f:
        f.write(b"two\n")
    with pytest.raises(Exception, match="replaced"):
        list(r.read(parts[0]))
    with pytest.raises(Exception, match="replaced"):
        r.partitions({}, end)
    assert reader(tmp_path, failOnDataLoss="false").partitions({}, end) == []


@pytest.mark.parametrize("piece", [1, 3, 7, 64])
def test_ranges_cover_every_line_once(tmp_path, piece):
    data = b"a\n\nbb\n" + b"c" * 50 + b"\n\xff\xfe\r\n" + "é\n".encode() + b"last"
    append(tmp_path / "a.log", data)
    r = reader(tmp_path, startingPosition="earliest", partitionBytes=piece)
    got = lines_between(r, {}, r.latestOffset())
    assert [t for _, _, t in got] == ["a", "bb", "c" * 50, "��\r", "é"]


def test_byte_limit_stops_at_a_line_end(tmp_path):
    log = tmp_path / "a.log"
    append(log, b"0\n")
    r = reader(tmp_path, startingPosition="earliest", maxBytesPerBatch=10)
    offset = r.latestOffset()
    append(log, b"".join(b"line%d\n" % i for i in range(5)) + b"x" * 40 + b"\n")
    sizes = []
    while (after := r.latestOffset()) != offset:
        sizes.append(len(lines_between(r, offset, after)))
        offset = after
    assert sizes == [1, 1, 1, 1, 1, 1]


def test_stream_restart_reads_only_what_is_new(spark, tmp_path):
    register_tail(spark)
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()
    append(logs / "a.log", b"l1\npart")

    def run():
        lines = (
            spark.readStream.format("tail").option("path", str(logs)).option("startingPosition", "earliest")
            .option("pathGlobFilter", "*.log").option("capture", "true").option("monitorId", "m").load()
        )
        q = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted((r.source, r.line) for r in spark.read.parquet(out).collect())

    assert run() == [("Zeek:a", "l1")]
    append(logs / "a.log", b"ial\nl3\n")
    append(logs / "b.txt", b"other\n")
    append(logs / "c.log.log", b"c1\n")
    assert run() == [("Zeek:a", "l1"), ("Zeek:a", "l3"), ("Zeek:a", "partial"), ("Zeek:c", "c1")]


def test_rotation_to_a_file_with_the_same_first_bytes(tmp_path):
    log = tmp_path / "a.log"
    head = b"#" * 2000 + b"\n"
    append(log, head + b"old 1\n")
    r = reader(tmp_path, startingPosition="earliest")
    r.initialOffset()
    a = r.latestOffset()
    with open(log, "wb") as f:
        f.write(head + b"new 1\nnew 2\nnew 3\n")
    b = r.latestOffset()
    assert [t for _, _, t in lines_between(r, a, b)][-3:] == ["new 1", "new 2", "new 3"]


def test_a_busy_file_does_not_hold_up_another(tmp_path):
    r = reader(tmp_path, startingPosition="earliest", maxBytesPerBatch=100)
    at = r.initialOffset()
    got = []
    for i in range(12):
        append(tmp_path / "a.log", b"busy line %d\n" % i * 50)
        append(tmp_path / "z.log", b"rare %d\n" % i)
        end = r.latestOffset()
        got += lines_between(r, at, end)
        at = end
    assert [t for n, _, t in got if n == "z.log"] == [f"rare {i}" for i in range(12)]


def test_many_files_take_turns(tmp_path):
    for i in range(10):
        append(tmp_path / f"{i}.log", b"0123456789\n" * 20)
    r = reader(tmp_path, startingPosition="earliest", maxBytesPerBatch=33)
    at, got = r.initialOffset(), []
    for _ in range(80):
        end = r.latestOffset()
        batch = lines_between(r, at, end)
        assert 1 <= len(batch) <= 4
        got, at = got + batch, end
        if len(got) == 200:
            break
    assert len(got) == len(set(got)) == 200


def test_first_batch_keeps_the_limit(tmp_path):
    append(tmp_path / "a.log", b"0123456789\n" * 1000)
    r = reader(tmp_path, startingPosition="earliest", maxBytesPerBatch=100)
    start = r.initialOffset()
    assert len(lines_between(r, start, r.latestOffset())) <= 10


def test_unchanged_files_are_not_opened(tmp_path, monkeypatch):
    append(tmp_path / "a.log", b"one\n")
    r = reader(tmp_path, startingPosition="earliest")
    r.initialOffset()
    a = r.latestOffset()
    monkeypatch.setattr(r, "_is_same", lambda *_: pytest.fail("opened"))
    assert r.latestOffset() == a


def test_restarted_reader_goes_on_from_its_log_within_the_limit(tmp_path):
    logs, log = tmp_path / "logs", tmp_path / "log"
    logs.mkdir()
    options = {"startingPosition": "earliest", "maxBytesPerBatch": 55, "positionLog": log}
    append(logs / "a.log", b"0123456789\n" * 5)
    r = reader(logs, **options)
    at = r.initialOffset()
    end = r.latestOffset()
    got = lines_between(r, at, end)
    append(logs / "a.log", b"9876543210\n" * 200)
    for _ in range(40):  # the reader starts anew for every batch
        r, at = reader(logs, **options), end
        end = r.latestOffset()
        batch = lines_between(r, at, end)
        assert len(batch) == 5
        got += batch
    assert len(set(got)) == 205
    torn = sorted(log.iterdir(), key=lambda f: int(f.read_bytes().split(b" ")[0]))[-1]
    torn.write_bytes(torn.read_bytes()[:20])  # the writer died: Spark plans that batch anew before it asks for more
    r = reader(logs, **options)
    assert lines_between(r, at, end) == sorted(batch) and r.latestOffset() == end
    assert reader(logs, **options).initialOffset() == {}  # a new query does not look there


def test_log_older_than_the_checkpoint_is_told(tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    append(logs / "a.log", b"one\ntwo\n")
    r = reader(logs, startingPosition="earliest", maxBytesPerBatch=4)
    r.initialOffset()
    first, second = r.latestOffset(), r.latestOffset()
    with pytest.raises(Exception, match="positionLog"):
        r.partitions(second, first)


def test_stream_restarts_within_the_byte_limit(spark, tmp_path):
    register_tail(spark)
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()
    append(logs / "a.log", b"".join(b"line %05d\n" % i for i in range(30)))

    def run():
        lines = (
            spark.readStream.format("tail").option("path", str(logs)).option("startingPosition", "earliest")
            .option("maxBytesPerBatch", "55").option("positionLog", f"{state}-positions").load()
        )
        q = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(r.line for r in spark.read.parquet(out).collect())

    assert len(run()) == 30  # a query's very first batch has no log to go on from
    append(logs / "a.log", b"".join(b"line %05d\n" % i for i in range(30, 45)))
    for n in (35, 40, 45):
        assert run() == [f"line {i:05}" for i in range(n)]
