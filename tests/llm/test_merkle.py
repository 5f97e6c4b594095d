import hashlib
from collections import Counter

from pyspark.sql import functions as F

from sigtrace.llm import merkle as M
from sigtrace.llm.queries import QUERIES


def pages(spark, n=600):
    rows = [(i, f"http://h/{i}", "<html>" + "é" * (i * 37 % 900)) for i in range(n)]
    rows += [(None, None, None), (3, None, "x"), (5, "http://h/5", None), (9, "http://h/9", rows[9][2]), (9, "http://h/9", rows[9][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", *(F.lit(1).alias(x) for x in ("file", "node", "hash", "HTML")))


def by_hand(laid_out):
    """Records of each file in order, with offsets: the plain way."""
    files, out = {}, {}
    for r in laid_out:
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {r.url}\r\nWARC-Record-ID: <urn:md5:{r.record_id}>\r\nContent-Type: text/html\r\nContent-Length: {len(r.html.encode())}\r\n\r\n"
        files.setdefault(r.file, []).append((r.record_id, hashlib.sha256((head + r.html + "\r\n\r\n").encode()).hexdigest(), len((head + r.html + "\r\n\r\n").encode())))
    for file, records in files.items():
        at = 0
        for (name, digest, length), n in sorted(Counter(records).items()):
            out[(file, name, digest)] = (at, length, n)
            at += length * n
    return out


def status(one, other):
    """{(file, record_id, status): (expected, found, length)} of the plain comparison of all records."""
    found = {}
    for file in {k[0] for k in [*one, *other]}:
        shift = None
        for name in sorted({k[1] for k in [*one, *other] if k[0] == file}):
            a = {k[2]: v for k, v in one.items() if k[:2] == (file, name)}
            b = {k[2]: v for k, v in other.items() if k[:2] == (file, name)}
            sizes = [sum(length * n for _, length, n in x.values()) for x in (a, b)]
            lost, gained = set(a) - set(b), set(b) - set(a)
            kind = "corrupt" if lost and gained else "missing" if lost else "extra" if gained else "copies" if any(a[d][2] != b[d][2] for d in a) else ""
            if not kind:
                assert (shift is None) == all(a[d][0] == b[d][0] for d in a) or shift
                continue
            start = [min((v[0] for v in x.values()), default=None) for x in (a, b)]
            lengths = [v[1] for v in [*a.values(), *b.values()]]
            found[file, name, kind] = (*start, min(lengths))
            if sizes[0] != sizes[1] and shift is None:
                at = start[0] if start[0] is not None else start[1]
                shift = (file, name, "shifted"), (at + sizes[0], at + sizes[1])
        if shift:
            total = sum(v[1] * v[2] for k, v in other.items() if k[0] == file) - sum(v[1] * v[2] for k, v in one.items() if k[0] == file)
            found[shift[0]] = (*shift[1], total)
    return found


def rows_of(audited):
    rows = audited.collect()
    out = {(r.file, r.record_id, r.status): (r.expected_offset, r.found_offset, r.length) for r in rows}
    assert len(out) == len(rows)
    return out


def test_fixity_and_audit_equal_the_plain_comparison(spark, monkeypatch):
    monkeypatch.setattr(M, "RECORDS", 200)
    written = M.layout(pages(spark), 200).cache()
    damaged = M.aged(written).where("page_id is null or page_id <> 9").union(written.where("page_id = 9").limit(2)).union(
        written.where("page_id = 44").withColumn("record_id", F.lit("f" * 32))
    ).cache()
    one, other = by_hand(written.collect()), by_hand(damaged.collect())
    got = {(r.file, r.record_id, r.digest): (r.offset, r.length, r.copies) for r in M.fixity(written).collect()}
    assert got == one
    for records in (M.RANGE, 1, 10_000):
        found = rows_of(M.audit(M.fixity(written), M.fixity(damaged), records))
        assert found == status(one, other)
    assert {"corrupt", "missing", "extra", "shifted", "copies"} == {kind for _, _, kind in found}


def test_one_lost_record_gives_one_row_and_one_shift(spark):
    """The leaves behind it are the same in both replicas, so one leaf of one file is read."""
    written = M.layout(pages(spark), 200)
    entries = M.fixity(written).cache()
    victim = entries.where("file = 1").orderBy("record_id").take(20)[10]
    damaged = M.fixity(written.where(F.col("record_id") != victim.record_id))
    leaves, level = M.suspects(entries, damaged)
    assert level >= 2 and leaves.count() == 1
    assert rows_of(M.audit(entries, damaged)) == {
        (1, victim.record_id, "missing"): (victim.offset, None, victim.length),
        (1, victim.record_id, "shifted"): (victim.offset + victim.length, victim.offset, -victim.length),
    }


def test_only_differing_branches_are_descended(spark):
    written = M.layout(pages(spark), 200)
    entries = M.fixity(written).cache()
    changed = entries.withColumn("digest", F.when(F.col("record_id") == entries.first().record_id, "0").otherwise(F.col("digest")))
    levels = M.height([entries], 1)
    assert levels >= 3
    one, other = (M.tree(e, levels) for e in (entries, changed))
    parents = None
    for level in range(levels, -1, -1):
        parents = M.differing(one[level], other[level], parents)
        assert parents.count() == 1


def test_leaves_read_follow_the_damage(spark):
    entries = M.fixity(M.layout(pages(spark), 200)).cache()
    for n in (1, 3, 9):
        names = [r.record_id for r in entries.orderBy("digest").limit(n).collect()]
        cut = entries.withColumn("length", F.when(F.col("record_id").isin(names), F.col("length") - 1).otherwise(F.col("length")))
        assert M.suspects(entries, cut)[0].count() <= n


def test_equal_replicas_and_empty_tables(spark):
    entries = M.fixity(M.layout(pages(spark)))
    assert M.audit(entries, entries).count() == 0
    none = M.fixity(M.layout(pages(spark).limit(0)))
    assert M.audit(none, none).count() == 0
    assert {r.status for r in M.audit(entries, none).collect()} == {"missing", "shifted"}


def test_every_moved_record_has_a_row(spark, monkeypatch):
    monkeypatch.setattr(M, "RECORDS", 200)
    written = M.layout(pages(spark), 200).cache()
    damaged = M.aged(written).where("record_id not like '3%'").unionByName(written.where("page_id = 77")).cache()
    one, other = by_hand(written.collect()), by_hand(damaged.collect())
    want = status(one, other)
    told = {key[:2] for key in want if key[2] != "shifted"}
    for key in set(one) & set(other):
        if key[:2] not in told and one[key][0] != other[key][0]:
            want[(*key[:2], "moved")] = (one[key][0], other[key][0], one[key][1])
    for records in (M.RANGE, 1, 10_000):
        assert rows_of(M.audit(M.fixity(written), M.fixity(damaged), records, moved=True)) == want
    assert sum(kind == "moved" for _, _, kind in want) > 300


def test_the_query_tells_moved_records(spark, sf_dir):
    rows = QUERIES["op8_warc_fixity"](spark, sf_dir).where("status = 'moved'").collect()
    assert rows and all(r.expected_offset != r.found_offset for r in rows)
