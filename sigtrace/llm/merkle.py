"""Fixity audit of WARC replicas with Merkle trees over ordered offset ranges.

A file holds its records in the order of their names, which are hashes of content.  Records are
hashed one by one; the records whose names begin with the same bits stand in one range of
offsets, and the hashes of a range, with offsets counted from its start, make a leaf.
``FANOUT`` neighbours make the node above, up to one root for each file.  Ranges
are thus cut by content: a lost, added or cut record changes its own leaf and the
nodes above, and leaves behind it stay as they are though they stand elsewhere in the file.  Two replicas
are compared from the roots down: only children of differing nodes are read
at each level, and only records of differing ranges are compared one by one.  That
everything behind a place has moved is told once for each file; on request every moved
record is told too: a range with the same hash at another start holds the same records, all moved by
the difference of the starts.

Equal records of a file stand next to each other and are held as one entry with its
number of copies, so that no range grows with repeated captures.  Null columns of a
page are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigtrace.operators.staging import stage

from .rows import only

#: Records of a file in expectation, records of a leaf range in expectation, bits of a name that each level tells apart.
RECORDS, RANGE, BITS = 1000, 8, 3
#: Children of a node.
FANOUT = 1 << BITS
#: Bits of a name that are looked at, the first 15 hexadecimal digits.
NAME_BITS = 60


def layout(pages: DataFrame, records: int = RECORDS) -> DataFrame:
    """(file, record_id, page_id, url, html): the file and name that each page gets when it is written.

    A record is named by the MD5 of its content, which also spreads records over
    files whatever the keys and hosts are.
    """
    rows = only(pages, "page_id", "url", "html")
    page, url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "url", "html"))
    files = max(1, -(-rows.count() // records))
    name = F.md5(F.concat_ws("|", page, url, html).cast("binary"))
    number = F.conv(F.substring(name, 1, 8), 16, 10).cast("long")
    return rows.select(F.pmod(number, F.lit(files)).alias("file"), name.alias("record_id"), "page_id", url.alias("url"), html.alias("html"))


def record_bytes(url: Column, record_id: Column, html: Column) -> Column:
    """A WARC resource record as stored, uncompressed."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Record-ID: <urn:md5:"),
        record_id,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, html, F.lit("\r\n\r\n"))


def fixity(laid_out: DataFrame) -> DataFrame:
    """(file, record_id, offset, length, copies, digest) of written records, in the order of their names.

    Only hashes and lengths are shuffled, never pages.
    """
    stored = record_bytes(F.col("url"), F.col("record_id"), F.col("html"))
    entries = (
        laid_out.select("file", "record_id", stored.alias("stored"))
        .select("file", "record_id", F.octet_length("stored").cast("long").alias("length"), F.sha2(F.col("stored").cast("binary"), 256).alias("digest"))
        .groupBy("file", "record_id", "length", "digest")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    before = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0))
    return entries.select("file", "record_id", offset.alias("offset"), "length", "copies", "digest")


def node_of(record_id: Column, level: int) -> Column:
    """The number of a record's node, ``level`` levels below the root; numbers follow the order of names."""
    number = F.conv(F.substring(record_id, 1, NAME_BITS // 4), 16, 10).cast("long")
    return F.shiftright(number, NAME_BITS - BITS * level)


def leaves(entries: DataFrame, level: int) -> DataFrame:
    """(file, node, hash, start) of ranges of records, offsets hashed as counted from ``start``, that of the first."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "record_id", "length", "copies", "digest")))
    text = lambda e, first: F.concat_ws(":", e["offset"] - first, e["record_id"], e["length"], e["copies"], e["digest"])
    grouped = entries.groupBy("file", node_of(F.col("record_id"), level).alias("node")).agg(ordered.alias("range"))
    start = F.col("range")[0]["offset"]
    joined = F.array_join(F.transform("range", lambda e: text(e, start)), ",")
    return grouped.select("file", "node", F.sha2(joined.cast("binary"), 256).alias("hash"), start.alias("start"))


def above(nodes: DataFrame) -> DataFrame:
    """The next level: each node hashes its children's numbers and hashes in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda e: F.concat_ws(":", e["node"], e["hash"]))
    return nodes.groupBy("file", F.shiftright("node", BITS).alias("node")).agg(F.sha2(F.array_join(ordered, ",").cast("binary"), 256).alias("hash"))


def tree(entries: DataFrame, levels: int) -> list[DataFrame]:
    """Levels from the leaves to one root for each file."""
    out = [stage(leaves(entries, levels))]
    for _ in range(levels):
        out.append(above(out[-1]))
    return out


def height(entries: list[DataFrame], records: int = RANGE) -> int:
    """Levels below the root that leave some ``records`` in a leaf of the longest file."""
    longest = max((e.groupBy("file").count().agg(F.max("count")).first()[0] or 0) for e in entries)
    levels = 0
    while longest > records and levels < NAME_BITS // BITS:
        longest, levels = longest / FANOUT, levels + 1
    return levels


def differing(one: DataFrame, other: DataFrame, parents: DataFrame | None) -> DataFrame:
    """(file, node) with unequal or one-sided hashes, among the children of ``parents``."""
    sides = []
    for side, nodes in enumerate((one, other)):
        if parents is not None:
            wanted = parents.withColumnRenamed("node", "parent")
            nodes = nodes.withColumn("parent", F.shiftright("node", BITS)).join(wanted, ["file", "parent"], "left_semi")
        sides.append(nodes.select("file", "node", F.col("hash").alias(f"hash_{side}")))
    joined = sides[0].join(sides[1], ["file", "node"], "full")
    return joined.where(~F.col("hash_0").eqNullSafe(F.col("hash_1"))).select("file", "node")


def descend(trees: list[list[DataFrame]]) -> DataFrame:
    """The leaves (file, node) in which two trees differ, found from the roots down."""
    nodes = None
    for one, other in zip(*map(reversed, trees)):
        nodes = stage(differing(one, other, nodes))
    return nodes


def suspects(expected: DataFrame, found: DataFrame, records: int = RANGE) -> tuple[DataFrame, int]:
    """The leaves (file, node) that differ and their level."""
    levels = height([expected, found], records)
    return descend([tree(e, levels) for e in (expected, found)]), levels


def moved_with_ranges(entries: DataFrame, one: DataFrame, other: DataFrame, level: int) -> DataFrame:
    """Rows of ``audit`` for the records of equal leaves that start elsewhere in ``other``; ``entries`` are those of ``one``."""
    starts = one.withColumnRenamed("start", "start_0").join(other.withColumnRenamed("start", "start_1"), ["file", "node", "hash"])
    ranges = starts.where("start_0 <> start_1").select("file", "node", (F.col("start_1") - F.col("start_0")).alias("by"))
    inside = entries.withColumn("node", node_of(F.col("record_id"), level)).join(ranges, ["file", "node"])
    rows = inside.groupBy("file", "record_id").agg(
        F.min("offset").alias("expected_offset"), F.min(F.col("offset") + F.col("by")).alias("found_offset"), F.min("length").alias("length")
    )
    return rows.select("file", "record_id", F.lit("moved").alias("status"), "expected_offset", "found_offset", "length")


def audit(expected: DataFrame, found: DataFrame, records: int = RANGE, moved: bool = False) -> DataFrame:
    """file, record_id, status, expected_offset, found_offset, length of every record that differs.

    ``expected`` and ``found`` are tables of ``fixity``.  Status: ``corrupt`` (other
    bytes), ``missing``, ``extra`` or ``copies`` (stored more or less often).  A file in which records
    stand elsewhere because of such a one has one more row, ``shifted``, with the first record
    that moves the others: where it ends in both replicas, and as length how much longer the found
    file is in all (shorter: negative).  With ``moved`` every record of the same bytes at another
    offset has a row ``moved`` as well.  Equal replicas give no rows.
    """
    expected, found = stage(expected), stage(found)
    level = height([expected, found], records)
    trees = [tree(e, level) for e in (expected, found)]
    nodes = descend(trees)
    keys = ["file", "record_id", "digest"]
    sides = []
    for side, entries in enumerate((expected, found)):
        touched = entries.withColumn("node", node_of(F.col("record_id"), level)).join(nodes, ["file", "node"], "left_semi")
        sides.append(touched.select(*keys, *(F.col(c).alias(f"{c}_{side}") for c in ("offset", "length", "copies"))))
    pairs = sides[0].join(sides[1], keys, "full")
    lost, gained = F.col("offset_1").isNull(), F.col("offset_0").isNull()
    elsewhere = F.col("offset_0") != F.col("offset_1")
    recounted = F.col("copies_0") != F.col("copies_1")
    size = lambda side: F.coalesce(F.sum(F.col(f"length_{side}") * F.col(f"copies_{side}")), F.lit(0))
    compared = pairs.groupBy("file", "record_id").agg(
        F.max(lost).alias("lost"),
        F.max(gained).alias("gained"),
        F.max(recounted).alias("recounted"),
        F.max(elsewhere).alias("elsewhere"),
        F.min("offset_0").alias("expected_offset"),
        F.min("offset_1").alias("found_offset"),
        F.min(F.coalesce("length_0", "length_1")).alias("length"),
        size(0).alias("size_0"),
        size(1).alias("size_1"),
    )
    status = (
        F.when(F.col("lost") & F.col("gained"), "corrupt")
        .when(F.col("lost"), "missing")
        .when(F.col("gained"), "extra")
        .when(F.col("recounted"), "copies")
        .when(F.col("elsewhere") & F.lit(moved), "moved")
    )
    rows = stage(compared.withColumn("status", status).where("status is not null"))
    # nothing before the first record of another size has moved, so it begins at one place in both replicas
    begins = F.coalesce("expected_offset", "found_offset")
    first = F.min(F.struct("record_id", (begins + F.col("size_0")).alias("ends_0"), (begins + F.col("size_1")).alias("ends_1")))
    sizes = rows.where("size_0 <> size_1").groupBy("file").agg(first.alias("first"), F.sum(F.col("size_1") - F.col("size_0")).alias("length"))
    shifts = sizes.select(
        "file", "first.record_id", F.lit("shifted").alias("status"), F.col("first.ends_0").alias("expected_offset"), F.col("first.ends_1").alias("found_offset"), "length"
    )
    out = rows.select(*shifts.columns).unionByName(shifts)
    return out.unionByName(moved_with_ranges(expected, trees[0][0], trees[1][0], level)) if moved else out


def aged(laid_out: DataFrame) -> DataFrame:
    """A replica with planted damage: altered first characters, cut pages and lost records, by page_id."""
    page = F.coalesce(F.col("page_id"), F.lit(0).cast("long"))
    altered = F.when(page % 211 == 5, F.concat(F.lit("!"), F.substring("html", 2, 2**31 - 1)))
    cut = F.when(page % 997 == 7, F.expr("left(html, length(html) div 2)"))
    return laid_out.where(page % 1499 != 11).withColumn("html", F.coalesce(cut, altered, "html"))
