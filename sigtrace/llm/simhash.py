"""SimHash fingerprints and their links by a byte-position inverted index with count filtering.

Fingerprints within ``MAX_BITS`` = 3 bits share at least five of eight bytes in
place.  The index has a posting list for each choice of four positions in
``FOURS`` and each value of these four bytes: every set of five positions contains
one of the 14 choices, so a linked pair meets in some list.  Within a list the
shared positional bytes of a pair are tallied, pairs with five or more are kept and
verified by their differing bits.  A list gives only links that connect what is not
yet connected, so its output never exceeds its length.

Long lists are cut into parts and each pair of parts is a list of its own, spread
over the cluster.  Exact copies share one fingerprint and are joined back at the end.

Null and empty texts have fingerprint zero and are linked like any other.  Rows
with a null doc_id take part, but a component's id is its smallest doc_id that is
not null (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.operators.staging import stage

from .components import components
from .rows import only, original, split, with_columns

SHINGLE = 3
MAX_BITS = 3
#: Bytes that a pair within MAX_BITS shares in place, of eight.
SHARED = 8 - MAX_BITS
#: Parts of a posting list that are compared with one another in one go.
PART = 4096
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SEPARATORS = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
FOLD = bytes(SEPARATORS[LOWER[b]] for b in range(256))


def _position_choices() -> list[tuple[int, ...]]:
    """The 14 sets of four of eight positions, of which every five positions contain one.

    Both halves, and two pairs that belong to the same way of halving each half.
    """
    ways = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    mixed = [(*a, *(x + 4 for x in b)) for way in ways for a in way for b in way]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *mixed]


FOURS = _position_choices()

#: Entry b holds bit i of the byte b in lane i, one byte a lane.
LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = text.encode().translate(FOLD).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_digest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes (big-endian bytes, one row each), counted eight bits at a time."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 255):
        lanes = LANES[hashes[start : start + 255]].sum(axis=0)
        counts += lanes.astype("<u8").view(np.uint8)
    bits = (counts * 2 > n).reshape(8, 8)  # byte by byte, lowest bit first
    return int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "big")


def with_fingerprint(documents: DataFrame) -> DataFrame:
    """All columns of ``documents`` and, last, the fingerprint as a signed long."""

    def compute(texts):
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()]

    return with_columns(documents, ["text"], [T.StructField("fp", T.LongType())], compute)


def posting_lists(fingerprints: DataFrame) -> DataFrame:
    """(choice, value, one, other, fp): the inverted index over distinct fingerprints (fp).

    ``one`` and ``other`` name two parts of a list, both 0 where the list has one part.
    """
    byte = [F.shiftrightunsigned("fp", 56 - 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    value = [sum((byte[p] * (1 << (8 * (3 - i))) for i, p in enumerate(four)), F.lit(0).cast("long")) for four in FOURS]
    entries = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), v.alias("value")) for i, v in enumerate(value))))
    index = fingerprints.select("fp", entries.alias("e")).select("fp", "e.choice", "e.value")
    sizes = index.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = index.join(sizes, ["choice", "value"])
    parts = F.ceil(F.col("n") / PART)
    mine = F.pmod(F.xxhash64("fp"), parts)
    # part p meets every part once: as (p, q) for q >= p and as (q, p) for q < p
    others = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    return shared.withColumn("mine", mine).withColumn("q", others).select(
        "choice", "value", F.least("mine", "q").alias("one"), F.greatest("mine", "q").alias("other"), "mine", "fp"
    )


def links(fingerprints: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints within MAX_BITS, enough of them to connect what is linked."""
    index = posting_lists(fingerprints)
    keys = ["choice", "value", "one", "other"]
    together = index.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            mine, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            rows = np.vstack([key, mine, fp])
            if held:
                rows = np.hstack([*held, rows])
            edges = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            starts = [0, *edges.tolist()]
            found = [_connect(rows[:, s:e]) for s, e in zip(starts, starts[1:])]
            held = [rows[:, starts[-1] :]]  # the last list may go on
            if out := [f for f in found if len(f[0])]:
                yield _pairs(out)
        if held and len((last := _connect(np.hstack(held)))[0]):
            yield _pairs([last])

    return together.mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _connect(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect one posting list or two parts of one."""
    one, other, mine, fp = rows[2][:1], rows[3][:1], rows[4], rows[5]
    if len(fp) < 2:
        return fp[:0], fp[:0]
    octets = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)
    if len(fp) == 2:
        keep = linked(octets[:1], octets[1:])[0]
        return fp[:1][keep], fp[1:][keep]
    apart = bool(one != other)
    a, b = [], []
    # breadth first: what is reached leaves the set of those still to be compared
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = linked(octets[at : at + 1], octets[left])[0]
            if apart:  # pairs within one part belong to that part's own list
                near &= mine[left] != mine[at]
            reached, left = left[near], left[~near]
            queue.extend(reached.tolist())
            a.append(np.full(len(reached), fp[at]))
            b.append(fp[reached])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def linked(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether pairs share enough positional bytes and, of those, which differ in few enough bits."""
    out = np.zeros((len(one), len(many)), bool)
    for i, octets in enumerate(one):
        differing = octets ^ many
        kept = np.flatnonzero((differing == 0).sum(axis=1) >= SHARED)
        out[i, kept] = POPCOUNT[differing[kept]].sum(axis=1) <= MAX_BITS
    return out


def _components_of(rows: DataFrame) -> DataFrame:
    """(fp, component) of written ``rows`` (doc_id, fp): the smallest doc_id of linked fingerprints."""
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints.select("fp")))
    joined = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(ids, "root").select("fp", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of ``documents`` (doc_id, text)."""
    names = ["doc_id", "text", "fp"]
    rows = stage(split(with_fingerprint(only(documents, "doc_id", "text")), names, ["doc_id", "fp"]))
    of = _components_of(rows)
    return rows.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component: the one with the smallest doc_id, one of equals.

    The rows are written once with their fingerprint and a number, which then
    names a row even where doc_ids repeat or are null.
    """
    made = with_fingerprint(documents)
    numbered = stage(made.select(*made.columns, F.monotonically_increasing_id().alias("row")))
    at = f"c{documents.columns.index('doc_id')}"
    rows = numbered.select("row", F.col(at).alias("doc_id"), F.col(made.columns[-1]).alias("fp"))
    roots = components(links(rows.select("fp").distinct()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    best = rows.groupBy("fp").agg(first.alias("best"))
    joined = best.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = joined.groupBy("root").agg(F.min("best").alias("best")).select("best.row")
    return original(numbered.join(kept, "row", "left_semi").select(*made.columns), documents)


