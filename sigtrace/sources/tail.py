"""Streaming source ``tail``: files that grow, rotate and appear while they are read.

    spark.dataSource.register(TailSource)          # or register_tail(spark)
    spark.readStream.format("tail").option("path", "/var/log/app").load()

=====================  =========================================================
option                 meaning
=====================  =========================================================
``path``               file or directory (local, HDFS or object store URI)
``pathGlobFilter``     files taken from a directory: ``*`` (default) or ``*.<extension>``
``monitorId``          value of ``monitor_id``, default ``tail``
``capture``            label capture logs ``Zeek:<name>``, default false
``startingPosition``   ``latest`` (default) or ``earliest``, for files present at start
``maxBytesPerBatch``   bytes a micro-batch takes from all files, default 1 GiB
``partitionBytes``     bytes per task, default 64 MiB
``failOnDataLoss``     fail when planned bytes are gone (default) or skip them
``positionLog``        folder of this query alone (beside its checkpoint) for its positions
=====================  =========================================================

The offset holds, per file, the end of what has been read and fingerprints of
the first bytes and of those before the end.  The end always stands behind a
newline, so unfinished lines wait in the file and nothing is kept between batches.
A file that got shorter or in which either fingerprint changed is another file and
read from its start.  The driver lists files and reads fingerprints and line ends,
but only of files whose size or time changed; executors read the byte ranges and
check the fingerprint first.

The byte limit is dealt out over the files that have something new, those that
waited longest first, so no busy file holds up another; a line longer than a share
is taken whole.  Spark does not tell a source where a restarted query stands before
it asks for the newest offset.  With ``positionLog`` the source keeps the end of every batch
it plans there, goes on from it, and the limit holds in the first batch as well;
without it that batch takes what was written while the query was down.  Spark notes a
batch before it is planned and plans an unfinished one anew before it asks for the next,
so the log never falls behind a batch that was run; of its two files, written in turn, one
is whole whenever the writer dies.  A new query ignores what an older one left there.  Spark
runs an ``availableNow`` query over a Python source as one batch, to which the limit then applies.  The offset is
proportional to the number of files present: use the built-in file source for
archives of closed files.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FINGERPRINT = 1024
BLOCK = 64 * 1024
CHUNK = 4 * 1024 * 1024
SCHEMA = (
    "monitor_id string, source string, path string, line_number bigint, line string,"
    " event_ts timestamp, file_id string"
)
ARROW_SCHEMA = pa.schema(
    [
        ("monitor_id", pa.string()),
        ("source", pa.string()),
        ("path", pa.string()),
        ("line_number", pa.int64()),
        ("line", pa.string()),
        ("event_ts", pa.timestamp("us", tz="UTC")),
        ("file_id", pa.string()),
    ]
)


class DataLoss(Exception):
    """Bytes that a batch was planned to read are no longer there."""


@dataclass
class TailRange(InputPartition):
    """Lines that start in ``[begin, end)`` of a file read from ``first`` to ``stop``."""

    path: str
    first: int
    begin: int
    end: int
    stop: int
    head_size: int
    head_hash: str


def file_glob(pattern: str) -> str:
    """``*`` takes every file, ``*.ext`` those whose extension is the pattern's last part."""
    return "*" if pattern == "*" else "?*." + pattern.removeprefix("*.").split(".")[-1]


def tail_hash(stream, end: int) -> str:
    """Fingerprint of the bytes before ``end``."""
    start = max(0, end - FINGERPRINT)
    stream.seek(start)
    return hashlib.sha256(stream.read(end - start)).hexdigest()[:32]


def head_hash(stream, size: int) -> str:
    stream.seek(0)
    head = stream.read(size)
    return hashlib.sha256(head).hexdigest()[:32] if len(head) == size else ""


def line_end_before(stream, low: int, high: int) -> int:
    """Position behind the last newline in ``[low, high)``, or ``low``."""
    while high > low:
        start = max(low, high - BLOCK)
        stream.seek(start)
        found = stream.read(high - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        high = start
    return low


def line_end_after(stream, low: int, high: int) -> int | None:
    """Position behind the first newline in ``[low, high)``."""
    stream.seek(low)
    while low < high:
        block = stream.read(min(BLOCK, high - low))
        if not block:
            return None
        found = block.find(b"\n")
        if found >= 0:
            return low + found + 1
        low += len(block)
    return None


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.glob = file_glob(options.get("pathglobfilter", "*"))
        self.monitor_id = options.get("monitorid", "tail")
        self.capture = options.get("capture", "false").lower() == "true"
        self.starting = options.get("startingposition", "latest")
        self.budget = int(options.get("maxbytesperbatch", 1 << 30))
        self.piece = int(options.get("partitionbytes", 64 << 20))
        self.strict = options.get("failondataloss", "true").lower() == "true"
        if self.starting not in ("latest", "earliest"):
            raise ValueError(f"startingPosition must be latest or earliest, not {self.starting}")
        self.positions = options.get("positionlog")
        self.written = 0
        self.last: dict | None = None
        self.seen: dict[str, tuple[int, int]] = {}
        self.served: dict[str, int] = {}
        self.turn = 0

    # -- on the driver ---------------------------------------------------------

    def initialOffset(self) -> dict:
        if self.last is None:
            self.last = {} if self.starting == "earliest" else self._ends(None)
        return {} if self.starting == "earliest" else dict(self.last)

    def latestOffset(self) -> dict:
        if self.last is None:  # a restarted query
            self.last = self._logged()
        self.last = self._ends(self.last)
        return dict(self.last)

    def partitions(self, start: dict, end: dict) -> list[TailRange]:
        if self.last is None:
            self.last = dict(end)
        self._log(end)
        fs, _ = self._filesystem()
        ranges: list[TailRange] = []
        for path, e in end.items():
            s = start.get(path)
            if s == e or e["end"] == 0:
                continue
            try:
                with fs.open_input_file(path) as f:
                    self._check(f, path, e["size"], e["hash"])
                    same = s is not None and self._is_same(f, s)
                    if same and s["end"] > e["end"]:
                        raise DataLoss("positionLog is older than the checkpoint; remove it")
            except (OSError, DataLoss) as problem:
                if self.strict:
                    raise DataLoss(f"{path}: {problem}") from problem
                continue
            first = s["end"] if same else 0
            for begin in range(first, e["end"], self.piece):
                stop = min(begin + self.piece, e["end"])
                ranges.append(TailRange(path, first, begin, stop, e["end"], e["size"], e["hash"]))
        return ranges

    def commit(self, end: dict) -> None:
        pass

    def _log(self, end: dict) -> None:
        """Keeps the end of a planned batch, in one of two files by turns."""
        if not self.positions:
            return
        fs, folder = pafs.FileSystem.from_uri(self.positions)
        if not self.written:
            self.written = max((n for n, _ in self._log_files()), default=0)
            fs.create_dir(folder, recursive=True)
        self.written += 1
        body = json.dumps(end).encode()
        head = f"{self.written} {hashlib.sha256(body).hexdigest()}\n".encode()
        with fs.open_output_stream(f"{folder}/{self.written % 2}") as f:
            f.write(head + body)

    def _log_files(self) -> list[tuple[int, dict]]:
        """Number and positions of each whole file of the log."""
        fs, folder = pafs.FileSystem.from_uri(self.positions)
        found = []
        for name in "01":
            try:
                with fs.open_input_file(f"{folder}/{name}") as f:
                    head, _, body = f.read().partition(b"\n")
            except FileNotFoundError:
                continue
            number, _, digest = head.decode("ascii", "replace").partition(" ")
            if hashlib.sha256(body).hexdigest() == digest:
                found.append((int(number), json.loads(body)))
        return found

    def _logged(self) -> dict | None:
        """Where the last planned batch ended, None without a log."""
        return max(self._log_files(), default=(0, None), key=lambda f: f[0])[1] if self.positions else None

    def _filesystem(self):
        return pafs.FileSystem.from_uri(self.path)

    def _files(self):
        fs, root = self._filesystem()
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return fs, [info]
        listed = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = [i for i in listed if i.type == pafs.FileType.File and fnmatch.fnmatchcase(i.base_name, self.glob)]
        return fs, sorted(files, key=lambda i: i.path)

    def _ends(self, known: dict | None) -> dict:
        """Where reading may go in every file present, given where it stands."""
        fs, files = self._files()
        self.turn += 1
        ends, waiting = {}, []
        for info in files:
            entry = (known or {}).get(info.path)
            state = (info.size, info.mtime_ns or 0)
            if entry is not None and self.seen.get(info.path) == state and entry["end"] == info.size:
                ends[info.path] = entry  # read to its end, and not written since
                continue
            try:
                with fs.open_input_file(info.path) as f:
                    base = entry["end"] if entry is not None and entry["end"] <= info.size and self._is_same(f, entry) else 0
            except FileNotFoundError:
                continue
            self.seen[info.path] = state
            if entry is not None and base == info.size == entry["end"]:
                ends[info.path] = entry
            else:
                waiting.append((info, base))
        waiting.sort(key=lambda w: (self.served.get(w[0].path, 0), w[0].size - w[1], w[0].path))
        left = self.budget
        for place, (info, base) in enumerate(waiting):
            pending = info.size - base
            share = pending if known is None else min(pending, max(1, left // (len(waiting) - place)) if left > 0 else 0)
            try:
                with fs.open_input_file(info.path) as f:
                    end = self._end(f, base, info.size, share)
                    size = min(end, FINGERPRINT)
                    entry = {"end": end, "size": size, "hash": head_hash(f, size), "tail": tail_hash(f, end)}
            except FileNotFoundError:
                continue
            ends[info.path] = entry
            if end > base:
                left -= end - base
                self.served[info.path] = self.turn
        return ends

    def _is_same(self, f, entry: dict) -> bool:
        """Whether the file still holds what the entry was made of."""
        return head_hash(f, entry["size"]) == entry["hash"] and entry.get("tail") in (None, tail_hash(f, entry["end"]))

    def _end(self, f, base: int, size: int, budget: int) -> int:
        if budget <= 0:
            return base
        limit = min(size, base + budget)
        end = line_end_before(f, base, limit)
        if end == base and limit < size:
            return line_end_after(f, limit, size) or base
        return end

    def _check(self, f, path: str, size: int, expected: str) -> None:
        if head_hash(f, size) != expected:
            raise DataLoss("the file was replaced after its bytes were planned")

    # -- on the executors --------------------------------------------------------

    def read(self, partition: TailRange):
        fs, _ = self._filesystem()
        name = partition.path.rstrip("/").rsplit("/", 1)[-1]
        source = "Zeek:" + re.sub(r"(\.log)+$", "", name) if self.capture else name
        file_id = f"{partition.head_size}:{partition.head_hash}"
        try:
            f = fs.open_input_file(partition.path)
        except OSError as problem:
            if self.strict:
                raise DataLoss(f"{partition.path}: {problem}") from problem
            return
        with f:
            self._check(f, partition.path, partition.head_size, partition.head_hash)
            written = fs.get_file_info(partition.path).mtime_ns
            when = datetime.fromtimestamp((written or 0) / 1e9, tz=timezone.utc)
            for offsets, lines in self._line_batches(f, partition):
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([self.monitor_id] * n, pa.string()),
                        pa.array([source] * n, pa.string()),
                        pa.array([partition.path] * n, pa.string()),
                        pa.array(offsets, pa.int64()),
                        pa.array(lines, pa.string()),
                        pa.array([when] * n, pa.timestamp("us", tz="UTC")),
                        pa.array([file_id] * n, pa.string()),
                    ],
                    schema=ARROW_SCHEMA,
                )

    def _line_batches(self, f, p: TailRange):
        """Offsets and texts of the non-empty lines that start in the range, chunk by chunk."""
        at = p.begin
        if p.begin > p.first:
            after = line_end_after(f, p.begin - 1, p.stop)
            if after is None:
                return
            at = after
        f.seek(at)
        pending = []
        position = at
        while at < p.end and position < p.stop:
            chunk = f.read(min(CHUNK, p.stop - position))
            if not chunk:
                raise DataLoss(f"{p.path}: the file ends before byte {p.stop}")
            position += len(chunk)
            pending.append(chunk)
            if b"\n" not in chunk:
                continue
            whole = b"".join(pending)
            *lines, rest = whole.split(b"\n")
            offsets, texts = [], []
            for raw in lines:
                if at >= p.end:
                    break
                if raw:
                    offsets.append(at)
                    texts.append(raw.decode("utf-8", "replace"))
                at += len(raw) + 1
            if texts:
                yield offsets, texts
            pending = [rest]


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def register_tail(spark) -> None:
    """Make ``format("tail")`` known; the code travels with the query to the executors."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TailSource)
