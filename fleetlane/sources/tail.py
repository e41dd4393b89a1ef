"""Line logs that are still being written, read by byte ranges.

One data source, ``growing_lines``, for three needs of a queue or
completion log that others append to:

* as a stream (:func:`growing_lines`), a file is followed while it grows.
  The offset of the stream is the byte up to which each file was read; a
  trigger reads from there to the last newline there is now, so half a line
  waits for its end, every line comes out once, and a restart goes on at the
  byte of the checkpoint.  What a trigger reads is cut into chunks, a task
  each, so a large backlog is read in parallel;
* the last lines (:func:`last_lines`), found by reading backwards from the
  end of the newest files, however long they are;
* the first lines (:func:`first_lines`).

Rows are (seq, file, offset, value): the file's place among the files read
(batch only), its URI, the byte its line starts at, the line without its
newline.  (file, offset) orders a file's lines.  A file that has become
shorter than what was read of it was begun anew and is read from its start.
An unterminated last line is left out (option ``partial`` takes it along in
batch reads).  Bytes that are not UTF-8 become U+FFFD.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fleetlane.sources import files
from fleetlane.sources.files import open_fs

BLOCK = 1 << 16          # bytes read at a time when a newline is looked for
CHUNK = 1 << 24          # bytes of one task
SCHEMA = "seq bigint, file string, offset bigint, value string"


# ---- byte ranges of one file (``f`` has read_at(bytes, offset)) ------------

def last_newline(f, lo: int, hi: int) -> int:
    """The byte after the last newline in [lo, hi), or lo."""
    while hi > lo:
        at = max(lo, hi - BLOCK)
        i = f.read_at(hi - at, at).rfind(b"\n")
        if i >= 0:
            return at + i + 1
        hi = at
    return lo


def next_newline(f, at: int, end: int) -> int:
    """The byte after the first newline in [at, end), or end."""
    while at < end:
        data = f.read_at(min(BLOCK, end - at), at)
        i = data.find(b"\n")
        if i >= 0:
            return at + i + 1
        at += len(data)
    return end


def tail_start(f, end: int, n: int) -> int:
    """Where the last n lines of [0, end) start."""
    at, found = end, 0
    while at > 0:
        lo = max(0, at - BLOCK)
        data = f.read_at(at - lo, lo)
        i = len(data)
        while (i := data.rfind(b"\n", 0, i)) >= 0:
            if lo + i + 1 < end:      # the newline that ends the range starts no line
                found += 1
                if found == n:
                    return lo + i + 1
        at = lo
    return 0


def head_end(f, size: int, n: int) -> int:
    """Where the first n lines end."""
    at = 0
    for _ in range(n):
        if at >= size:
            break
        at = next_newline(f, at, size)
    return at


def lines(f, first: int, lo: int, hi: int, end: int) -> tuple[np.ndarray, pa.Array]:
    """(offsets, values) of the lines of [first, end) that start in
    [lo, hi); ``first`` starts a line."""
    start = lo if lo == first else next_newline(f, lo - 1, end)
    if start >= hi:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    stop = hi if hi == end else next_newline(f, hi - 1, end)
    data = np.frombuffer(f.read_at(stop - start, start), np.uint8)
    ends = np.flatnonzero(data == 10)
    if not len(ends) or ends[-1] != len(data) - 1:
        ends = np.append(ends, len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    keep = np.ones(len(data), bool)
    keep[ends[ends < len(data)]] = False
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[keep])])
    try:
        return start + starts, raw.cast(pa.string())
    except pa.ArrowInvalid:
        return start + starts, pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


# ---- files ---------------------------------------------------------------------

def _open(uri: str):
    _, fs, path = open_fs(uri)
    return fs.open_input_file(path)


def is_file(path: str) -> bool:
    _, fs, base = open_fs(path)
    return fs.get_file_info(base).type == pafs.FileType.File


def list_files(path: str) -> list[tuple[str, int, int]]:
    """(URI, bytes, modification time) of a file, or of the files of a
    folder (hidden ones and marks of writers left out); none if it is not
    there yet."""
    uri, fs, base = open_fs(path)
    prefix = uri[:len(uri) - len(base)] if uri.endswith(base) else uri.split(":", 1)[0] + "://"
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(base))
    else:
        found = [info]
    return [(prefix + x.path, x.size, x.mtime_ns or 0) for x in found
            if x.type == pafs.FileType.File and x.base_name[0] not in "._"]


class Range(InputPartition):
    """Lines of [first, end) of a file that start in [lo, hi)."""

    def __init__(self, seq: int | None, uri: str, first: int, lo: int, hi: int, end: int):
        super().__init__(None)
        self.seq, self.uri, self.first, self.lo, self.hi, self.end = seq, uri, first, lo, hi, end


def _ranges(seq: int | None, uri: str, first: int, end: int, chunk: int) -> list[Range]:
    return [Range(seq, uri, first, lo, min(lo + chunk, end), end) for lo in range(first, end, chunk)]


def _read(part: Range | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # how Spark reads a source without partitions
        return
    with _open(part.uri) as f:
        offsets, values = lines(f, part.first, part.lo, part.hi, part.end)
    n = len(values)
    yield pa.RecordBatch.from_arrays([pa.array([part.seq] * n, pa.int64()), pa.array([part.uri] * n, pa.string()),
                                      pa.array(offsets, pa.int64()), values], names=["seq", "file", "offset", "value"])


class GrowingStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options.get("chunkbytes", CHUNK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for uri, size, _ in list_files(self.path):
            with _open(uri) as f:
                end = last_newline(f, 0, size)
            if end:
                out[uri] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for uri, stop in sorted(end.items()):
            first = start.get(uri, 0)
            out += _ranges(None, uri, first if first <= stop else 0, stop, self.chunk)
        return out

    def read(self, partition: Range):
        return _read(partition)


class GrowingBatch(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options.get("chunkbytes", CHUNK))
        self.tail, self.head = int(options.get("tail", 0)), int(options.get("head", 0))
        self.partial = str(options.get("partial", "false")).lower() == "true"
        self.by_name = options.get("order", "time") == "name"

    def partitions(self) -> list[Range]:
        # empty files hold no line, so the newest n others hold the last n
        files = sorted((x for x in list_files(self.path) if x[1]), key=lambda x: x[0] if self.by_name else (x[2], x[0]))
        out, lines_left = [], self.tail or self.head
        order = list(enumerate(files))
        if self.tail:
            order = order[::-1]
        for seq, (uri, size, _) in order:
            if lines_left <= 0 and (self.tail or self.head):
                break
            with _open(uri) as f:
                first, end = 0, size if self.partial else last_newline(f, 0, size)
                if self.tail:
                    first = tail_start(f, end, lines_left)
                    lines_left -= _count(f, first, end)
                elif self.head:
                    end = min(end, head_end(f, end, lines_left))
                    lines_left -= _count(f, 0, end)
            out += _ranges(seq, uri, first, end, self.chunk)
        return out

    def read(self, partition: Range):
        return _read(partition)


def _count(f, lo: int, hi: int) -> int:
    """Lines of [lo, hi)."""
    n, last = 0, b"\n"
    while lo < hi:
        data = f.read_at(min(BLOCK, hi - lo), lo)
        n, lo, last = n + data.count(b"\n"), lo + len(data), data[-1:]
    return n + (last != b"\n")


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GrowingBatch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingStream(self.options)


# ---- readers ---------------------------------------------------------------------

def _register(spark: SparkSession) -> None:
    """Make the source known to the session.  Spark plans it in Python
    processes beside the driver, which have neither the driver's path nor
    the files added to the session, so its code travels with it."""
    for module in (sys.modules[__name__], files):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(GrowingLines)


def growing_lines(spark: SparkSession, path: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """A growing file, or the growing files of a folder, as a stream of
    (pos, value) lines; pos = (file, byte)."""
    _register(spark)
    df = spark.readStream.format("growing_lines").option("chunkBytes", str(chunk_bytes)).load(path)
    return df.select(F.struct("file", "offset").alias("pos"), "value")


def _batch(spark: SparkSession, path: str, **options: str) -> DataFrame:
    _register(spark)
    df = spark.read.format("growing_lines").options(**options).load(path)
    return df.select(F.struct("seq", "file", "offset").alias("pos"), "value")


def last_lines(spark: SparkSession, path: str, n: int, order: str = "time") -> DataFrame:
    """O38 on files: the last n whole lines of a log (a file, or a folder
    whose files follow each other by ``order``: time, then name, or name).
    Reads about those lines and one block a file."""
    return _batch(spark, path, tail=str(n), order=order)


def first_lines(spark: SparkSession, path: str, n: int, order: str = "time") -> DataFrame:
    """O36 on files: the first n whole lines."""
    return _batch(spark, path, head=str(n), order=order)
