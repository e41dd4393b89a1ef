"""Growing logs: streams by byte offset, bounded reads from either end."""

import os
import random

import pytest

from fleetlane.operators import tasks as tk
from fleetlane.sources import tail as T


class Counting:
    """A file that counts the bytes read of it."""

    def __init__(self, data: bytes):
        self.data, self.bytes = data, 0

    def read_at(self, n, at):
        self.bytes += n
        return self.data[at:at + n]


def test_ranges_share_out_every_line_once(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    rnd = random.Random(2)
    for _ in range(200):
        data = b"".join(rnd.choice([b"", b"a", b"bcd" * 9, "é".encode()]) + b"\n" for _ in range(rnd.randint(1, 30)))
        data += rnd.choice([b"", b"half"])
        f = Counting(data)
        end = T.last_newline(f, 0, len(data))
        assert end == data.rfind(b"\n") + 1
        for stop in (end, len(data)):
            got = []
            for p in T._ranges(None, "x", 0, stop, rnd.randint(1, 40)):
                offsets, values = T.lines(f, p.first, p.lo, p.hi, p.end)
                got += zip(offsets.tolist(), values.to_pylist())
            want, at = [], 0
            for line in data[:stop].split(b"\n"):
                want.append((at, line.decode()))
                at += len(line) + 1
            want = want[:-1] if data[:stop].endswith(b"\n") else want
            assert got == want


def test_reads_from_the_end_do_not_grow_with_the_log():
    line = b"sh run-wordcount2.sh input output id\n"
    read = []
    for n in (10_000, 1_000_000):
        f = Counting(line * n + b"half")
        end = T.last_newline(f, 0, len(f.data))
        start = T.tail_start(f, end, 5)
        assert f.data[start:end] == line * 5
        g = Counting(f.data)
        assert g.data[:T.head_end(g, len(g.data), 5)] == line * 5
        read.append((f.bytes, g.bytes))
    assert read[0] == read[1] and max(read[0]) <= 6 * T.BLOCK


@pytest.mark.parametrize("n", [1, 3, 8, 100])
def test_first_and_last_lines(spark, tmp_path, n):
    files = [["a", "", "b"], [], ["c"], ["d", "é", "f", "g"]]
    for i, rows in enumerate(files):
        p = tmp_path / f"log-{i}"
        p.write_text("".join(r + "\n" for r in rows) + ("half" if i == 3 else ""))
        os.utime(p, (1000 + i, 1000 + i))
    (tmp_path / "_SUCCESS").write_text("no line\n")
    every = [r for rows in files for r in rows]
    for order in ("time", "name"):
        got = [r.value for r in T.last_lines(spark, str(tmp_path), n, order).orderBy("pos").collect()]
        assert got == every[-n:]
        got = [r.value for r in T.first_lines(spark, str(tmp_path), n, order).orderBy("pos").collect()]
        assert got == every[:n]
    assert T.last_lines(spark, str(tmp_path / "none"), n).count() == 0


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"ok\n\xff\xfe x\n")
    assert [r.value for r in T.last_lines(spark, str(tmp_path / "log"), 5).orderBy("pos").collect()] == ["ok", "�� x"]


def run(spark, log, out, chunk=64):
    """One availableNow run of a stream over ``log``."""
    q = (T.growing_lines(spark, str(log), chunk_bytes=chunk).select("pos.offset", "value").writeStream.format("parquet")
         .option("path", str(out)).option("checkpointLocation", f"{out}-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
    return [tuple(r) for r in spark.read.schema("offset bigint, value string").parquet(str(out)).orderBy("offset").collect()]


def test_a_growing_file_is_followed(spark, tmp_path):
    """Appends between runs, half lines included; every run is a restart."""
    log, out = tmp_path / "subscribe.txt", tmp_path / "out"
    want, at, text = [], 0, ""
    for part in ["one\ntw", "o\n", "", "three\n\nfour\n" + "x" * 300, "yz\nlast"]:
        with open(log, "a") as f:
            f.write(part)
        text += part
        want, at = [], 0
        for line in text.split("\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert run(spark, log, out) == want


def test_one_query_follows_while_the_file_grows(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("a\nb")
    seen = []
    q = (T.growing_lines(spark, str(log)).writeStream.foreachBatch(lambda df, i: seen.extend(r.value for r in df.orderBy("pos").collect()))
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    try:
        q.processAllAvailable()
        assert seen == ["a"]
        for part, now in (("c\n", ["a", "bc"]), ("d\ne", ["a", "bc", "d"]), ("\n", ["a", "bc", "d", "e"])):
            with open(log, "a") as f:
                f.write(part)
            q.processAllAvailable()
            assert seen == now
    finally:
        q.stop()


def test_files_appear_and_begin_anew(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "a").write_text("1\n2\n")
    assert [v for _, v in run(spark, logs, out)] == ["1", "2"]
    (logs / "b").write_text("3\n")
    assert sorted(v for _, v in run(spark, logs, out)) == ["1", "2", "3"]
    (logs / "a").write_text("4\n")     # shorter than what was read
    assert sorted(v for _, v in run(spark, logs, out)) == ["1", "2", "3", "4"]


def test_completions_of_a_growing_log(spark, tmp_path):
    u = [f"{i:08x}-0000-11ea-8000-000000000000" for i in range(3)]
    log = tmp_path / "subscribe.txt"
    log.write_text(f"{u[0]}:::logs/a.txt\nsh run-wordcount2.sh in out {u[1]}\n{u[2]}:::lo")
    parsed = tk.parse_completions(T.growing_lines(spark, str(log)))
    q = (parsed.select("uuid", "path", "valid").writeStream.format("parquet").option("path", str(tmp_path / "o"))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert sorted((r.uuid, r.path, r.valid) for r in got) == [(u[0], "logs/a.txt", True), (u[1], None, True)]
