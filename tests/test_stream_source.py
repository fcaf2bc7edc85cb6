"""The tailing source: torn lines, rotation, truncation, ranges, restarts."""

import os

import pytest

from textmill.streaming import source


@pytest.fixture
def log(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in" / "events.jsonl"


class Tail:
    def __init__(self, spark, tmp_path, pattern, size=1 << 20):
        self.spark, self.pattern, self.size, self.base = spark, pattern, size, tmp_path

    def read(self):
        """All lines of everything that the stream has given so far."""
        stream = source.tail_lines(self.spark, str(self.pattern), self.size)
        out = str(self.base / "out")
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(self.base / "cp")).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        rows = self.spark.read.parquet(out).collect() if os.path.isdir(out) else []
        return sorted(r.line for r in rows)


def test_torn_line_and_restart(spark, tmp_path, log):
    tail = Tail(spark, tmp_path, log)
    log.write_text("a\nb\nto")
    assert tail.read() == ["a", "b"]
    with log.open("a") as f:
        f.write("rn\nc\n")
    assert tail.read() == ["a", "b", "c", "torn"]
    assert tail.read() == ["a", "b", "c", "torn"]  # nothing new, nothing twice


def test_rotated_file(spark, tmp_path, log):
    tail = Tail(spark, tmp_path, log)
    log.write_text("a\nb\n")
    assert tail.read() == ["a", "b"]
    with log.open("a") as f:
        f.write("late\n")
    log.rename(log.with_suffix(".1"))
    log.write_text("new\n")
    assert tail.read() == ["a", "b", "late", "new"]


def test_truncated_and_deleted_file(spark, tmp_path, log):
    tail = Tail(spark, tmp_path, log)
    log.write_text("one\ntwo\nthree\n")
    assert tail.read() == ["one", "three", "two"]
    with log.open("r+") as f:
        f.truncate(0)
        f.write("x\n")
    assert tail.read() == ["one", "three", "two", "x"]
    log.unlink()
    log.with_name("other").write_text("unused\n")  # takes the inode that was set free, perhaps
    log.write_text("fresh\n")
    assert "fresh" in tail.read()


def test_many_files_in_ranges(spark, tmp_path, log):
    want = []
    for k in range(3):
        lines = [f"{k}-{i}" + "é" * (i % 5) for i in range(200)]
        log.with_name(f"part{k}.log").write_text("".join(f"{x}\n" for x in lines))
        want += lines
    assert Tail(spark, tmp_path, log.with_name("part*.log"), 37).read() == sorted(want)


def test_ranges_share_no_line(tmp_path, log):
    log.write_bytes(b"\n\nabc\nde\n" + b"x" * 100 + b"\nlast\ntorn")
    end, inode = source.last_line_end(str(log), log.stat().st_size), source.inode_of(str(log))
    for size in (1, 2, 3, 7, 64, 1000):
        rows = [r for part in source.cut(str(log), inode, 0, end, size) for r in source.lines_of(part)]
        assert [r[2] for r in rows] == ["", "", "abc", "de", "x" * 100, "last"] and [r[1] for r in rows] == sorted({r[1] for r in rows})


def test_last_line_end(tmp_path, monkeypatch):
    monkeypatch.setattr(source, "STEP", 3)
    f = tmp_path / "f"
    for data, want in ((b"", 0), (b"abc", 0), (b"a\nb", 2), (b"a\n", 2), (b"a\n" + b"b" * 10, 2), (b"\n", 1)):
        f.write_bytes(data)
        assert source.last_line_end(str(f), len(data)) == want


def test_path_is_needed():
    with pytest.raises(ValueError, match="path"):
        source.TailSource({}).streamReader(None)
