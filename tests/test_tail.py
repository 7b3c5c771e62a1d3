"""The tail source against whole files, ranges read one by one and a stream that goes on."""

import io
import os
import random

from conftest import write_lines

from turnweave.sources import tail
from turnweave.sources.tail import TailReader, owned_lines


class Counted(io.BytesIO):
    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


def test_every_line_belongs_to_one_range():
    r = random.Random(1)
    for _ in range(300):
        text = b"".join(r.choice([b"a", b"\n", b"bc", b"x" * r.randrange(400)]) for _ in range(r.randrange(60)))
        cuts = sorted({0, len(text), *[r.randrange(len(text) + 1) for _ in range(4)]})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in owned_lines(io.BytesIO(text), a, b)]
        want, at = [], 0
        for line in text.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want


def reader(tmp_path, **options):
    return TailReader({"path": str(tmp_path / "root"), "state": str(tmp_path / "state"), **options})


def rows(source, start, end):
    return [x for p in source.partitions(start, end) for b in source.read(p) for x in b.to_pylist()]


def test_only_appended_bytes_are_read_while_a_file_grows(tmp_path):
    path = tmp_path / "root" / "p" / "s.jsonl"
    path.parent.mkdir(parents=True)
    source, at, read = reader(tmp_path), {}, []
    line = b'{"pad": "%s"}\n' % (b"x" * 1000)
    for i in range(30):
        with open(path, "ab") as f:
            f.write(line * 5 + (line[:300] if i % 2 else b""))
        now = reader(tmp_path).latestOffset()  # another reader object each time, as after a restart
        parts = source.partitions(at, now)
        f = Counted(path.read_bytes())
        n = sum(1 for p in parts for _ in owned_lines(f, p.start, p.end))
        read.append(f.got)
        assert n >= 5
        at = now
    assert max(read) < 7 * len(line) and os.path.getsize(path) > 20 * max(read)


def test_torn_line_truncation_deletion_and_limit(tmp_path):
    path = tmp_path / "root" / "p" / "s.jsonl"
    source = reader(tmp_path)
    write_lines(str(path), ["a", "b"], end="\nc")
    one = source.latestOffset()
    assert [(x["epoch"], x["line_no"], x["value"]) for x in rows(source, {}, one)] == [(0, 0, "a"), (0, 2, "b")]
    with open(path, "a") as f:
        f.write("c\né\n")
    two = source.latestOffset()
    assert [(x["line_no"], x["value"]) for x in rows(source, one, two)] == [(4, "cc"), (7, "é")]
    write_lines(str(path), ["z"])
    three = reader(tmp_path).latestOffset()
    assert [(x["epoch"], x["line_no"], x["value"]) for x in rows(source, two, three)] == [(1, 0, "z")]
    path.unlink()
    four = source.latestOffset()
    assert rows(source, three, four) == [] and four[str(path)] == [2, 0]
    write_lines(str(path), ["back"])
    five = source.latestOffset()
    assert [(x["epoch"], x["value"]) for x in rows(source, four, five)] == [(2, "back")]
    assert rows(source, five, source.latestOffset()) == []
    # a bounded batch takes the rest later, and splits give the same lines
    write_lines(str(path), [f"line {i}" for i in range(100)])
    slow, at, got = reader(tmp_path, maxBytesPerTrigger="100", splitBytes="7"), five, []
    for _ in range(12):
        now = slow.latestOffset()
        assert sum(p.end - p.start for p in slow.partitions(at, now)) <= 100
        got += rows(slow, at, now)
        at = now
    assert [x["value"] for x in got if x["epoch"] == 2][-99:] == [f"line {i}" for i in range(1, 100)]


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    root, state, ck, out = (str(tmp_path / n) for n in ("root", "state", "ck", "out"))
    want = []
    for i in range(3):
        for s in ("s1", "s2"):
            os.makedirs(f"{root}/p{s}", exist_ok=True)
            with open(f"{root}/p{s}/s.jsonl", "a") as f:
                f.write(f"{s} {i}\n")
            want.append((f"p{s}", "s", "main", f"{s} {i}"))
        lines = tail.tail_transcripts(spark, root, state)
        q = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(out)
    assert sorted((r.project_key, r.session_id, r.file_role, r.value) for r in got.collect()) == sorted(want)
