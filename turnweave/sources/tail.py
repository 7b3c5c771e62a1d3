"""Streaming source of appended transcript lines.

The offset of a file is (epoch, bytes). A batch covers the byte ranges that were appended since the last one, cut into splits of
bounded size, and only these bytes are read. A line belongs to the range its line break lies in, as in Hadoop's text splits: a
torn last line waits, and the range that brings its break looks back for its beginning. A file that shrank or went away starts a
new epoch at byte 0.

The engine asks for the latest offset without telling the one before, so epochs are kept in a small journal in the folder of
option ``state`` (one per query, beside its checkpoint). It is written before an offset is handed out: after a crash the journal
is never behind the checkpoint, and a range is always computed from the two offsets of the checkpoint.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .transcripts import with_file_identity

FORMAT = "transcript_tail"
SCHEMA = "path string, epoch bigint, line_no bigint, value string, mtime timestamp, file_size bigint"
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


@dataclass
class ByteRange(InputPartition):
    path: str
    epoch: int
    start: int
    end: int


def _open(root: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def owned_lines(f, start: int, end: int):
    """(place of the first byte, line without break) of the lines whose break lies in [start, end) of an open file."""
    back, begin = b"", start
    while begin > 0:  # look back, twice as far each time, for the beginning of a line that an earlier range left torn
        step = min(max(256, len(back)), begin)
        f.seek(begin - step)
        piece = f.read(step)
        cut = piece.rfind(b"\n")
        if cut >= 0:
            back, begin = piece[cut + 1 :] + back, begin - step + cut + 1
            break
        back, begin = piece + back, begin - step
    f.seek(start)
    held, place, at = [back], begin, start
    while at < end:
        piece = f.read(min(READ_BYTES, end - at))
        if not piece:  # cut off meanwhile: the next batch sees a new epoch
            return
        at += len(piece)
        *whole, rest = piece.split(b"\n")
        for line in whole:
            line = b"".join((*held, line))
            yield place, line
            place, held = place + len(line) + 1, []
        held.append(rest)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state = options["path"], options["state"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.most = int(options.get("maxBytesPerTrigger", 0))
        self.suffix = options.get("suffix", ".jsonl")

    def initialOffset(self) -> dict:
        return {}

    def _journal(self, write: dict | None = None) -> dict:
        disk, folder = _open(self.state)
        path = f"{folder.rstrip('/')}/epochs.json"
        if write is None:
            from pyarrow.fs import FileType

            if disk.get_file_info(path).type == FileType.NotFound:
                return {}
            with disk.open_input_file(path) as f:
                return json.loads(f.read())
        disk.create_dir(folder, recursive=True)
        with disk.open_output_stream(path + ".new") as f:
            f.write(json.dumps(write).encode())
        disk.move(path + ".new", path)
        return write

    def latestOffset(self) -> dict:
        from pyarrow import fs

        disk, root = _open(self.root)
        listed = disk.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        sizes = {i.path: i.size for i in listed if i.is_file and i.path.endswith(self.suffix)}
        known = self._journal()
        out, left = {}, self.most or None
        for path in sorted(known.keys() | sizes.keys()):
            epoch, seen = known.get(path, (0, 0))
            size = sizes.get(path, 0)
            if size < seen:
                epoch, seen = epoch + 1, 0
            if left is not None:
                size = min(size, seen + left)
                left -= size - seen
            out[path] = [epoch, size]
        if out != known:
            self._journal(out)
        return out

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for path, (epoch, stop) in sorted(end.items()):
            before, seen = start.get(path, (epoch, 0))
            begin = seen if before == epoch else 0
            out += [ByteRange(path, epoch, at, min(at + self.split, stop)) for at in range(begin, stop, self.split)]
        return out

    def read(self, part: ByteRange):
        import pyarrow as pa

        disk, _ = _open(self.root)
        info = disk.get_file_info(part.path)
        mtime = int(info.mtime_ns or 0) // 1000
        kind = pa.schema([("path", pa.string()), ("epoch", pa.int64()), ("line_no", pa.int64()), ("value", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("file_size", pa.int64())])

        def batch(rows):
            n = len(rows)
            columns = [[part.path] * n, [part.epoch] * n, [p for p, _ in rows], [v.decode("utf-8", "replace") for _, v in rows], [mtime] * n, [info.size or 0] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types)], schema=kind)

        if not info.is_file:
            return
        rows, size = [], 0
        with disk.open_input_file(part.path) as f:
            for place, line in owned_lines(f, part.start, part.end):
                rows.append((place, line))
                size += len(line)
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


class TranscriptTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_transcripts(spark: SparkSession, root: str, state: str, **options) -> DataFrame:
    """Stream of the whole lines appended below ``root``, with file identity and epoch.

    ``line_no`` is the place of the line's first byte: it rises with the line and is known without reading what is before.
    ``state``: a folder all drivers of this query can reach. ``splitBytes``, ``maxBytesPerTrigger``: as named.
    """
    spark.dataSource.register(TranscriptTail)
    reader = spark.readStream.format(FORMAT).option("path", root).option("state", state)
    for key, value in options.items():
        reader = reader.option(key, value)
    return with_file_identity(reader.load())
