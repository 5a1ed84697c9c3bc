"""A stream of the lines of growing text files, by byte offset (A4, A5).

``spark.readStream.format("growing_lines").load(path)`` follows all files of a folder (or one file) that writers append
to: (value, file, at) with the line, its file and the byte at which it begins. The offset of a batch is a map from file to
byte, so Spark's checkpoint holds all that a restart needs, and every line is read once over any number of restarts. A last
line without its line end is held back until the end comes. Files are read in pieces of ``pieceBytes``, each by its own
task, which belongs to the lines that begin in it; ``batchBytes`` bounds what one batch takes of a file.

Files must only grow. Those whose names begin with a dot or an underscore are left out, as Spark's own sources do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE = 32 << 20
BATCH = 1 << 30
BLOCK = 1 << 16


@dataclass
class Piece(InputPartition):
    file: str
    begin: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def last_line_end(store: fs.FileSystem, file: str, begin: int, end: int) -> int:
    """Byte after the last line end in [begin, end), or ``begin``."""
    with store.open_input_file(file) as f:
        while end > begin:
            at = max(begin, end - BLOCK)
            f.seek(at)
            cut = f.read(end - at).rfind(b"\n")
            if cut >= 0:
                return at + cut + 1
            end = at
    return begin


def next_line_end(store: fs.FileSystem, file: str, begin: int, size: int) -> int:
    """Byte after the first line end from ``begin`` on, or ``begin``."""
    with store.open_input_file(file) as f:
        f.seek(begin)
        at = begin
        while at < size:
            block = f.read(min(BLOCK, size - at))
            cut = block.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            if not block:
                break
            at += len(block)
    return begin


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.piece = int(options.get("pieceBytes", PIECE))
        self.batch = int(options.get("batchBytes", BATCH))
        self.done: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> dict[str, int]:
        store, base = opened(self.path)
        about = store.get_file_info(base)
        found = [about] if about.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"}

    def latestOffset(self) -> dict:
        store, _ = opened(self.path)
        out = dict(self.done)
        for file, size in sorted(self._files().items()):
            begin = out.get(file, 0)
            if size > begin:
                end = last_line_end(store, file, begin, min(size, begin + self.batch))
                if end == begin and size > begin + self.batch:  # a line longer than a batch
                    end = next_line_end(store, file, begin + self.batch, size)
                    end = end if end > begin + self.batch else begin
                if end > begin:
                    out[file] = end
        self.done = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.done = {**end, **{f: max(at, end.get(f, 0)) for f, at in self.done.items()}}
        return [Piece(file, at, min(at + self.piece, stop)) for file, stop in sorted(end.items())
                for at in range(start.get(file, 0), stop, self.piece)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        store, _ = opened(self.path)
        with store.open_input_file(partition.file) as f:
            at, rest, base = partition.begin, b"", partition.begin
            if at > 0:  # a line that began before this piece is another task's
                f.seek(at - 1)
                while True:
                    block = f.read(BLOCK)
                    if not block:
                        return
                    if (cut := block.find(b"\n")) >= 0:
                        at = base = at - 1 + cut + 1
                        break
                    at += len(block)
            f.seek(at)
            while base < partition.end:
                block = f.read(BLOCK)
                if not block:
                    return
                rest += block
                *lines, rest = rest.split(b"\n")
                for line in lines:
                    if base >= partition.end:
                        return
                    yield line.removesuffix(b"\r").decode("utf-8", "replace"), partition.file, base
                    base += len(line) + 1


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string, file string, at bigint"

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(GrowingLines)
