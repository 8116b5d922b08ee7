"""A streaming source of log files that are appended to.

Spark's own file stream takes a file once; logs grow. The offset is each file's
size at the end of its last complete line. A batch has one partition for each
grown file, which reads from the old offset to the new one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, raw string"


class _Grown(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _complete_size(path: str, known: int, most: int | None = None) -> int:
    """The end of the last complete line, read backwards from the file's end; with ``most``, of the last one that ends within so many bytes from ``known`` on, or else of the next one."""
    size = os.path.getsize(path)
    if size < known:
        known = 0
    with open(path, "rb") as f:
        at = end = size if most is None else min(size, known + most)
        while at > known:
            step = min(64 << 10, at - known)
            f.seek(at - step)
            cut = f.read(step).rfind(b"\n")
            if cut >= 0:
                return at - step + cut + 1
            at -= step
        if end < size:  # a line that is longer than the bound
            f.seek(end)
            while block := f.read(64 << 10):
                if (cut := block.find(b"\n")) >= 0:
                    return end + cut + 1
                end += len(block)
    return known


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.most = int(options["max_bytes"]) if "max_bytes" in options else None
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for folder, _, names in os.walk(self.root):
            for n in names:
                if n.endswith(".jsonl"):
                    p = os.path.join(folder, n)
                    self.last[p] = _complete_size(p, self.last.get(p, 0), self.most)
        return {p: n for p, n in self.last.items() if n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = {**end, **self.last}
        # A file that became shorter was rewritten and is read anew.
        return [_Grown(p, start.get(p, 0) if n >= start.get(p, 0) else 0, n) for p, n in sorted(end.items()) if n != start.get(p, 0)]

    def read(self, partition: _Grown) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                raw = f.readline()
                if not raw:
                    break
                line = raw.rstrip(b"\r\n").decode("utf-8", "replace")
                if line.strip():
                    yield (partition.path, at, line)
                at += len(raw)


class LogTail(DataSource):
    """``spark.dataSource.register(LogTail)``, then ``spark.readStream.format("log_tail").load(folder)``; the folder is one that all executors see. Option ``max_bytes``: how far a file is read in one batch (to the end of a line)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(self.options)
