"""Records of growing files by byte ranges.

A file is read from a known position to the size that it had when it was listed,
in ranges of bounded size; a range has the records that begin in it. A task reads
block by block and holds one record at most, whose size is limited while it is
read. Files are opened by ``pyarrow.fs`` (local, HDFS with its client, S3, GCS).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .logs import FINGERPRINT_BYTES, MAX_RECORD_BYTES

RANGE_BYTES = 128 << 20
BLOCK_BYTES = 1 << 20
#: Bytes of records that a task passes on at a time.
BATCH_BYTES = 4 << 20

RECORDS = "agent string, path string, line long, offset long, next long, raw string, terminated boolean, too_long boolean"


def open_file(path: str):
    """A file of any kind of storage that pyarrow knows, for reading from any position."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    return system.open_input_file(at)


def records(f, start: int, end: int, size: int, aligned: bool = True, limit: int = MAX_RECORD_BYTES) -> Iterator[tuple[int, int, bytes | None, bool]]:
    """(offset, next offset, record without its line break, terminated) of the records that begin from ``start`` to before ``end``; ``size`` is the file's when it was listed.

    If ``start`` is not known to begin a record (not aligned), what belongs to the
    one before is skipped. A record of more than ``limit`` bytes is given as None,
    and nothing after it.
    """
    position = start if aligned else start - 1
    f.seek(position)
    begin, held, skipping = position, bytearray(), not aligned
    while position < size and (block := f.read(min(BLOCK_BYTES, size - position))):
        lo = 0
        while (cut := block.find(b"\n", lo)) >= 0:
            if not skipping:
                record = bytes(held) + block[lo:cut]
                record = record.removesuffix(b"\r")
                long = len(record) > limit
                yield begin, position + cut + 1, None if long else record, True
                if long:
                    return
            held.clear()
            skipping, lo = False, cut + 1
            begin = position + lo
            if begin >= end:
                return
        if not skipping:
            held += block[lo:]
            if len(held) > limit + 2:
                yield begin, begin + len(held), None, True
                return
        position += len(block)
    if held:
        yield begin, begin + len(held), bytes(held).removesuffix(b"\r"), False


def split(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Files (agent, path, start, size, lines) as ranges (agent, path, start, end, size, aligned, first_line), dealt by their number.

    ``start`` begins a record and ``lines`` is how many lines come before it. Lines
    of files with several ranges are counted first, range by range, so that each
    knows the number of its first line.
    """
    some = files.where("start < size")
    at = F.explode(F.sequence("start", F.col("size") - 1, F.lit(range_bytes)))
    ranges = some.select("agent", "path", F.col("start").alias("from"), "size", "lines", at.alias("start"))
    ranges = ranges.select("agent", "path", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end"), "size", (F.col("start") == F.col("from")).alias("aligned"), "lines")
    large = ranges.where(F.col("end") < F.col("size")).select("path").distinct()

    def count(it):
        for pdf in it:
            out = []
            for path, start, end, size, aligned in zip(pdf["path"], pdf["start"], pdf["end"], pdf["size"], pdf["aligned"], strict=True):
                with open_file(path) as f:
                    out.append((path, start, sum(1 for _ in records(f, start, end, size, aligned))))
            yield pd.DataFrame(out, columns=["path", "start", "n"])

    counted = _dealt(ranges.join(large, "path", "left_semi")).mapInPandas(count, "path string, start long, n long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counted.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return ranges.join(earlier, ["path", "start"], "left").select("agent", "path", "start", "end", "size", "aligned", (F.col("lines") + F.coalesce("before", F.lit(0))).alias("first_line"))


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges by a hash, so that those of one file and small files are read side by side."""
    return ranges.repartition("path", "start")


def read(ranges: DataFrame, limit: int = MAX_RECORD_BYTES) -> DataFrame:
    """RECORDS of ranges: blank lines are counted and left out; a record that is too long has no raw text."""

    def each(it):
        for pdf in it:
            out, held = [], 0
            for agent, path, start, end, size, aligned, line in zip(*(pdf[c] for c in ("agent", "path", "start", "end", "size", "aligned", "first_line")), strict=True):
                with open_file(path) as f:
                    for offset, after, record, terminated in records(f, start, end, size, aligned, limit):
                        line += 1
                        if record is None or record.strip():
                            out.append((agent, path, line, offset, after, None if record is None else record.decode("utf-8", "replace"), terminated, record is None))
                            held += len(record or b"")
                        if held > BATCH_BYTES:
                            yield pd.DataFrame(out, columns=RECORD_NAMES)
                            out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=RECORD_NAMES)

    return _dealt(ranges).mapInPandas(each, RECORDS)


RECORD_NAMES = [c.split()[0] for c in RECORDS.split(", ")]


def fingerprints(files: DataFrame, at: str = "size") -> DataFrame:
    """``files`` (path, size, ...) with first_record_hash and boundary_hash: SHA-256 of the first record, and of the last 64 KiB before the position in column ``at`` (null where the file ends before, or it is null). Only these bytes are read."""

    def each(it):
        for pdf in it:
            out = []
            for path, size, position in zip(pdf["path"], pdf["size"], pdf["at"], strict=True):
                with open_file(path) as f:
                    found, boundary = next(records(f, 0, 1, size), None), None
                    if 0 <= position <= size:
                        begin = max(0, position - FINGERPRINT_BYTES)
                        f.seek(begin)
                        boundary = hashlib.sha256(f.read(position - begin)).hexdigest()
                    out.append((path, hashlib.sha256(found[2] if found and found[2] is not None else b"").hexdigest(), boundary))
            yield pd.DataFrame(out, columns=["path", "first_record_hash", "boundary_hash"])

    asked = files.select("path", "size", F.coalesce(at, F.lit(-1)).alias("at")).repartition("path")
    return files.join(asked.mapInPandas(each, "path string, first_record_hash string, boundary_hash string"), "path")
