"""Helpers that several operators use: staged tables, text as numpy arrays, Bloom filters.

Staged tables cut lineage and survive lost executors: they are Parquet in the
folder that ``spark.checkpoint.dir`` names, which every executor can reach.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root

#: Characters of text that are turned into arrays at a time in a task (one longer text is taken whole).
CHUNK_CHARS = 400_000

_MASK = (1 << 64) - 1
SPACES = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------------ staged tables
#: Staged folders by application, so that they can be deleted when nothing reads them any more.
_STAGED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The run's folder under ``spark.checkpoint.dir``, or what stands in for it on one machine."""
    return f"{shared_root(spark)}/ledgerloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Folders that are staged inside are deleted at the end, but for those that the list it gives then holds. Frames that read them must be written or gone by then."""
    made = _STAGED.setdefault(spark.sparkContext.applicationId, [])
    before, kept = len(made), []
    yield kept
    inside = made[before:]
    del made[before:]
    made += kept
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in inside:
        if path not in kept:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)


def stage_only(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Stage what ``make`` gives. What it staged on the way is deleted, and must not be read by anything else."""
    with scratch(spark) as kept:
        df, path = make(), new_path(spark, name)
        df.write.parquet(path)
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a missing identifier in tasks, where pandas would turn a column with nulls into floats.
NO_ID = -(1 << 63)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, under fixed names, whatever other columns there are."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def named(docs: DataFrame) -> DataFrame:
    """Null doc_ids become NO_ID, for tasks; ``unnamed`` turns them back."""
    return docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def unnamed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the identifier as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


# ------------------------------------------------------------------ text as arrays
def give_back() -> None:
    """What a worker has freed goes back to the system: workers live on from task to task, and what one of them needs little of later would stay with it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` characters together. After the last one, free memory is given back."""
    lo = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)
    give_back()


def mix64(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base & _MASK
    return out


_LONG_WORD = 1024
_POWERS = _powers(0xD6E8FEB86659FD93, _LONG_WORD)
_BYTE_VALUES = mix64(np.arange(256, dtype=np.uint64), 7)
_IDENTITY = np.arange(256, dtype=np.uint8)
_LOWER = _IDENTITY.copy()
_LOWER[65:91] += 32
#: Words of anything but ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, *range(9, 14)]] = False
#: Words of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class Words:
    """The words of some texts, in order: ``hashes`` (64 bits), ``starts`` and ``ends`` (bytes of ``data``), ``first`` (a text's first word; one entry more than texts)."""

    def __init__(self, texts: list, word_bytes: np.ndarray, lower: bool):
        encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.data = b"\n".join([*encoded, b""])
        raw = np.frombuffer(self.data, np.uint8)
        if lower:
            raw = _LOWER[raw]
        inside = word_bytes[raw]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(e) + 1 for e in encoded], out=begin[1:])
        self.first = np.searchsorted(self.starts, begin)
        self.raw = raw
        self.hashes = self._hash(raw, inside)

    def _hash(self, raw: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(at, lens)
        long = lens > _LONG_WORD
        if long.any():
            place %= _LONG_WORD
        h = np.add.reduceat(_BYTE_VALUES[raw[inside]] * _POWERS[place], at)
        h = mix64(h ^ lens.astype(np.uint64))
        for i in np.flatnonzero(long):
            h[i] = xxhash.xxh3_64_intdigest(raw[self.starts[i] : self.ends[i]].tobytes())
        return h

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(words: Words, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every k consecutive words of one text, and the first of these for each text (one entry more). A text of fewer words has none."""
    n = np.maximum(words.counts() - k + 1, 0)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], n)
    h = mix64(words.hashes, salt + 11)
    out = np.zeros(len(at), np.uint64)
    q = np.uint64(0xC2B2AE3D27D4EB4F + 2 * salt)
    for j in range(k):
        out = out * q + h[at + j]
    return mix64(out, salt), first


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each entry, from the bounds that ``first`` holds."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def pack_planes(a: np.ndarray) -> bytes:
    """All values' first bytes, then all second ones, ...: of small numbers only the first take room."""
    return pack(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T)


def unpack_planes(b: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit values: their differences, byte by byte, so that what all have in common takes no room."""
    return pack_planes(np.diff(a, prepend=a.dtype.type(0)) if len(a) else a)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(b, np.uint64), dtype=np.uint64)


# ------------------------------------------------------------------ Bloom filters
PROBES = 3
#: Bits of a filter's segment. A hash falls into one segment alone, so that each segment is built in one task, from the hashes of its range.
SEGMENT_BITS = 1 << 19
#: Bits of a filter that is sent to all tasks, at most (128 MiB).
MOST_BITS = 1 << 30


def bloom_segments(expected: int, bits_each: int = 16, most_bits: int = MOST_BITS) -> int:
    """Segments (a power of two) for so many entries; 0 if these need more than ``most_bits``."""
    n = 1
    while n * SEGMENT_BITS < expected * bits_each:
        n *= 2
    return n if n * SEGMENT_BITS <= max(most_bits, SEGMENT_BITS) and expected * bits_each <= most_bits else 0


def _probe(h: np.ndarray, bits: int, i: int) -> np.ndarray:
    """Bit i of each hash: within the segment that the hash falls into, or within ``bits`` if there are fewer."""
    inner = mix64(h, 100 + i) & np.uint64(min(bits, SEGMENT_BITS) - 1)
    if bits > SEGMENT_BITS:
        inner |= _segment(h, bits // SEGMENT_BITS) * np.uint64(SEGMENT_BITS)
    return inner.astype(np.int64)


def _segment(h: np.ndarray, n: int) -> np.ndarray:
    return mix64(h, 99) & np.uint64(n - 1)


def bloom_add(filled: np.ndarray, h: np.ndarray) -> None:
    for i in range(PROBES):
        p = _probe(h, len(filled) * 8, i)
        np.bitwise_or.at(filled, p >> 3, (1 << (p & 7)).astype(np.uint8))


def bloom_has(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for i in range(PROBES):
        p = _probe(h, len(filled) * 8, i)
        found &= (filled[p >> 3] >> (p & 7).astype(np.uint8)) & 1 != 0
    return found


def build_bloom(hashes: DataFrame, column: str, n: int) -> np.ndarray:
    """A filter of ``n`` segments over a long column of distinct hashes. They are shuffled by segment, and each segment is built where its hashes are; the driver gets the whole, of a size that ``bloom_segments`` bounds."""

    def place(it):
        for pdf in it:
            h = pdf["h"].to_numpy(np.int64)
            yield pd.DataFrame({"segment": _segment(h.view(np.uint64), n).astype(np.int32), "h": h})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(SEGMENT_BITS // 8, np.uint8)
        bloom_add(own, pdf["h"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "body": [pack(own)]})

    built = hashes.select(F.col(column).alias("h")).mapInPandas(place, "segment int, h long").groupBy("segment").applyInPandas(build, "segment int, body binary")
    out = np.zeros(n * SEGMENT_BITS // 8, np.uint8)
    for r in built.toLocalIterator():
        out[r["segment"] * SEGMENT_BITS // 8 : (r["segment"] + 1) * SEGMENT_BITS // 8] = unpack(bytes(r["body"]), np.uint8)
    return out


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
