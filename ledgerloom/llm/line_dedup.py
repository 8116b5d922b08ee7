"""Removal of lines that many documents share.

Pass 1 deals hashes of line keys out by hash range, each once a task. Every
range has two Bloom filters, one for keys seen and one for keys seen again, and
gives back the hashes that the second one has. Pass 2 sends only suspected
repeats through a shuffle, which confirms them exactly, counts documents and
chooses the occurrence that stays. Pass 3 drops the lines where the texts are
read. No task holds a filter of all keys; what is sent to all tasks (a filter of
the suspects, the confirmed keys) has a checked size, and joins stand in for it
beyond that. False positives only cost shuffle; there are no false negatives.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import NO_ID, SPACES, bloom_add, bloom_has, build_bloom, chunks, give_back, id_text, named, pack, pack_sorted, stage, unpack, unpack_sorted

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys of a range of hashes, about, and the least number of ranges.
RANGE_KEYS, MIN_RANGES = 1 << 22, 64
#: Distinct hashes that a task holds before it passes them on.
TASK_KEYS = 4_000_000
#: Confirmed keys (32 bytes each) that are sent to all tasks at most.
BROADCAST_KEYS = 1_000_000


def line_key(line: str) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased, as UTF-8."""
    return line.strip(SPACES).encode("utf-8", "surrogatepass").lower()


def _digests(text: str | None, min_chars: int) -> list[bytes | None]:
    """A 128-bit digest of each line's key; None for shorter keys."""
    return [hashlib.blake2b(line_key(x), digest_size=16).digest() if len(x) >= min_chars and len(x.strip(SPACES)) >= min_chars else None for x in (text or "").split("\n")]


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def _distinct(h: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and whether each came twice or was marked."""
    order = np.argsort(h, kind="stable")
    h, many = h[order], many[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[at], (np.logical_or.reduceat(many, at) | (np.diff(np.append(at, len(h))) > 1)) if len(at) else many[at]


def suspected_hashes(docs: DataFrame, expected: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """h: hashes of line keys that two documents may hold, each once, from two Bloom filters for each range of hashes; ``expected`` keys at most."""
    ranges = MIN_RANGES
    while ranges * RANGE_KEYS < expected:
        ranges *= 2
    shift = np.uint64(64 - ranges.bit_length() + 1)
    bits = 1 << 12
    while bits < 16 * expected // ranges:
        bits *= 2

    def emit(it):
        held, n = [], 0

        def rows():
            h, many = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
            r = (h >> shift).astype(np.int32)
            cut = np.flatnonzero(np.diff(r, prepend=-1, append=-1))
            return pd.DataFrame([(int(r[i]), pack_sorted(h[i:j]), pack(many[i:j])) for i, j in zip(cut, cut[1:], strict=False)], columns=["part", "body", "many"])

        for pdf in it:
            texts = pdf["text"].to_list()
            for lo, hi in chunks(texts):
                h = _hashes([d for t in texts[lo:hi] for d in {*_digests(t, min_chars)} if d])
                held.append(_distinct(h, np.zeros(len(h), bool)))
                n += len(held[-1][0])
                if n > TASK_KEYS:
                    held = [_distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    n = len(held[0][0])
                    if n > TASK_KEYS // 2:
                        yield rows()
                        held, n = [], 0
        if n:
            yield rows()

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        bodies = [(unpack_sorted(h), unpack(m, bool)) for h, m in zip(pdf["body"], pdf["many"], strict=True)]
        for h, many in bodies:
            bloom_add(twice, h[many | bloom_has(once, h)])
            bloom_add(once, h)
        found = np.unique(np.concatenate([h[bloom_has(twice, h)] for h, _ in bodies]))
        return pd.DataFrame({"h": found.view(np.int64)})

    return docs.select("text").mapInPandas(emit, "part int, body binary, many binary").groupBy("part").applyInPandas(look, "h long")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, most_bits: int = shared.MOST_BITS) -> DataFrame:
    """(key, keeper): 128-bit digests of line keys that ``min_docs`` documents hold, with the largest doc_id that does. Beyond ``most_bits`` the filter of suspects gives way to a join."""
    thin, spark = id_text(docs, id_col, text_col), docs.sparkSession
    size = thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    suspected = stage(suspected_hashes(thin, size // (min_chars + 1) + 1, min_chars), "line-hashes")
    n = shared.bloom_segments(suspected.count(), most_bits=most_bits)
    sent = spark.sparkContext.broadcast(build_bloom(suspected, "h", n)) if n else None

    def keys(it):
        for pdf in it:
            ids, texts = pdf["doc_id"].to_numpy(np.int64), pdf["text"].to_list()
            for lo, hi in chunks(texts):
                own = [[*({*_digests(t, min_chars)} - {None})] for t in texts[lo:hi]]
                key = [d for x in own for d in x]
                h = _hashes(key)
                seen = bloom_has(sent.value, h) if sent else np.ones(len(h), bool)
                at = np.repeat(np.arange(lo, hi), [len(x) for x in own])[seen]
                yield pd.DataFrame({"doc_id": ids[at], "key": [k for k, s in zip(key, seen, strict=True) if s], "h": h[seen].view(np.int64)})

    # Null identifiers count as one document, smaller than any other.
    found = named(thin).mapInPandas(keys, "doc_id long, key binary, h long")
    if not sent:
        found = found.join(suspected, "h", "left_semi")
    confirmed = found.select("doc_id", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    return confirmed.select("key", "keeper")


class _Lost:
    """Confirmed keys, sorted, for look-ups in tasks."""

    def __init__(self, rows: list):
        keys = np.frombuffer(b"".join(bytes(r["key"]) for r in rows), np.uint64).reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        self.high, self.low = keys[order, 0].copy(), keys[order, 1].copy()
        self.keeper = np.array([rows[i]["keeper"] for i in order], np.int64)

    def of(self, doc_id: int, digests: list) -> list[bool]:
        """Whether each line of a document goes."""
        at = [i for i, d in enumerate(digests) if d]
        gone = [False] * len(digests)
        if at and len(self.high):
            own = np.frombuffer(b"".join(digests[i] for i in at), np.uint64).reshape(-1, 2)
            k, end = np.searchsorted(self.high, own[:, 0]), len(self.high)
            hit = np.zeros(len(at), bool)
            while (more := (k < end) & ~hit & (self.high[np.minimum(k, end - 1)] == own[:, 0])).any():
                hit |= more & (self.low[np.minimum(k, end - 1)] == own[:, 1])
                k = np.where(more & ~hit, k + 1, np.where(hit, k, end))
            for i, h, x in zip(at, hit, k, strict=True):
                gone[i] = bool(h) and self.keeper[x] != doc_id
        return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, most_bits: int = shared.MOST_BITS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with one struct column more, ``line_dedup``: kept text, n_lines, n_dropped.

    Texts are split at \\n. Keys of at least ``min_chars`` code points that at
    least ``min_docs`` documents hold lose all their lines except in the largest
    doc_id holding them; there, all stay.

    Null or empty text is one empty line, kept; its kept text is empty. Rows
    that repeat a doc_id count as one document and lose the same lines. Null
    doc_ids count as one document, smaller than any other. An empty table gives
    an empty result; other columns pass through. Any column of the name
    ``line_dedup`` is replaced. Up to ``broadcast_keys`` confirmed keys go to all
    tasks; more of them are joined to the documents that hold them.
    """
    spark = docs.sparkSession
    confirmed = stage(repeated_lines(docs, id_col, text_col, min_chars, min_docs, most_bits), "line-keys")
    rest = docs.drop("line_dedup")
    out = "kept string, n_lines long, n_dropped long"

    def drop(text, gone) -> tuple:
        lines = (text or "").split("\n")
        kept = [x for x, g in zip(lines, gone, strict=True) if not g] if any(gone) else lines
        return "\n".join(kept), len(lines), len(lines) - len(kept)

    if confirmed.count() <= broadcast_keys:
        sent = spark.sparkContext.broadcast(_Lost(confirmed.collect()))

        @F.pandas_udf(out)
        def keep(ids: pd.Series, text: pd.Series) -> pd.DataFrame:
            kept = pd.DataFrame([drop(t, sent.value.of(i, _digests(t, min_chars))) for i, t in zip(ids, text, strict=True)], columns=["kept", "n_lines", "n_dropped"])
            give_back()
            return kept

        return rest.withColumn("line_dedup", keep.asNondeterministic()(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.col(text_col).cast("string")))

    @F.pandas_udf("array<binary>")
    def keys(text: pd.Series) -> pd.Series:
        return pd.Series([[*({*_digests(t, min_chars)} - {None})] for t in text])

    held = named(id_text(docs, id_col, text_col)).select("doc_id", F.explode(keys("text")).alias("key")).join(confirmed, "key").where("doc_id <> keeper")
    lost = held.groupBy(F.col("doc_id").alias("__lost_id")).agg(F.collect_set("key").alias("__lost_keys"))

    @F.pandas_udf(out)
    def keep_others(text: pd.Series, lost_keys: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k in zip(text, lost_keys, strict=True):
            gone = {bytes(x) for x in k} if k is not None else ()
            rows.append(drop(t, [d in gone for d in _digests(t, min_chars)] if gone else [False] * ((t or "").count("\n") + 1)))
        return pd.DataFrame(rows, columns=["kept", "n_lines", "n_dropped"])

    joined = rest.join(stage(lost, "line-lost"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col("__lost_id"), "left")
    return joined.withColumn("line_dedup", keep_others(F.col(text_col).cast("string"), "__lost_keys")).drop("__lost_id", "__lost_keys")
