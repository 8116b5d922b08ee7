"""Removal of repeated passages with a log-structured fingerprint index.

A window is k consecutive words. Of every window, the smallest hash among its
runs of ANCHOR words is its fingerprint, so that equal windows have equal
fingerprints while the index holds about a fifth of all positions. The index is
a log of immutable runs, each sorted by fingerprint within buckets of the hash
range, with the smallest document that holds it. A batch of documents is
merge-joined with the runs; fingerprints met before, or twice in the batch, are
suspects. The batch then becomes a run of its own; when a level has FANOUT runs,
they are compacted to one of the next level, in more buckets if need be.
Suspected windows are verified by 128-bit hashes of their words before anything
is removed. Verified windows are runs of the index, too: a later batch needs
the text of an earlier document only if that alone held a fingerprint so far.
A manifest names the runs, so that other sessions can open the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import NON_SPACE, Words, bloom_has, chunks, grams, id_text, mix64, owner, pack, pack_sorted, stage, unpack, unpack_sorted

WINDOW = 13
ANCHOR = 5
#: Entries of a bucket, about; a bucket is the unit of a merge join.
BUCKET_ROWS = 500_000
LEAST_BUCKETS = 64
FANOUT = 4
#: Buckets in a file of a run, about. Runs are tables bucketed by bucket, so that joins of runs of one size need no shuffle, however large the index is.
FILE_BUCKETS = 8
#: A table is fed in batches of so many bytes of text at most, and in so many batches at least.
BATCH_BYTES, BATCHES = 1 << 40, 6

RUN_SCHEMA = "bucket int, body binary, owners binary, many binary"
WINDOW_SCHEMA = "bucket int, body binary, checks binary, owners binary"


def buckets_of(entries: int) -> int:
    """A power of two of buckets for so many entries."""
    n = LEAST_BUCKETS
    while n * BUCKET_ROWS < entries:
        n *= 2
    return n


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32)


def fingerprints(words: Words, window: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Each window's fingerprint, and the first window of each text (one entry more than texts)."""
    h, first = grams(words, anchor)
    n = np.maximum(words.counts() - window + 1, 0)
    wins = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=wins[1:])
    at = np.arange(wins[-1]) + np.repeat(first[:-1] - wins[:-1], n)
    low = h[at] if len(at) else np.zeros(0, np.uint64)
    for j in range(1, window - anchor + 1):
        low = np.minimum(low, h[at + j])
    # Smallest hashes are small; mixed again, they fill all buckets evenly.
    return mix64(low, 3), wins


def _sorted_groups(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending; the smallest owner of each; whether it has several owners."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    low = owners[at]
    high = owners[np.append(at[1:], len(keys)) - 1] if len(at) else low
    return keys[at], low, high != low


def _by_bucket(keys: np.ndarray, buckets: int):
    """Bounds of each bucket that has some of the sorted keys."""
    b = _bucket(keys, buckets)
    cut = np.flatnonzero(np.diff(b, prepend=-1, append=-1))
    return zip(b[cut[:-1]].tolist(), cut, cut[1:], strict=False)


def split_buckets(run: DataFrame, old: int, new: int) -> DataFrame:
    """The run in ``new`` buckets, which are parts of the ``old`` ones."""
    if new == old:
        return run
    types = {"owners": np.int64, "many": bool, "checks": np.uint64}
    others = [c for c in run.columns if c not in ("bucket", "body")]

    def split(it):
        for pdf in it:
            for r in pdf.itertuples(index=False):
                keys, rest = unpack_sorted(r.body), [unpack(getattr(r, c), types[c]) for c in others]
                rows = [(b, pack_sorted(keys[i:j]), *(pack(x[i:j]) for x in rest)) for b, i, j in _by_bucket(keys, new)]
                yield pd.DataFrame(rows, columns=["bucket", "body", *others])

    return run.select("bucket", "body", *others).mapInPandas(split, run.schema)


def batch_run(batch: DataFrame, window: int, buckets: int, anchor: int = ANCHOR) -> DataFrame:
    """The batch's fingerprints as one sorted run: a row for each bucket. Owners are counted once in a task's chunk before they are shuffled."""

    def emit(it):
        for pdf in it:
            ids, texts = pdf["doc_id"].to_numpy(np.int64), pdf["text"].to_list()
            for lo, hi in chunks(texts):
                low, first = fingerprints(Words(texts[lo:hi], NON_SPACE, lower=False), window, anchor)
                change = np.ones(len(low), bool)
                change[1:] = low[1:] != low[:-1]
                change[first[:-1][first[:-1] < len(low)]] = True
                keys, owners, many = _sorted_groups(low[change], ids[lo:hi][owner(first)[change]])
                rows = [(b, pack_sorted(keys[i:j]), pack(owners[i:j]), pack(many[i:j])) for b, i, j in _by_bucket(keys, buckets)]
                yield pd.DataFrame(rows, columns=["bucket", "body", "owners", "many"])

    return batch.where("doc_id is not null").mapInPandas(emit, RUN_SCHEMA).groupBy("bucket").applyInPandas(merge_runs, RUN_SCHEMA)


def merge_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One sorted run of a bucket from several."""
    keys = np.concatenate([unpack_sorted(b) for b in pdf["body"]])
    owners = np.concatenate([unpack(b, np.int64) for b in pdf["owners"]])
    many = np.concatenate([unpack(b, bool) for b in pdf["many"]])
    order = np.argsort(keys, kind="stable")
    k, low, several = _sorted_groups(keys, owners)
    if len(k):
        several = several | np.logical_or.reduceat(many[order], np.searchsorted(keys[order], k))
    return pd.DataFrame([(int(pdf["bucket"].iloc[0]), pack_sorted(k), pack(low), pack(several))], columns=["bucket", "body", "owners", "many"])


def merge_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """One sorted run of a bucket's verified windows from several: each window once, with its smallest document."""
    keys = np.concatenate([unpack_sorted(b) for b in pdf["body"]])
    check, docs = np.concatenate([unpack(b, np.uint64) for b in pdf["checks"]]), np.concatenate([unpack(b, np.int64) for b in pdf["owners"]])
    order = np.lexsort((docs, check, keys))
    keys, check, docs = keys[order], check[order], docs[order]
    new = _new(keys, check)
    return pd.DataFrame([(int(pdf["bucket"].iloc[0]), pack_sorted(keys[new]), pack(check[new]), pack(docs[new]))], columns=["bucket", "body", "checks", "owners"])


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class Run(NamedTuple):
    """An immutable run: kind is fingerprints or windows, number of the batch that made it or its newest part."""

    kind: str
    path: str
    level: int
    buckets: int
    entries: int
    number: int

    @property
    def files(self) -> int:
        return max(1, self.buckets // FILE_BUCKETS)


MANIFEST = "kind string, path string, level int, buckets int, entries long, number int, window int, anchor int, batch int"


class FingerprintIndex:
    """A log of sorted runs under ``folder`` (a new one by default). Batches come in any order; what a batch repeats of earlier ones, or of itself, is returned as suspected fingerprints."""

    SCHEMAS = {"fingerprints": RUN_SCHEMA, "windows": WINDOW_SCHEMA}

    def __init__(self, spark: SparkSession, window: int = WINDOW, anchor: int = ANCHOR, fanout: int = FANOUT, folder: str | None = None):
        self.spark, self.window, self.anchor, self.fanout = spark, window, anchor, fanout
        self.folder = folder or shared.new_path(spark, "fingerprint-index")
        self.runs: list[Run] = []
        self.batch = self.compactions = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = FANOUT) -> FingerprintIndex:
        """The index as its newest complete manifest has it."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests/*/_SUCCESS")
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        newest = max(str(f.getPath().getParent()) for f in found)
        rows = spark.read.schema(MANIFEST).json(newest).collect()
        self = cls(spark, rows[0]["window"], rows[0]["anchor"], fanout, folder)
        self.batch = rows[0]["batch"]
        self.runs = [Run(*r[:6]) for r in rows if r["kind"] in cls.SCHEMAS]
        return self

    def commit(self) -> None:
        """Write the manifest. Until then, others see the index as it was; runs that no manifest names are left to be deleted."""
        head = (None, None, None, None, None, None, self.window, self.anchor, self.batch)
        rows = [head, *((*r, self.window, self.anchor, self.batch) for r in self.runs)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{self.folder}/manifests/{self.batch:08d}-{self.compactions:08d}")

    def read(self, run: Run, buckets: int | None = None) -> DataFrame:
        name = self._table(run.path)
        if not self.spark.catalog.tableExists(name):  # another session's
            self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMAS[run.kind]}) USING parquet CLUSTERED BY (bucket) SORTED BY (bucket) INTO {run.files} BUCKETS LOCATION '{run.path}'")
        return split_buckets(self.spark.table(name), run.buckets, buckets or run.buckets)

    @staticmethod
    def _table(path: str) -> str:
        """A run's name as a table of the session: by what tells its folder apart."""
        return "run_" + hashlib.blake2b(path.encode(), digest_size=12).hexdigest()

    def all_of(self, kind: str, buckets: int) -> DataFrame | None:
        """All runs of a kind in so many buckets, which have to be as many as those of every run at least."""
        out = None
        for r in self.runs:
            if r.kind == kind:
                out = self.read(r, buckets) if out is None else out.unionByName(self.read(r, buckets))
        return out

    def most_buckets(self, kind: str, least: int = LEAST_BUCKETS) -> int:
        return max([least, *(r.buckets for r in self.runs if r.kind == kind)])

    def _write(self, kind: str, df: DataFrame, level: int, buckets: int, entries: int) -> Run:
        path = f"{self.folder}/{kind}-{self.batch:08d}-{level}-{self.compactions}"
        run = Run(kind, path, level, buckets, entries, self.batch)
        df.write.bucketBy(run.files, "bucket").sortBy("bucket").format("parquet").option("path", path).saveAsTable(self._table(path))
        return run

    def ingest(self, batch: DataFrame, words: int) -> DataFrame:
        """Append the batch (doc_id, text; about so many words) as a run and return its suspects: fp, a row for each fingerprint that two documents hold, and alone, the one earlier document that held it so far (else null)."""
        self.batch += 1
        run = self._write("fingerprints", batch_run(batch, self.window, n := buckets_of(words // 4), self.anchor), 0, n, words // 4)
        suspects = self.read(run).mapInPandas(_within, "fp long, alone long")
        met = None
        for old in self.runs:
            if old.kind == "fingerprints":
                most = max(n, old.buckets)
                new = self.read(run, most).withColumnsRenamed({"body": "new_body", "owners": "new_owners", "many": "new_many"})
                both = self.read(old, most).join(new, "bucket").mapInPandas(_across, "fp long, owner long, many boolean, differs boolean")
                met = both if met is None else met.unionByName(both)
        if met is not None:
            # All runs together know whether one document held a fingerprint.
            met = met.groupBy("fp").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.max("many").alias("many"), F.max("differs").alias("differs")).where("differs or many or lo <> hi")
            suspects = suspects.unionByName(met.select("fp", F.when(~F.col("many") & (F.col("lo") == F.col("hi")), F.col("lo")).alias("alone")))
        self.runs.append(run)
        self.compact("fingerprints")
        return suspects

    def remember(self, windows: DataFrame, buckets: int) -> None:
        """Append verified windows (rows of WINDOW_SCHEMA) as a run."""
        self.runs.append(self._write("windows", windows.groupBy("bucket").applyInPandas(merge_windows, WINDOW_SCHEMA), 0, buckets, 0))
        self.compact("windows")

    def compact(self, kind: str) -> None:
        """Merge runs level by level, as long as some level has ``fanout`` of them. Older runs stay as files for readers that still hold them."""
        while True:
            levels = [r.level for r in self.runs if r.kind == kind]
            full = [n for n in sorted({*levels}) if levels.count(n) >= self.fanout]
            if not full:
                return
            old = [r for r in self.runs if r.kind == kind and r.level == full[0]]
            entries = sum(r.entries for r in old)
            buckets = max(buckets_of(entries), *(r.buckets for r in old))
            both = self.read(old[0], buckets)
            for r in old[1:]:
                both = both.unionByName(self.read(r, buckets))
            self.compactions += 1
            merged = self._write(kind, both.groupBy("bucket").applyInPandas(merge_runs if kind == "fingerprints" else merge_windows, self.SCHEMAS[kind]), full[0] + 1, buckets, entries)
            self.runs = [r for r in self.runs if r not in old] + [merged]


def _within(it):
    for pdf in it:
        for body, many in zip(pdf["body"], pdf["many"], strict=True):
            fp = unpack_sorted(body)[unpack(many, bool)].view(np.int64)
            yield pd.DataFrame({"fp": fp, "alone": pd.array([None] * len(fp), "Int64")})


def _across(it):
    """Merge join of two sorted runs of a bucket."""
    for pdf in it:
        for r in pdf.itertuples(index=False):
            both, i, j = np.intersect1d(unpack_sorted(r.body), unpack_sorted(r.new_body), assume_unique=True, return_indices=True)
            old = unpack(r.owners, np.int64)[i]
            yield pd.DataFrame({"fp": both.view(np.int64), "owner": old, "many": unpack(r.many, bool)[i], "differs": unpack(r.new_many, bool)[j] | (old != unpack(r.new_owners, np.int64)[j])})


VERIFY_SCHEMA = "bucket int, keys binary, checks binary, doc_ids binary, texts binary, places binary"
SPAN_SCHEMA = "doc_id long, text_key long, starts binary"


def suspected_windows(docs: DataFrame, suspects: DataFrame, window: int, buckets: int, anchor: int = ANCHOR, most_bits: int = shared.MOST_BITS) -> DataFrame:
    """Windows of ``docs`` (doc_id, text, text_key; text_key null: earlier documents, whose own windows stay) that suspects (fp) point at, sorted by bucket.

    Suspects reach the tasks as a Bloom filter of a checked size; where they are
    too many for it, all windows are looked at. In a chunk only a window's
    smallest document goes on; larger ones are known to repeat it, and their
    places go on in a bucket of the chunk's own (below 0).
    """
    spark, suspects = docs.sparkSession, stage(suspects.distinct(), "suspects")
    n = shared.bloom_segments(suspects.count(), most_bits=most_bits)
    sent = spark.sparkContext.broadcast(shared.build_bloom(suspects, "fp", n)) if n else None

    def emit(it):
        chunk = TaskContext.get().partitionId() << 10
        for pdf in it:
            ids, texts, keys_of = pdf["doc_id"].to_numpy(np.int64), pdf["text"].to_list(), pdf["text_key"].to_numpy(np.int64)
            earlier = pdf["earlier"].to_numpy(bool)
            for lo, hi in chunks(texts):
                chunk += 1
                w = Words(texts[lo:hi], NON_SPACE, lower=False)
                low, first = fingerprints(w, window, anchor)
                maybe = np.flatnonzero(bloom_has(sent.value, low)) if sent else np.arange(len(low))
                if not len(maybe):
                    continue
                key, check = grams(w, window, 1)[0][maybe], grams(w, window, 2)[0][maybe]
                of = owner(first)[maybe]
                doc, text, place, old = ids[lo:hi][of], keys_of[lo:hi][of], (maybe - first[of]).astype(np.uint32), earlier[lo:hi][of]
                order = np.lexsort((place, text, old, doc, check, key))
                key, check, doc, text, place, old = (x[order] for x in (key, check, doc, text, place, old))
                at = np.flatnonzero(_new(key, check))
                later = doc > np.repeat(doc[at], np.diff(np.append(at, len(key))))
                known = later & ~old
                if known.any():
                    yield pd.DataFrame([(-1 - (chunk & 0x3FFFFFFF), None, None, pack(doc[known]), pack(text[known]), pack(place[known]))], columns=["bucket", "keys", "checks", "doc_ids", "texts", "places"])
                key, check, doc, text, place, old = (x[~later] for x in (key, check, doc, text, place, old))
                for is_old, some in ((False, ~old), (True, old)):
                    k, c, d, t, p = (x[some] for x in (key, check, doc, text, place))
                    rows = [(b, pack_sorted(k[i:j]), pack(c[i:j]), pack(d[i:j]), None if is_old else pack(t[i:j]), None if is_old else pack(p[i:j])) for b, i, j in _by_bucket(k, buckets)]
                    yield pd.DataFrame(rows, columns=["bucket", "keys", "checks", "doc_ids", "texts", "places"])

    marked = docs.where("doc_id is not null").select("doc_id", "text", F.coalesce("text_key", F.lit(0)).alias("text_key"), F.col("text_key").isNull().alias("earlier"))
    return marked.mapInPandas(emit, VERIFY_SCHEMA)


def repeated_windows(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, starts): places in each text where a window starts that also starts in a document with a smaller doc_id, among ``found`` and ``known`` (WINDOW_SCHEMA) windows, compared by 128 bits. Rows of one doc_id may have several texts, so places belong to a doc_id and its text's hash; which document owns a window is decided by doc_id alone."""

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, t, p in pdf.loc[pdf["keys"].isna(), ["doc_ids", "texts", "places"]].itertuples(index=False):
            out += _places(unpack(d, np.int64), unpack(t, np.int64), unpack(p, np.uint32))
        own = pdf[pdf["keys"].notna()]
        if len(own):
            keys = [unpack_sorted(b) for b in own["keys"]]
            key, check, doc = np.concatenate(keys), np.concatenate([unpack(b, np.uint64) for b in own["checks"]]), np.concatenate([unpack(b, np.int64) for b in own["doc_ids"]])
            # Earlier documents' windows have no text and no place; they own, but lose nothing.
            text, place = (np.concatenate([np.zeros(len(k), kind) if b is None else unpack(b, kind) for b, k in zip(own[c], keys, strict=True)]) for c, kind in (("texts", np.int64), ("places", np.uint32)))
            old = np.repeat(own["texts"].isna().to_numpy(), [len(k) for k in keys])
            order = np.lexsort((doc, check, key))
            key, check, doc, text, place, old = (x[order] for x in (key, check, doc, text, place, old))
            at = np.flatnonzero(_new(key, check))
            later = (doc > np.repeat(doc[at], np.diff(np.append(at, len(key))))) & ~old
            out += _places(doc[later], text[later], place[later])
        return pd.DataFrame(out, columns=["doc_id", "text_key", "starts"])

    if known is not None:
        found = found.unionByName(known.select("bucket", F.col("body").alias("keys"), "checks", F.col("owners").alias("doc_ids")), allowMissingColumns=True)
    return found.groupBy("bucket").applyInPandas(decide, SPAN_SCHEMA)


def text_key(text: Column) -> Column:
    """What tells texts of one doc_id apart."""
    return F.xxhash64(text)


def _places(doc: np.ndarray, text: np.ndarray, place: np.ndarray) -> list[tuple[int, int, bytes]]:
    """The places of each document's texts, packed."""
    if not len(doc):
        return []
    order = np.lexsort((place, text, doc))
    doc, text, place = doc[order], text[order], place[order].astype(np.uint32)
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]))
    return [(int(doc[i]), int(text[i]), pack(place[i:j])) for i, j in zip(at, [*at[1:], len(doc)], strict=True)]


def _cut(text: pd.Series, starts: pd.Series, window: pd.Series) -> pd.DataFrame:
    out = []
    for t, s, k in zip(text, starts, window, strict=True):
        words = Words([t], NON_SPACE, lower=False)
        n = len(words.starts)
        cover = np.zeros(n + 1, np.int64)
        for b in s if s is not None else ():
            at = unpack(b, np.uint32).astype(np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + k, -1)
        gone = np.cumsum(cover)[:-1] > 0
        kept = [words.data[a:z] for a, z, g in zip(words.starts, words.ends, gone, strict=True) if not g]
        out.append((b" ".join(kept).decode("utf-8", "replace"), n, int(gone.sum())))
    return pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])


def _batches(docs: DataFrame, batches: int) -> Iterator[DataFrame]:
    """Ranges of doc_id with about as many documents each."""
    cuts = sorted({*(docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or ())}) if batches > 1 else []
    for a, z in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs if a is None else docs.where(F.col("doc_id") > a)
        yield part if z is None else part.where(F.col("doc_id") <= z)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int | None = None, index: FingerprintIndex | None = None, history: DataFrame | None = None, most_bits: int = shared.MOST_BITS) -> DataFrame:
    """``docs`` with one struct column more, ``substring_dedup``: kept text, n_words, n_removed.

    Words are runs of anything but ASCII white space. Each word goes that a
    window covers whose words also start in a document with a smaller doc_id, in
    ``docs`` or in ``history`` (all documents that ``index`` has had, with other
    doc_ids than ``docs``). Kept words are joined by one space. ``docs`` are fed
    to the index in batches by ranges of doc_id (by default of BATCH_BYTES of
    text, BATCHES at least) and then verified at once. Earlier documents are not
    judged anew, and of these only such are read again as alone held a
    fingerprint that ``docs`` hold; other windows are in the index.

    Null text has no words and gives an empty kept text. A document with a null
    doc_id neither loses words nor takes any from others. Rows that repeat a
    doc_id count as one document; each loses the places of its own text. An empty
    table gives an empty result; other columns pass through. Any column of the
    name ``substring_dedup`` is replaced.
    """
    thin, spark = id_text(docs, id_col, text_col), docs.sparkSession
    size = thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = batches or max(BATCHES, -(-size // BATCH_BYTES))
    lasting, words = index is not None, size // 6
    index = index or FingerprintIndex(spark, window)
    before = bool(index.runs)
    suspects = None
    for part in _batches(thin, batches):
        found = index.ingest(part, words // batches)
        suspects = found if suspects is None else suspects.unionByName(found)
    suspects = stage(suspects, "suspects")

    buckets = index.most_buckets("windows", buckets_of(words // 4))  # about a quarter of the windows are suspects
    looked = thin.withColumn("text_key", text_key(F.col("text")))
    if before and history is not None:
        alone = suspects.select(F.col("alone").alias("doc_id")).where("doc_id is not null").distinct()
        looked = looked.unionByName(id_text(history, id_col, text_col).join(alone, "doc_id", "left_semi").withColumn("text_key", F.lit(None).cast("long")))
    found = suspected_windows(looked, suspects.select("fp"), window, buckets, index.anchor, most_bits)
    if lasting:
        found = stage(found, "suspected-windows")
    starts = repeated_windows(found, index.all_of("windows", buckets) if lasting else None)
    # A document's windows lie in many buckets: as many rows as buckets at most.
    per_doc = starts.groupBy(F.col("doc_id").alias("__cut_id"), F.col("text_key").alias("__cut_text")).agg(F.collect_list("starts").alias("__cut_starts"))
    if lasting:
        per_doc = stage(per_doc, "places")
        index.remember(found.where("keys is not null").select("bucket", F.col("keys").alias("body"), "checks", F.col("doc_ids").alias("owners")), buckets)
        index.commit()
    else:
        per_doc = stage(per_doc, "places")
    cut = F.pandas_udf(_cut, "kept string, n_words long, n_removed long")
    rest, whole = docs.drop("substring_dedup"), F.col(text_col).cast("string")
    losers = stage(per_doc.select(F.col("__cut_id").alias("id")).distinct(), "losers")
    n = shared.bloom_segments(losers.count(), most_bits=most_bits)
    alone = None
    if n:
        # Texts that lose nothing stay where they are.
        sent = spark.sparkContext.broadcast(shared.build_bloom(losers, "id", n))

        @F.pandas_udf("boolean")
        def loses(i: pd.Series) -> pd.Series:
            return pd.Series(bloom_has(sent.value, i.to_numpy(np.int64).view(np.uint64)))

        marked = rest.withColumn("__loses", F.col(id_col).isNotNull() & loses(F.coalesce(F.col(id_col).cast("long"), F.lit(0))))
        alone = marked.where("not __loses").drop("__loses").withColumn("substring_dedup", cut(whole, F.lit(None).cast("array<binary>"), F.lit(window)))
        rest = marked.where("__loses").drop("__loses")
    joined = rest.join(per_doc, (F.col(id_col).cast("long") == F.col("__cut_id")) & (text_key(whole) == F.col("__cut_text")), "left")
    out = joined.withColumn("substring_dedup", cut(whole, "__cut_starts", F.lit(window))).drop("__cut_id", "__cut_text", "__cut_starts")
    return out if alone is None else out.unionByName(alone)
