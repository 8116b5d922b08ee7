"""A kept text index: where every three consecutive characters of all texts stand.

The index is a folder of Parquet tables. ``rows-g`` has the index rows that
generation g brought, each with a number; ``postings-g`` has one row for each
gram and block of 4,096 numbers, in folders of grams' hashes and sorted by gram, so
that a search reads a few row groups; ``dead-g`` has numbers of rows that
generation g replaced or removed. A pointer names the generations in force and
keeps their statistics. Nothing is changed in place: an update adds a generation
with the lists of its own rows, and a merge writes small generations as one, then
moves the pointer.

A term is looked for by the grams that cover it: their places, moved by the
grams' offsets, are intersected block by block, from the rarest. What is left are
exactly the places of the term, so that matches, their number and BM25 need no
text.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import postings as p
from ..functions.text import supports_trigrams
from ..sources import sinks
from . import search as s

#: Bits of a row's number within its block, of its number within a generation, and blocks that are intersected together.
BLOCK_BITS, GENERATION_BITS, GROUP_BITS = 12, 50, 6
#: Rows that one folder of grams is meant for, and how many of these there are at most.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 4096
#: Characters that a task turns into grams at a time.
CHUNK_CHARS = 300_000
#: Numbers of removed rows that are sent to all tasks; beyond that they are shuffled.
BROADCAST_DEAD = 1_000_000
#: Blocks whose removed rows (512 bytes each) are sent to all tasks when lists are merged; beyond that they are shuffled.
BROADCAST_BLOCKS = 50_000
#: Bytes of places that a task cleans of removed rows at a time.
CLEAN_BYTES = 2_000_000
#: Generations after which ``update`` merges all but the largest.
MOST_GENERATIONS = 4

_CHUNK = "bucket int, range long, block long, grams binary, n_docs binary, docs binary, places binary"
_POSTINGS = "bucket int, gram long, block long, n_docs int, docs binary, places binary"


def _texts(rows: DataFrame) -> DataFrame:
    lowered = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return rows.select("n", lowered("summary").alias("a"), lowered("searchable").alias("b"))


def _to_lists(buckets: int):
    """Texts to the lists of chunks, a packed row for each bucket and block."""

    def chunk(n: np.ndarray, columns: list[list[str]]):
        found = [p.grams_of(c) for c in columns]
        own_blocks, of_block = np.unique(n >> BLOCK_BITS, return_inverse=True)
        of = np.concatenate([of for of, _, _ in found])
        gram = np.concatenate([g for _, g, _ in found])
        place = np.concatenate([2 * at + k for k, (_, _, at) in enumerate(found)])
        bucket, block, gram, doc, place = p.in_order([p.bucket_of(gram, buckets), of_block[of]], gram, [n[of] & ((1 << BLOCK_BITS) - 1), place])
        edge = np.flatnonzero(np.diff(bucket, prepend=-1) | np.diff(block, prepend=-1))
        for a, z in zip(edge, np.append(edge[1:], len(gram)), strict=True):
            own = p.Lists(gram[a:z], doc[a:z], place[a:z], ordered=True)
            b = int(own_blocks[block[a]])
            yield int(bucket[a]), b >> BLOCK_BITS, b, p.varints(np.diff(own.grams, prepend=0))[0].tobytes(), p.varints(own.n_docs)[0].tobytes(), own.docs.tobytes(), own.places.tobytes()

    def each(it):
        for pdf in it:
            n, a, b = pdf["n"].to_numpy(np.int64), pdf["a"].to_list(), pdf["b"].to_list()
            size = np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)]) // CHUNK_CHARS
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                out = [*chunk(n[at], [[a[i] for i in at], [b[i] for i in at]])]
                if out:
                    yield pd.DataFrame(out, columns=["bucket", "range", "block", "grams", "n_docs", "docs", "places"])

    return each


def _join_lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """The lists of one bucket and block, from those of its chunks."""
    grams = np.concatenate([np.cumsum(p.unvarints(x)) for x in pdf["grams"]])
    of, doc, place = p.decode(p.unvarints(b"".join(pdf["n_docs"])), b"".join(pdf["docs"]), b"".join(pdf["places"]))
    own = p.Lists(grams[of], doc, place)
    out = pd.DataFrame([*own.each()], columns=["gram", "n_docs", "docs", "places"])
    return out.assign(bucket=int(pdf["bucket"].iloc[0]), block=int(pdf["block"].iloc[0]))[["bucket", "gram", "block", "n_docs", "docs", "places"]]


def _without_gone(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lists less the places of rows whose bit is set in ``gone``; lists of which nothing is left go."""
    dirty = pdf["gone"].notna()
    touched = pdf[dirty]
    block, of_block = np.unique(touched["block"].to_numpy(np.int64), return_inverse=True)
    bits = np.zeros((len(block), 1 << BLOCK_BITS), bool)
    for k, at in enumerate(np.unique(of_block, return_index=True)[1]):
        bits[k] = np.unpackbits(np.frombuffer(touched["gone"].iloc[at], np.uint8), bitorder="little")
    of, doc, place = p.decode(touched["n_docs"].to_numpy(np.int64), b"".join(touched["docs"]), b"".join(touched["places"]))
    keep = ~bits[of_block[of], doc]
    # Lists are numbered in their order, so that what is left of them is in order.
    left = pd.DataFrame([*p.Lists(of[keep], doc[keep], place[keep], ordered=True).each()], columns=["at", "n_docs", "docs", "places"])
    cleaned = touched.iloc[left["at"].to_numpy(np.int64)][["gram", "block"]].reset_index(drop=True).join(left[["n_docs", "docs", "places"]])
    return pd.concat([pdf.loc[~dirty, cleaned.columns], cleaned], ignore_index=True)


def _find(terms: list[str]):
    """Blocks' lists of grams to (n, _tf0, _tf1, ...), one row for each number that has a place of some term."""
    covers = [p.cover(t) for t in terms]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        base = int(pdf["block"].iloc[0]) >> GROUP_BITS << GROUP_BITS
        keys: dict[int, np.ndarray] = {}
        for gram, own in pdf.groupby("gram", sort=False):
            of, doc, place = p.decode(own["n_docs"].to_numpy(np.int64), b"".join(own["docs"]), b"".join(own["places"]))
            keys[int(gram)] = ((own["block"].to_numpy(np.int64) - base)[of] << BLOCK_BITS | doc) << p.PLACE_BITS | place
        found, none = [], np.zeros(0, np.int64)
        for cover in covers:
            lists = sorted((keys.get(g, none) - 2 * offset for g, offset in cover), key=len)
            hit = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), lists)
            found.append(np.unique(hit >> p.PLACE_BITS, return_counts=True))
        numbers = np.unique(np.concatenate([d for d, _ in found]))
        out = pd.DataFrame({"n": numbers + (base << BLOCK_BITS)})
        for k, (d, tf) in enumerate(found):
            own = np.zeros(len(numbers), np.int64)
            own[np.searchsorted(numbers, d)] = tf
            out[f"_tf{k}"] = own
        return out

    return each


class TextIndex:
    """The index in a folder that the driver and all executors reach. Index rows are those of ``search``; ids are unique."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -------------------------------------------------------------- what is kept
    def state(self) -> dict:
        return sinks.read_pointer(self.spark, self.root) or {"version": 0, "next": 1, "generations": [], "dead": [], "dead_rows": 0, "dead_length": 0}

    def _read(self, names: list[str]) -> DataFrame | None:
        frames = [self.spark.read.parquet(f"{self.root}/{n}") for n in names]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def _alive(self, rows: DataFrame, state: dict) -> DataFrame:
        dead = self._read(state["dead"])
        if dead is None:
            return rows
        numbers = dead.select("n")
        return rows.join(F.broadcast(numbers) if state["dead_rows"] <= BROADCAST_DEAD else numbers.hint("shuffle_hash"), "n", "left_anti")

    def rows(self) -> DataFrame:
        """The rows in force, with their numbers (n) and lengths in grams (_len)."""
        state = self.state()
        found = self._read([g["rows"] for g in state["generations"]])
        if found is None:
            raise FileNotFoundError(self.root)
        return self._alive(found, state)

    # -------------------------------------------------------------- changes
    def update(self, rows: DataFrame | None, gone: DataFrame | None = None) -> None:
        """Add rows, in place of those with the same id, and remove the ids of ``gone``. Texts of other rows are neither read nor written. A run that dies before its end leaves the index as it was."""
        state = self.state()
        g, name = state["next"], uuid.uuid4().hex[:8]
        if g >> (62 - GENERATION_BITS):
            raise ValueError("too many generations; build the index anew")
        new = dict(state, version=state["version"] + 1, next=g + 1, generations=[*state["generations"]], dead=[*state["dead"]])
        if rows is not None:
            length = lambda c: F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - (p.GRAM - 1), F.lit(0))
            numbered = rows.withColumn("_len", (length("summary") + length("searchable")).cast("long")).withColumn("n", F.monotonically_increasing_id() + F.lit(g << GENERATION_BITS))
            numbered.write.parquet(f"{self.root}/rows-{g}-{name}")
            own = self.spark.read.parquet(f"{self.root}/rows-{g}-{name}")
            n, total = own.agg(F.count(F.lit(1)), F.sum("_len")).first()
            if n:
                buckets = self._write_postings(own, n, f"postings-{g}-{name}")
                new["generations"].append({"gen": g, "rows": f"rows-{g}-{name}", "postings": f"postings-{g}-{name}", "buckets": buckets, "n": n, "length": total})
        if state["generations"]:
            ids = [x.select("id") for x in (rows, gone) if x is not None]
            if ids:
                dead = self.rows().select("id", "n", "_len").join(reduce(DataFrame.unionByName, ids).distinct(), "id", "left_semi")
                dead.write.parquet(f"{self.root}/dead-{g}-{name}")
                n, total = self._read([f"dead-{g}-{name}"]).agg(F.count(F.lit(1)), F.sum("_len")).first()
                if n:
                    new["dead"].append(f"dead-{g}-{name}")
                    new |= {"dead_rows": state["dead_rows"] + n, "dead_length": state["dead_length"] + total}
        sinks.write_pointer(self.spark, self.root, new, state["version"] or None)
        if len(new["generations"]) > MOST_GENERATIONS:
            self.merge()

    def _write_postings(self, rows: DataFrame, n: int, name: str) -> int:
        buckets = min(MOST_BUCKETS, 1 << max(4, (n // BUCKET_ROWS).bit_length()))
        # One shuffle: by folder of grams and range of blocks, so that a frequent gram is never one task's.
        packed = _texts(rows).mapInPandas(_to_lists(buckets), _CHUNK).repartition("bucket", "range")
        lists = packed.groupBy("bucket", "range", "block").applyInPandas(_join_lists, _POSTINGS)
        lists.sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{self.root}/{name}")
        return buckets

    def merge(self) -> None:
        """Write all generations but the largest as one, without rows that are gone, and forget these. Numbers stay."""
        state = self.state()
        small = sorted(state["generations"], key=lambda g: g["n"])[:-1]
        if len(small) < 2:
            return
        g, name = state["next"], uuid.uuid4().hex[:8]
        names = {k: f"{k}-{g}-{name}" for k in ("rows", "postings", "dead")}
        alive = self._alive(self._read([x["rows"] for x in small]), state)
        alive.write.parquet(f"{self.root}/{names['rows']}")
        n, total = self._read([names["rows"]]).agg(F.count(F.lit(1)), F.sum("_len")).first()
        new = dict(state, version=state["version"] + 1, next=g + 1, generations=[x for x in state["generations"] if x not in small])
        if n:
            buckets = max(x["buckets"] for x in small)
            self._merge_postings(small, state, buckets, names["postings"])
            new["generations"].append({"gen": g, "rows": names["rows"], "postings": names["postings"], "buckets": buckets, "n": n, "length": total})
        new |= {"dead": [], "dead_rows": 0, "dead_length": 0}
        if state["dead"]:
            kept = [x for x in state["generations"] if x not in small]
            left = self._read(state["dead"]).join(self._read([x["rows"] for x in kept]).select("n"), "n", "left_semi")
            left.write.parquet(f"{self.root}/{names['dead']}")
            d, length = self._read([names["dead"]]).agg(F.count(F.lit(1)), F.coalesce(F.sum("_len"), F.lit(0))).first()
            new |= {"dead": [names["dead"]] if d else [], "dead_rows": d, "dead_length": length}
        sinks.write_pointer(self.spark, self.root, new, state["version"])

    def _merge_postings(self, small: list[dict], state: dict, buckets: int, name: str) -> None:
        lists = self._read([x["postings"] for x in small]).select("gram", "block", "n_docs", "docs", "places")
        if state["dead"]:
            # A block's removed rows are one bit each.
            bits = F.substring(F.bitmap_construct_agg(F.col("n") % (1 << BLOCK_BITS)), 1, 1 << BLOCK_BITS - 3)
            gone = self._read(state["dead"]).groupBy(F.shiftright("n", BLOCK_BITS).alias("block")).agg(bits.alias("gone"))
            few = state["dead_rows"] <= BROADCAST_BLOCKS or gone.count() <= BROADCAST_BLOCKS
            lists = lists.join(F.broadcast(gone) if few else gone, "block", "left")
        else:
            lists = lists.withColumn("gone", F.lit(None).cast("binary"))

        def clean(it):
            for pdf in it:
                size = np.cumsum(pdf["places"].str.len().to_numpy(np.int64)) // CLEAN_BYTES
                for _, own in pdf.groupby(size, sort=False):
                    own = _without_gone(own.reset_index(drop=True))
                    yield own.assign(bucket=p.bucket_of(own["gram"].to_numpy(np.int64), buckets))[["bucket", "gram", "block", "n_docs", "docs", "places"]]

        cleaned = lists.mapInPandas(clean, _POSTINGS).repartition("bucket", F.shiftright("block", BLOCK_BITS))
        cleaned.sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{self.root}/{name}")

    def vacuum(self) -> list[str]:
        """Delete what no longer belongs to the generations in force; no search or update may be under way."""
        state = self.state()
        used = {*state["dead"], *(x[k] for x in state["generations"] for k in ("rows", "postings"))}
        old = sorted(n for n in sinks.folders(self.spark, self.root) if n not in used)
        for n in old:
            sinks.delete_folder(self.spark, f"{self.root}/{n}")
        return old

    # -------------------------------------------------------------- searches
    def postings(self, grams: list[int]) -> DataFrame:
        """Lists of some grams: folders and row groups that have none of them are not read."""
        frames = []
        for g in self.state()["generations"]:
            buckets = np.unique(p.bucket_of(np.array(grams, np.int64), g["buckets"])).tolist()
            own = self.spark.read.parquet(f"{self.root}/{g['postings']}").where(F.col("bucket").isin(buckets))
            frames.append(own.where(reduce(lambda a, b: a | b, (F.col("gram") == x for x in grams))).select("gram", "block", "n_docs", "docs", "places"))
        return reduce(DataFrame.unionByName, frames)

    def counts(self, terms: list[str]) -> DataFrame:
        """(n, _tf0, _tf1, ...): how often each term stands in the rows that have one of them at least."""
        if not supports_trigrams(terms):
            raise ValueError("terms of fewer than three characters have no grams")
        terms = [t.lower() for t in terms]
        grams = sorted({g for t in terms for g, _ in p.cover(t)})
        shape = ", ".join(["n long", *(f"_tf{k} long" for k in range(len(terms)))])
        group = F.shiftright("block", GROUP_BITS).alias("group")
        found = self.postings(grams).groupBy(group).applyInPandas(_find(terms), shape)
        return self._alive(found, self.state())

    def totals(self) -> tuple[int, float]:
        """How many rows are in force, and their mean length in grams."""
        state = self.state()
        n = sum(g["n"] for g in state["generations"]) - state["dead_rows"]
        return n, (sum(g["length"] for g in state["generations"]) - state["dead_length"]) / max(n, 1)

    def matched(self, o: s.Options, columns: list[str]) -> DataFrame:
        """Columns of the rows that the options' filters leave and that hold every term, with _len and frequencies. Neither texts nor other rows' frequencies are read."""
        found = self.counts(o.terms)
        for k in range(len(o.terms)):
            found = found.where(F.col(f"_tf{k}") > 0)
        own = s.eligible(self.rows(), o).select("n", *columns, "_len")
        return own.join(found, "n")

    def text_branch(self, o: s.Options, depth: int) -> DataFrame:
        """(id, rank, score) as ``search.text_branch`` gives it."""
        if not supports_trigrams(o.terms):
            return s.text_branch(self.rows(), o, depth)
        n, mean = self.totals()
        frequencies = self.counts(o.terms).agg(*(F.count_if(F.col(f"_tf{k}") > 0).alias(f"_df{k}") for k in range(len(o.terms))))
        totals = frequencies.withColumns({"_n": F.lit(n), "_avg": F.lit(float(mean))})
        rows = s.bm25_scores(self.matched(o, ["id", "timestamp_ns"]), totals, len(o.terms))
        return s.ranked(rows.select("id", "timestamp_ns", "score"), [F.desc("score"), F.desc("timestamp_ns"), F.asc("id")], depth).select("id", "rank", "score")

    def matching_ids(self, o: s.Options) -> DataFrame:
        """(id) of all rows that the filters leave and that hold every term."""
        if not supports_trigrams(o.terms):
            return s.eligible(self.rows(), o).where(s.matches(o.terms)).select("id")
        return self.matched(o, ["id"]).select("id")
