"""Benchmark decontamination with a distributed positional inverted index.

Index rows are postings of a block of whole training documents: its sorted
distinct terms and, for each term, the places where it stands. Blocks are
independent, so that building and searching need no shuffle and no group of
documents can grow hot. A search sends phrases to all blocks in batches of
bounded size; in each block a phrase's offset-adjusted lists are intersected
from the rarest term on, and a phrase ends as soon as nothing is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, Words, chunks, give_back, id_text, pack, stage, unpack

WINDOW = 10
#: Characters of text in a block of the index, about.
BLOCK_CHARS = 1_000_000
#: Words of benchmark items that are sent to all tasks at a time (8 bytes each).
BATCH_WORDS = 500_000
INDEX_SCHEMA = "block string, doc_ids array<long>, firsts binary, terms binary, bounds binary, places binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of all words of all texts, staged in the shared folder: a row for each block of about 1M characters.

    firsts: each document's first word in the block; terms: sorted distinct
    64-bit word hashes; bounds: each term's first entry in places; places: word
    positions in the block, ascending for each term.
    """

    def index(it):
        for pdf in it:
            ids, texts = pdf["doc_id"].to_list(), pdf["text"].to_list()
            for lo, hi in chunks(texts, BLOCK_CHARS):
                w = Words(texts[lo:hi], ALNUM, lower=True)
                order = np.argsort(w.hashes, kind="stable").astype(np.uint32)
                terms, bounds = np.unique(w.hashes[order], return_index=True)
                named = [None if pd.isna(i) else int(i) for i in ids[lo:hi]]
                yield pd.DataFrame([(uuid.uuid4().hex, named, pack(w.first.astype(np.uint32)), pack(terms), pack(bounds.astype(np.uint32)), pack(order))], columns=["block", "doc_ids", "firsts", "terms", "bounds", "places"])

    return stage(id_text(docs, id_col, text_col).mapInPandas(index, INDEX_SCHEMA), "postings")


def phrases(items: list[tuple], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all items in a row, and of each window its first word and its item. A shorter item is one window; one without words has none."""
    w = Words([t for _, t in items], ALNUM, lower=True)
    starts, of = [], []
    for i, (a, n) in enumerate(zip(w.first, w.counts(), strict=False)):
        if n:
            starts += range(a, a + max(n - window, 0) + 1)
            of += [i] * (max(n - window, 0) + 1)
    return w.hashes, np.array(starts, np.int64), np.array(of, np.int64)


def _batches(items: DataFrame, item_col: str, text_col: str, most_words: int) -> Iterator[list[tuple]]:
    """Benchmark items in batches of bounded size; the whole table is never on the driver."""
    batch, size = [], 0
    for r in items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        n = len(r["t"] or "") // 2 + 1
        if batch and size + n > most_words:
            yield batch
            batch, size = [], 0
        batch.append((r["i"], r["t"]))
        size += n
    if batch:
        yield batch


class _Block:
    """One index row, opened."""

    def __init__(self, row):
        self.ids = row.doc_ids
        self.firsts = unpack(row.firsts, np.uint32).astype(np.int64)
        self.terms, self.bounds, self.places = unpack(row.terms, np.uint64), unpack(row.bounds, np.uint32).astype(np.int64), unpack(row.places, np.uint32)
        self.bounds = np.append(self.bounds, len(self.places))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's term, and how often it stands in the block (0: never)."""
        if not len(self.terms):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return at, np.where(self.terms[at] == hashes, self.bounds[at + 1] - self.bounds[at], 0)

    def list_of(self, term: int) -> np.ndarray:
        return self.places[self.bounds[term] : self.bounds[term + 1]].astype(np.int64)

    def match(self, terms: np.ndarray, often: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and places of a phrase's first word. With slop, each term may stand in the document so many words from its place beside the rarest one; the first place may then lie outside of it."""
        order = np.argsort(often, kind="stable")
        rarest = self.list_of(terms[order[0]])
        doc = np.searchsorted(self.firsts, rarest, "right") - 1
        for j in order[1:]:
            if not len(rarest):
                break
            p, due = self.list_of(terms[j]), rarest + (j - order[0])
            k = np.searchsorted(p, np.maximum(due - slop, self.firsts[doc]))
            found = p[np.minimum(k, len(p) - 1)]
            keep = (k < len(p)) & (found <= due + slop) & (found < self.firsts[doc + 1])
            rarest, doc = rarest[keep], doc[keep]
        return doc, rarest - order[0]


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 0, batch_words: int = BATCH_WORDS) -> Iterator[DataFrame]:
    """For each batch of items, rows for documents of the index: block, place (in the block), doc_id, n_words, item_ids that match, and hits. The first batch has a row for every document, later ones for those that they hit.

    hits has first and last word (exclusive) of merged stretches that matched
    phrases cover. slop 0 asks for exact phrases; above 0 it asks for proximity
    matches: each term stands in the document, at most so many words from its
    place in the phrase, seen from the phrase's rarest term; the stretch is the
    phrase's own length from there, as far as the document goes.
    """
    spark = index.sparkSession
    for number, batch in enumerate(_batches(items, item_col, text_col, batch_words)):
        hashes, starts, of = phrases(batch, window)
        n_of = Words([t for _, t in batch], ALNUM, lower=True).counts()
        sent = spark.sparkContext.broadcast((hashes, starts, of, np.minimum(n_of[of], window) if len(of) else of, [i for i, _ in batch]))

        def look(it, sent=sent, every=number == 0):
            hashes, starts, of, length, names = sent.value
            for pdf in it:
                for row in pdf.itertuples(index=False):
                    b = _Block(row)
                    at, often = b.find(hashes)
                    missing = np.concatenate([[0], np.cumsum(often == 0)])
                    whole = np.flatnonzero(missing[starts + length] == missing[starts])
                    n = len(b.ids)
                    items_of, cover = [set() for _ in range(n)], np.zeros(int(b.firsts[-1]) + 1, np.int64)
                    for p in whole:
                        d, found = b.match(at[(a := starts[p]) : a + length[p]], often[a : a + length[p]], slop)
                        for x in np.unique(d):
                            items_of[x].add(names[of[p]])
                        np.add.at(cover, np.maximum(found, b.firsts[d]), 1)
                        np.add.at(cover, np.minimum(found + length[p], b.firsts[d + 1]), -1)
                    hit = np.cumsum(cover)[:-1] > 0
                    edge = np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
                    # A stretch that runs on from one document to the next is cut there.
                    cut = b.firsts[1:-1][(b.firsts[1:-1] > 0) & (b.firsts[1:-1] < len(hit))]
                    cut = np.unique(cut[hit[cut] & hit[cut - 1]]) if len(cut) else cut
                    begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
                    end = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
                    d = np.searchsorted(b.firsts, begin, "right") - 1
                    hits: list[list] = [[] for _ in range(n)]
                    for x, a, z in zip(d, begin, end, strict=True):
                        hits[x].append({"first": int(a - b.firsts[x]), "last": int(z - b.firsts[x])})
                    out = pd.DataFrame({"block": row.block, "place": np.arange(n), "doc_id": pd.array([None if pd.isna(i) else int(i) for i in b.ids], "Int64"), "n_words": np.diff(b.firsts), "item_ids": [sorted(s) for s in items_of], "hits": hits})
                    yield out if every else out[[bool(s) for s in items_of]]
                give_back()

        yield index.mapInPandas(look, "block string, place int, doc_id long, n_words long, item_ids array<string>, hits array<struct<first:long,last:long>>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0, batch_words: int = BATCH_WORDS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit (words that some matched window covers), item_ids (sorted), hits.

    A window is ``window`` consecutive words of an item; a shorter item is one
    window, one without words (or null) has none. Null or empty text has no
    words and no hits. Rows that repeat a doc_id or have none are looked at one
    by one, as are items that repeat an item_id. Empty tables are allowed on
    either side; other columns are not looked at.
    """
    index = build_index(docs, id_col, text_col)
    found = list(search(index, items, item_col, item_text_col, window, slop, batch_words)) or [index.select("block", F.posexplode("doc_ids").alias("place", "doc_id"), "firsts").mapInPandas(_unhit, "block string, place int, doc_id long, n_words long, item_ids array<string>, hits array<struct<first:long,last:long>>")]
    if len(found) == 1:
        out = found[0]
    else:
        both = found[0]
        for x in found[1:]:
            both = both.unionByName(x)
        # A row for each document, and one more for each further batch that hits it.
        out = both.groupBy("block", "place", "doc_id").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.flatten(F.collect_list("hits")).alias("hits"))
        out = out.withColumn("hits", _merged("hits"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["last"] - h["first"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids", "hits")


def _merged(column: str):
    """Stretches that overlap or touch, joined."""
    empty = F.expr("cast(array() as array<struct<first:long,last:long>>)")

    def add(acc, h):
        tail = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(tail["first"].alias("first"), F.greatest(tail["last"], h["last"]).alias("last"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= h["first"]), joined).otherwise(F.concat(acc, F.array(h)))

    return F.aggregate(F.array_sort(column), empty, add)


def _unhit(it):
    for pdf in it:
        n = [int(np.diff(unpack(f, np.uint32).astype(np.int64))[p]) for f, p in zip(pdf["firsts"], pdf["place"], strict=True)]
        yield pdf[["block", "place", "doc_id"]].assign(n_words=n, item_ids=[[] for _ in n], hits=[[] for _ in n])
