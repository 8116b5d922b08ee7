"""Best-fit packing of tokenised documents with certified bounds.

Documents are tokenised once, where they are read; only (document, piece, length)
goes on. Pieces are dealt to partitions of bounded size and packed there by
best-fit decreasing. Dual feasible functions give a lower bound on the bins of
each partition: one that meets its bound is final, unless a whole bin's worth of
space is free in it, which other partitions' pieces may fill. All others give
up the pieces of all bins that are not full; these pieces meet in fewer, newly
dealt partitions and best-fit decreasing runs again, round by round, until all
partitions are certified or a round saves next to nothing.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, id_text, named, stage, unnamed

CAPACITY = 4096
END_ID = 1
#: Pieces that are packed together, at most about; a partition's memory is a few dozen bytes a piece.
PARTITION_PIECES = 20_000
#: Each round's partitions are so many times larger than the last one's, up to so many pieces.
GROWTH, MOST_PIECES = 4, 1_280_000
#: Rounds go on as long as one saves more than this share of the bins that it was given.
LEAST_SAVED = 1 / 10_000
#: Words and parts of words whose ids a worker keeps before it drops those that it has not met lately, about 150 bytes each; twice as many are there at most.
CACHE_WORDS = 400_000

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"

#: How a vocabulary must normalise and split for its words to be looked up one by one.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "<|")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones are themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + n) for n, b in enumerate(others)}}


class _Kept(dict):
    """Values by key, made when they are first asked for. Once there are more than so many, those go that were not asked for since there were so many last time."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key):
        value = self.before.pop(key, None)
        self[key] = value = self.make(key) if value is None else value
        return value

    def shrink(self, most: int) -> None:
        if len(self) > most:
            self.before = {**self}
            super().clear()

    def clear(self) -> None:
        super().clear()
        self.before = {}


class WordTokens:
    """Ids of texts by a tokenizer. Where its vocabulary is byte-level, lower-cases and ends words at white space, ids of words, and of their letters apart from case and the punctuation behind, are kept; plain letters go to the vocabulary's merges directly. Any other one gets whole texts."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.by_word = own.get("normalizer") == WORD_NORMALIZER and own.get("pre_tokenizer") == WORD_SPLITTER and not own.get("truncation") and own["model"].get("end_of_word_suffix") == "</w>"
        self.tokenizer, self.cache_words = Tokenizer.from_file(path), cache_words
        self.merges, self.letters = self.tokenizer.model, _byte_letters()
        self.words = _Kept(self._word)
        del own
        give_back()  # the vocabulary's file, parsed, is larger than what the tokenizer keeps of it

    def _part(self, part: str) -> bytes:
        if _LETTERS.fullmatch(part):
            tokens = self.merges.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))
            ids = [t.id for t in tokens]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if low != word:
            return self.words[low]
        core = low.rstrip(".,!")
        if len(core) < len(low) and _LETTERS.fullmatch(core[-1:]):
            return self.words[core] + self.words[low[len(core) :]]
        return self._part(low)

    def forget(self) -> None:
        self.words.clear()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids. Splitting at white space and before punctuation at a word's end, and lower-casing don't change what the tokenizer gives; texts for which they might are given to it whole."""
        if not self.by_word or any(x in text for x in _ODD) or not unicodedata.is_normalized("NFC", text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        self.words.shrink(self.cache_words)
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_tokens(path: str, cache_words: int = CACHE_WORDS) -> WordTokens:
    """A worker's one tokenizer. What it keeps of a task's words goes at the task's end: small tables are faster than full ones."""
    return WordTokens(path)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): each document's ids and its end, cut into pieces of ``capacity`` ids where it is longer. row numbers the rows of docs."""

    def emit(it):
        tokens = word_tokens(tokenizer_path, cache_words)
        tokens.forget()
        end = np.array([end_id], "<u4").tobytes()
        try:
            for pdf in it:
                out = []
                for i, r, t in zip(pdf["doc_id"], pdf["row"], pdf["text"], strict=True):
                    body = (tokens.ids(t) if t else b"") + end
                    for k, a in enumerate(range(0, len(body), 4 * capacity)):
                        part = body[a : a + 4 * capacity]
                        out.append((i, r, k, a // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(out, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
        finally:
            tokens.forget()
            give_back()

    return unnamed(named(id_text(docs, id_col, text_col)).withColumn("row", F.monotonically_increasing_id()).mapInPandas(emit, PIECES))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of these lengths needs: the best of total size and the dual feasible functions u_k(x) = x if (k+1)x/C is whole, else floor((k+1)x/C) C/k, and f_e (large items count whole, items below e not at all)."""
    x = lengths.astype(np.int64)
    if not len(x):
        return 0
    best = -(-int(x.sum()) // capacity)
    for k in range(1, 12):
        whole = (k + 1) * x % capacity == 0
        twice = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # u_k times k
        best = max(best, -(-int(twice.sum()) // (k * capacity)))
    for e in np.unique(np.minimum(x, capacity // 2))[::-1][:: max(1, len(np.unique(x)) // 200)]:
        u = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int(u.sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; each goes, longest first, to the fullest bin that it fits."""
    bins = np.zeros(len(lengths), np.int64)
    free: list[int] = []  # remaining sizes that open bins have, ascending
    with_free: dict[int, list[int]] = {}
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect_left(free, n)
        if k == len(free):
            b, left = opened, capacity - n
            opened += 1
        else:
            room = free[k]
            b, left = with_free[room].pop(), room - n
            if not with_free[room]:
                del with_free[room], free[k]
        if left:
            if left not in with_free:
                insort(free, left)
                with_free[left] = []
            with_free[left].append(b)
        bins[i] = b
    return bins


PACKED = "row long, piece int, length long, final boolean, part long, bin long, offset long, part_bins long, part_bound long"
PLACED = "row long, piece int, sequence_id long, offset long, part_bins long, part_bound long"


def _pack_parts(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        n, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        final = np.ones(len(bins), bool)
        if n > bound or n * capacity - int(lengths.sum()) >= capacity:
            # All bins but full ones, so that their pieces have room to combine anew.
            final = np.bincount(bins, lengths)[bins] == capacity
        order = np.argsort(bins, kind="stable")
        run = np.cumsum(lengths[order]) - lengths[order]
        at = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = run - np.repeat(run[at], np.diff(np.append(at, len(run))))
        return pdf.assign(final=final, bin=bins, offset=offset, part_bins=n, part_bound=bound)[["row", "piece", "length", "final", "part", "bin", "offset", "part_bins", "part_bound"]]

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, most_pieces: int = MOST_PIECES, least_saved: float = LEAST_SAVED) -> DataFrame:
    """(row, piece, sequence_id, offset, part_bins, part_bound) for pieces (row, piece, length), each of 1 to ``capacity``.

    part_bins and part_bound are the bins of the partition that a piece was
    packed in at last and the least that it needs: equal ones are certified. Only
    the last round leaves others, which is the one after which all pieces met in
    one partition, or that saved no more than ``least_saved`` of its bins.
    """
    todo, done, given, r = pieces.select("row", "piece", "length"), [], None, 0
    while n := todo.count():
        parts = max(1, -(-n // min(partition_pieces * GROWTH**r, most_pieces)))
        part = F.pmod(F.xxhash64("row", "piece", F.lit(r)), F.lit(parts))
        packed = stage(todo.withColumn("part", part).groupBy("part").applyInPandas(_pack_parts(capacity), PACKED), "packed")
        one = packed.groupBy("part").agg(F.first("part_bins").alias("bins"), F.count_distinct(F.when(~F.col("final"), F.col("bin"))).alias("open"))
        bins, opened = one.agg(F.sum("bins"), F.sum("open")).first()
        last = parts == 1 or (given is not None and given - bins <= least_saved * given)
        # Rounds, partitions and bins are told apart in the number of a sequence.
        number = F.lit(r) * F.lit(1 << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin")
        done.append((packed if last else packed.where("final")).select("row", "piece", number.alias("sequence_id"), "offset", "part_bins", "part_bound"))
        if last:
            break
        todo, given, r = packed.where("not final").select("row", "piece", "length"), opened, r + 1
    if not done:
        return pieces.sparkSession.createDataFrame([], PLACED)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, partition_pieces: int = PARTITION_PIECES, cache_words: int = CACHE_WORDS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified (whether its partition has as few bins as any packing needs).

    Null or empty texts are one piece that holds the end id alone. Rows that
    repeat a doc_id, and rows without one, are packed one by one. An empty table
    gives an empty result; other columns are not looked at.
    """
    pieces = stage(tokenised_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, cache_words), "pieces")
    placed = pack_pieces(pieces, capacity, partition_pieces).withColumn("certified", F.col("part_bins") == F.col("part_bound"))
    return pieces.join(placed, ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
