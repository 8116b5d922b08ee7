"""Token counts by a two-tier lookup in the tasks; no pre-token is ever shuffled.

Texts are cut into pre-tokens (what the tokenizer's own pattern gives) as arrays.
The first tier is a compact hash table of frequent pre-tokens' token counts,
which every task gets: fingerprints and one byte each, 2.3 MB at most. The
second is each worker's cache of the other pre-tokens; what is new to it goes to
the tokenizer, once. Both tiers only save work: counts don't depend on what they
hold.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK_CHARS, _powers, chunks, mix64, pack, unpack

#: Pre-tokens in the table, at most.
FREQUENT = 1 << 16
#: Slots of the table; a quarter is used at most.
SLOTS = 1 << 18
#: The sample that the table is made from: files, and characters of each task that reads them.
SAMPLE_FILES, SAMPLE_CHARS = 32, 8_000_000
#: Pre-tokens that a task of the sample reports, at most (17 bytes each).
REPORTED = 1 << 15
#: Pre-tokens that a worker keeps, of up to LONG characters; beyond that the older half goes.
CACHE = 200_000
LONG = 512

#: How a vocabulary must normalise and split for its pre-tokens to be found here.
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: The code points that are white space to that pattern, and the endings that it takes off behind an apostrophe.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

OTHER, LETTER, NUMBER, SPACE, EDGE, ODD = range(6)
_EDGE = 0x110000
_POWERS = _powers(0x9FB21C651E98DF25, LONG)
_CUT = re.compile("(?<=[a-z]) (?=[a-z])")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The pattern's class of each code point. ODD ones became letters or numbers only lately, or are not assigned, so that libraries may differ; texts that have them go to the tokenizer whole."""
    kinds = {"L": LETTER, "N": NUMBER}
    now = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(_EDGE)), np.uint8, _EDGE)
    before = np.fromiter((kinds.get(unicodedata.ucd_3_2_0.category(chr(i))[0], OTHER) for i in range(_EDGE)), np.uint8, _EDGE)
    unassigned = np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(_EDGE)), bool, _EDGE)
    out = np.append(np.where((now != before) | unassigned, ODD, now), EDGE).astype(np.uint8)
    out[WHITE] = SPACE
    return out


class PreTokens:
    """The pre-tokens of some texts without ODD code points: ``starts`` and ``ends`` (code points of ``joined``), ``of`` (the text), ``hashes``."""

    def __init__(self, texts: list[str]):
        self.joined = "\n".join(["", *texts, ""])
        code = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        code[edges] = _EDGE
        kind = classes()[code]
        start = np.ones(len(code), bool)
        start[1:] = kind[1:] != kind[:-1]
        start[edges] = True
        # White space before something else gives up its last character, which goes with what follows if it is a space.
        space, other = kind == SPACE, kind < SPACE
        last = np.flatnonzero(space[:-1] & other[1:])
        start[last] = True
        start[last + 1] = code[last] != 32
        self._endings(code, kind, start)
        at = np.flatnonzero(start)
        own = kind[at] != EDGE
        self.starts, self.ends = at[own], np.append(at[1:], len(code))[own]
        self.of = np.searchsorted(edges, self.starts, "right") - 1
        self.hashes = self._hash(code, at, own)

    @staticmethod
    def _endings(code: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """An apostrophe that begins a pre-token, alone before letters, takes the endings of contractions."""
        mark = np.flatnonzero((code[1:-2] == 39) & start[1:-2] & (kind[2:-1] == LETTER)) + 1
        one = np.isin(code[mark + 1], [ord(c) for c in ONE_LETTER])
        two = np.zeros(len(mark), bool)
        for a, b in TWO_LETTERS:
            two |= (code[mark + 1] == ord(a)) & (code[mark + 2] == ord(b))
        for found, n in ((mark[one], 1), (mark[two & ~one], 2)):
            start[found + 1] = False
            start[found + 1 + n] |= kind[found + 1 + n] == LETTER

    @staticmethod
    def _hash(code: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        lens = np.diff(at, append=len(code))
        place = np.arange(len(code)) - np.repeat(at, lens)
        h = np.add.reduceat(mix64(code.astype(np.uint64), 21) * _POWERS[place % LONG], at)
        return mix64(h ^ lens.astype(np.uint64), 22)[own]


class Table:
    """Token counts of frequent pre-tokens by fingerprint: open addressing, looked up for arrays."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, slots: int = SLOTS):
        self.keys, self.counts, self.probes = np.zeros(slots, np.uint64), np.zeros(slots, np.uint8), 0
        for h, n in zip(hashes.tolist(), counts.tolist(), strict=True):
            at, probes = h % slots, 1
            while self.counts[at]:
                at, probes = (at + 1) % slots, probes + 1
            self.keys[at], self.counts[at] = h, n
            self.probes = max(self.probes, probes)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The counts; 0 where a fingerprint is not in the table."""
        at = (h % np.uint64(len(self.keys))).astype(np.int64)
        out = np.where(self.keys[at] == h, self.counts[at], 0).astype(np.int64)
        left = np.flatnonzero((out == 0) & (self.counts[at] > 0))
        for _ in range(1, self.probes):
            at[left] = (at[left] + 1) % len(self.keys)
            out[left] = np.where(self.keys[at[left]] == h[left], self.counts[at[left]], 0)
            left = left[(out[left] == 0) & (self.counts[at[left]] > 0)]
        return out


class Tokens:
    """A vocabulary's token counts of texts, without begin, end or other added special tokens; special strings in texts are found as its library does by default."""

    def __init__(self, path: str):
        self.cache: dict[str, int] = {}
        self.by_pretoken, self.special = False, None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.encode: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        self.encode = lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        added = said["added_tokens"]
        plain = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in added)
        self.by_pretoken = said["normalizer"] is None and said["pre_tokenizer"] == SPLITTER and said["post_processor"] is None and said["model"]["type"] == "BPE" and not said["model"]["dropout"] and plain
        if added:
            self.special = re.compile("|".join(re.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"]))))

    def parts(self, texts: list[str]) -> tuple[list[str], list[int], list[int]]:
        """What lies between special strings, in parts of bounded length (cut between two words), the text of each, and how many special strings each text has."""
        out, of, specials = [], [], []
        for i, t in enumerate(texts):
            between = self.special.split(t) if self.special else [t]
            specials.append(len(between) - 1)
            for b in between:
                lo = 0
                while len(b) - lo > CHUNK_CHARS and (cut := _CUT.search(b, lo + CHUNK_CHARS)):
                    out.append(b[lo : cut.start()])
                    lo = cut.start()
                out.append(b[lo:])
            of += [i] * (len(out) - len(of))
        return out, of, specials

    def misses(self, words: list[str]) -> list[int]:
        """Counts of pre-tokens, from this worker's cache where it has them."""
        new = [*dict.fromkeys(w for w in words if w not in self.cache)]
        fresh = dict(zip(new, self.encode(new), strict=True)) if new else {}
        out = [fresh[w] if w in fresh else self.cache[w] for w in words]
        self.cache |= {w: n for w, n in fresh.items() if len(w) <= LONG}
        if len(self.cache) > CACHE:
            for w in [*islice(self.cache, len(self.cache) - CACHE // 2)]:
                del self.cache[w]
        return out

    def counts(self, texts: list[str | None], table: Table) -> np.ndarray:
        out, whole, usual = np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            if t:
                (usual if self.by_pretoken and usual_text(t) else whole).append(i)
        if whole:
            out[whole] = self.encode([texts[i] for i in whole])
        if usual:
            parts, of, specials = self.parts([texts[i] for i in usual])
            own = np.array(specials, np.int64)
            for lo, hi in _ranges(parts):
                pre = PreTokens(parts[lo:hi])
                n = table.get(pre.hashes)
                n[pre.ends - pre.starts > LONG] = 0
                miss = np.flatnonzero(n == 0)
                n[miss] = self.misses([pre.joined[a:z] for a, z in zip(pre.starts[miss].tolist(), pre.ends[miss].tolist(), strict=True)])
                np.add.at(own, np.array(of[lo:hi])[pre.of], n)
            out[usual] = own
        return out


def _ranges(parts: list[str]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, p in enumerate(parts):
        if i > lo and total + len(p) > CHUNK_CHARS:
            yield lo, i
            lo, total = i, 0
        total += len(p)
    if lo < len(parts):
        yield lo, len(parts)


def usual_text(text: str) -> bool:
    """Whether a text has no ODD code points."""
    return text.isascii() or not (classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == ODD).any()


@lru_cache(maxsize=2)
def worker_tokens(path: str) -> Tokens:
    return Tokens(path)


def few_files(docs: DataFrame, files: int = SAMPLE_FILES) -> DataFrame:
    """``docs``, as read from Parquet, or of more than ``files`` files so many, evenly spread by name."""
    names = sorted(docs.inputFiles())
    if len(names) <= files:
        return docs
    return docs.sparkSession.read.schema(docs.schema).parquet(*(names[i * len(names) // files] for i in range(files)))


def learn_table(sample: DataFrame, path: str, text_col: str = "text", most: int = FREQUENT) -> Table:
    """The table of the ``most`` pre-tokens that a sample has most often. Each of SAMPLE_FILES tasks at most reads up to SAMPLE_CHARS and reports REPORTED pre-tokens in one packed row, so that the driver merges 17 MB at most."""

    def count(it):
        tokens, left, found = worker_tokens(path), SAMPLE_CHARS, []
        for pdf in it:
            texts = [t for t in pdf["text"] if tokens.by_pretoken and t and usual_text(t)]
            for lo, hi in chunks(texts):
                if left <= 0:
                    break
                parts, _, _ = tokens.parts(texts[lo:hi])
                left -= sum(map(len, parts))
                for a, z in _ranges(parts):
                    pre = PreTokens(parts[a:z])
                    short = np.flatnonzero(pre.ends - pre.starts <= LONG)
                    h, first, n = np.unique(pre.hashes[short], return_index=True, return_counts=True)
                    own = tokens.misses([pre.joined[pre.starts[k] : pre.ends[k]] for k in short[first]])
                    found.append((h, n, np.array(own, np.int64)))
            if left <= 0:
                break
        if found:
            h, n, own = (np.concatenate(x) for x in zip(*found, strict=True))
            h, n, own = _summed(h, n, own, REPORTED)
            yield pd.DataFrame({"hashes": [pack(h)], "n": [pack(n)], "tokens": [pack(own)]})

    rows = sample.select(F.col(text_col).cast("string").alias("text")).coalesce(SAMPLE_FILES).mapInPandas(count, "hashes binary, n binary, tokens binary").collect()
    got = [(unpack(bytes(r["hashes"]), np.uint64), unpack(bytes(r["n"]), np.int64), unpack(bytes(r["tokens"]), np.int64)) for r in rows]
    if not got:
        return Table(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h, _, own = _summed(*(np.concatenate(x) for x in zip(*got, strict=True)), most)
    return Table(h, own)


def _summed(h: np.ndarray, n: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` most frequent fingerprints (ties: the smaller) whose token count fits a byte."""
    h, first, back = np.unique(h, return_index=True, return_inverse=True)
    n, own = np.bincount(back, n, len(h)).astype(np.int64), own[first]
    best = np.argsort(-n, kind="stable")
    best = best[own[best] < 256][:most]
    return h[best], n[best], own[best]


def count_tokens(docs: DataFrame, path: str, table: Table, text_col: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with one struct column more, ``token_count``: n_bytes (of UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null and empty texts have 0 of both. Rows are counted one by one, also such
    that repeat a doc_id or have none; other columns pass through, and a column of
    the name ``token_count`` is replaced. An empty table gives an empty result.
    Vocabularies that split otherwise than SPLITTER get whole texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def look(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = worker_tokens(path)
        for text in it:
            texts = text.to_list()
            yield pd.Series(np.concatenate([np.zeros(0, np.int64), *(tokens.counts(texts[lo:hi], sent.value) for lo, hi in chunks(texts))]))

    text = F.col(text_col).cast("string")
    # Said to be nondeterministic, so that it isn't computed once for each field.
    n = F.pandas_udf(look, "long").asNondeterministic()(text)
    counted = docs.drop("token_count").withColumn("token_count", n)
    bytes_ = F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
    return counted.withColumn("token_count", F.struct(bytes_.alias("n_bytes"), F.col("token_count").alias("n_tokens"), (F.col("token_count") > limit).alias("over_limit")))
