"""Secret scan: fixed patterns, and formats inferred from what they find.

What the patterns find are labelled credentials. From a bounded sample of each
kind a prefix tree is built over character classes. States are merged where
their frequencies agree within Hoeffding bounds, as do the states below them and
the lengths of what follows. States of equal depth may merge on any evidence,
others (which makes loops) only if both were passed by many strings, so that
formats of fixed length and of fixed places keep them. The result is a
probabilistic automaton of the kind's format. The automaton
of ordinary text has a state for each class, and counts of what follows it in all
candidates of all texts. Candidates are all runs of the labelled credentials' own
alphabet, of their least length and more, outside of what the patterns found.
Each is scored by its likelihood under each format against the ordinary one,
whole, and where that does not do, in the parts between '=' and '.'.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, id_text, stage

KINDS = ("assign", "access", "hex")
FORMAT = "format"
#: Labelled strings of each kind that automata are inferred from at most.
SAMPLE = 1000
ALPHA = 0.05
#: Strings that must have passed two states of different depths before they may be merged.
LEAST_SUPPORT = 30
#: Probability that an automaton leaves for characters that it never saw in a state.
UNSEEN = 0.01
#: A format must be so many times (as a logarithm) likelier than ordinary text.
LEAST_GAIN = 12.0
#: The least length of a labelled credential, and so of a candidate.
CANDIDATE_CHARS = 6

# The three kinds' patterns over UTF-8 bytes of which A-Z are lower-cased for the first.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
COUNTS = "kind int, value string, n long"
SPANS = "doc_id long, spans array<struct<kind:string,start:long,stop:long>>"


def base_spans(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, credential) in bytes, of the fixed patterns."""
    out = [(0, m.start(), m.end(), data[m.start(1) : m.end(1)]) for m in _ASSIGN.finditer(data.lower()) if m.end(1) - m.start(1) >= CANDIDATE_CHARS]
    out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(data)]
    return out + [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(data)]


def classes(value: str) -> str:
    """Each character's class: digits 0, a-f h, other lower case l, A-F H, other upper case U, others themselves."""
    return value.translate(_CLASSES)


_CLASSES = {**{ord(c): "0" for c in "123456789"}, **{ord(c): "h" for c in "abcdef"}, **{c: "l" for c in range(ord("g"), ord("z") + 1)}, **{ord(c): "H" for c in "ABCDEF"}, **{c: "U" for c in range(ord("G"), ord("Z") + 1)}}
_SYMBOL_LIST = "0hlHU+/_-.="
_SYMBOLS = len(_SYMBOL_LIST)
#: For each byte its class, as a byte and as a number; other bytes end a candidate.
_ALPHABET = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-.="
_CLASS_BYTES = bytes(ord(classes(chr(b))) if b in _ALPHABET else 0 for b in range(256))
_CLASS_NUMBERS = np.array([_SYMBOL_LIST.index(chr(c)) if c else _SYMBOLS for c in _CLASS_BYTES], np.uint8)


class Automaton:
    """A probabilistic automaton: for each state, how often it is passed and how often a string ends there, and its transitions with their frequencies."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, least_support: int = LEAST_SUPPORT):
        self.passed, self.ended, self.next = [0], [0], [{}]
        self.depth: list[int] = [0]
        #: How many more characters followed, for each state.
        self.rest: list[Counter[int]] = [Counter()]
        for s in sorted(strings):
            state = 0
            self.passed[0] += 1
            self.rest[0][len(s)] += 1
            for at, c in enumerate(s, 1):
                if c not in self.next[state]:
                    self.next[state][c] = len(self.passed)
                    self.passed.append(0)
                    self.ended.append(0)
                    self.next.append({})
                    self.depth.append(at)
                    self.rest.append(Counter())
                state = self.next[state][c]
                self.passed[state] += 1
                self.rest[state][len(s) - at] += 1
            self.ended[state] += 1
        self.count = [{c: self.passed[t] for c, t in n.items()} for n in self.next]
        self.bound, self.least_support = math.sqrt(0.5 * math.log(2 / alpha)), least_support
        self._merge_states()
        self._memo: dict[str, float] = {}

    @classmethod
    def of_pairs(cls, pairs: dict[str, int]) -> Automaton:
        """A state for each class, from counts of two classes in a row; a blank stands for a string's beginning and its end."""
        self = cls.__new__(cls)
        states = {c: k for k, c in enumerate(" " + _SYMBOL_LIST)}
        self.next = [{c: k for c, k in states.items() if k} for _ in states]
        self.count: list[dict[str, int]] = [{} for _ in states]
        self.ended = [0] * len(states)
        for (a, b), n in pairs.items():
            if b == " ":
                self.ended[states[a]] += n
            else:
                self.count[states[a]][b] = n
        self.passed = [max(e + sum(c.values()), 1) for e, c in zip(self.ended, self.count, strict=True)]
        self.states, self._memo = len(states), {}
        return self

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _lengths_differ(self, a: int, b: int) -> bool:
        """Whether what follows two states differs in length: the largest distance of both distributions against its bound."""
        n, m, x, y, apart = self.passed[a], self.passed[b], 0, 0, 0.0
        for k in sorted({*self.rest[a], *self.rest[b]}):
            x, y = x + self.rest[a][k], y + self.rest[b][k]
            apart = max(apart, abs(x / n - y / m))
        return apart > self.bound * math.sqrt((n + m) / (n * m))

    def _compatible(self, a: int, b: int) -> bool:
        if self.depth[a] != self.depth[b] and min(self.passed[a], self.passed[b]) < self.least_support:
            return False
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.passed[a], self.passed[b]
            if self._differ(self.ended[a], n, self.ended[b], m) or self._lengths_differ(a, b):
                return False
            for c in {*self.count[a], *self.count[b]}:
                if self._differ(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                # What a loop leads back to is compared already.
                if c in self.next[a] and c in self.next[b] and (self.next[a][c], self.next[b][c]) != (a, b):
                    x, y = self.next[a][c], self.next[b][c]
                    if self.passed[y] and self.depth[y] > self.depth[b]:
                        todo.append((x, y))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a tree's frequencies to a state and those it leads to."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            self.rest[a] += self.rest[b]
            for c, t in self.next[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + self.count[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_states(self) -> None:
        kept = [0]
        fringe = [(0, c) for c in sorted(self.next[0])]
        while fringe:
            # Depth by depth, best known first.
            source, c = min(fringe, key=lambda x: (self.depth[self.next[x[0]][x[1]]], -self.count[x[0]][x[1]], x))
            tree = self.next[source][c]
            same = next((k for k in sorted(kept, key=lambda k: (self.depth[k] != self.depth[tree], k)) if self._compatible(k, tree)), None)
            if same is None:
                kept.append(tree)
            else:
                self.next[source][c] = same
                self._fold(same, tree)
            known = {*kept}
            fringe = [(k, x) for k in kept for x in sorted(self.next[k]) if self.next[k][x] not in known]
        self.states = len(kept)

    def log_likelihood(self, s: str) -> float:
        """Of a string of classes. A small share is spread evenly over what a state never saw; such a character leaves the state as it is."""
        if s not in self._memo:
            if len(self._memo) > 100_000:
                self._memo.clear()
            state, total = 0, 0.0
            for c in s:
                total += self._share(state, self.count[state].get(c, 0))
                state = self.next[state].get(c, state)
            total += self._share(state, self.ended[state])
            if len(s) > 100:
                return total
            self._memo[s] = total
        return self._memo[s]

    def _share(self, state: int, seen: int) -> float:
        return math.log((1 - UNSEEN) * seen / self.passed[state] + UNSEEN / (_SYMBOLS + 1))


class Formats:
    """Automata of all kinds and of ordinary tokens, and the least gain for each kind."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: dict[str, int], least_gain: float = LEAST_GAIN, alpha: float = ALPHA):
        self.kinds = {k: Automaton([classes(v) for v in values], alpha) for k, values in labelled.items() if values}
        self.ordinary = Automaton.of_pairs(ordinary) if ordinary else None
        self.least_gain = least_gain
        self._memo: dict[str, float] = {}

    def gain(self, s: str) -> float:
        """Of a string of classes: the logarithm of its likelihood under its likeliest kind over that of ordinary tokens."""
        if (known := self._memo.get(s)) is not None:
            return known
        plain = self.ordinary.log_likelihood(s) if self.ordinary else -(len(s) + 1) * math.log(_SYMBOLS + 1)
        g = max((a.log_likelihood(s) - plain for a in self.kinds.values()), default=-math.inf)
        if len(s) <= 100:
            if len(self._memo) > 100_000:
                self._memo.clear()
            self._memo[s] = g
        return g

    def find(self, s: str, level: int = 0) -> list[tuple[int, int]]:
        """Where a run of classes has credentials: the run (without the dots that end it, if these are unlikely), else parts of it between '=' (those that end a part stay with it), else between dots."""
        if len(s) < CANDIDATE_CHARS:
            return []
        g, stop = self.gain(s), len(s)
        if s[-1] == "." and len(bare := s.rstrip(".")) >= CANDIDATE_CHARS and self.gain(bare) > g:
            g, stop = self.gain(bare), len(bare)
        if g >= self.least_gain:
            return [(0, stop)]
        out = []
        for k in range(level, len(_PARTS)):
            if _PARTS[k].search(s):
                at = 0
                for m in [*_PARTS[k].finditer(s), None]:
                    z = m.start() if m else len(s)
                    out += [(at + a, at + b) for a, b in self.find(s[at:z], k + 1)]
                    at = m.end() if m else z
                break
        return out


#: What parts of a run are separated by, level by level: '=' inside, dots, '=' that pad.
_PARTS = (re.compile(r"^[=.]+|=+(?=[^=.])"), re.compile(r"\.+"), re.compile(r"=+"))


def _runs(texts: list[str]) -> tuple[bytes, np.ndarray, list[list[tuple[int, int, int, bytes]]], np.ndarray, np.ndarray]:
    """Of some texts: their bytes, each text's first one, its base spans (from its own first byte), and the bounds of all candidates."""
    encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b"\n".join([*encoded, b""])
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(e) + 1 for e in encoded], out=begin[1:])
    inside = _CLASS_NUMBERS[np.frombuffer(data, np.uint8)] < _SYMBOLS
    found = [base_spans(e) for e in encoded]
    for at, spans in zip(begin.tolist(), found, strict=False):
        for _, a, z, _ in spans:
            inside[at + a : at + z] = False
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= CANDIDATE_CHARS
    return data, begin, found, first[long], last[long]


def count_labels(docs: DataFrame) -> DataFrame:
    """One pass over all texts (text), staged: kind and value of labelled credentials, and of kind -1 pairs of classes in all candidates; how often each occurs."""

    def look(it):
        width = _SYMBOLS + 1
        pairs, labels = np.zeros(width * width, np.int64), set()
        for pdf in it:
            texts = pdf["text"].to_list()
            for lo, hi in chunks(texts):
                data, _, found, first, last = _runs(texts[lo:hi])
                labels |= {(k, v.decode("ascii")) for spans in found for k, _, _, v in spans}
                if len(labels) > 100_000:
                    yield pd.DataFrame([(k, v, 1) for k, v in labels], columns=["kind", "value", "n"])
                    labels = set()
                c = _CLASS_NUMBERS[np.frombuffer(data, np.uint8)].astype(np.int64)
                inner = np.zeros(len(c) + 1, np.int8)
                inner[first + 1], inner[last] = 1, -1
                at = np.flatnonzero(np.cumsum(inner[:-1], dtype=np.int8))
                pairs += np.bincount(c[at - 1] * width + c[at], minlength=width * width)
                pairs += np.bincount(_SYMBOLS * width + c[first], minlength=width * width)
                pairs += np.bincount(c[last - 1] * width + _SYMBOLS, minlength=width * width)
        name = _SYMBOL_LIST + " "
        rows = [(-1, name[i // width] + name[i % width], int(pairs[i])) for i in np.flatnonzero(pairs)]
        yield pd.DataFrame(rows + [(k, v, 1) for k, v in labels], columns=["kind", "value", "n"])

    counted = docs.select("text").mapInPandas(look, COUNTS)
    return stage(counted.groupBy("kind", "value").agg(F.sum("n").alias("n")), "secret-labels")


def infer_formats(counted: DataFrame, sample: int = SAMPLE, least_gain: float = LEAST_GAIN) -> Formats:
    """Automata of each kind, from its distinct strings with the smallest hashes, and of ordinary text, from all counts."""
    strings = {name: [r["value"] for r in counted.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample).collect()] for k, name in enumerate(KINDS)}
    pairs = {r["value"]: r["n"] for r in counted.where("kind = -1").collect()}  # a cell for each pair of classes
    return Formats(strings, pairs, least_gain)


def _code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    out, before, n = {}, 0, 0
    for x in offsets:
        n += len(data[before:x].decode("utf-8", "surrogatepass"))
        out[x], before = n, x
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least_gain: float = LEAST_GAIN) -> DataFrame:
    """doc_id and spans (kind, start, stop; code points, stop exclusive; by start, then kind) for each row of ``docs``.

    Kinds are ``assign``, ``access`` and ``hex`` (the fixed patterns, leftmost and
    non-overlapping for each) and ``format``: runs of letters, digits and
    ``+/_.=-`` of six characters and more outside of these, or parts of them,
    whose likelihood under some inferred format exceeds that of ordinary tokens
    by ``least_gain``, as a logarithm. Without labelled credentials there are no
    formats. Null and empty texts have no spans. Rows that repeat a doc_id, and
    rows without one, are looked at one by one; an empty table gives an empty
    result; other columns are not looked at.
    """
    thin = id_text(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(infer_formats(count_labels(thin), sample, least_gain))

    def judge(it):
        formats = sent.value
        for pdf in it:
            ids, texts, out = pdf["doc_id"].astype("Int64"), pdf["text"].to_list(), []
            for lo, hi in chunks(texts):
                data, begin, found, first, last = _runs(texts[lo:hi])
                shown = data.translate(_CLASS_BYTES).decode("ascii")
                cut = np.searchsorted(first, begin)
                first, last = first.tolist(), last.tolist()
                for i, (at, end) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    spans = [(a, k, z) for k, a, z, _ in found[i]]
                    if formats.kinds:
                        spans += [(a - at + x, len(KINDS), a - at + y) for a, z in zip(first[cut[i] : cut[i + 1]], last[cut[i] : cut[i + 1]], strict=True) for x, y in formats.find(shown[a:z])]
                    if spans and end - at - 1 != len(texts[lo + i]):
                        points = _code_points(data[at : end - 1], sorted({x for a, _, z in spans for x in (a, z)}))
                        spans = [(points[a], k, points[z]) for a, k, z in spans]
                    out.append([{"kind": (*KINDS, FORMAT)[k], "start": a, "stop": z} for a, k, z in sorted(spans)])
            yield pd.DataFrame({"doc_id": ids, "spans": out})

    return thin.mapInPandas(judge, SPANS)
