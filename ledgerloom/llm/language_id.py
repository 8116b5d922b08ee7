"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (of 1 to 3 letters,
words padded by a space), in order. A document's own most frequent n-grams are
ranked the same way; its distance to a profile is the sum over them of how far
each is out of place, or the profile's length where the profile lacks it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks

PROFILE = 300
UNKNOWN = "und"
#: Languages at most; their profiles go to all tasks, 2,400 bytes each. A column with more names is refused.
MOST_LANGUAGES = 10_000
#: The threshold of a score is fitted so that this share of held-out documents is lost.
LOST_SHARE = 0.001
#: Characters whose n-grams are made at a time: some 200 bytes of arrays each, and no slower than more of them.
CHARS = 100_000
_TABLE: list[np.ndarray] = []


def letters_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def doc_grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) by text and n-gram.

    Texts are lower-cased and everything but letters separates words. An n-gram
    is its code points as digits of base 2**16 (code points beyond that base are
    folded into it); 0 stands for the space beside a word.
    """
    lowered = [t.lower() if t else "" for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters_table()[points], points, 0)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lowered])
    c = (points & 0xFFFF).astype(np.uint64)
    inside = points[1:] > 0
    a, mid, z = c[:-2], c[1:-1], c[2:]
    own, here = inside[:-1], of[: len(c) - 2]
    pad = ~own & (a > 0)  # the space that ends a word
    bits = np.uint64(16)
    parts = [
        (mid[own], here[own]),  # single letters
        ((a << bits | mid)[own], here[own]),  # pairs, the first with the space before
        ((a << bits)[pad], here[pad]),  # pairs of a last letter and the space
        (((a << bits | mid) << bits | z)[own], here[own]),  # triples around each letter
    ]
    # A code of pairs or triples that begins with a space must not look like a shorter one.
    codes = np.concatenate([parts[0][0], parts[1][0] | np.uint64(1 << 48), parts[2][0] | np.uint64(1 << 48), parts[3][0] | np.uint64(1 << 49)])
    docs = np.concatenate([p[1] for p in parts])
    return _count(codes, docs, len(texts))


def _count(codes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step = 1 << 14  # texts whose number and n-gram fit 64 bits together
    out = []
    for lo in range(0, n, step):
        here = (docs >= lo) & (docs < lo + step) if n > step else slice(None)
        key = np.sort(((docs[here] - lo).astype(np.uint64) << np.uint64(50)) | codes[here])
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        out.append(((key[at] >> np.uint64(50)).astype(np.int64) + lo, key[at] & np.uint64((1 << 50) - 1), np.diff(np.append(at, len(key)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's ``size`` most frequent n-grams over all of ``docs`` whose language is known, by count and then by code. The driver gets ``size`` rows a language, of which MOST_LANGUAGES are allowed."""

    def count(it):
        for pdf in it:
            texts = pdf["text"].to_list()
            langs, names = pd.factorize(pdf["lang"])
            found: list[tuple] = []
            for lo, hi in chunks(texts, CHARS):
                of, gram, n = doc_grams(texts[lo:hi])
                key = langs[lo:hi][of]
                by = np.lexsort((gram, key))
                key, gram, n = key[by], gram[by], n[by]
                at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (gram[1:] != gram[:-1])])) if len(key) else np.zeros(0, np.int64)
                if len(at):
                    found.append((key[at], gram[at], np.add.reduceat(n, at)))
            if found:
                key, gram, n = (np.concatenate(x) for x in zip(*found, strict=True))
                total = pd.DataFrame({"key": key, "gram": gram.view(np.int64), "n": n}).groupby(["key", "gram"], as_index=False)["n"].sum()
                yield pd.DataFrame({"lang": names[total["key"]], "gram": total["gram"], "n": total["n"]})

    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    if (n := known.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages, more than {MOST_LANGUAGES}")
    counts = known.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The best of each part of a language, then the best of these: no task gets a whole language.
    counts = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, np.ndarray] = {}
    rows = best.select("lang", "rank", "gram").collect()
    for lang in sorted({r["lang"] for r in rows}):
        out[lang] = np.array([r["gram"] for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["rank"])], np.int64).view(np.uint64)
    return out


def distances(texts: list, profiles: dict[str, np.ndarray], size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each text to each profile, from 0 to 1 (nothing in common), and whether the text has a letter."""
    of, gram, n = doc_grams(texts)
    most = int(n.max()) if len(n) else 0
    key = (of.astype(np.uint64) << np.uint64(40)) | (np.uint64(most) - n.astype(np.uint64))
    by = np.argsort(key, kind="stable")  # by text, then count, then n-gram
    of, gram = of[by], gram[by]
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    rank = np.arange(len(of)) - first[of]
    keep = rank < size
    of, gram, rank = of[keep], gram[keep], rank[keep]
    total = np.bincount(of, minlength=len(texts))
    out = np.ones((len(texts), len(profiles)))
    for k, profile in enumerate(profiles.values()):
        by = np.argsort(profile)
        at = np.minimum(np.searchsorted(profile[by], gram), len(profile) - 1)
        place = np.where(profile[by][at] == gram, np.abs(by[at] - rank), size)
        out[:, k] = np.bincount(of, np.minimum(place, size), len(texts)) / np.maximum(total * size, 1)
    return out, total > 0


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with one struct column more, ``language_id``: lang (of the nearest profile, the first by name on ties), score (1 less its distance).

    Null texts and those without a letter are ``und`` with score 0, as are all
    texts if there is no profile. Rows are looked at one by one; other columns
    pass through. An empty table gives an empty result. Any column of the name
    ``language_id`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def look(text: pd.Series) -> pd.DataFrame:
        texts, names, out = text.to_list(), np.array([*sent.value], object), []
        for lo, hi in chunks(texts, CHARS):
            if not len(names):
                out += [(UNKNOWN, 0.0)] * (hi - lo)
                continue
            d, some = distances(texts[lo:hi], sent.value, size)
            best = d.argmin(axis=1)
            out += [(names[b], 1 - row[b]) if s else (UNKNOWN, 0.0) for b, row, s in zip(best, d, some, strict=True)]
        return pd.DataFrame(out, columns=["lang", "score"])

    # Said to be nondeterministic, so that filters on the result don't have it computed twice.
    udf = F.pandas_udf(look, "lang string, score double").asNondeterministic()
    return docs.drop("language_id").withColumn("language_id", udf(F.col(text_col).cast("string")))


def fit_threshold(held_out: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang", lost_share: float = LOST_SHARE, size: int = PROFILE) -> float:
    """The score that all but ``lost_share`` of the held-out documents reach whose language is recognised, in hundredths, rounded down; 0 if there are none."""
    own = identify(held_out.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")), profiles, "text", size).where("lang = language_id.lang")
    low = own.agg(F.percentile_approx("language_id.score", lost_share, 100_000).alias("t")).first()["t"]
    return 0.0 if low is None else np.floor(low * 100) / 100
