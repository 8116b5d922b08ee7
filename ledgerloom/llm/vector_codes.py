"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Parts fall into coarse grid cells. For a cell's box, an entry whose least
distance is above another one's greatest is dominated: it is nearest to no point
of the box. The entries that are left are kept by cell in a worker's memory, and
only these are evaluated for a part, exactly.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import scaled, within
from .shared import stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components beyond this are refused: squared distances have to fit 64 bits.
MOST = 1 << 27
#: Cells whose entries a worker keeps, for each part; the longest unused ones go.
CELLS = 20_000
#: A cell's sides are the power of two next below so many standard deviations of a part's components.
SIDE = 0.3
#: Cells or parts that are compared with entries at a time.
BATCH = 512
#: Sums by label that are sent to all tasks, at most; beyond that, rows are shuffled by label.
BROADCAST_LABELS = 1_000_000


class Codebook:
    """The entries of one part, and for cells of side ``side`` the entries that may be nearest in them."""

    def __init__(self, entries: np.ndarray, side: int):
        self.entries, self.side = entries, side
        self.kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.evaluated = self.bounded = 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries not dominated across each cell's box, by number; from memory where they are there."""
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.kept]
        fresh = {keys[i]: own for i, own in zip(new, self._undominated(cells[new]), strict=True)}
        out = []
        for k in keys:
            if k in fresh:
                out.append(fresh[k])
                self.kept[k] = fresh[k]
            else:
                out.append(self.kept[k])
                self.kept.move_to_end(k)
        while len(self.kept) > CELLS:
            self.kept.popitem(last=False)
        return out

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries whose least squared distance to a cell's box is not above the least of all entries' greatest ones. Both are sums over components; each side of the boxes is held against the entries once."""
        sides = []
        for d in range(cells.shape[1]):
            at, of = np.unique(cells[:, d], return_inverse=True)
            low, e = (at * self.side)[:, None], self.entries[:, d]
            high = low + self.side - 1
            sides.append((np.maximum(np.maximum(low - e, e - high), 0) ** 2, np.maximum(high - e, e - low) ** 2, of))
        out = []
        for lo in range(0, len(cells), BATCH):
            n = len(cells[lo : lo + BATCH])
            least, most = np.zeros((n, len(self.entries)), np.int64), np.zeros((n, len(self.entries)), np.int64)
            for near, far, of in sides:
                least += near[of[lo : lo + BATCH]]
                most += far[of[lo : lo + BATCH]]
            cell, entry = np.nonzero(least <= most.min(1, keepdims=True))
            out += np.split(entry.astype(np.int32), np.searchsorted(cell, np.arange(1, n)))
        self.bounded += len(cells) * len(self.entries)
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (ties: the lower index) and the squared distance."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        cells, of = np.unique(x // self.side, axis=0, return_inverse=True)
        own = self.candidates(np.ascontiguousarray(cells))
        best, d = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        by = np.argsort(of.ravel(), kind="stable")
        sizes = np.array([len(c) for c in own])
        for lo in range(0, len(by), BATCH):
            rows = by[lo : lo + BATCH]
            n = sizes[of.ravel()[rows]]
            pair = np.concatenate([own[c] for c in of.ravel()[rows]])
            diff = x[np.repeat(rows, n)] - self.entries[pair]
            each = np.einsum("pd,pd->p", diff, diff)
            self.evaluated += len(each)
            first = np.cumsum(n) - n
            d[rows] = np.minimum.reduceat(each, first)
            # Candidates ascend, so that the first one at the least distance is the lowest index.
            hit = np.flatnonzero(each == np.repeat(d[rows], n))
            best[rows] = pair[hit[np.searchsorted(hit, first)]]
        return best, d


class Codebooks:
    """All parts' codebooks as arrays; a worker makes its cells' memory of them."""

    def __init__(self, entries: np.ndarray, sides: list[int]):
        self.entries, self.sides = entries, sides
        self.books: list[Codebook] | None = None

    def __getstate__(self):
        return {"entries": self.entries, "sides": self.sides, "books": None}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) of entries and of distances for rows (rows, parts, components)."""
        if self.books is None:
            self.books = [Codebook(e, s) for e, s in zip(self.entries, self.sides, strict=True)]
        found = [b.nearest(x[:, p]) for p, b in enumerate(self.books)]
        return np.stack([b for b, _ in found], 1), np.stack([d for _, d in found], 1)


def _parts(column: pd.Series, parts: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64).reshape(len(column), parts, -1)


def _moved(vectors: DataFrame, at: Codebooks) -> np.ndarray:
    """The entries after one round. A task gives one row of sums for each used entry; only these are shuffled."""
    sent, shape = vectors.sparkSession.sparkContext.broadcast(at), at.entries.shape

    def add(it):
        sums, n = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for pdf in it:
            if len(pdf):
                x = _parts(pdf["x"], shape[0])
                best, _ = sent.value.nearest(x)
                for p in range(shape[0]):
                    np.add.at(sums[p], best[:, p], x[:, p])
                    n[p] += np.bincount(best[:, p], minlength=shape[1])
        part, entry = np.nonzero(n)
        if len(part):
            yield pd.DataFrame({"part": part, "entry": entry, "n": n[part, entry], "sums": [*sums[part, entry]]})

    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(shape[2])]
    out = at.entries.copy()
    for r in vectors.select("x").mapInPandas(add, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(shape[2])]
    return out


def _sides(vectors: DataFrame, parts: int, size: int) -> list[int]:
    """A power of two for each part's cells, from the spread of its components over all vectors."""
    if not size:
        return [1] * parts
    own = lambda p: F.slice("x", p * size + 1, size)
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    r = vectors.agg(F.count("*").alias("n"), *(F.sum(add(own(p), lambda x: x)).alias(f"s{p}") for p in range(parts)), *(F.sum(add(own(p), lambda x: x * x)).alias(f"q{p}") for p in range(parts))).first()
    count = r["n"] * size
    spread = [max(r[f"q{p}"] / count - (r[f"s{p}"] / count) ** 2, 0.0) ** 0.5 for p in range(parts)]
    return [1 << max(int(SIDE * s).bit_length() - 1, 0) for s in spread]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for each kept vector, and the codebooks (part, entry, component).

    Dropped are null vectors, those with a component that is null or not finite,
    and those of another length than most kept ones have (ties: the longer) or
    than ``parts`` divides. Each component x is floor(scale * x). Codebooks start
    as the parts of the ``entries`` smallest vec_ids (rows that repeat one come by
    their vectors; rows without vec_id start none, but are coded). Each round
    moves every entry to floor(sum / count) of its parts; unused ones stay. Ties
    go to the lower index. Null labels count as one label. Without a kept vector
    that has a vec_id the result is empty. Components beyond ``MOST`` after
    scaling fail the job. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), scaled(F.col(vector_col), scale).alias("x")).where("x is not null")
    kept = stage(within(kept, "x", MOST), "scaled")
    lengths = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = lengths["n"] // parts if lengths else 0
    kept = kept.where((F.size("x") == F.lit(size * parts)) if lengths and lengths["n"] % parts == 0 else F.lit(False))
    first = kept.where("vec_id is not null").orderBy("vec_id", "x").limit(entries).collect()
    shape = kept.select("vec_id", "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256")).schema
    if not first:
        return spark.createDataFrame([], shape), np.zeros((parts, 0, size), np.int64)
    start = np.array([r["x"] for r in first]).astype(np.int64).reshape(len(first), parts, size)
    sides = _sides(kept, parts, size)
    at = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)), sides)
    for _ in range(rounds if size else 0):
        at = Codebooks(_moved(kept, at), sides)
    sent = spark.sparkContext.broadcast(at)


    def code(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in it:
            best, d = sent.value.nearest(_parts(x, parts)) if len(x) else (np.zeros((0, parts), int), np.zeros((0, parts), int))
            yield pd.DataFrame({"code": ["".join(f"{b:02x}" for b in r) for r in best.tolist()], "error": d.sum(1)})

    made = F.pandas_udf(code, "code string, error long").asNondeterministic()(F.col("x"))
    coded = stage(kept.withColumn("made", made).select("vec_id", "label", "made.code", "made.error"), "coded")
    told = hashlib.sha256(",".join(map(str, at.entries.ravel().tolist())).encode()).hexdigest()
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(told)), at.entries


def with_label_errors(coded: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """(vec_id, label, code, error) with label_error, the error summed over rows of equal label. Sums of up to ``broadcast_labels`` labels go to all tasks; beyond that Spark joins by label and splits frequent ones."""
    sums = stage(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    few = sums.count() <= broadcast_labels
    joined = coded.join(F.broadcast(sums) if few else sums.hint("merge"), F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error")
