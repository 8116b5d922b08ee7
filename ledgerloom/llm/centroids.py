"""Centroid clustering of integer vectors by bit planes.

A vector of 64 components is kept as bit planes: one 64-bit word holds one bit of
all components, in two's complement, so that plane p weighs 2**p and the last one
-2**p. A dot product with a centroid is the weighted sum of the popcounts of the
ANDs of their planes; squared distances follow from it and both norms, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

COMPONENTS = 64
CENTROIDS, ROUNDS, SCALE = 16, 3, 64
#: Scaled components beyond this are refused: squared distances have to fit 64 bits.
MOST = 1 << 27


def scaled(vector: Column, scale: int) -> Column:
    """Whole numbers floor(scale * x), as doubles; null if a component is null or not finite, or if the vector is null."""
    wide = vector.cast("array<double>")
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


def within(vectors: DataFrame, column: str, most: int) -> DataFrame:
    """``vectors``, whose job fails where a component is beyond ``most``."""
    told = F.concat(F.lit(f"a scaled component is beyond {most} in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    return vectors.withColumn(column, F.when(F.exists(column, lambda x: F.abs(x) > most), F.raise_error(told).cast("array<double>")).otherwise(F.col(column)))


def planes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, weights) of rows of 64 whole numbers: an array of plane by row, and what each plane weighs; as many planes as the widest component needs."""
    n = int(max(int(x.max(initial=0)).bit_length(), int(-1 - x.min(initial=-1)).bit_length())) + 1
    bits = (x[None] >> np.arange(n)[:, None, None]) & 1
    planes = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[..., 0]
    weights = np.int64(1) << np.arange(n, dtype=np.int64)
    weights[-1] = -weights[-1]
    return planes, weights


def components_of(planes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The whole numbers that ``planes_of`` was given."""
    bits = np.unpackbits(np.ascontiguousarray(planes)[..., None].view(np.uint8), axis=2, bitorder="little")
    return np.tensordot(weights, bits.astype(np.int64), 1)


def dot_products(planes: np.ndarray, weights: np.ndarray, other: np.ndarray, other_weights: np.ndarray) -> np.ndarray:
    """Dot products of all rows with all ``other`` rows."""
    out = np.zeros((planes.shape[1], other.shape[1]), np.int64)
    for p, w in zip(planes, weights, strict=True):
        for q, v in zip(other, other_weights, strict=True):
            out += np.bitwise_count(p[:, None] & q[None]).astype(np.int64) * (w * v)
    return out


class Centroids:
    """Centroids as planes; what tasks hold vectors against."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.planes, self.weights = planes_of(x)
        self.norms = (x * x).sum(1)

    def nearest(self, planes: np.ndarray, weights: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (ties: the smaller number) and the squared distance."""
        d = norms[:, None] - 2 * dot_products(planes, weights, self.planes, self.weights) + self.norms
        best = d.argmin(1)
        return best, d[np.arange(len(d)), best]


#: Vectors that are compared at a time in a task.
BATCH = 4096


def _batches(words: pd.Series, norm: pd.Series) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, planes, weights, norm) of vectors with equally many planes."""
    widths = words.map(len).to_numpy(np.int64)
    for width in np.unique(widths):
        same = np.flatnonzero(widths == width)
        for lo in range(0, len(same), BATCH):
            rows = same[lo : lo + BATCH]
            planes = np.frombuffer(b"".join(words.iloc[rows]), "<u8").reshape(len(rows), -1).T
            weights = np.int64(1) << np.arange(width // 8, dtype=np.int64)
            weights[-1] = -weights[-1]
            yield rows, planes, weights, norm.to_numpy()[rows]


def to_planes(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) to (vec_id, planes, norm): each vector has as many planes as its widest component needs."""

    def pack(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in it:
            x = np.stack(column.to_list()).astype(np.int64) if len(column) else np.zeros((0, COMPONENTS), np.int64)
            planes, _ = planes_of(x)
            width = [int(v).bit_length() + 1 for v in np.where(x < 0, -1 - x, x).max(1, initial=0)]
            rows = np.ascontiguousarray(planes.T)
            yield pd.DataFrame({"planes": [r[:w].tobytes() for r, w in zip(rows, width, strict=True)], "norm": (x * x).sum(1)})

    made = F.pandas_udf(pack, "planes binary, norm long").asNondeterministic()(F.col("x"))
    return vectors.withColumn("made", made).select("vec_id", "made.planes", "made.norm")


def _moved(vectors: DataFrame, at: Centroids) -> np.ndarray:
    """The centroids after one round. A task gives one row of sums for each centroid; only these are shuffled."""
    sent, k = vectors.sparkSession.sparkContext.broadcast(at), len(at.x)

    def add(it):
        sums, n = np.zeros((k, COMPONENTS), np.int64), np.zeros(k, np.int64)
        for pdf in it:
            for _, planes, weights, norms in _batches(pdf["planes"], pdf["norm"]):
                best, _ = sent.value.nearest(planes, weights, norms)
                x = components_of(planes, weights)
                for c in np.unique(best):
                    sums[c] += x[best == c].sum(0)
                n += np.bincount(best, minlength=k)
        used = np.flatnonzero(n)
        if len(used):
            yield pd.DataFrame({"cluster": used, "n": n[used], "sums": [*sums[used]]})

    parts = vectors.select("planes", "norm").mapInPandas(add, "cluster int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(COMPONENTS)]
    out = at.x.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(COMPONENTS)]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector, and the final centroids.

    Kept are vectors of exactly 64 components, none of them null or not finite;
    each component x is floor(scale * x). Centroids start as the k kept vectors
    with the smallest lower-case hexadecimal sha256 of ``seed:vec_id`` (of rows
    that repeat a vec_id, the smaller vector comes first; rows without vec_id
    start none, but are clustered like others). Each round moves every centroid to
    floor(sum / count) of its vectors; those without vectors stay. Ties go to the
    smaller number. Fewer than k vectors make fewer centroids; without a vector
    that has a vec_id the result is empty. Components beyond ``MOST`` after
    scaling fail the job. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("x")).where((F.size("x") == COMPONENTS) & F.col("x").isNotNull())
    kept = within(kept, "x", MOST)
    packed = stage(to_planes(kept), "planes")
    first = kept.where("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)).orderBy("hash", "x").limit(k).collect()
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], shape), np.zeros((0, COMPONENTS), np.int64)
    at = Centroids(np.array([r["x"] for r in first]).astype(np.int64))
    for _ in range(rounds):
        at = Centroids(_moved(packed, at))
    sent = spark.sparkContext.broadcast(at)

    def assign(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for planes, norm in it:
            best, d = np.zeros(len(norm), np.int32), np.zeros(len(norm), np.int64)
            for rows, *batch in _batches(planes, norm):
                best[rows], d[rows] = sent.value.nearest(*batch)
            yield pd.DataFrame({"cluster": best, "distance": d})

    made = F.pandas_udf(assign, "cluster int, distance long").asNondeterministic()("planes", "norm")
    assigned = stage(packed.withColumn("made", made).select("vec_id", "made.cluster", "made.distance"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in at.x.tolist()]
    total = F.lit(Decimal(sum(sums.values()))).cast("long")
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    out = assigned.withColumns({"cluster_inertia": of([sums.get(c, 0) for c in range(len(hashes))]).cast("long"), "inertia": total, "centroid_sha256": of(hashes)})
    return out, at.x
