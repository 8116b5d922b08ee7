"""Derived tables that follow changing sources: change capture, merges and what is left to do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 64


def changes(current: DataFrame, indexed: DataFrame, key: str = "record_key", versions: tuple[str, ...] = ("mtime_ns", "size")) -> DataFrame:
    """(key, change): new, changed, deleted or same, by one full join on the key and the columns that tell a version."""
    a = current.select(F.col(key), F.lit(True).alias("_a"), *(F.col(v).alias(f"_a_{v}") for v in versions))
    b = indexed.select(F.col(key), F.lit(True).alias("_b"), *(F.col(v).alias(f"_b_{v}") for v in versions))
    same = F.lit(True)
    for v in versions:
        same = same & F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted").when(same, "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def stale(indexed: DataFrame, current: DataFrame, key: str = "record_key") -> DataFrame:
    """Indexed rows whose source is gone."""
    return indexed.join(current.select(key), key, "left_anti")


def upsert(base: DataFrame, updates: DataFrame, key: str = "record_key") -> DataFrame:
    """``base`` with rows of ``updates`` in place of those with the same key."""
    return base.join(updates.select(key), key, "left_anti").unionByName(updates)


def delete(base: DataFrame, keys: DataFrame, key: str = "record_key") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def key_owners(rows: DataFrame, key: str = "record_key", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(owners, duplicates): the first path owns a key; the others are warnings. An owner that goes leaves the key to the next."""
    first = rows.groupBy(key).agg(F.min(path).alias("_first"))
    judged = rows.join(first, key)
    return judged.where(F.col(path) == F.col("_first")).drop("_first"), judged.where(F.col(path) != F.col("_first")).select(key, path, F.col("_first").alias("owner"))


def synchronize(current: DataFrame, indexed: DataFrame, key: str = "record_key", versions: tuple[str, ...] = ("mtime_ns", "size"), version: int | None = None, indexed_version: int | None = None) -> DataFrame:
    """The index after a run: unchanged rows stay, others come from the source, stale ones go; another version rebuilds all."""
    if version != indexed_version:
        return current
    c = changes(current, indexed, key, versions)
    fresh = current.join(c.where("change in ('new', 'changed')"), key, "left_semi")
    kept = indexed.join(c.where("change = 'same'"), key, "left_semi")
    return kept.unionByName(fresh)


def index_status(current: DataFrame, indexed: DataFrame, key: str = "record_key", versions: tuple[str, ...] = ("mtime_ns", "size")) -> DataFrame:
    """One row: indexed rows and how many are new, changed, deleted and unsynchronized."""
    c = changes(current, indexed, key, versions)
    n = lambda k: F.count_if(F.col("change") == k).alias(k)
    return c.agg(F.count_if(F.col("change") != "new").alias("indexed"), n("new"), n("changed"), n("deleted"), F.count_if(F.col("change") != "same").alias("unsynchronized"))


def sync_state(state: DataFrame | None, spark, attempt, error: str | None = None) -> DataFrame:
    """The one-row state (last_attempt, last_success, last_error) after an attempt; an error keeps the last success."""
    before = state.first() if state is not None else None
    success = attempt if error is None else before["last_success"] if before else None
    return spark.createDataFrame([(attempt, success, error)], "last_attempt timestamp, last_success timestamp, last_error string")


def representative(kind: str = "kind"):
    """The text that stands for a row in vector search: a feedstock's summary, else the claim."""
    return F.when(F.col(kind) == "feedstock", F.trim("summary")).otherwise(F.trim("claim"))


Encoder = Callable[[list[str]], list[list[float]]]


def synchronize_vectors(rows: DataFrame, vectors: DataFrame, encoder: Encoder, model: str, batch: int = BATCH) -> DataFrame:
    """Vector rows (record_key, id, kind, mtime_ns, size, model_id, embedding) after a run.

    Rows whose version or model changed are encoded anew, in batches inside the
    tasks; vectors of rows that are gone or have no text any more go.
    """
    own = rows.withColumn("_text", representative()).where("coalesce(_text, '') <> ''").withColumn("model_id", F.lit(model))
    c = changes(own, vectors, "record_key", ("mtime_ns", "size", "model_id"))
    todo = own.join(c.where("change in ('new', 'changed')"), "record_key", "left_semi").select("record_key", "id", "kind", "mtime_ns", "size", "model_id", "_text")
    kept = vectors.join(c.where("change = 'same'"), "record_key", "left_semi")

    def encode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield part.drop(columns="_text").assign(embedding=encoder(part["_text"].to_list()))

    fresh = todo.mapInPandas(encode, "record_key string, id string, kind string, mtime_ns long, size long, model_id string, embedding array<float>")
    return kept.select(fresh.columns).unionByName(fresh)


def vectors_without_rows(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """Vectors whose metadata is missing: an error of the index."""
    return vectors.join(rows.select("record_key"), "record_key", "left_anti")


def embeddable(rows: DataFrame) -> DataFrame:
    """One row: how many rows have a text to encode, and how many have none."""
    has = F.coalesce(F.trim(representative()), F.lit("")) != ""
    return rows.agg(F.count_if(has).alias("with_text"), F.count_if(~has).alias("without_text"))
