"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows are grouped by length, then by a hash of a prefix, then by a hash of the
whole content. Each step looks at the rows alone that the one before left in
groups of two or more: a length that occurs once ends there, as does a prefix
hash that is alone in its length. Texts never move: what a step compares is
computed where a text is read, and thin keys of a few dozen bytes are counted
(with partial counts before each exchange) and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_text, stage

PREFIX_CHARS = 256
#: Rows of surviving groups (16 bytes each) that are sent to all tasks at most, to tell which texts are read whole.
BROADCAST_GROUPS = 1_000_000


def normalised(text):
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys of groups with two rows or more."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and sha256 for every row of ``docs``.

    Rows with equal normalised texts form a group; ``keep_id`` is its smallest
    doc_id. sha256 is null for texts without an equal, unless ``digest_all`` asks
    for all of them; then they are computed in the first reading, and there is no
    second one. Without it, only texts of surviving groups are hashed whole, or,
    where these groups are more than ``broadcast_groups``, all whose length
    occurs twice.

    Null text counts as empty, and all empty texts are one group. A null doc_id
    is larger than any other and is kept only if it is alone in its group or
    all are null. Rows that repeat a doc_id count separately in group_size, and
    each of those with the smallest doc_id is kept. An empty table gives an
    empty result; other columns are not looked at.
    """
    base = id_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    read = base.select("doc_id", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"))
    keyed = stage(read if digest_all else read.drop("digest"), "exact-keys")

    # Lengths that occur twice; of their rows the prefix hashes that do.
    lengths = stage(_repeated(keyed, "len"), "exact-lengths")
    groups = stage(_repeated(keyed.join(lengths, "len", "left_semi"), "len", "prefix").withColumn("survives", F.lit(True)), "exact-prefixes")
    if digest_all:
        rows = keyed
    else:
        few = groups.count() <= broadcast_groups
        whole = F.broadcast(groups) if few else lengths.withColumn("survives", F.lit(True))
        own = read.join(whole, ["len", "prefix"] if few else "len", "left")
        rows = stage(own.select("doc_id", "len", "prefix", F.when(F.col("survives"), F.col("digest")).alias("digest")), "exact-full")

    # The full hash, of survivors only. Groups are written before rows meet them, so that joins can split a large group's rows.
    survivors = rows.join(groups.drop("survives"), ["len", "prefix"], "left_semi")
    best = survivors.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    out = rows.join(stage(best, "exact-best"), "digest", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(alone | F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
        (F.lower(F.hex("digest")) if digest_all else F.when(~alone, F.lower(F.hex("digest")))).alias("sha256"),
    )
