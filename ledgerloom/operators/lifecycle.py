"""The life of knowledge: status, the supersession graph, its checks and its reconciliation.

Knowledge rows have id, subject, statement, feedstocks, approved, supersedes
(ids), superseded_by, superseded_at, invalidated_at, organized_at and updated.
Edges are exploded once; every rule is a join or an aggregate over them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .cycles import components


def effective_status() -> Column:
    """superseded, invalidated, active or pending, in this order of precedence."""
    return (
        F.when(F.coalesce("superseded_by", F.lit("")) != "", "superseded")
        .when(F.col("invalidated_at").isNotNull(), "invalidated")
        .when(F.coalesce("approved", F.lit(False)), "active")
        .otherwise("pending")
    )


def with_status(knowledge: DataFrame) -> DataFrame:
    return knowledge.withColumn("status", effective_status())


def _current(knowledge: DataFrame) -> DataFrame:
    return with_status(knowledge.where("organized_at is not null")).where("status in ('active', 'pending')")


def edges(knowledge: DataFrame) -> DataFrame:
    """(id, predecessor), and the successor's status."""
    return with_status(knowledge).select("id", "status", F.explode(F.array_distinct("supersedes")).alias("predecessor"))


def heads(knowledge: DataFrame, subject: str | None = None) -> DataFrame:
    """Organized, pending or active knowledge that no other such row (of the subject) supersedes."""
    current = _current(knowledge)
    if subject is not None:
        current = current.where(F.col("subject") == subject)
    named = current.select(F.explode("supersedes").alias("id")).distinct()
    return current.join(named, "id", "left_anti")


def distillable(knowledge: DataFrame, subject: str) -> DataFrame:
    """What documents of a subject may be made from: organized and active."""
    return with_status(knowledge.where("organized_at is not null")).where((F.col("subject") == subject) & (F.col("status") == "active"))


def claim_key(statement: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(statement, r"\s+", " ")))


def duplicate_claims(knowledge: DataFrame) -> DataFrame:
    """(subject, claim, ids) of heads that say the same."""
    grouped = heads(knowledge).groupBy("subject", claim_key(F.col("statement")).alias("claim")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.where("n > 1")


def multiple_successors(knowledge: DataFrame) -> DataFrame:
    """(predecessor, n): named by more than one pending or active row."""
    named = edges(knowledge.where("organized_at is not null")).where("status in ('active', 'pending')")
    return named.groupBy("predecessor").agg(F.count_distinct("id").alias("n")).where("n > 1")


def reachable(graph: DataFrame, rounds: int = 64, spread: DataFrame | None = None) -> DataFrame:
    """(src, dst) for every node that edges (src, dst) lead to, by doubling paths until nothing is new: as many rounds as the logarithm of the longest path.

    The closure has a row for each pair, so it is for graphs of short chains, as
    supersession is; ``spread`` (src) limits the starts of the result. RuntimeError
    if ``rounds``, which double the paths each, are not enough.
    """
    step = graph.select("src", "dst").distinct()
    size = -1
    for _ in range(rounds):
        longer = step.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("_next")), "dst").select("src", F.col("_next").alias("dst"))
        step = checkpoint(step.unionByName(longer).distinct())
        now = step.count()
        if now == size:
            return step if spread is None else step.join(spread.select("src").distinct(), "src", "left_semi")
        size = now
    raise RuntimeError(f"paths are longer than {rounds} doublings")


def on_cycles(graph: DataFrame) -> DataFrame:
    """(id) of the nodes on cycles of edges (src, dst); see ``cycles``."""
    return components(graph).select("id")


def validate_graph(knowledge: DataFrame) -> DataFrame:
    """(id, issue): self, missing target, inconsistent back link, multiple successors, cycle, duplicate claim."""
    organized = with_status(knowledge.where("organized_at is not null"))
    links = edges(organized)
    ids = organized.select(F.col("id").alias("predecessor"))
    back = organized.where("coalesce(superseded_by, '') <> ''").select("id", "superseded_by")
    successors = links.select(F.col("id").alias("superseded_by"), F.col("predecessor").alias("id"))
    parts = [
        links.where("id = predecessor").select("id", F.lit("supersedes itself").alias("issue")),
        links.where("id <> predecessor").join(ids, "predecessor", "left_anti").select("id", F.lit("supersedes missing knowledge").alias("issue")),
        back.join(successors, ["id", "superseded_by"], "left_anti").select("id", F.lit("inconsistent superseded_by").alias("issue")),
        multiple_successors(organized).select(F.col("predecessor").alias("id"), F.lit("multiple current successors").alias("issue")),
        on_cycles(links.where("id <> predecessor").select(F.col("id").alias("src"), F.col("predecessor").alias("dst"))).select("id", F.lit("supersession cycle").alias("issue")),
        duplicate_claims(organized).select(F.explode("ids").alias("id"), F.lit("duplicate current claim").alias("issue")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def restored(knowledge: DataFrame, now: datetime) -> DataFrame:
    """Organized knowledge, with those pending again whose successor is gone, invalidated or no longer names them; ``_changed`` marks them."""
    own = with_status(knowledge.where("organized_at is not null"))
    holders = own.where("status <> 'invalidated'").select(F.explode(F.array_distinct("supersedes")).alias("id"), F.col("id").alias("superseded_by"), F.lit(True).alias("_held"))
    out = own.join(holders, ["id", "superseded_by"], "left")
    lost = (F.col("status") == "superseded") & ~F.coalesce("approved", F.lit(False)) & F.col("invalidated_at").isNull() & F.col("_held").isNull()
    out = out.withColumn("_changed", lost).withColumn("superseded_by", F.when(~lost, F.col("superseded_by"))).withColumn("superseded_at", F.when(~lost, F.col("superseded_at")))
    out = out.withColumn("updated", F.when(lost, F.lit(now)).otherwise(F.col("updated")))
    return with_status(out).drop("_held")


def reconcile(knowledge: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(changed rows, issues (id, issue)). Every edge is judged by the statuses after restoring.

    A row that exactly one eligible row supersedes is superseded by it; active rows
    are eligible, and pending ones where the target is pending. Invalidated rows
    stay. Missing targets, several eligible successors, cycles and rows that
    another has superseded already are issues and change nothing.
    """
    state = checkpoint(restored(knowledge, now))
    links = state.where("status in ('active', 'pending')").select("id", F.col("status").alias("by_status"), F.explode(F.array_distinct("supersedes")).alias("target"))
    targets = state.select(F.col("id").alias("target"), F.col("status").alias("target_status"), F.col("superseded_by").alias("by"))
    judged = links.join(targets, "target", "left")
    missing = judged.where("target_status is null").select("id", F.lit("target does not exist").alias("issue"))
    eligible = judged.where("target_status <> 'invalidated' and (by_status = 'active' or target_status = 'pending')")
    one = eligible.groupBy("target", "target_status", "by").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    several = one.where("n > 1").select(F.col("target").alias("id"), F.lit("multiple eligible successors").alias("issue"))
    cyclic = on_cycles(links.select(F.col("id").alias("src"), F.col("target").alias("dst"))).select(F.col("id").alias("target"), F.lit(True).alias("_t"))
    ends = one.where("n = 1").join(cyclic, "target", "left").join(cyclic.select(F.col("target").alias("id"), F.col("_t").alias("_s")), "id", "left")
    loop = F.col("_t").isNotNull() & F.col("_s").isNotNull()
    cycles = ends.where(loop).select("id", F.lit("supersession cycle").alias("issue"))
    taken = ends.where(~loop & (F.col("target_status") == "superseded") & ~F.col("by").eqNullSafe(F.col("id"))).select(F.col("target").alias("id"), F.lit("already superseded by another").alias("issue"))
    retire = ends.where(~loop & (F.col("target_status") != "superseded")).select(F.col("target").alias("id"), F.col("id").alias("_by"))
    out = state.join(retire, "id", "left")
    new = F.col("_by").isNotNull()
    for c, value in (("superseded_by", F.col("_by")), ("superseded_at", F.lit(now)), ("updated", F.lit(now))):
        out = out.withColumn(c, F.when(new, value).otherwise(F.col(c)))
    changed = with_status(out.where(new | F.col("_changed"))).drop("_by", "_changed")
    return changed, missing.unionByName(several).unionByName(cycles).unionByName(taken)
