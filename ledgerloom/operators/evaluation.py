"""Retrieval quality: graded rankings, curves, thresholds and comparisons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import order_statistics, quantiles

MRR_DEPTH, MRR_GRADE, MISSING_RANK = 10, 2, 21


def case_metrics(ranking: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Recall and nDCG at each cutoff and MRR at 10 for every case. ``ranking``: case_id, id, rank (from 1); ``qrels``: case_id, id, grade (above 0: relevant). The discount of rank r is log2(r + 1)."""
    w = Window.partitionBy("case_id").orderBy(F.desc("grade"), "id")
    ideal = qrels.withColumn("_at", F.row_number().over(w)).withColumn("_gain", F.pow(F.lit(2.0), F.col("grade")) - 1)
    both = ideal.join(ranking, ["case_id", "id"], "left")
    out = [F.count_if(F.col("grade") > 0).alias("relevant")]
    for k in cutoffs:
        hit = F.count_if((F.col("rank") <= k) & (F.col("grade") > 0))
        gain = F.sum(F.when(F.col("rank") <= k, F.col("_gain") / F.log2(F.col("rank") + 1)).otherwise(0.0))
        best = F.sum(F.when(F.col("_at") <= k, F.col("_gain") / F.log2(F.col("_at") + 1)).otherwise(0.0))
        out += [(hit / F.nullif(F.count_if(F.col("grade") > 0), F.lit(0))).alias(f"recall_{k}"), (gain / F.nullif(best, F.lit(0.0))).alias(f"ndcg_{k}")]
    top = F.min(F.when((F.col("grade") == MRR_GRADE) & (F.col("rank") <= MRR_DEPTH), F.col("rank")))
    return both.groupBy("case_id").agg(*out, F.coalesce(1.0 / top, F.lit(0.0)).alias("mrr"))


def macro_mean(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*(F.avg(c).alias(c) for c in metrics.columns if c != "case_id"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """count, min, p10, p50, p90, p95 and max, interpolated linearly; exact, by refinement of histograms."""
    _, found = quantiles(rows, column, [0.1, 0.5, 0.9, 0.95])
    ends = rows.agg(F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"))
    return ends.select("count", "min", *(F.lit(v).cast("double").alias(f"p{round(100 * q)}") for q, v in found.items()), "max")


def recall_curve(ranking: DataFrame, qrels: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(cutoff, micro, macro, least): recall over all pairs, its mean over cases and its minimum. Hits are counted once for each case and cutoff range, then summed."""
    n = F.count(F.lit(1))
    relevant = qrels.where("grade > 0").join(ranking, ["case_id", "id"], "left").groupBy("case_id").agg(n.alias("relevant"), *(F.count_if(F.col("rank") <= c).alias(f"hit_{c}") for c in cutoffs))
    rows = relevant.select("relevant", F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"hit_{c}").alias("hit")) for c in cutoffs))).alias("x")).select("relevant", "x.*")
    return rows.groupBy("cutoff").agg((F.sum("hit") / F.sum("relevant")).alias("micro"), F.avg(F.col("hit") / F.col("relevant")).alias("macro"), F.min(F.col("hit") / F.col("relevant")).alias("least"))


def plateau(curve: DataFrame, column: str = "micro", tolerance: float = 0.01) -> DataFrame:
    """The smallest cutoff that is within ``tolerance`` of the last one's value."""
    final = curve.agg(F.max_by(column, "cutoff").alias("_final"))
    return curve.crossJoin(F.broadcast(final)).where(F.col(column) >= F.col("_final") - tolerance).agg(F.min("cutoff").alias("cutoff"))


def compare_rankings(left: DataFrame, right: DataFrame, exact: int = 10, depth: int = 20) -> DataFrame:
    """(case_id, exact_top, jaccard, max_shift): equal first ids in order, overlap of the first ``depth``, and the largest change of rank, where what is missing counts as rank 21."""
    def own(d: DataFrame, c: str) -> DataFrame:
        return d.where(F.col("rank") <= depth).select("case_id", "id", F.col("rank").alias(c))

    both = own(left, "a").join(own(right, "b"), ["case_id", "id"], "full_outer")
    differ = F.count_if(((F.col("a") <= exact) | (F.col("b") <= exact)) & ~F.col("a").eqNullSafe(F.col("b")))
    shift = F.max(F.abs(F.coalesce("a", F.lit(MISSING_RANK)) - F.coalesce("b", F.lit(MISSING_RANK))))
    common = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.groupBy("case_id").agg((differ == 0).alias("exact_top"), (common / F.count(F.lit(1))).alias("jaccard"), shift.alias("max_shift"))


def threshold(scores: DataFrame, column: str = "score", share: float = 0.05) -> DataFrame:
    """One row: the least threshold that at most ``share`` of these (negative) scores reach: just above the first that has to stay out. Null without a score, or where that one is NaN."""
    n, known = scores.agg(F.count(F.lit(1)), F.count(column)).first()
    out = None
    if known:
        at = known - min(math.floor(share * n) + 1, known)
        first = order_statistics(scores, column, [at])[at]
        out = None if math.isnan(first) else math.nextafter(first, math.inf)
    return scores.sparkSession.range(1).select(F.lit(out).cast("double").alias("threshold"))


def payload_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows there are and a digest of them as a multiset: SHA-256 of the count and of the sums of four parts of each row's own SHA-256. Tasks only send sums, so any corpus can be verified."""
    def escape(c: str):
        out = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for plain, escaped in (("\\", r"\\"), ("\t", r"\t"), ("\n", r"\n"), ("\r", r"\r")):
            out = F.replace(out, F.lit(plain), F.lit(escaped))
        return out

    own = rows.select(F.sha2(F.concat_ws("\t", *(escape(c) for c in columns)), 256).alias("h"))
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    sums = own.agg(F.count(F.lit(1)).alias("rows"), *(part(k).alias(f"p{k}") for k in range(4)))
    return sums.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), "p0", "p1", "p2", "p3"), 256).alias("digest"))


def selection_metrics(attempts: DataFrame) -> DataFrame:
    """One row of agent selection quality. ``attempts``: case_id, kind (positive or negative), ok, attempts, selected, correct."""
    positive, negative = F.col("kind") == "positive", F.col("kind") == "negative"
    rate = lambda a, b: (F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)))
    return attempts.agg(
        rate(F.col("ok"), F.lit(True)).alias("success_rate"),
        (F.sum("correct") / F.nullif(F.sum("selected"), F.lit(0))).alias("precision"),
        rate(negative & (F.col("selected") > 0), negative).alias("false_acceptance"),
        rate(positive & (F.col("correct") > 0), positive).alias("recall"),
        F.sum(F.col("attempts") - 1).alias("retries"),
    )


def token_usage(usage: DataFrame, key: list[str]) -> DataFrame:
    """Sums of input, cached, cache_write and output tokens by key, and standard tokens: input less both caches, 0 at least for each row."""
    parts = ("input", "cached", "cache_write", "output")
    standard = F.greatest(F.col("input") - F.col("cached") - F.col("cache_write"), F.lit(0))
    return usage.groupBy(*key).agg(*(F.sum(p).alias(p) for p in parts), F.sum(standard).alias("standard"))


def last_usage(events: DataFrame, key: str, order: str, usage: str) -> DataFrame:
    """The last usage that a run's events report."""
    return events.groupBy(key).agg(F.max_by(usage, order).alias(usage))


# The kinds of tokens that a run's events count.
EVENT_TOKENS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")


def event_log_totals(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """One row over the JSON lines of a run's events: tokens of all completed turns, and how many events name an executed command, which is a string. Lines that are no JSON object count as nothing."""
    named = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), "$.item.command", "variant")) == "STRING"
    r = F.from_json(raw, f"type string, usage struct<{','.join(f'{c}:long' for c in EVENT_TOKENS)}>, item struct<type:string>")
    done, command = F.coalesce(r["type"] == "turn.completed", F.lit(False)), F.coalesce((r["item"]["type"] == "command_execution") & named, F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(done, r["usage"][c])), F.lit(0)).alias(c)
    return lines.agg(F.count_if(done).alias("turns"), *map(total, EVENT_TOKENS), F.count_if(command).alias("commands"))
