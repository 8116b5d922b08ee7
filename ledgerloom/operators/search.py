"""Full-text, vector and hybrid search over index rows.

Index rows have id, kind (feedstock, knowledge or document), session, agent,
timestamp_ns, summary, searchable, claim, subjects, types, status and path; vector rows
have id, kind and embedding. Filters are applied first, then each branch takes
its best rows with one ordered limit, and only these are joined to the columns of
the result. Nothing but the options is on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_terms, like_contains, occurrences, supports_trigrams
from ..functions.vectors import dot
from ..session import shared_path

if TYPE_CHECKING:
    from .text_index import TextIndex

# Limits and constants of ranking.
DEFAULT_LIMIT, MAX_LIMIT, DEFAULT_MAX_TOKENS, BYTES_PER_TOKEN = 20, 100, 2000, 4
LEAST_DEPTH, FUSION_CONSTANT = 50, 60
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

ACTIVE, PENDING, INVALIDATED, SUPERSEDED = "active", "pending", "invalidated", "superseded"
KINDS = ("feedstock", "knowledge", "document")
MODES = ("text", "vector", "hybrid")


@dataclass(frozen=True)
class Options:
    """What is asked for. Time bounds are nanoseconds, both inclusive."""

    kind: str
    keywords: Sequence[str] = ()
    mode: str = "hybrid"
    subject: str | None = None
    type: str | None = None
    template: str | None = None
    session: str | None = None
    agent: str | None = None
    since_ns: int | None = None
    until_ns: int | None = None
    include_pending: bool = False
    include_retired: bool = False
    limit: int = DEFAULT_LIMIT
    max_tokens: int = DEFAULT_MAX_TOKENS
    last: int = 0
    query_vector: Sequence[float] | None = field(default=None, repr=False)

    @property
    def terms(self) -> list[str]:
        return keyword_terms([*self.keywords])


def validate(o: Options) -> Options:
    """The options with defaults for zeros; ValueError for what is not allowed."""
    o = replace(o, limit=o.limit or DEFAULT_LIMIT, max_tokens=o.max_tokens or DEFAULT_MAX_TOKENS)
    allowed = {"knowledge": {"subject", "type"}, "feedstock": {"type", "session", "agent"}, "document": {"subject", "template"}}
    if o.kind not in allowed:
        raise ValueError(f"unknown kind {o.kind!r}")
    if o.mode not in MODES:
        raise ValueError(f"unknown mode {o.mode!r}")
    if not 1 <= o.limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if o.max_tokens < 1 or o.last < 0:
        raise ValueError("max_tokens and last must not be negative")
    for name in ("subject", "type", "template", "session", "agent"):
        if getattr(o, name) and name not in allowed[o.kind]:
            raise ValueError(f"{name} does not apply to {o.kind}")
    if (o.include_pending or o.include_retired) and o.kind != "knowledge":
        raise ValueError("pending and retired apply to knowledge only")
    if o.last and (o.kind != "feedstock" or o.terms):
        raise ValueError("last applies to feedstock without keywords")
    if o.since_ns is not None and o.until_ns is not None and o.since_ns > o.until_ns:
        raise ValueError("since is after until")
    if o.terms and o.mode == "vector" and o.query_vector is None:
        raise ValueError("vector mode needs an encoded query")
    return o


def visible_statuses(pending: bool = False, retired: bool = False) -> list[str]:
    return [ACTIVE, *[PENDING] * pending, *[INVALIDATED, SUPERSEDED] * retired]


def end_of_day_ns(midnight_ns: int) -> int:
    """The last nanosecond of the day that begins at ``midnight_ns``: what a date alone means as an upper bound."""
    return midnight_ns + 86_400_000_000_000 - 1


def eligible(index: DataFrame, o: Options) -> DataFrame:
    """The rows that the options' filters leave."""
    out = index.where(F.col("kind") == o.kind)
    if o.kind == "knowledge":
        out = out.where(F.col("status").isin(visible_statuses(o.include_pending, o.include_retired)))
    if o.subject:
        out = out.where(F.array_contains("subjects", o.subject))
    if o.type or o.template:
        out = out.where(F.array_contains("types", o.type or o.template))
    for name in ("session", "agent"):
        if getattr(o, name):
            out = out.where(F.col(name) == getattr(o, name))
    if o.since_ns is not None:
        out = out.where(F.col("timestamp_ns") >= o.since_ns)
    if o.until_ns is not None:
        out = out.where(F.col("timestamp_ns") <= o.until_ns)
    return out


def _searched(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def matches(terms: list[str]) -> Column:
    """Whether every term is part of summary or searchable text: by Unicode case if all terms have three characters, by ASCII case in the searchable text otherwise."""
    if supports_trigrams(terms):
        lowered = [F.lower(_searched(c)) for c in ("summary", "searchable")]
        each = [F.contains(lowered[0], F.lit(t.lower())) | F.contains(lowered[1], F.lit(t.lower())) for t in terms]
    else:
        each = [like_contains(_searched("searchable"), t) for t in terms]
    out = F.lit(True)
    for e in each:
        out = out & e
    return out


TEXT_COLUMNS = ("summary", "searchable", "claim")


def term_counts(index: DataFrame, terms: list[str]) -> DataFrame:
    """The index without its texts, but with their length in grams and how often each term stands in them (_tf0, _tf1, ...)."""
    length = F.greatest(F.length(_searched("summary")) - 2, F.lit(0)) + F.greatest(F.length(_searched("searchable")) - 2, F.lit(0))
    frequency = [(occurrences(_searched("summary"), t) + occurrences(_searched("searchable"), t)).alias(f"_tf{k}") for k, t in enumerate(terms)]
    return index.select(*(c for c in index.columns if c not in TEXT_COLUMNS), length.alias("_len"), *frequency)


def bm25_scores(matched: DataFrame, totals: DataFrame, n_terms: int) -> DataFrame:
    """``matched`` rows (_len, _tf0, ...) with a score column. ``totals`` is one row of the whole index, all kinds: _n rows, their mean length _avg, and how many have each term (_df0, ...)."""
    score = F.lit(0.0)
    for k in range(n_terms):
        tf, df = F.col(f"_tf{k}"), F.col(f"_df{k}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return matched.crossJoin(F.broadcast(totals)).withColumn("score", score)


def ranked(rows: DataFrame, order: list[Column], depth: int) -> DataFrame:
    """(id, rank, ...) of the first ``depth`` rows; the limit comes before the window, which then has ``depth`` rows at most."""
    return rows.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


class ScannedTexts:
    """What a scan of all texts finds for one search, in the place of a kept index: the pass that writes what matches also observes the statistics of the whole index. All terms have three characters."""

    def __init__(self, index: DataFrame, o: Options):
        self.n_terms = len(o.terms)
        names = [f"_tf{k}" for k in range(self.n_terms)]
        seen = Observation()
        counted = term_counts(index, o.terms).observe(seen, F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(c) > 0).alias(f"_df{k}") for k, c in enumerate(names)))
        found = eligible(counted, o)
        for c in names:
            found = found.where(F.col(c) > 0)
        found = found.select("id", "timestamp_ns", "_len", *names)
        path = shared_path(index.sparkSession, "matches")
        found.write.parquet(path)
        self.found = index.sparkSession.read.schema(found.schema).parquet(path)
        self.totals = index.sparkSession.range(1).select(*(F.lit(v).cast("double" if k == "_avg" else "long").alias(k) for k, v in seen.get.items()))

    def text_branch(self, o: Options, depth: int) -> DataFrame:
        rows = bm25_scores(self.found, self.totals, self.n_terms).select("id", "timestamp_ns", "score")
        return ranked(rows, [F.desc("score"), F.desc("timestamp_ns"), F.asc("id")], depth).select("id", "rank", "score")

    def matching_ids(self, o: Options) -> DataFrame:
        return self.found.select("id")


def text_branch(index: DataFrame, o: Options, depth: int) -> DataFrame:
    """(id, rank, score) from one scan of all texts. With a short term the newest come first and scores are null. ``text_index.TextIndex`` gives the same rows from kept lists."""
    if supports_trigrams(o.terms):
        return ScannedTexts(index, o).text_branch(o, depth)
    found = eligible(index, o).where(matches(o.terms))
    rows = found.select("id", "timestamp_ns", F.lit(None).cast("double").alias("score"))
    return ranked(rows, [F.desc("timestamp_ns"), F.asc("id")], depth).select("id", "rank", "score")


def vector_branch(index: DataFrame, vectors: DataFrame, o: Options, depth: int, least: float | None = None) -> DataFrame:
    """(id, rank, score) by cosine similarity of unit vectors; eligible rows first, then the exact best."""
    query = F.array(*(F.lit(float(x)) for x in o.query_vector))
    own = vectors.where(F.col("kind") == o.kind).join(eligible(index, o).select("id"), "id", "left_semi")
    rows = own.select("id", dot(F.col("embedding"), query).alias("score"))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    return ranked(rows, [F.desc("score"), F.asc("id")], depth)


def fuse(branches: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of branches (id, rank[, score]): id, rank, score and the branches' own scores.

    The first occurrence of an id in a branch counts, and ranks below 1 are taken
    by position among the branch's rows.
    """
    parts = None
    for name, b in branches.items():
        own = b.select("id", F.col("rank").alias("_r"), (F.col("score") if "score" in b.columns else F.lit(None).cast("double")).alias("_s"), F.lit(name).alias("_b"))
        first = own.groupBy("id", "_b").agg(F.min("_r").alias("_r"), F.min_by("_s", "_r").alias("_s"))
        parts = first if parts is None else parts.unionByName(first)
    scores = [F.max(F.when(F.col("_b") == n, F.col("_s"))).alias(f"{n}_score") for n in branches]
    sums = parts.groupBy("id").agg(F.sum(1.0 / (FUSION_CONSTANT + F.col("_r"))).alias("score"), *scores)
    order = [F.desc("score"), F.asc("id")]
    if limit is not None:
        return ranked(sums, order, limit)
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def depth_of(o: Options) -> int:
    return max(LEAST_DEPTH, o.limit + 1)


def newest(index: DataFrame, o: Options) -> DataFrame:
    """Without keywords: newest first; with ``last`` the newest so many, oldest first."""
    rows = eligible(index, o).select("id", "timestamp_ns")
    if o.last:
        recent = rows.orderBy(F.desc("timestamp_ns"), F.asc("id")).limit(o.last)
        return ranked(recent, [F.asc("timestamp_ns"), F.asc("id")], o.last).select("id", "rank")
    return ranked(rows, [F.desc("timestamp_ns"), F.asc("id")], o.limit + 1).select("id", "rank")


def candidates(index: DataFrame, vectors: DataFrame | None, o: Options, kept: TextIndex | ScannedTexts | None = None) -> DataFrame:
    """(id, rank) of what a search finds, before rows are loaded. Hybrid search without an encoded query is text search. With a kept text index (of the same rows as ``index``) texts are not scanned."""
    o = validate(o)
    by_text = kept.text_branch if kept else lambda o, depth: text_branch(index, o, depth)
    if not o.terms:
        return newest(index, o)
    if o.mode == "vector":
        return vector_branch(index, vectors, o, o.limit + 1).select("id", "rank")
    if o.mode == "text" or o.query_vector is None or vectors is None:
        return by_text(o, o.limit + 1).select("id", "rank")
    depth = depth_of(o)
    return fuse({"text": by_text(o, depth), "vector": vector_branch(index, vectors, o, depth)}, o.limit + 1).select("id", "rank")


def total(index: DataFrame, vectors: DataFrame | None, o: Options, kept: TextIndex | ScannedTexts | None = None) -> DataFrame:
    """One row: the exact number of rows that the search could return at any limit."""
    o = validate(o)
    rows = eligible(index, o)
    if not o.terms:
        return rows.agg(F.count(F.lit(1)).alias("total"))
    by_text = kept.matching_ids(o) if kept else rows.where(matches(o.terms)).select("id")
    if o.mode == "text" or o.query_vector is None or vectors is None:
        return by_text.agg(F.count(F.lit(1)).alias("total"))
    by_vector = rows.select("id").join(vectors.where(F.col("kind") == o.kind).select("id"), "id", "left_semi")
    ids = by_vector if o.mode == "vector" else by_text.union(by_vector).distinct()
    return ids.agg(F.count(F.lit(1)).alias("total"))


RESULT_COLUMNS = {
    "knowledge": ["id", "subject", "type", "claim"],
    "document": ["id", "subject", "template", "timestamp", "path"],
    "feedstock": ["id", "timestamp", "agent", "session", "summary", "types"],
}


def load(index: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """Found ids with the columns that their kind shows; ids that are gone are skipped. ``found`` has a limit's rows at most."""
    columns = {
        "subject": F.get("subjects", F.lit(0)).alias("subject"),
        "type": F.get("types", F.lit(0)).alias("type"),
        "template": F.get("types", F.lit(0)).alias("template"),
        "timestamp": F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000)).alias("timestamp"),
    }
    rows = index.where(F.col("kind") == kind).join(F.broadcast(found), "id")
    return rows.select("rank", *(columns.get(c, F.col(c)) for c in RESULT_COLUMNS[kind]))


def _empty_to_null(rows: DataFrame, columns: list[str]) -> list[Column]:
    kinds = dict(rows.dtypes)
    out = []
    for c in columns:
        empty = F.size(c) == 0 if kinds[c].startswith("array") else F.col(c) == "" if kinds[c] == "string" else F.lit(False)
        out.append(F.when(~empty, F.col(c)).alias(c))
    return out


def json_bytes(rows: DataFrame, columns: list[str]) -> Column:
    """Bytes of a result as JSON, without empty fields and with <, > and & escaped as six bytes each."""
    text = F.to_json(F.struct(*_empty_to_null(rows, columns)))
    return F.octet_length(text) + 5 * F.length(F.regexp_replace(text, "[^<>&]", ""))


def within_budget(rows: DataFrame, size: Column, max_tokens: int) -> DataFrame:
    """The results by rank up to the first that exceeds the budget of bytes; those behind it go as well. ``rows`` has a limit's rows at most."""
    running = F.sum(size).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_running", running).where(F.col("_running") <= max_tokens * BYTES_PER_TOKEN).drop("_running")


def search(index: DataFrame, vectors: DataFrame | None, o: Options, kept: TextIndex | ScannedTexts | None = None) -> tuple[DataFrame, DataFrame]:
    """(results by rank, one row of total, returned, has_more and truncated)."""
    o = validate(o)
    if kept is None and o.mode != "vector" and supports_trigrams(o.terms):
        kept = ScannedTexts(index, o)  # once, for candidates and the total
    found = candidates(index, vectors, o, kept)
    rows = load(index, found, o.kind)
    shown = o.last or o.limit
    page = rows.where(F.col("rank") <= shown)
    results = within_budget(page, json_bytes(page, RESULT_COLUMNS[o.kind]), o.max_tokens)
    counts = page.agg(F.count(F.lit(1)).alias("fetched")).crossJoin(results.agg(F.count(F.lit(1)).alias("returned")))
    summary = total(index, vectors, o, kept).crossJoin(counts).select("total", "returned", (F.col("returned") < F.col("total")).alias("has_more"), (F.col("returned") < F.col("fetched")).alias("truncated"))
    return results, summary
