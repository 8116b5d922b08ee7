"""Retrieval quality, usage and scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import records as rc
from .registry import query
from .tables import table

# A case is a source: its documents are ranked by length, and labels grade them.
_RANK = """q AS (SELECT source AS case_id, doc_id::VARCHAR AS id, quality + (1 - toxic) AS grade FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT source AS case_id, doc_id::VARCHAR AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    i AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, id) AS ideal FROM q),
    b AS (SELECT i.*, r.rank FROM i LEFT JOIN r USING (case_id, id))"""


def _case(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id"), "n_chars")
    labels = table(spark, sf_dir, "labels")
    qrels = docs.join(labels, "doc_id").select("case_id", F.col("doc_id").cast("string").alias("id"), (F.col("quality") + (1 - F.col("toxic"))).alias("grade"))
    w = Window.partitionBy("case_id").orderBy(F.desc("n_chars"), "doc_id")
    return docs.select("case_id", F.col("doc_id").cast("string").alias("id"), F.row_number().over(w).alias("rank")), qrels


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_METRICS = "count(*) FILTER (WHERE grade > 0) AS relevant, " + ", ".join(
    f"count(*) FILTER (WHERE rank <= {k} AND grade > 0) / nullif(count(*) FILTER (WHERE grade > 0), 0) AS recall_{k}, coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (WHERE rank <= {k}), 0) / nullif(sum((pow(2, grade) - 1) / log2(ideal + 1)) FILTER (WHERE ideal <= {k}), 0) AS ndcg_{k}" for k in (5, 10, 20)
)
_MRR = "coalesce(1.0 / min(rank) FILTER (WHERE grade = 2 AND rank <= 10), 0)::DOUBLE AS mrr"
_NAMES = [f"{m}_{k}" for k in (5, 10, 20) for m in ("recall", "ndcg")] + ["mrr"]


@query(f"WITH {_RANK}, m AS (SELECT case_id, {_METRICS}, {_MRR} FROM b GROUP BY case_id) SELECT case_id, relevant, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM m")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.case_metrics(*_case(spark, sf_dir)))


@query(f"WITH {_RANK}, m AS (SELECT case_id, {_METRICS}, {_MRR} FROM b GROUP BY case_id) SELECT round(avg(relevant), 6) AS relevant, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM m")
def rank_metrics_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.macro_mean(ev.case_metrics(*_case(spark, sf_dir))))


_CUTS = [5, 10, 20, 30, 50, 100]
_CURVE = f"""{_RANK}, c AS (SELECT unnest({_CUTS}) AS cutoff), h AS (SELECT cutoff, case_id, count(*) AS relevant, count(*) FILTER (WHERE rank <= cutoff) AS hit FROM b, c WHERE grade > 0 GROUP BY ALL),
    curve AS (SELECT cutoff, sum(hit) / sum(relevant) AS micro, avg(hit / relevant) AS macro, min(hit / relevant) AS least FROM h GROUP BY cutoff)"""


@query(f"WITH {_CURVE} SELECT cutoff, round(micro, 6) AS micro, round(macro, 6) AS macro, round(least, 6) AS least FROM curve")
def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.recall_curve(*_case(spark, sf_dir), _CUTS))


@query(f"WITH {_CURVE} SELECT min(cutoff) AS cutoff FROM curve WHERE micro >= (SELECT micro FROM curve WHERE cutoff = 100) - 0.01")
def recall_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.plateau(ev.recall_curve(*_case(spark, sf_dir), _CUTS))


@query("SELECT count(value) AS count, min(value) AS min, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events")
def score_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.distribution(table(spark, sf_dir, "events"), "value"))


@query(f"""WITH {_RANK}, l AS (SELECT case_id, id, rank FROM r WHERE rank <= 20), x AS (SELECT source AS case_id, doc_id::VARCHAR AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars // 1000 DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
    f AS (SELECT coalesce(l.case_id, x.case_id) AS case_id, l.rank AS a, x.rank AS z FROM l FULL JOIN x ON l.case_id = x.case_id AND l.id = x.id)
    SELECT case_id, count(*) FILTER (WHERE (coalesce(a, 99) <= 10 OR coalesce(z, 99) <= 10) AND a IS DISTINCT FROM z) = 0 AS exact_top, round(count(*) FILTER (WHERE a IS NOT NULL AND z IS NOT NULL) / count(*), 6) AS jaccard, max(abs(coalesce(a, 21) - coalesce(z, 21)))::INTEGER AS max_shift FROM f GROUP BY case_id""")
def ranking_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking by length against one by thousands of characters."""
    left, _ = _case(spark, sf_dir)
    w = Window.partitionBy("source").orderBy(F.desc(F.floor(F.col("n_chars") / 1000)), "doc_id")
    right = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("id"), F.row_number().over(w).alias("rank"))
    return _rounded(ev.compare_rankings(left, right))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS value, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def last_event_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user wins, beside sums."""
    e = table(spark, sf_dir, "events")
    sums = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    last = ev.last_usage(e.withColumn("_o", F.struct("ts", "event_id")), "user_id", "_o", "event_type")
    return sums.join(last.withColumnRenamed("event_type", "last_type"), "user_id")


@query("WITH u AS (SELECT l_returnflag, l_quantity::BIGINT * 100 AS input, (l_discount * 1000)::BIGINT AS cached, (l_tax * 40000)::BIGINT AS cache_write, l_linenumber::BIGINT AS output FROM lineitem) SELECT l_returnflag, sum(input)::BIGINT AS input, sum(cached)::BIGINT AS cached, sum(cache_write)::BIGINT AS cache_write, sum(output)::BIGINT AS output, sum(greatest(input - cached - cache_write, 0))::BIGINT AS standard FROM u GROUP BY l_returnflag")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of four classes of tokens and what is left of the input."""
    u = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity").cast("long") * 100).alias("input"), F.round(F.col("l_discount") * 1000).cast("long").alias("cached"), F.round(F.col("l_tax") * 40000).cast("long").alias("cache_write"), F.col("l_linenumber").cast("long").alias("output"))
    return ev.token_usage(u, ["l_returnflag"])


@query("WITH m AS (SELECT count(*) AS n FROM events WHERE event_type = 'click'), s AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS rank FROM events WHERE event_type = 'click') SELECT round(value, 6) AS threshold FROM s, m WHERE rank = floor(0.05 * n) + 1")
def threshold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score that at most five per cent of clicks reach."""
    return _rounded(ev.threshold(table(spark, sf_dir, "events").where("event_type = 'click'"), "value"))


_PART = ", ".join(f"sum(('0x' || substr(h, {15 * k + 1}, 15))::BIGINT)::VARCHAR AS p{k}" for k in range(4))


@query(f"WITH h AS (SELECT sha256(c_custkey || chr(9) || c_name || chr(9) || c_nationkey || chr(9) || c_mktsegment) AS h FROM customer), s AS (SELECT count(*) AS rows, {_PART} FROM h) SELECT rows, sha256(rows || '|' || p0 || '|' || p1 || '|' || p2 || '|' || p3) AS digest FROM s")
def payload_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of a table's rows."""
    return ev.payload_digest(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown-subject') AS slug FROM part")
def subject_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("SELECT p_partkey, trim(p_brand) AS name, '[[' || p_brand || ']]' AS link FROM part")
def wikilink(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = tx.wikilink(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.strip_wikilink(F.concat(F.lit(" "), link, F.lit(" "))).alias("name"), link.alias("link"))


@query("SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(string_split(p_name || ' ' || p_type || '  ' || p_name, ' '), lambda x: trim(x)), lambda x: x <> ''))) AS types FROM part")
def set_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit("  "), F.col("p_name")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", tx.set_normalize(words).alias("types"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '' ELSE lower(regexp_extract(url, '^https?://([^/?#]*)', 1) || '/' || trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/')) END AS repo FROM pages")
def canonical_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.canonical_repo(F.col("url")).alias("repo"))


@query("SELECT o_orderkey, CASE WHEN t < 1000 THEN t || ' tokens' WHEN t < 100000 THEN printf('%.1fk tokens', t / 1000) WHEN t < 1000000 THEN printf('%.0fk tokens', t / 1000) ELSE printf('%.1fm tokens', t / 1000000) END AS tokens FROM (SELECT o_orderkey, (o_totalprice * 4)::BIGINT // 10 * 10 + 3 AS t FROM orders)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.round(F.col("o_totalprice") * 4).cast("long") / 10).cast("long") * 10 + 3
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.format_token_count(n).alias("tokens"))


@query("SELECT doc_id, CASE WHEN strlen(p) <= 500 THEN p END AS excerpt FROM (SELECT doc_id, trim(string_split(coalesce(text, ''), chr(10) || chr(10))[1]) AS p FROM documents) WHERE strlen(p) <= 500 AND p <> '' AND NOT starts_with(p, '#')")
def short_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First paragraphs of 500 bytes at most, where they are no headings."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = F.trim(F.get(F.split("text", "\n\n"), F.lit(0)))
    return d.where((F.octet_length(first) <= 500) & (first != "") & ~first.startswith("#")).select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


_STRIPPED = "regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


@query(f"WITH d AS (SELECT doc_id, coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: {_STRIPPED}), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], '') AS p FROM documents) SELECT doc_id, CASE WHEN strlen(p) <= {tx.EXCERPT_BYTES} THEN p ELSE left(p, list_max(list_filter(range({tx.EXCERPT_BYTES + 1}), lambda n: strlen(left(p, n)) <= {tx.EXCERPT_BYTES}))) END AS excerpt FROM d")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's excerpt: headings and blank paragraphs skipped, long paragraphs cut; empty where there is none."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))


@query("SELECT name, any_value(definition) AS definition, list_sort(list_distinct(flatten(list(aliases)))) AS aliases FROM (SELECT c_mktsegment AS name, c_mktsegment AS definition, list('n' || c_nationkey) AS aliases FROM customer GROUP BY ALL UNION ALL SELECT p_type, p_type, list(p_brand) FROM part GROUP BY ALL) GROUP BY name")
def merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masters with new aliases and new masters, each a set."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.first("c_mktsegment").alias("definition"), F.collect_set(F.concat(F.lit("n"), "c_nationkey")).alias("aliases"))
    b = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.first("p_type").alias("definition"), F.collect_set("p_brand").alias("aliases"))
    return rc.merge_aliases(a, b).withColumn("aliases", F.array_sort("aliases"))
