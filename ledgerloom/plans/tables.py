"""The engine's tables as derived from the given ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and conversation messages as index rows."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("document").alias("kind"), F.lit("").alias("session"), F.lit("").alias("agent"), (F.col("doc_id") * 1000).alias("timestamp_ns"),
        F.lit("").alias("summary"), text.alias("searchable"), F.lit("").alias("claim"), F.array("lang").alias("subjects"), F.array("source").alias("types"), F.lit("active").alias("status"), F.concat(F.lit("documents/"), "doc_id", F.lit(".md")).alias("path"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.concat(F.lit("c"), "conv_id"), "turn").alias("id"), F.lit("feedstock").alias("kind"), F.col("conv_id").cast("string").alias("session"), F.col("role").alias("agent"), ((F.col("conv_id") * 1000 + F.col("turn")) * 1000).alias("timestamp_ns"),
        text.alias("summary"), text.alias("searchable"), F.lit("").alias("claim"), F.array().cast("array<string>").alias("subjects"), F.array("role").alias("types"), F.lit("active").alias("status"), F.lit("").alias("path"),
    )
    return docs.unionByName(turns)


INDEX = """idx AS (
    SELECT 'd' || doc_id AS id, 'document' AS kind, '' AS session, '' AS agent, doc_id * 1000 AS timestamp_ns, '' AS summary, coalesce(text, '') AS searchable, [lang] AS subjects, [source] AS types, 'documents/' || doc_id || '.md' AS path FROM documents
    UNION ALL SELECT 'c' || conv_id || '-' || turn, 'feedstock', conv_id::VARCHAR, role, (conv_id * 1000 + turn) * 1000, coalesce(text, ''), coalesce(text, ''), []::VARCHAR[], [role], '' FROM conversations)"""


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("id"), F.lit("document").alias("kind"), "embedding")


VECTORS = "vecs AS (SELECT 'd' || vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings), query AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The encoded query: the vector numbered 0."""
    return [*table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedstock rows in time."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("id"), F.lit("feedstock").alias("kind"), F.col("user_id").cast("string").alias("session"), F.lit("claude").alias("agent"), (micros("ts") * 1000).alias("timestamp_ns"),
        F.col("props").alias("summary"), F.col("props").alias("searchable"), F.lit("").alias("claim"), F.array().cast("array<string>").alias("subjects"), F.array("event_type").alias("types"), F.lit("active").alias("status"), F.lit("").alias("path"),
    )


EVENTS = "ev AS (SELECT 'e' || event_id AS id, user_id::VARCHAR AS session, epoch_us(ts) * 1000 AS timestamp_ns, event_type AS type FROM events)"


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as knowledge: urgent ones supersede the customer's order before, medium ones its first; open ones name the next as their successor."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key = lambda c: F.concat(F.lit("k-"), c)
    o = o.withColumns({"prev": F.lag("o_orderkey").over(w), "next": F.lead("o_orderkey").over(w), "first": F.first("o_orderkey").over(w)})
    urgent, medium = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority") == "3-MEDIUM"
    supersedes = F.array_compact(F.array(F.when(urgent, key("prev")), F.when(medium & (F.col("first") != F.col("o_orderkey")), key("first"))))
    date = F.col("o_orderdate").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    return o.select(
        key("o_orderkey").alias("id"), F.concat(F.lit("c-"), "o_custkey").alias("subject"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("statement"), F.lit("decision").alias("type"), F.array(F.concat(F.lit("fs-"), "o_orderkey")).alias("feedstocks"),
        (F.col("o_orderstatus") == "F").alias("approved"), supersedes.alias("supersedes"), F.when(F.col("o_orderstatus") == "O", F.coalesce(key("next"), F.lit(""))).otherwise("").alias("superseded_by"),
        F.when((F.col("o_orderstatus") == "O") & F.col("next").isNotNull(), date).otherwise(none).alias("superseded_at"), F.when(F.col("o_totalprice") > 400000, date).otherwise(none).alias("invalidated_at"), F.when(F.col("o_orderpriority") != "5-LOW", date).otherwise(none).alias("organized_at"), date.alias("updated"), date.alias("created"),
    )


KNOWLEDGE = """o AS (SELECT *, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    kn AS (SELECT 'k-' || o_orderkey AS id, 'c-' || o_custkey AS subject, o_orderpriority || ' ' || o_orderstatus AS statement, o_orderstatus = 'F' AS approved,
        list_filter([CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'k-' || prev END, CASE WHEN o_orderpriority = '3-MEDIUM' AND first <> o_orderkey THEN 'k-' || first END], lambda x: x IS NOT NULL) AS supersedes,
        CASE WHEN o_orderstatus = 'O' THEN coalesce('k-' || next, '') ELSE '' END AS superseded_by, o_totalprice > 400000 AS invalidated, o_orderpriority <> '5-LOW' AS organized FROM o),
    ks AS (SELECT *, CASE WHEN superseded_by <> '' THEN 'superseded' WHEN invalidated THEN 'invalidated' WHEN approved THEN 'active' ELSE 'pending' END AS status FROM kn)"""
