"""Validation, lookups and changes of records; results of model calls; caches of sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as tx
from ..operators import documents as dc
from ..operators import evaluation as ev
from ..operators import lifecycle as lc
from ..operators import organize as og
from ..operators import records as rc
from ..operators import sync
from ..session import shared_path
from ..sources import logs, markdown, record_files
from .registry import query
from .tables import KNOWLEDGE, knowledge, table

NOW = datetime(2024, 6, 1)

# Parts as templates, some of which lack a field.
_TEMPLATES = "t AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || '.md' END AS output, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS purpose, CASE WHEN p_partkey % 4 = 0 THEN 'always' WHEN p_partkey % 13 = 0 THEN 'never' END AS inject FROM part)"


@query(f"WITH {_TEMPLATES} SELECT p_partkey, CASE WHEN trim(name) = '' THEN 'name is required' WHEN trim(output) = '' THEN 'output is required' WHEN NOT ends_with(output, '.md') THEN 'output must be Markdown' WHEN trim(coalesce(purpose, '')) = '' THEN 'purpose is required' WHEN inject = 'never' THEN 'unknown inject mode' END AS reason FROM t")
def template_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing that is wrong with each template."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(
        k, F.when(k % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(k % 5 == 0, "").when(k % 3 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit(".md"))).alias("output"),
        F.when(k % 11 != 0, F.col("p_brand")).alias("purpose"), F.when(k % 4 == 0, "always").when(k % 13 == 0, "never").alias("inject"),
    )
    return t.select("p_partkey", rc.template_error().alias("reason"))


@query(f"WITH {KNOWLEDGE}, j AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN upper(ks.id) ELSE ks.id END AS own, CASE WHEN o_orderkey % 7 = 0 THEN ['x'] ELSE ['fs-' || o_orderkey] END AS fs, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE statement END AS st FROM ks JOIN orders ON ks.id = 'k-' || o_orderkey) SELECT o_orderkey, CASE WHEN own <> lower(own) THEN 'invalid id' WHEN fs[1] = 'x' THEN 'established_by is not among feedstocks' WHEN NOT organized AND (approved OR superseded_by <> '' OR invalidated OR len(supersedes) > 0) THEN 'unorganized knowledge has no lifecycle' WHEN st = '' THEN 'statement is required' END AS reason FROM j")
def knowledge_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing that is wrong with each row of knowledge."""
    key = F.expr("cast(substring(id, 3) as bigint)")
    k = knowledge(spark, sf_dir).withColumn("o_orderkey", key).withColumn("established_by", F.concat(F.lit("fs-"), "o_orderkey"))
    k = k.withColumns({"id": F.when(F.col("o_orderkey") % 5 == 0, F.upper("id")).otherwise(F.col("id")), "feedstocks": F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("x"))).otherwise(F.col("feedstocks")), "statement": F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("statement"))})
    return k.select("o_orderkey", rc.knowledge_error().alias("reason"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'invalid id' WHEN o_custkey % 5 = 0 THEN 'session is required' WHEN o_orderstatus = 'P' THEN 'unknown agent' WHEN o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0 THEN 'extracted before drafted' WHEN o_custkey % 2 = 1 AND o_custkey % 3 = 0 THEN 'summary is required' END AS reason FROM orders")
def feedstock_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing that is wrong with each turn."""
    c, at = F.col("o_custkey"), F.col("o_orderdate").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(c % 7 == 0, F.concat(F.lit("-"), "o_orderkey")).otherwise(F.concat(F.lit("fs-"), "o_orderkey")).alias("id"), F.concat(F.lit("t:"), "o_orderkey").alias("turn_id"), F.when(c % 5 == 0, "").otherwise(c.cast("string")).alias("session_id"),
        at.alias("timestamp"), F.when(F.col("o_orderstatus") == "P", "other").otherwise("codex").alias("agent"), F.when(F.col("o_orderpriority") == "1-URGENT", at).alias("extracted_at"), F.when(c % 2 == 1, at).alias("drafted_at"), F.when(c % 3 != 0, F.col("o_orderpriority")).alias("summary"), F.array(F.lit("a"), F.lit("b")).alias("types"),
    )
    return rows.select("o_orderkey", rc.feedstock_error().alias("reason"))


@query("SELECT o_custkey || '/' || o_orderstatus AS document, CASE WHEN o_custkey % 10 = 0 THEN 'subject is required' WHEN count(*) FILTER (WHERE o_orderpriority <> '5-LOW') < 1 THEN 'knowledge is required' WHEN count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority <> '5-LOW') <> count(*) FILTER (WHERE o_orderpriority <> '5-LOW') THEN 'knowledge repeats' END AS reason FROM orders GROUP BY o_custkey, o_orderstatus")
def document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing that is wrong with documents that cite priorities as knowledge."""
    cited = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    d = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("template")).agg(F.collect_list(cited).alias("knowledge_ids"))
    d = d.select(F.concat_ws("/", "o_custkey", "template").alias("document"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey").cast("string")).alias("subject"), "template", "knowledge_ids", F.lit("text").alias("body"))
    return d.select("document", rc.document_error().alias("reason"))


_TURNS_OF = f"{KNOWLEDGE}, fs AS (SELECT DISTINCT 'fs-' || l_orderkey AS id FROM lineitem WHERE l_linenumber >= 4)"


@query(f"WITH {_TURNS_OF} SELECT ks.id, fs.id IS NOT NULL AS found, CASE WHEN fs.id IS NOT NULL THEN 's' || substr(ks.id, 3) END AS session FROM ks LEFT JOIN fs ON fs.id = 'fs-' || substr(ks.id, 3)")
def established_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge with the turn that established it, and that whose turn is missing."""
    order = F.col("l_orderkey").cast("string")
    turns = table(spark, sf_dir, "lineitem").where("l_linenumber >= 4").select(F.concat(F.lit("fs-"), order).alias("id"), F.lit(NOW).alias("timestamp"), F.concat(F.lit("s"), order).alias("session_id"), order.alias("turn_id")).distinct()
    k = knowledge(spark, sf_dir).withColumn("established_by", F.get("feedstocks", F.lit(0)))
    found, missing = rc.with_established(k, turns)
    return found.select("id", F.lit(True).alias("found"), F.col("established.session_id").alias("session")).unionByName(missing.select("id", F.lit(False).alias("found"), F.lit(None).cast("string").alias("session")))


@query(f"WITH {KNOWLEDGE} SELECT ks.id, CASE WHEN status = 'pending' AND next IS NOT NULL THEN 'superseded' ELSE status END AS status, CASE WHEN status = 'pending' AND next IS NOT NULL THEN 'k-' || next ELSE superseded_by END AS superseded_by FROM ks JOIN o ON ks.id = 'k-' || o_orderkey")
def supersede_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders superseded by the customer's next one; others stay as they are."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key = lambda c: F.concat(F.lit("k-"), c)
    by = table(spark, sf_dir, "orders").select(key("o_orderkey").alias("id"), key(F.lead("o_orderkey").over(w)).alias("by")).where("by is not null")
    return lc.with_status(rc.supersede_pending(knowledge(spark, sf_dir), by, NOW)).select("id", "status", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"))


@query(f"WITH {KNOWLEDGE} SELECT id, CASE WHEN organized AND status = 'pending' THEN 'active' ELSE status END AS status FROM ks WHERE ends_with(statement, 'O') OR ends_with(statement, 'P')")
def approve_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organized, pending rows approved; those unorganized or over stay."""
    k = knowledge(spark, sf_dir).where(~F.endswith("statement", F.lit("F")))
    return lc.with_status(rc.approve(k, k.select("id"), NOW)).select("id", "status")


_FEEDSTOCKS = "f AS (SELECT 'fs-' || o_orderkey AS id, o_orderstatus <> 'O' AS drafted, o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' AS extracted FROM orders)"


def _feedstocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as turns: those that are not open are drafted, urgent ones of them extracted."""
    at = F.col("o_orderdate").cast("timestamp_ntz")
    drafted = F.col("o_orderstatus") != "O"
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("fs-"), "o_orderkey").alias("id"), F.when(drafted, at).alias("drafted_at"), F.when(drafted & (F.col("o_orderpriority") == "1-URGENT"), at).alias("extracted_at"), F.when(drafted, F.col("o_orderpriority")).alias("summary"), F.when(drafted, F.array(F.lit("old"))).alias("types"))


@query(f"WITH {_FEEDSTOCKS}, n AS (SELECT DISTINCT 'fs-' || l_orderkey AS id FROM lineitem WHERE l_quantity > 25) SELECT f.id, drafted AND (extracted OR n.id IS NOT NULL) AS extracted FROM f LEFT JOIN n ON n.id = f.id")
def mark_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of large orders marked as extracted, if they are drafted."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.concat(F.lit("fs-"), "l_orderkey").alias("id"))
    return rc.mark_extracted(_feedstocks(spark, sf_dir), done, NOW).select("id", F.col("extracted_at").isNotNull().alias("extracted"))


@query(f"WITH {_FEEDSTOCKS}, d AS (SELECT 'fs-' || l_orderkey AS id, 'sum ' || count(*) AS summary, list_sort(list(DISTINCT l_returnflag)) AS types FROM lineitem GROUP BY l_orderkey) SELECT f.id, CASE WHEN drafted THEN o_orderpriority ELSE d.summary END AS summary, CASE WHEN drafted THEN ['old'] ELSE d.types END AS types FROM f LEFT JOIN d ON d.id = f.id JOIN orders ON f.id = 'fs-' || o_orderkey")
def apply_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts applied once: to turns that have none yet."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.collect_list("l_returnflag").alias("types"))
    drafts = d.select(F.concat(F.lit("fs-"), "l_orderkey").alias("id"), F.concat(F.lit(" sum "), "n").alias("summary"), "types")
    return og.apply_drafts(_feedstocks(spark, sf_dir), drafts, NOW).select("id", "summary", "types")


_CLAIMS = f"{_FEEDSTOCKS}, d AS (SELECT 'fs-' || l_orderkey AS fid, l_linenumber AS ordinal, l_returnflag AS type, l_linestatus AS subject, 'part ' || l_partkey AS statement FROM lineitem), v AS (SELECT fid, bool_and(type IN ('A', 'R') AND subject = 'F') AS ok FROM d JOIN f ON f.id = fid WHERE drafted AND NOT extracted GROUP BY fid)"


@query(f"WITH {_CLAIMS} SELECT substr(sha256(d.fid || chr(0) || ordinal), 1, 32) AS id, d.fid AS established_by, type, subject, statement FROM d JOIN v ON d.fid = v.fid WHERE ok UNION ALL SELECT NULL, fid, 'invalid', NULL, NULL FROM v WHERE NOT ok")
def extracted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge from drafts of turns, all of a turn's or none, and the turns with an invalid one."""
    drafts = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("fs-"), "l_orderkey").alias("feedstock_id"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit(" "), "l_returnflag").alias("type"), F.col("l_linestatus").alias("subject"), F.concat(F.lit("part "), "l_partkey").alias("statement"), F.lit("").alias("rationale"))
    good, bad = og.extract(_feedstocks(spark, sf_dir), drafts, ["A", "R"], ["F"])
    null = lambda c: F.lit(None).cast("string").alias(c)
    return good.select("id", "established_by", "type", "subject", "statement").unionByName(bad.select(null("id"), F.col("feedstock_id").alias("established_by"), F.lit("invalid").alias("type"), null("subject"), null("statement")))


# Results of model calls, one in six of each kind: right, with an unknown key, incomplete, with something behind, of a wrong type, and null types.
@query("SELECT doc_id, doc_id % 6 = 0 AS ok, CASE WHEN doc_id % 6 = 0 THEN source END AS summary FROM documents")
def strict_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which results are exactly the object that the task asks for."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("s"))
    right = F.to_json(F.struct(F.col("s").alias("summary"), F.array("s").alias("types")))
    odd = (right, F.to_json(F.struct(F.col("s").alias("summary"), F.array("s").alias("types"), F.lit(1).alias("more"))), F.to_json(F.struct(F.col("s").alias("summary"))), F.concat(right, F.lit(" {}")), F.concat(F.lit("["), right, F.lit("]")), F.to_json(F.struct(F.col("s").alias("summary"), F.lit(None).cast("array<string>").alias("types")), {"ignoreNullFields": "false"}))
    chosen = odd[0]
    for k in range(1, 6):
        chosen = F.when(F.col("doc_id") % 6 == k, odd[k]).otherwise(chosen)
    good, bad = rc.decode_result(d.withColumn("result", chosen), "draw")
    return good.select("doc_id", F.lit(True).alias("ok"), F.col("decoded.summary").alias("summary")).unionByName(bad.select("doc_id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("summary")))


@query("SELECT l_orderkey, l_linenumber, dialect, CASE WHEN dialect = 'claude' THEN a + b + c ELSE a END AS input, CASE WHEN dialect = 'claude' THEN b ELSE least(b * 10, a) END AS cached, CASE WHEN dialect = 'claude' THEN c ELSE 0 END AS cache_write, a * 2 AS output FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS a, l_linenumber::BIGINT AS b, (l_partkey % 5)::BIGINT AS c FROM lineitem), (VALUES ('claude'), ('codex')) t(dialect)")
def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of calls, as two dialects report them."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("a"), F.col("l_linenumber").cast("long").alias("b"), (F.col("l_partkey") % 5).cast("long").alias("c"))  # noqa: E741
    claude = l.withColumn("usage", F.to_json(F.struct(F.col("a").alias("input_tokens"), F.col("b").alias("cache_read_input_tokens"), F.col("c").alias("cache_creation_input_tokens"), (F.col("a") * 2).alias("output_tokens"))))
    codex = l.withColumn("usage", F.to_json(F.struct(F.col("a").alias("input_tokens"), (F.col("b") * 10).alias("cached_input_tokens"), (F.col("a") * 2).alias("output_tokens"))))
    out = None
    for dialect, rows in (("claude", claude), ("codex", codex)):
        part = rc.model_usage(rows, dialect).select("l_orderkey", "l_linenumber", F.lit(dialect).alias("dialect"), "input", "cached", "cache_write", "output")
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH a AS (SELECT o_orderkey, o_orderpriority AS p FROM orders WHERE o_custkey % 10 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE o_orderpriority END AS p FROM orders WHERE o_custkey % 10 <> 1) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.p IS DISTINCT FROM b.p")
def changed_since_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that changed, came or went since a plan's snapshot."""
    o = table(spark, sf_dir, "orders")
    now = o.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "P", "x").otherwise(F.col("o_orderpriority")))
    digest = lambda d: rc.snapshot_digest(d, ["o_orderpriority"], "o_orderkey")
    return rc.changed_since(digest(o.where("o_custkey % 10 <> 0")), digest(now.where("o_custkey % 10 <> 1")), "o_orderkey")


_REFERENCES = f"WITH {KNOWLEDGE}, b AS (SELECT id, subject, 'K' || CASE WHEN place < 1000 THEN lpad(place::VARCHAR, 3, '0') ELSE place::VARCHAR END AS reference FROM (SELECT id, subject, row_number() OVER (PARTITION BY subject ORDER BY id) AS place FROM ks WHERE organized AND status = 'active')), r AS (SELECT 'c-' || o_custkey AS subject, 'K' || lpad(l_linenumber::VARCHAR, 3, '0') AS reference, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 47 GROUP BY ALL)"


@query(f"{_REFERENCES} SELECT r.subject, r.reference, CASE WHEN b.id IS NULL THEN 'unknown' WHEN n > 1 THEN 'repeated' ELSE b.id END AS found FROM r LEFT JOIN b ON b.subject = r.subject AND b.reference = r.reference")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that a model gave, as the ids that they stand for, or what is wrong with them."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c-"), "o_custkey").alias("subject"))
    given = table(spark, sf_dir, "lineitem").where("l_quantity > 47").join(own, "l_orderkey").select("subject", F.format_string("K%03d", "l_linenumber").alias("reference"))
    batches = dc.selection_batches(knowledge(spark, sf_dir))
    good, bad = dc.resolve_references(given, batches)
    named = good.join(batches.select("subject", "id", "reference"), ["subject", "id"]).select("subject", "reference", F.col("id").alias("found"))
    return named.unionByName(bad.select("subject", "reference", F.col("reason").alias("found")))


@query("""WITH c AS (SELECT doc_id, 'p' || doc_id AS path, n_chars AS size, doc_id % 7 AS mtime FROM documents), s AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'old' || doc_id ELSE 'p' || doc_id END AS path, CASE WHEN doc_id % 4 = 0 THEN n_chars - 1 ELSE n_chars END AS size, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE doc_id % 7 END AS mtime FROM documents WHERE doc_id % 11 <> 0)
    SELECT c.path, CASE WHEN s.doc_id IS NULL THEN 'reparse' WHEN s.path <> c.path AND s.size = c.size AND c.doc_id % 6 <> 0 THEN 'relocate' WHEN s.path <> c.path THEN 'reparse' WHEN c.size = s.size AND c.mtime = s.mtime THEN 'reuse' WHEN c.size > s.size AND c.doc_id % 6 <> 0 THEN 'resume' ELSE 'reparse' END AS decision FROM c LEFT JOIN s ON s.doc_id = c.doc_id""")
def cache_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each log, by what was last seen of it: unchanged, moved, grown or rewritten."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    first = F.concat(F.lit("first"), "doc_id").alias("first_record_hash")
    now = d.select(F.concat(F.lit("p"), "doc_id").alias("path"), F.col("n_chars").alias("size"), (i % 7).alias("mtime"), first, F.lit("b").alias("boundary_hash"))
    seen = d.where("doc_id % 11 <> 0").select(F.concat(F.when(i % 9 == 0, "old").otherwise("p"), "doc_id").alias("path"), F.when(i % 4 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars")).alias("size"), F.when(i % 5 == 0, F.lit(-1)).otherwise(i % 7).alias("mtime"), first, F.when(i % 6 == 0, "other").otherwise("b").alias("boundary_hash"))
    return logs.cache_decision(now, seen).select("path", "decision")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'b' || page_id || '-c-d-e-f' ELSE 'plain-' || page_id END AS session, CASE WHEN page_id % 3 = 0 OR page_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS agent FROM pages")
def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and agents by the names of log files."""
    i = F.col("page_id")
    folder = F.when(i % 2 == 0, "/home/u/.codex/").otherwise("/home/u/.claude/")
    path = F.concat(folder, F.when(i % 3 == 0, F.concat(F.lit("rollout-2024-01-02-b"), i, F.lit("-c-d-e-f"))).otherwise(F.concat(F.lit("plain-"), i)), F.lit(".jsonl"))
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", ids.session_from_path(F.col("path")).alias("session"), ids.infer_agent(F.col("path")).alias("agent"))


@query("SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576) ELSE printf('%.1f GiB', n / 1073741824) END AS size FROM (SELECT event_id, event_id * event_id * 131 + 7 AS n FROM events)")
def byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of bytes as people read them."""
    return table(spark, sf_dir, "events").select("event_id", tx.format_bytes(F.col("event_id") * F.col("event_id") * 131 + 7).alias("size"))


@query("SELECT round(count(*) FILTER (WHERE ok) / count(*), 6) AS success_rate, round(sum(correct) / sum(selected), 6) AS precision, round(count(*) FILTER (WHERE kind = 'negative' AND selected > 0) / count(*) FILTER (WHERE kind = 'negative'), 6) AS false_acceptance, round(count(*) FILTER (WHERE kind = 'positive' AND correct > 0) / count(*) FILTER (WHERE kind = 'positive'), 6) AS recall, sum(attempts - 1)::BIGINT AS retries FROM (SELECT CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS kind, doc_id % 17 <> 0 AS ok, doc_id % 3 + 1 AS attempts, doc_id % 5 AS selected, quality * (doc_id % 5) AS correct FROM labels)")
def selection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of an agent's selections over all labels as cases."""
    i = F.col("doc_id")
    a = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("kind"), (i % 17 != 0).alias("ok"), (i % 3 + 1).alias("attempts"), (i % 5).alias("selected"), (F.col("quality") * (i % 5)).alias("correct"))
    out = ev.selection_metrics(a)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("SELECT c_custkey, list_filter(['AUTOMOBILE', c_mktsegment, 'x' || c_nationkey % 3], lambda t: t NOT IN ('AUTOMOBILE', 'BUILDING', 'x0', 'x1')) AS unknown FROM customer WHERE len(list_filter([c_mktsegment, 'x' || c_nationkey % 3], lambda t: t NOT IN ('AUTOMOBILE', 'BUILDING', 'x0', 'x1'))) > 0")
def unknown_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that no master defines."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("AUTOMOBILE"), "c_mktsegment", F.concat(F.lit("x"), F.col("c_nationkey") % 3)).alias("types"))
    return rc.unknown_types(rows, ["AUTOMOBILE", "BUILDING", "x0", "x1"]).withColumnRenamed("id", "c_custkey")


@query("WITH d AS (SELECT doc_id, text, doc_id % 3 = 0 AS f FROM documents) SELECT doc_id, CASE WHEN f THEN trim(left(coalesce(text, ''), 20)) ELSE trim(source) END AS text FROM d JOIN documents USING (doc_id)".replace("left(coalesce(text, ''), 20)", "left(coalesce(d.text, ''), 20)"))
def representative_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a row in vector search: a summary for turns, else the claim."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "feedstock").otherwise("knowledge").alias("kind"), F.substring(F.coalesce("text", F.lit("")), 1, 20).alias("summary"), F.concat(F.lit(" "), "source").alias("claim"))
    return d.select("doc_id", sync.representative().alias("text"))


@query(f"WITH {KNOWLEDGE} SELECT DISTINCT subject FROM ks WHERE NOT organized")
def pending_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with unorganized knowledge."""
    return og.pending_subjects(knowledge(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE trim(coalesce(CASE WHEN doc_id % 2 = 0 THEN left(text, 3) ELSE CASE WHEN doc_id % 5 <> 0 THEN source END END, '')) <> '') AS with_text, count(*) FILTER (WHERE trim(coalesce(CASE WHEN doc_id % 2 = 0 THEN left(text, 3) ELSE CASE WHEN doc_id % 5 <> 0 THEN source END END, '')) = '') AS without_text FROM documents")
def embeddable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have a text to encode: half are turns, of the others every fifth has no claim."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(F.when(i % 2 == 0, "feedstock").otherwise("knowledge").alias("kind"), F.substring("text", 1, 3).alias("summary"), F.when(i % 5 != 0, F.col("source")).alias("claim"))
    return sync.embeddable(d)


@query("WITH e AS (SELECT event_id AS n, event_type AS t FROM events) SELECT count(*) FILTER (WHERE t = 'click' AND n % 10 <> 0) AS turns, coalesce(sum(n) FILTER (WHERE t = 'click' AND n % 10 <> 0), 0)::BIGINT AS input_tokens, coalesce(sum(n // 2) FILTER (WHERE t = 'click' AND n % 10 <> 0), 0)::BIGINT AS cached_input_tokens, 0::BIGINT AS cache_write_input_tokens, coalesce(sum(7) FILTER (WHERE t = 'click' AND n % 10 <> 0), 0)::BIGINT AS output_tokens, 0::BIGINT AS reasoning_output_tokens, count(*) FILTER (WHERE t = 'view' AND n % 10 <> 0 AND n % 7 > 2) AS commands FROM e")
def event_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and commands of event logs, of which every tenth line is broken; some commands are lists, numbers or null, which count as none."""
    n = F.col("event_id").cast("long")
    usage = F.struct(n.alias("input_tokens"), F.floor(n / 2).alias("cached_input_tokens"), F.lit(7).alias("output_tokens"))
    kind = F.when(F.col("event_type") == "click", "turn.completed").when(F.col("event_type") == "view", "item.completed").otherwise("item.started")
    raw = F.to_json(F.struct(kind.alias("type"), F.when(F.col("event_type") == "click", usage).alias("usage"), F.struct(F.when(F.col("event_type") == "view", "command_execution").otherwise("reasoning").alias("type"), F.lit("ls").alias("command")).alias("item")))
    for k, other in enumerate(('["ls","-l"]', "7", "null")):
        raw = F.when(n % 7 == k, F.replace(raw, F.lit('"command":"ls"'), F.lit(f'"command":{other}'))).otherwise(raw)
    lines = table(spark, sf_dir, "events").select(F.when(n % 10 == 0, F.substring(raw, 1, 9)).otherwise(raw).alias("raw"))
    return ev.event_log_totals(lines)


@query("WITH s AS (SELECT DISTINCT conv_id, '/logs/' || CASE WHEN conv_id % 4 = 0 THEN 'x' ELSE '' END || conv_id || '.jsonl' AS path, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN conv_id % 4 = 0 THEN 'x' ELSE '' END || conv_id ELSE 's' || conv_id END AS session_id FROM conversations) SELECT session_id, path FROM s WHERE conv_id % 5 <> 0 UNION ALL SELECT 'nowhere', NULL")
def found_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of wanted sessions, by the sessions that they name or their files' names, and a session that none has."""
    c = table(spark, sf_dir, "conversations")
    i = F.col("conv_id")
    path = F.concat(F.lit("/logs/"), F.when(i % 4 == 0, "x").otherwise(""), i, F.lit(".jsonl"))
    raw = F.to_json(F.struct(F.lit("user").alias("type"), F.when((i % 3 != 0) & (F.col("turn") > 0), F.concat(F.lit("s"), i)).alias("sessionId")))
    lines = c.select(F.lit("claude").alias("agent"), path.alias("path"), F.col("turn").alias("line"), raw.alias("raw"))
    catalog = logs.session_catalog(lines.select("agent", "path").distinct(), logs.named_sessions(lines))
    wanted = catalog.join(c.where(i % 5 != 0).select(path.alias("path")).distinct(), "path", "left_semi").select("agent", "session_id").unionByName(spark.createDataFrame([("claude", "nowhere")], "agent string, session_id string"))
    found, missing = logs.find_sessions(catalog, wanted)
    return found.select("session_id", "path").unionByName(missing.select("session_id", F.lit(None).cast("string").alias("path")))


@query("SELECT 's' || doc_id AS subject, CASE WHEN doc_id % 7 <> 0 THEN sha256(coalesce(text, '')) END AS body_sha256, CASE WHEN doc_id % 7 = 0 THEN 'subject is other, want s' || doc_id END AS reason FROM documents WHERE doc_id % 7 = 0 OR trim(coalesce(text, '')) <> ''")
def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as record files, one folder a subject, and read back; the heads of one in seven name another subject."""
    root = shared_path(spark, "records")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), "doc_id").alias("_at"), F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.concat(F.lit("s"), "doc_id")).alias("subject"), F.lit("page").alias("template"), F.array(F.concat(F.lit("k"), "doc_id")).alias("knowledge"), F.coalesce("text", F.lit("")).alias("body"))
    rows = d.select(F.concat(F.lit("documents/"), "_at", F.lit("/page.md")).alias("path"), markdown.render(["subject", "template", "knowledge"], F.col("body")).alias("content"), F.lit(None).cast("string").alias("expected"))
    refused = record_files.write_files(rows, root).where(F.col("outcome") != record_files.WRITTEN).count()
    if refused:
        raise RuntimeError(f"{refused} files were not written")
    templates = spark.createDataFrame([("page", "page.md")], "name string, output string")
    rows = record_files.judged_documents(spark, root, templates)
    fine = F.col("reason").isNull()
    # A document without a body is refused, as its head was right.
    told = rows.where(fine | F.startswith("reason", F.lit("subject is")))
    return told.select(F.when(fine, F.col("subject")).otherwise(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)).alias("subject"), F.when(fine, F.sha2(F.col("body").cast("binary"), 256)).alias("body_sha256"), "reason")
