"""Whole runs over conversations and orders, each run twice: what failed or waits is taken up again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as dc
from ..operators import organize as og
from ..operators import run_plans as rp
from ..operators.run_store import RunStore
from ..session import checkpoint, shared_path
from .registry import query
from .tables import KNOWLEDGE, knowledge, table

NOW = datetime(2024, 6, 1)
_FEEDSTOCKS = "id string, turn_id string, session_id string, timestamp timestamp, agent string, source_sequence long, summary string, types array<string>, drafted_at timestamp, extracted_at timestamp"
_CLAIMS = "id string, established_by string, type string, subject string, statement string, rationale string, feedstocks array<string>, approved boolean, supersedes array<string>, created timestamp, updated timestamp"


def _results(task: str, rows: DataFrame, result: Column, digest: str | None = None) -> DataFrame:
    return rows.select(F.lit(task).alias("task"), "key", result.alias("result"), (F.col(digest) if digest else F.lit(None).cast("string")).alias("digest"))


@query("""WITH t AS (SELECT 't' || conv_id || '-' || turn AS id, conv_id, (conv_id + turn) % 5 AS m FROM conversations WHERE role = 'user')
    SELECT id, CASE WHEN m = 1 THEN 'waiting' ELSE 'done' END AS draft_state, CASE WHEN m = 4 THEN 'failed' WHEN m <> 1 THEN 'done' END AS extract_state, m = 2 AS second, CASE WHEN m <> 1 THEN 'about ' || conv_id END AS summary, CASE WHEN m = 0 THEN 2 ELSE 0 END::BIGINT AS claims FROM t""")
def resumed_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of users drawn in two runs. Of five, one has no result, one an unknown type at first, one no types, and one claims that are of no known type."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumns({"id": F.concat_ws("-", F.concat(F.lit("t"), "conv_id"), "turn"), "_m": (F.col("conv_id") + F.col("turn")) % 5})
    candidates = c.select(
        "id", F.col("id").alias("turn_id"), F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("timestamp"), F.lit("claude").alias("agent"), *(F.lit("").alias(x) for x in ("cwd", "repo", "branch")),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("dialogue"), F.col("turn").alias("source_sequence"), F.lit("").alias("source_owner_session_id"), F.col("conv_id").cast("string").alias("path"),
    )
    c = c.withColumnRenamed("id", "key")
    draft = lambda kind: F.to_json(F.struct(F.concat(F.lit("about "), "conv_id").alias("summary"), kind.alias("types")))
    typed, none = F.array(F.lit("rule")), F.array().cast("array<string>")
    kinds = F.when(F.col("_m") == 2, F.array(F.lit("odd"))).when(F.col("_m") == 3, none).otherwise(typed)
    made = lambda n: F.struct(F.when(F.col("_m") == 4, "odd").otherwise("rule").alias("type"), F.lit("").alias("subject"), F.concat(F.lit(f"claim {n} of "), "key").alias("statement"), F.lit("").alias("rationale"))
    extracted = _results("extract", c.where("_m in (0, 4)"), F.to_json(F.struct(F.array(made(1), made(2)).alias("knowledge"))))
    first = _results("draw", c.where("_m <> 1"), draft(kinds)).unionByName(extracted)
    second = _results("draw", c.where("_m = 2"), draft(none)).unionByName(extracted)
    store = RunStore(spark, shared_path(spark, "draw"))
    store.create({"feedstocks": (spark.createDataFrame([], _FEEDSTOCKS), "id"), "knowledge": (spark.createDataFrame([], _CLAIMS), "id")})
    rp.draw_run(store, candidates, first, ["rule"], [], NOW)
    before = store.version
    rp.draw_run(store, candidates, second, ["rule"], [], NOW)
    steps = store.steps()
    of = lambda step, name: steps.where(F.col("step") == step).select(F.col("key").alias("id"), F.col("state").alias(name), (F.col("run") > before).alias(f"_{name}"))
    claims = store.table("knowledge").groupBy(F.col("established_by").alias("id")).agg(F.count(F.lit(1)).alias("claims"))
    out = store.table("feedstocks").join(of("draft", "draft_state"), "id", "left").join(of("extract", "extract_state"), "id", "left").join(claims, "id", "left")
    return out.select("id", "draft_state", "extract_state", (F.col("_draft_state") & (F.col("draft_state") == "done")).alias("second"), "summary", F.coalesce("claims", F.lit(0).cast("long")).alias("claims"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as knowledge without a past, whose statements differ."""
    none = F.lit(None).cast("timestamp_ntz")
    own = knowledge(spark, sf_dir).withColumns({"order_key": F.concat(F.date_format("created", "yyyyMMdd"), "id"), "supersedes": F.array().cast("array<string>"), "superseded_by": F.lit(""), "superseded_at": none, "statement": F.concat_ws(" ", "statement", "id"), "rationale": F.lit("")})
    return own.withColumn("established_by", F.get("feedstocks", F.lit(0)))


@query(f"""WITH {KNOWLEDGE}, s AS (SELECT subject, substr(subject, 3)::BIGINT % 5 AS m, count(*) FILTER (WHERE organized) AS old, count(*) FILTER (WHERE NOT organized) AS new FROM ks GROUP BY subject HAVING count(*) FILTER (WHERE NOT organized) > 0)
    SELECT subject, CASE m WHEN 0 THEN 'waiting' WHEN 2 THEN 'failed' ELSE 'done' END AS state, CASE WHEN m = 2 THEN '{og.CHANGED}' END AS reason, m <= 2 AS again, old + CASE WHEN m IN (0, 2) THEN 0 ELSE new END AS organized FROM s""")
def resumed_brew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' unorganized orders organized in two runs. Of five customers one has no plan, one at first something that is none, and one a plan that was made from other knowledge."""
    store = RunStore(spark, shared_path(spark, "brew"))
    store.create({"knowledge": (_orders(spark, sf_dir), "id")})
    k = store.table("knowledge")
    inputs = k.where("organized_at is null")
    digests = og.subject_digests(inputs, k.where("organized_at is not null"))
    resolution = F.struct(F.lit("new").alias("kind"), F.array().cast("array<string>").alias("knowledge_ids"), F.lit(None).cast("struct<type:string>").alias("draft"))
    plans = inputs.groupBy("subject").agg(F.collect_list(F.struct(F.col("id").alias("knowledge_id"), resolution.alias("resolution"))).alias("actions"))
    m = F.expr("cast(substring(subject, 3) as long) % 5")
    rows = plans.join(digests, "subject").withColumns({"key": F.col("subject"), "_m": m}).where("_m <> 0").withColumn("digest", F.when(F.col("_m") == 2, "another").otherwise(F.col("digest")))
    plan = F.to_json(F.struct("actions"))
    good = checkpoint(_results("brew", rows, plan, "digest").withColumn("_m", F.expr("cast(substring(key, 3) as long) % 5")))
    bad = good.withColumn("result", F.when(F.col("_m") == 1, F.concat("result", F.lit(" and more"))).otherwise(F.col("result")))
    rp.brew_run(store, bad.drop("_m"), ["decision"], NOW)
    before = store.version
    rp.brew_run(store, good.drop("_m"), ["decision"], NOW, retry=True)
    steps = store.steps().where("step = 'organize'").select(F.col("key").alias("subject"), "state", "reason", (F.col("run") > before).alias("again"))
    return steps.join(store.table("knowledge").groupBy("subject").agg(F.count("organized_at").alias("organized")), "subject")


# Groups of 25 customers are subjects, so that they have several batches; every third group's document cites its last order already.
_GROUPS = f"""{KNOWLEDGE}, g AS (SELECT substr(subject, 3)::BIGINT % 40 AS n, id, organized AND status = 'active' AS ok, statement FROM ks),
    j AS (SELECT DISTINCT n, 'g-' || n AS subject, 'a' AS template FROM g UNION ALL SELECT DISTINCT n, 'g-' || n, 'b' FROM g WHERE n % 10 = 0),
    ci AS (SELECT n, 'a' AS template, max(id) AS id FROM g WHERE n % 3 = 0 GROUP BY n),
    cand AS (SELECT j.subject, j.template, g.id, g.statement, row_number() OVER (PARTITION BY j.subject, j.template ORDER BY g.id) - 1 AS p FROM j JOIN g ON g.n = j.n AND ok WHERE NOT EXISTS (SELECT 1 FROM ci WHERE ci.n = j.n AND ci.template = j.template AND ci.id = g.id))"""


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(knowledge, subjects, templates, documents)."""
    n = F.expr("cast(substring(subject, 3) as long) % 40")
    k = knowledge(spark, sf_dir).withColumns({"_n": n, "subject": F.concat(F.lit("g-"), n), "rationale": F.lit("")})
    names = k.select("_n", "subject").distinct()
    assigned = F.when(F.col("_n") % 10 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("x"))).otherwise(F.array(F.lit("a")))
    cited = k.where("_n % 3 = 0").groupBy("subject").agg(F.array(F.max("id")).alias("knowledge_ids"))
    written = cited.select(F.concat("subject", F.lit("/a")).alias("key"), "subject", F.lit("a").alias("template"), "knowledge_ids", F.lit("before").alias("body"))
    templates = spark.createDataFrame([("a", "a.md", "decide"), ("b", "b.md", "list")], "name string, output string, purpose string")
    return k.drop("_n"), names.select(F.col("subject").alias("name"), assigned.alias("documents")), templates, written


@query(f"WITH {_GROUPS} SELECT subject || '/' || template || '/' || (p // 50 + 1) AS key, count(*) AS n, sha256(string_agg('K' || lpad((p % 50 + 1)::VARCHAR, 3, '0') || ' ' || statement, ',' ORDER BY id)) AS digest FROM cand GROUP BY ALL")
def selection_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of batches of candidates: how many they have, and a digest of references and claims."""
    k, subjects, templates, written = _groups(spark, sf_dir)
    rows = rp.selection_payloads(dc.jobs(subjects, templates)[0], templates, written, k)
    told = F.from_json("payload", "unselected_knowledge array<struct<reference:string,claim:string>>")["unselected_knowledge"]
    return rows.select("key", F.size(told).cast("long").alias("n"), F.sha2(F.array_join(F.transform(told, lambda x: F.concat_ws(" ", x["reference"], x["claim"])), ",").cast("binary"), 256).alias("digest"))


@query(f"""WITH {_GROUPS}, ev AS (SELECT subject, template, id FROM cand WHERE p % 50 = 0 AND template = 'a' UNION ALL SELECT 'g-' || n, template, id FROM ci JOIN (SELECT id FROM g WHERE ok) USING (id))
    SELECT 'done' AS state, NULL::VARCHAR AS reason, subject || '/' || template AS key, string_agg(id, ',' ORDER BY id) AS knowledge FROM ev GROUP BY ALL
    UNION ALL SELECT 'done', NULL, subject || '/' || template, NULL FROM j WHERE (subject, template) NOT IN (SELECT (subject, template) FROM ev)
    UNION ALL SELECT 'failed', 'preparation: template is not defined', 'g-' || n || '/x', NULL FROM (SELECT DISTINCT n FROM g WHERE n % 10 = 0)""")
def resumed_distill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of groups of customers in two runs: the first batches' results come with the first, all others with the second. Documents of the second template use nothing and are not written."""
    k, subjects, templates, written = _groups(spark, sf_dir)
    store = RunStore(spark, shared_path(spark, "distill"))
    store.create({"knowledge": (k, "id"), "documents": (written, "key")})
    root, candidates = rp.job_evidence(dc.jobs(subjects, templates)[0], store.table("documents"), store.table("knowledge"))
    batches = rp.selection_evidence(candidates).select(F.col("batch_key"), "key", "template", "batch").distinct()
    picked = batches.select(F.col("batch_key").alias("key"), "batch")
    select = _results("distill_select", picked, F.lit('{"knowledge_references": ["K001"]}'))
    sizes = root.select("key", "template").unionByName(batches.select("key", "template")).groupBy("key", "template").agg(F.count(F.lit(1)).alias("n"))
    references = F.when(F.col("template") == "a", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.format_string("K%03d", i))).otherwise(F.array().cast("array<string>"))
    body = F.when(F.col("template") == "a", "all of it").otherwise("")
    generate = _results("distill_generate", sizes, F.to_json(F.struct(body.alias("body"), references.alias("knowledge_references"))))
    every = checkpoint(select.unionByName(generate))
    rp.distill_run(store, subjects, templates, every.where("task = 'distill_generate' or endswith(key, '/1')"))
    rp.distill_run(store, subjects, templates, every, retry=True)
    steps = store.steps().where("step = 'distill'").select("key", "state", "reason")
    return steps.join(store.table("documents").select("key", F.array_join("knowledge_ids", ",").alias("knowledge")), "key", "left")
