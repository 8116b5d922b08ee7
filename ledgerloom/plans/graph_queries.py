"""The life of knowledge over orders, organizing, and documents made from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as dc
from ..operators import lifecycle as lc
from ..operators import organize as og
from ..operators import records as rc
from ..session import checkpoint
from .registry import query
from .tables import KNOWLEDGE, knowledge, table

NOW = datetime(2024, 6, 1)

_HEADS = f"""{KNOWLEDGE},
    cur AS (SELECT * FROM ks WHERE organized AND status IN ('active', 'pending')),
    heads AS (SELECT * FROM cur WHERE id NOT IN (SELECT unnest(supersedes) FROM cur))"""
_EDGES = f"""{KNOWLEDGE},
    ed AS (SELECT DISTINCT id, status, unnest(supersedes) AS target FROM ks WHERE organized)"""


@query(f"WITH {KNOWLEDGE} SELECT id, status FROM ks")
def effective_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.with_status(knowledge(spark, sf_dir)).select("id", "status")


@query(f"WITH {KNOWLEDGE} SELECT id FROM ks WHERE status IN ('active', 'invalidated', 'superseded')")
def status_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and retired knowledge, without pending."""
    from ..operators.search import visible_statuses

    return lc.with_status(knowledge(spark, sf_dir)).where(F.col("status").isin(visible_statuses(retired=True))).select("id")


@query(f"WITH {_HEADS} SELECT id, subject, status FROM heads")
def knowledge_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.heads(knowledge(spark, sf_dir)).select("id", "subject", "status")


@query(f"WITH {_HEADS} SELECT subject, lower(statement) AS claim, count(*) AS n, list_sort(list(id)) AS ids FROM heads GROUP BY ALL HAVING count(*) > 1")
def duplicate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.duplicate_claims(knowledge(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT target AS predecessor, count(DISTINCT id) AS n FROM ed WHERE status IN ('active', 'pending') GROUP BY target HAVING count(DISTINCT id) > 1")
def multi_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.multiple_successors(knowledge(spark, sf_dir))


_CYCLES = """g AS (SELECT 'k-' || o_orderkey AS src, 'k-' || CASE WHEN o_orderpriority = '1-URGENT' AND next IS NOT NULL THEN next ELSE prev END AS dst FROM o WHERE CASE WHEN o_orderpriority = '1-URGENT' AND next IS NOT NULL THEN next ELSE prev END IS NOT NULL)"""


@query(f"WITH {KNOWLEDGE}, {_CYCLES} SELECT DISTINCT a.src AS id FROM g a JOIN g b ON a.dst = b.src AND b.dst = a.src")
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on cycles, where urgent ones point to the customer's next order and others to the one before: neighbours that point at each other."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumns({"prev": F.lag("o_orderkey").over(w), "next": F.lead("o_orderkey").over(w)})
    key = lambda c: F.concat(F.lit("k-"), c)
    to = F.when((F.col("o_orderpriority") == "1-URGENT") & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("prev"))
    return lc.on_cycles(o.select(key("o_orderkey").alias("src"), key(to).alias("dst")).where("dst is not null"))


_RECONCILE = f"""{KNOWLEDGE},
    org AS (SELECT * FROM ks WHERE organized),
    held AS (SELECT DISTINCT unnest(supersedes) AS id, id AS holder FROM org WHERE status <> 'invalidated'),
    st AS (SELECT o.* EXCLUDE (superseded_by, status), lost, CASE WHEN lost THEN '' ELSE o.superseded_by END AS superseded_by, CASE WHEN lost THEN 'pending' ELSE o.status END AS status
        FROM (SELECT o.*, o.status = 'superseded' AND NOT o.approved AND NOT o.invalidated AND h.id IS NULL AS lost FROM org o LEFT JOIN held h ON h.id = o.id AND h.holder = o.superseded_by) o),
    ln AS (SELECT DISTINCT id, status AS by_status, unnest(supersedes) AS target FROM st WHERE status IN ('active', 'pending')),
    jd AS (SELECT ln.*, st.status AS target_status, st.superseded_by AS named FROM ln LEFT JOIN st ON st.id = ln.target),
    el AS (SELECT target, target_status, named, count(*) AS n, min(id) AS id FROM jd WHERE target_status <> 'invalidated' AND (by_status = 'active' OR target_status = 'pending') GROUP BY ALL)"""


@query(f"WITH {_RECONCILE}, re AS (SELECT target AS id, id AS successor FROM el WHERE n = 1 AND target_status <> 'superseded') SELECT st.id, CASE WHEN re.successor IS NOT NULL THEN 'superseded' ELSE st.status END AS status, coalesce(re.successor, st.superseded_by, '') AS superseded_by FROM st LEFT JOIN re ON re.id = st.id WHERE lost OR re.successor IS NOT NULL")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that reconciling changes: restored ones, and those that exactly one eligible row supersedes."""
    changed, _ = lc.reconcile(knowledge(spark, sf_dir), NOW)
    return changed.select("id", "status", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"))


@query(f"WITH {_RECONCILE} SELECT id, 'target does not exist' AS issue FROM jd WHERE target_status IS NULL UNION ALL SELECT target, 'multiple eligible successors' FROM el WHERE n > 1 UNION ALL SELECT target, 'already superseded by another' FROM el WHERE n = 1 AND target_status = 'superseded' AND named IS DISTINCT FROM id")
def reconcile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.reconcile(knowledge(spark, sf_dir), NOW)[1]


@query(f"""WITH {_EDGES}, {_HEADS.split(KNOWLEDGE + ',')[1]}
    SELECT DISTINCT id, 'supersedes missing knowledge' AS issue FROM ed WHERE target NOT IN (SELECT id FROM ks WHERE organized) AND id <> target
    UNION SELECT id, 'inconsistent superseded_by' FROM ks WHERE organized AND superseded_by <> '' AND (superseded_by, id) NOT IN (SELECT (id, target) FROM ed)
    UNION SELECT target, 'multiple current successors' FROM ed WHERE status IN ('active', 'pending') GROUP BY target HAVING count(DISTINCT id) > 1
    UNION SELECT unnest(ids), 'duplicate current claim' FROM (SELECT list(id) AS ids FROM heads GROUP BY subject, lower(statement) HAVING count(*) > 1)""")
def graph_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with the supersession graph."""
    return lc.validate_graph(knowledge(spark, sf_dir))


def _organizing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unorganized orders against the organized, by an action that follows from their status and price."""
    kn = knowledge(spark, sf_dir).withColumns({"order_key": F.concat(F.date_format("created", "yyyyMMdd"), "id"), "supersedes": F.array().cast("array<string>"), "superseded_by": F.lit(""), "statement": F.concat_ws(" ", "statement", "id")})
    inputs, old = kn.where("organized_at is null"), kn.where("organized_at is not null")
    head = lc.heads(old).groupBy("subject").agg(F.min("id").alias("head"))
    joined = inputs.join(head, "subject", "left")
    price = table(spark, sf_dir, "orders").select(F.concat(F.lit("k-"), "o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    joined = joined.join(price, "id")
    kind = F.when(F.col("head").isNull(), "new").when(F.col("o_totalprice") < 50000, "discard").when(F.col("o_orderstatus") == "F", "equivalent").when(F.col("o_orderstatus") == "P", "complements").otherwise("conflicts")
    acts = joined.withColumn("kind", kind)
    named = F.col("kind").isin("equivalent", "complements", "conflicts")
    draft = F.col("kind") == "complements"
    actions = acts.select(F.col("id").alias("knowledge_id"), "kind", F.when(named, F.array("head")).otherwise(F.array().cast("array<string>")).alias("knowledge_ids"), F.when(draft, "decision").alias("draft_type"), F.when(draft, F.concat_ws(" ", F.lit("merged"), "id")).alias("draft_statement"))
    return inputs, old, actions


@query()
def organize_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of organizing, subject by subject in time."""
    return og.organize(*_organizing(spark, sf_dir)).select("subject", "input_id", "knowledge_id", "outcome", "supersedes", "retires", "error")


@query(f"WITH {KNOWLEDGE} SELECT DISTINCT subject, '{og.CHANGED}' AS error FROM ks WHERE NOT organized AND substr(subject, 3)::BIGINT % 3 = 0 AND subject IN (SELECT subject FROM ks WHERE organized AND NOT invalidated)")
def organize_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects whose plan is refused, as a third of them had other statements when it was made."""
    inputs, now, actions = _organizing(spark, sf_dir)
    other = F.expr("cast(substring(subject, 3) as long) % 3 = 0")
    before = now.withColumn("statement", F.when(other, F.concat("statement", F.lit(" before"))).otherwise(F.col("statement")))
    done = og.organize_planned(inputs, now, actions, og.subject_digests(inputs, before))
    return done.where(F.col("error") == og.CHANGED).select("subject", "error")


@query("WITH i AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderpriority = '5-LOW'), a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'), n AS (SELECT id, count(*) AS n FROM a GROUP BY id) SELECT coalesce(i.id, n.id) AS knowledge_id, CASE WHEN n.n IS NULL THEN 'omitted' WHEN i.id IS NULL THEN 'unknown' ELSE 'repeated' END AS problem FROM i FULL JOIN n ON i.id = n.id WHERE n.n IS NULL OR i.id IS NULL OR n.n > 1")
def action_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs without, and actions that are unknown or repeated."""
    o = table(spark, sf_dir, "orders")
    inputs = o.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("id"))
    actions = o.where("o_orderstatus <> 'O'").unionByName(o.where("o_orderstatus = 'P'")).select(F.col("o_orderkey").alias("knowledge_id"))
    return rc.one_action_each(inputs, actions)


_EVIDENCE = "e AS (SELECT l_orderkey, list_sort(list(DISTINCT 'p-' || l_partkey)) AS parts FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)"


@query(f"WITH {KNOWLEDGE}, {_EVIDENCE} SELECT ks.id, CASE WHEN e.parts IS NOT NULL AND status IN ('active', 'pending') THEN list_sort(list_distinct(list_concat(['fs-' || substr(ks.id, 3)], e.parts))) ELSE ['fs-' || substr(ks.id, 3)] END AS feedstocks FROM ks LEFT JOIN e ON 'k-' || l_orderkey = ks.id")
def add_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence added to rows that are not retired: a set union."""
    more = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("k-"), "l_orderkey").alias("id"), F.concat(F.lit("p-"), "l_partkey").alias("feedstock"))
    return rc.add_evidence(knowledge(spark, sf_dir), more, NOW).select("id", "feedstocks")


@query(f"WITH {KNOWLEDGE} SELECT id, CASE WHEN organized AND status IN ('pending', 'active') AND 'k-' || l_orderkey = id THEN 'invalidated' ELSE status END AS status FROM ks LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 50) ON 'k-' || l_orderkey = id")
def invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organized, current rows of large orders invalidated."""
    ids = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.concat(F.lit("k-"), "l_orderkey").alias("id"))
    return lc.with_status(rc.invalidate(knowledge(spark, sf_dir), ids, NOW)).select("id", "status")


@query("SELECT 'k-' || o_orderkey AS id, max(l_shipdate) AS last_evidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def last_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turn that each row cites."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_orderkey", F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"))
    cited = lines.groupBy("l_orderkey").agg(F.collect_set("id").alias("feedstocks")).select(F.concat(F.lit("k-"), "l_orderkey").alias("id"), "feedstocks")
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("k-"), "o_orderkey").alias("id"))
    return rc.last_evidence(cited.join(orders, "id", "left_semi"), lines)


@query("SELECT 'k-' || l_orderkey AS id, 'o-' || l_partkey AS reference FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to rows that are not among the finished orders."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("k-"), "l_orderkey").alias("id")).agg(F.collect_set(F.concat(F.lit("o-"), "l_partkey")).alias("refs"))
    targets = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o-"), "o_orderkey").alias("id"))
    return rc.missing_references(rows, "refs", targets)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as subjects, whose documents are those of their region and one more."""
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = table(spark, sf_dir, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    return n.select(F.col("s_name").alias("name"), F.array(F.col("r_name"), F.lit("SUMMARY")).alias("documents"))


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lower("r_name"), F.lit(".md")).alias("output"), F.when(F.col("r_regionkey") == 0, "always").otherwise("subject").alias("inject"))


_JOBS = "j AS (SELECT s_name AS subject, r_name AS template FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), c AS (SELECT max(subject) AS cursor FROM j WHERE subject < (SELECT max(subject) FROM j))"


@query(f"WITH {_JOBS} SELECT subject, template, row_number() OVER (ORDER BY (subject, template) > (cursor, '') DESC, subject, template)::INTEGER AS rank FROM j, c QUALIFY rank <= 100")
def round_robin_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred jobs behind a cursor at the last subject but one."""
    good, _ = dc.jobs(_subjects(spark, sf_dir), _templates(spark, sf_dir))
    last = [r["subject"] for r in good.select("subject").distinct().orderBy(F.desc("subject")).limit(2).collect()]
    cursor = (last[-1], "")
    rows = dc.next_jobs(good, 100, cursor)
    behind = F.struct("subject", "template") > F.struct(F.lit(cursor[0]).alias("subject"), F.lit("").alias("template"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(behind), "subject", "template")))


@query("SELECT s_name AS subject, 'SUMMARY' AS template FROM supplier")
def missing_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that subjects are assigned and that do not exist."""
    return dc.jobs(_subjects(spark, sf_dir), _templates(spark, sf_dir))[1]


@query(f"WITH {KNOWLEDGE}, r AS (SELECT id, subject, row_number() OVER (PARTITION BY subject ORDER BY id) AS place FROM ks WHERE organized AND status = 'active') SELECT id, subject, ((place - 1) // 50)::INTEGER AS batch, 'K' || CASE WHEN place < 1000 THEN lpad(place::VARCHAR, 3, '0') ELSE place::VARCHAR END AS reference FROM r")
def batch_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active knowledge in selection batches of 50 a subject, with references."""
    return dc.selection_batches(knowledge(spark, sf_dir)).select("id", "subject", "batch", "reference")


_HOSTS = "u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*/([^/?#]*)', 1) AS part FROM pages)"
#: Aliases with stars, single characters, classes and escapes, and the regular expressions that SQL has for them.
ALIASES = {
    "*.example.com": r"[^/]*\.example\.com", "m.*.example.net": r"m\.[^/]*\.example\.net", "www.*.example.org": r"www\.[^/]*\.example\.org", "*[02468].example.*": r"[^/]*[02468]\.example\.[^/]*", "*[^0-5].example.???": r"[^/]*[^0-5]\.example\.[^/][^/][^/]",
    r"\*.example.com": r"\*\.example\.com", r"*e\x[a-bm]mple.*": r"[^/]*ex[a-bm]mple\.[^/]*", "*[": "(^$a)",
}


@query(f"WITH {_HOSTS}, p AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{r}')" for a, r in ALIASES.items())}) t(alias, regex)) SELECT page_id, alias FROM u JOIN p ON regexp_full_match(host, regex)")
def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages matched by aliases with wild cards, classes and escapes."""
    hosts = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"))
    aliases = checkpoint(spark.createDataFrame([(a,) for a in ALIASES], "alias string").withColumn("regex", tx.glob_regex("alias")))
    return hosts.join(F.broadcast(aliases), tx.alias_matches(F.col("alias"), F.col("host"), F.col("regex"))).select("page_id", "alias")


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT id AS src, target AS dst FROM ed WHERE status IN ('active', 'pending') UNION SELECT r.src, ed.target FROM r JOIN ed ON r.dst = ed.id)
    SELECT src, dst FROM r""")
def supersession_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that current knowledge supersedes, directly or through others, whatever their status."""
    links = lc.edges(knowledge(spark, sf_dir).where("organized_at is not null"))
    graph = links.select(F.col("id").alias("src"), F.col("predecessor").alias("dst"))
    return lc.reachable(graph, spread=links.where("status in ('active', 'pending')").select(F.col("id").alias("src")))


@query()
def context_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session in each language, as a subject, is given from all documents: the newest excerpt of each source that fits, and a notice of those that don't."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("subject"), F.coalesce("source", F.lit("")).alias("template"), "doc_id", tx.excerpt(F.coalesce("text", F.lit(""))).alias("body"))
    newest = docs.groupBy("subject", "template").agg(F.max_by("body", "doc_id").alias("body"))
    sessions = newest.select(F.col("subject").alias("session"), F.lit(1).alias("section"), "subject", "template", F.concat(F.lit("## "), "subject").alias("heading"), F.concat(F.lit("### "), "template", F.lit("\n\n"), "body", F.lit("\n")).alias("block"))
    return dc.inject(sessions, "# Session context\n", 1000)


@query(f"WITH {KNOWLEDGE}, d AS (SELECT 'c-' || o_custkey AS subject, o_orderstatus AS template, list('k-' || o_orderkey) AS ids FROM orders GROUP BY ALL) SELECT d.subject, d.template, count(*) AS cited, count(*) FILTER (WHERE ks.organized AND ks.status = 'active') AS current FROM (SELECT subject, template, unnest(ids) AS id FROM d) d JOIN ks USING (id) GROUP BY ALL")
def document_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what documents cite is still active."""
    docs = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c-"), "o_custkey").alias("subject"), F.col("o_orderstatus").alias("template")).agg(F.collect_list(F.concat(F.lit("k-"), "o_orderkey")).alias("knowledge_ids"))
    return dc.document_evidence(docs, knowledge(spark, sf_dir))
