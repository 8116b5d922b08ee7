"""Search over documents, messages, vectors and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import batch_search as bs
from ..operators import lifecycle as lc
from ..operators import runs
from ..operators import search as s
from ..operators.text_index import TextIndex
from ..session import shared_path
from .registry import query
from .tables import EVENTS, INDEX, KNOWLEDGE, VECTORS, event_rows, index_rows, knowledge, micros, query_vector, table, vector_rows

TERMS = ("the", "erin")
DEPTH = 51
DAY_NS = 86_400_000_000_000
START_NS = 1_704_067_200_000_000_000  # 2024-01-01

_MATCH = " AND ".join(f"(contains(lower(summary), '{t}') OR contains(lower(searchable), '{t}'))" for t in TERMS)


def _tf(term: str) -> str:
    count = lambda c: f"(length({c}) - length(replace(lower({c}), '{term}', ''))) / {len(term)}"
    return f"({count('summary')} + {count('searchable')})"


_RANKED = f"""m AS (SELECT *, {', '.join(f"{_tf(t)}::DOUBLE AS tf{k}" for k, t in enumerate(TERMS))}, greatest(length(summary) - 2, 0) + greatest(length(searchable) - 2, 0) AS len FROM idx),
    t AS (SELECT count(*) AS n, avg(len) AS al, {', '.join(f"count(*) FILTER (WHERE tf{k} > 0) AS df{k}" for k in range(len(TERMS)))} FROM m),
    scored AS (SELECT id, kind, timestamp_ns, {' + '.join(f"(CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{k} + 0.5) / (df{k} + 0.5)) END) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * len / al))" for k in range(len(TERMS)))} AS score
        FROM m, t WHERE {' AND '.join(f'tf{k} > 0' for k in range(len(TERMS)))}),
    text_branch AS (SELECT id, row_number() OVER (ORDER BY score DESC, timestamp_ns DESC, id) AS rank, score FROM scored WHERE kind = 'document' QUALIFY rank <= {DEPTH}),
    {VECTORS},
    vector_branch AS (SELECT v.id, row_number() OVER (ORDER BY list_inner_product(embedding, q) DESC, v.id) AS rank, list_inner_product(embedding, q) AS score FROM vecs v JOIN idx USING (id), query QUALIFY rank <= {DEPTH}),
    fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM (SELECT id, rank FROM text_branch UNION ALL SELECT id, rank FROM vector_branch) GROUP BY id),
    hybrid AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM fused)"""
_BM25 = f"WITH {INDEX}, {_RANKED}"


def _options(**more) -> s.Options:
    return s.Options(**{"kind": "document", "keywords": TERMS, "mode": "text", "limit": DEPTH - 1} | more)


@query(f"WITH {INDEX} SELECT id FROM idx WHERE kind = 'document' AND {_MATCH}")
def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold every term."""
    return s.eligible(index_rows(spark, sf_dir), _options()).where(s.matches([*TERMS])).select("id")


@query(f"{_BM25} SELECT id, rank::INTEGER AS rank, round(score, 6) AS score FROM text_branch")
def text_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents by BM25 over the index of all kinds."""
    return s.text_branch(index_rows(spark, sf_dir), _options(), DEPTH).withColumn("score", F.round("score", 6))


@query(f"WITH {INDEX} SELECT id, row_number() OVER (ORDER BY timestamp_ns DESC, id)::INTEGER AS rank FROM idx WHERE kind = 'document' AND contains(translate(searchable, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'de') AND contains(translate(searchable, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'eau') QUALIFY rank <= {DEPTH}")
def text_short_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a term of two letters all terms are looked for as they are, newest first."""
    return s.text_branch(index_rows(spark, sf_dir), _options(keywords=("de EAU",)), DEPTH).select("id", "rank")


@query(f"{_BM25} SELECT id, rank::INTEGER AS rank, round(score, 6) AS score FROM vector_branch")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents nearest to a vector."""
    o = _options(mode="vector", query_vector=query_vector(spark, sf_dir))
    return s.vector_branch(index_rows(spark, sf_dir), vector_rows(spark, sf_dir), o, DEPTH).withColumn("score", F.round("score", 6))


@query(f"WITH {INDEX}, {VECTORS} SELECT v.id, row_number() OVER (ORDER BY list_inner_product(embedding, q) DESC, v.id)::INTEGER AS rank FROM vecs v JOIN idx USING (id), query WHERE list_contains(subjects, 'fr') QUALIFY rank <= {DEPTH}")
def vector_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among documents of one subject: filtered before, not after."""
    o = _options(mode="vector", subject="fr", query_vector=query_vector(spark, sf_dir))
    return s.vector_branch(index_rows(spark, sf_dir), vector_rows(spark, sf_dir), o, DEPTH).select("id", "rank")


@query(f"{_BM25} SELECT id, rank::INTEGER AS rank FROM hybrid WHERE rank <= {DEPTH}")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and vector branches, fused by reciprocal ranks."""
    o = _options(mode="hybrid", query_vector=query_vector(spark, sf_dir))
    return s.candidates(index_rows(spark, sf_dir), vector_rows(spark, sf_dir), o)


@query(f"WITH {INDEX}, {VECTORS} SELECT count(*) AS total FROM (SELECT id FROM idx WHERE kind = 'document' AND {_MATCH} UNION SELECT v.id FROM vecs v JOIN idx USING (id))")
def hybrid_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number of hybrid hits: matches and documents with vectors, each once."""
    o = _options(mode="hybrid", query_vector=query_vector(spark, sf_dir))
    return s.total(index_rows(spark, sf_dir), vector_rows(spark, sf_dir), o)


@query(f"WITH {INDEX} SELECT count(*) AS total FROM idx WHERE kind = 'document' AND {_MATCH}")
def text_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.total(index_rows(spark, sf_dir), None, _options())


@query(f"{_BM25} SELECT h.rank::INTEGER AS rank, h.id, subjects[1] AS subject, types[1] AS template, make_timestamp(timestamp_ns // 1000) AS timestamp, path FROM hybrid h JOIN idx USING (id) WHERE h.rank <= {DEPTH - 1}")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole hybrid search: candidates, columns of the kind, page and budget."""
    o = _options(mode="hybrid", query_vector=query_vector(spark, sf_dir), max_tokens=1_000_000)
    return s.search(index_rows(spark, sf_dir), vector_rows(spark, sf_dir), o)[0].withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(f"WITH {INDEX}, r AS (SELECT id, row_number() OVER (ORDER BY timestamp_ns DESC, id) AS rank, strlen(searchable) AS size FROM idx WHERE kind = 'document' QUALIFY rank <= 100), b AS (SELECT *, sum(size) OVER (ORDER BY rank) AS running FROM r) SELECT id, rank::INTEGER AS rank FROM b WHERE running <= 80000")
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest documents until the first that exceeds the budget of bytes."""
    index = index_rows(spark, sf_dir).where("kind = 'document'")
    rows = s.ranked(index.select("id", "timestamp_ns", F.octet_length("searchable").alias("size")), [F.desc("timestamp_ns"), F.asc("id")], 100)
    return s.within_budget(rows, F.col("size"), 20_000).select("id", "rank")


@query(f"WITH {EVENTS} SELECT id, row_number() OVER (ORDER BY timestamp_ns DESC, id)::INTEGER AS rank FROM ev QUALIFY rank <= 101")
def chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without keywords: the newest first."""
    return s.newest(event_rows(spark, sf_dir), s.Options("feedstock", limit=100))


@query(f"WITH {EVENTS}, n AS (SELECT * FROM ev WHERE type = 'purchase' ORDER BY timestamp_ns DESC, id LIMIT 40) SELECT id, row_number() OVER (ORDER BY timestamp_ns, id)::INTEGER AS rank FROM n")
def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of one type, oldest first."""
    return s.newest(event_rows(spark, sf_dir), s.Options("feedstock", type="purchase", last=40))


@query(f"WITH {EVENTS} SELECT id, session, timestamp_ns FROM ev WHERE timestamp_ns BETWEEN {START_NS + 3 * DAY_NS} AND {START_NS + 9 * DAY_NS - 1}")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events between two bounds, both inclusive, the last day to its end."""
    o = s.Options("feedstock", since_ns=START_NS + 3 * DAY_NS, until_ns=s.end_of_day_ns(START_NS + 8 * DAY_NS))
    return s.eligible(event_rows(spark, sf_dir), o).select("id", "session", "timestamp_ns")


@query("WITH g AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS types FROM labels) SELECT doc_id FROM g WHERE list_contains(types, 'toxic')")
def array_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose set of types has a value, by the search's own filter."""
    types = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.lit("document").alias("kind"), types.alias("types"))
    return s.eligible(rows, s.Options("document", template="toxic")).select("doc_id")


@query(f"""{_BM25}, ft AS (SELECT id, rank FROM text_branch WHERE rank <= 50), fv AS (SELECT id, rank FROM vector_branch WHERE rank <= 50 AND score >= 0.2),
    th AS (SELECT id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT * FROM ft UNION ALL SELECT * FROM fv) GROUP BY id) SELECT id, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM th""")
def threshold_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search whose vectors only count from a score on."""
    o = _options(mode="hybrid", query_vector=query_vector(spark, sf_dir))
    return runs.threshold_hybrid(index_rows(spark, sf_dir), vector_rows(spark, sf_dir), o, 0.2, depth=50).select("id", "rank")


@query(f"""{_BM25} SELECT id, rank::INTEGER AS rank FROM hybrid WHERE id IN (SELECT id FROM hybrid ORDER BY rank LIMIT 10)""")
def hybrid_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of a hybrid search."""
    o = _options(mode="hybrid", query_vector=query_vector(spark, sf_dir))
    return s.candidates(index_rows(spark, sf_dir), vector_rows(spark, sf_dir), o).where("rank <= 10")


# Knowledge as index rows; a claim has characters that JSON for HTML escapes.
_CLAIMS = f"""{KNOWLEDGE}, kx AS (SELECT ks.id, subject, 'decision' AS type, statement || ' <' || o_custkey || '&>' AS claim, epoch_us(o_orderdate::TIMESTAMP) * 1000 AS timestamp_ns, status FROM ks JOIN orders ON 'k-' || o_orderkey = ks.id),
    ok AS (SELECT *, row_number() OVER (ORDER BY timestamp_ns DESC, id) AS rank FROM kx WHERE status IN ('active', 'pending')),
    sized AS (SELECT *, strlen('{{"id":"' || id || '","subject":"' || subject || '","type":"' || type || '","claim":"' || claim || '"}}') + 15 AS size FROM ok WHERE rank <= 100),
    page AS (SELECT *, sum(size) OVER (ORDER BY rank) AS running FROM sized)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lc.with_status(knowledge(spark, sf_dir))
    text = F.concat(F.col("statement"), F.lit(" <"), F.expr("substring(subject, 3)"), F.lit("&>"))
    return k.select("id", F.lit("knowledge").alias("kind"), F.lit("").alias("session"), F.lit("").alias("agent"), (micros("created") * 1000).alias("timestamp_ns"), F.lit("").alias("summary"), text.alias("searchable"), text.alias("claim"), F.array("subject").alias("subjects"), F.array("type").alias("types"), "status", F.lit("").alias("path"))


_CLAIM_OPTIONS = s.Options("knowledge", mode="text", limit=100, max_tokens=1500, include_pending=True)


@query(f"WITH {_CLAIMS} SELECT id, subject, type, claim, rank::INTEGER AS rank FROM page WHERE running <= 6000")
def budgeted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest knowledge, pending included, up to the first result that exceeds the budget of bytes as JSON."""
    return s.search(_claims(spark, sf_dir), None, _CLAIM_OPTIONS)[0]


@query(f"WITH {_CLAIMS} SELECT (SELECT count(*) FROM ok) AS total, count(*) AS returned, count(*) < (SELECT count(*) FROM ok) AS has_more, count(*) < (SELECT count(*) FROM page) AS truncated FROM page WHERE running <= 6000")
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many there are, how many were returned, and whether the budget cut them."""
    return s.search(_claims(spark, sf_dir), None, _CLAIM_OPTIONS)[1]


@query(f"""{_BM25}, ft AS (SELECT id, rank, score FROM text_branch WHERE rank <= 50), fv AS (SELECT id, rank, score FROM vector_branch WHERE rank <= 50)
    SELECT coalesce(ft.id, fv.id) AS id, round(ft.score, 6) AS text_score, round(fv.score, 6) AS vector_score, round(coalesce(1.0 / (60 + ft.rank), 0) + coalesce(1.0 / (60 + fv.rank), 0), 9) AS score FROM ft FULL JOIN fv ON ft.id = fv.id""")
def branch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits with the scores of both branches."""
    o = _options(mode="hybrid", query_vector=query_vector(spark, sf_dir))
    index = index_rows(spark, sf_dir)
    fused = s.fuse({"text": s.text_branch(index, o, 50), "vector": s.vector_branch(index, vector_rows(spark, sf_dir), o, 50)})
    return fused.select("id", F.round("text_score", 6).alias("text_score"), F.round("vector_score", 6).alias("vector_score"), F.round("score", 9).alias("score"))


@query("SELECT 'd' || vec_id AS id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS length, round(embedding[1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors at unit length."""
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("id"), vectors.normalize(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return v.select("id", F.round(vectors.norm(F.col("v")), 5).alias("length"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"))


@query(f"{_BM25} SELECT 'text' AS mode, id, rank::INTEGER AS rank FROM text_branch UNION ALL SELECT 'vector', id, rank::INTEGER FROM vector_branch UNION ALL SELECT 'hybrid', id, rank::INTEGER FROM hybrid WHERE rank <= {DEPTH}")
def mode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that each mode gives, to one more than the limit."""
    out = None
    for mode in s.MODES:
        o = _options(mode=mode, query_vector=query_vector(spark, sf_dir))
        n = s.candidates(index_rows(spark, sf_dir), vector_rows(spark, sf_dir), o).select(F.lit(mode).alias("mode"), "id", "rank")
        out = n if out is None else out.unionByName(n)
    return out


# ------------------------------------------------------------------ a kept text index
def _kept(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The text index of all rows, written to the shared folder."""
    kept = TextIndex(spark, shared_path(spark, "text-index"))
    kept.update(index_rows(spark, sf_dir))
    return kept


@query(f"{_BM25} SELECT id, rank::INTEGER AS rank, round(score, 6) AS score FROM text_branch")
def index_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents by BM25, from the lists of a kept index alone."""
    return _kept(spark, sf_dir).text_branch(_options(), DEPTH).withColumn("score", F.round("score", 6))


@query(f"{_BM25} SELECT h.rank::INTEGER AS rank, h.id, subjects[1] AS subject, types[1] AS template, make_timestamp(timestamp_ns // 1000) AS timestamp, path FROM hybrid h JOIN idx USING (id) WHERE h.rank <= {DEPTH - 1}")
def index_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole hybrid search over a kept index."""
    kept, o = _kept(spark, sf_dir), _options(mode="hybrid", query_vector=query_vector(spark, sf_dir), max_tokens=1_000_000)
    return s.search(kept.rows(), vector_rows(spark, sf_dir), o, kept)[0].withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# After changes: every fifth document reversed and every seventh gone, every third message's summary repeated.
_CHANGED = f"""{INDEX.replace('idx AS', 'before AS', 1)}, idx AS (SELECT id, kind, timestamp_ns, CASE WHEN kind = 'feedstock' AND (timestamp_ns // 1000) % 3 = 0 THEN summary || ' ' || summary ELSE summary END AS summary,
        CASE WHEN kind = 'document' AND (timestamp_ns // 1000) % 5 = 0 THEN reverse(searchable) ELSE searchable END AS searchable FROM before WHERE NOT (kind = 'document' AND (timestamp_ns // 1000) % 7 = 0))"""


def _changed_kept(spark: SparkSession, sf_dir: str) -> TextIndex:
    """An index that grew by four updates, so that lists of several generations were merged."""
    rows, kept = index_rows(spark, sf_dir), TextIndex(spark, shared_path(spark, "text-index"))
    number = F.floor(F.col("timestamp_ns") / 1000)
    kept.update(rows.where("kind = 'document'"))
    kept.update(rows.where((F.col("kind") == "feedstock") & (number % 2 == 0)))
    kept.update(rows.where((F.col("kind") == "document") & (number % 5 == 0)).withColumn("searchable", F.reverse("searchable")))
    kept.update(rows.where((F.col("kind") == "feedstock") & (number % 2 == 1)), rows.where((F.col("kind") == "document") & (number % 7 == 0)))
    again = rows.where((F.col("kind") == "feedstock") & (number % 3 == 0))
    kept.update(again.withColumn("summary", F.concat_ws(" ", "summary", "summary")))
    return kept


@query(f"WITH {_CHANGED}, {_RANKED} SELECT id, rank::INTEGER AS rank, round(score, 6) AS score FROM text_branch")
def index_changed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 after changes, removals and a merge: lists of rows that are gone count no more."""
    return _changed_kept(spark, sf_dir).text_branch(_options(), DEPTH).withColumn("score", F.round("score", 6))


@query(f"WITH {_CHANGED} SELECT id FROM idx WHERE (contains(lower(summary), 'große') OR contains(lower(searchable), 'große')) OR (contains(lower(summary), 'stone') OR contains(lower(searchable), 'stone'))")
def index_changed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of both kinds that hold one of two words, after the same changes."""
    kept = _changed_kept(spark, sf_dir)
    found = None
    for kind in ("document", "feedstock"):
        for word in ("Große", "STONE"):
            own = kept.matching_ids(s.Options(kind, [word], "text"))
            found = own if found is None else found.union(own)
    return found.distinct()


@query(f"WITH {INDEX} SELECT count(*) AS total FROM idx WHERE kind = 'document' AND {_MATCH}")
def index_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number of matches, from lists alone."""
    kept = _kept(spark, sf_dir)
    return s.total(kept.rows(), None, _options(), kept)


# ------------------------------------------------------------------ many searches at once
# Cases: two words of each benchmark item (of letters, the first of which doesn't come again, so that no two occurrences overlap), and the vector of its number.
_WORDS = "[a-z]{4,}"
_CASES = f"""{INDEX}, q AS MATERIALIZED (SELECT item_id::VARCHAR AS case_id, item_id, w[1] AS t1, w[2] AS t2, embedding::DOUBLE[] AS v FROM (SELECT *, list_filter(regexp_extract_all(lower(text), '{_WORDS}'), lambda x: NOT contains(x[2:], x[1])) AS w FROM benchmark) JOIN embeddings ON vec_id = item_id WHERE len(w) >= 2),
    m AS MATERIALIZED (SELECT id, kind, timestamp_ns, lower(summary) AS a, lower(searchable) AS b, greatest(length(summary) - 2, 0) + greatest(length(searchable) - 2, 0) AS len FROM idx),
    tt AS MATERIALIZED (SELECT id, kind, timestamp_ns, len, t, (length(a) - length(replace(a, t, '')) + length(b) - length(replace(b, t, ''))) / length(t) AS tf FROM m, (SELECT t1 AS t FROM q UNION SELECT t2 FROM q) WHERE contains(a, t) OR contains(b, t)),
    df AS (SELECT t, CASE WHEN ln(((SELECT count(*) FROM m) - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln(((SELECT count(*) FROM m) - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM tt GROUP BY t),
    al AS (SELECT avg(len) AS al FROM m),
    sc AS (SELECT case_id, x.id, x.timestamp_ns, f.idf * x.tf * 2.2 / (x.tf + 1.2 * (0.25 + 0.75 * x.len / al)) + g.idf * y.tf * 2.2 / (y.tf + 1.2 * (0.25 + 0.75 * y.len / al)) AS score
        FROM q JOIN tt x ON x.t = t1 JOIN tt y ON y.t = t2 AND y.id = x.id JOIN df f ON f.t = t1 JOIN df g ON g.t = t2, al WHERE x.kind = 'document'),
    rt AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, timestamp_ns DESC, id) AS rank FROM sc QUALIFY rank <= 50),
    rv AS (SELECT case_id, 'd' || vec_id AS id, row_number() OVER (PARTITION BY case_id ORDER BY list_inner_product(embedding::DOUBLE[], v) DESC, 'd' || vec_id) AS rank FROM q, embeddings JOIN documents ON doc_id = vec_id QUALIFY rank <= 50),
    rh AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, id) AS rank FROM (SELECT * FROM rt UNION ALL SELECT * FROM rv) GROUP BY case_id, id)"""


def _cases(spark: SparkSession, sf_dir: str) -> dict[str, s.Options]:
    """The cases, which are a setting of an evaluation, on the driver."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(0)), lambda x: ~F.contains(F.substring(x, 2, 1000), F.substring(x, 1, 1)))
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where("size(w) >= 2").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    return {str(r["item_id"]): _options(mode="hybrid", keywords=r["w"][:2], limit=20, query_vector=[*r["embedding"]]) for r in rows.collect()}


@query(f"WITH {_CASES} SELECT case_id, id, rank::INTEGER AS rank FROM rh WHERE rank <= 21")
def batch_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid searches of all benchmark items at once: one scan of texts and one of vectors."""
    return bs.rankings(index_rows(spark, sf_dir), vector_rows(spark, sf_dir), _cases(spark, sf_dir))


_GAIN = "(2 ^ grade - 1)"


def _mean(k: int) -> str:
    hit, gain = f"count(*) FILTER (WHERE rank <= {k})", f"coalesce(sum({_GAIN} / log2(rank + 1)) FILTER (WHERE rank <= {k}), 0)"
    return f"{hit} / count(*) AS recall_{k}, {gain} / sum({_GAIN} / log2(place + 1)) FILTER (WHERE place <= {k}) AS ndcg_{k}"


@query(f"""WITH {_CASES}, g AS (SELECT case_id, 'd' || doc_id AS id, CASE WHEN doc_id % 200 = item_id THEN 2 ELSE 1 END AS grade FROM q JOIN documents ON doc_id % 40 = item_id % 40),
    ideal AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, id) AS place FROM g), modes AS (SELECT 'text' AS mode, * FROM rt UNION ALL SELECT 'vector', * FROM rv UNION ALL SELECT 'hybrid', * FROM rh WHERE rank <= 50),
    c AS (SELECT mode, i.case_id, {', '.join(map(_mean, (5, 10, 20)))}, coalesce(1.0 / min(rank) FILTER (WHERE grade = 2 AND rank <= 10), 0) AS mrr FROM (SELECT DISTINCT mode FROM modes) CROSS JOIN ideal i LEFT JOIN modes r USING (mode, case_id, id) GROUP BY mode, i.case_id)
    SELECT mode, count(*) AS cases, {', '.join(f'round(avg({n}_{k}), 6) AS {n}_{k}' for k in (5, 10, 20) for n in ('recall', 'ndcg'))}, round(avg(mrr), 6) AS mrr FROM c GROUP BY mode""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, nDCG and MRR of text, vector and hybrid search over all cases. Relevant are documents of a case's number, in part."""
    cases = _cases(spark, sf_dir)
    n = F.col("doc_id")
    numbers = spark.createDataFrame([(k, int(k)) for k in cases], "case_id string, item int")
    qrels = table(spark, sf_dir, "documents").select("doc_id").join(F.broadcast(numbers), n % 40 == F.col("item") % 40).select("case_id", F.concat(F.lit("d"), n).alias("id"), F.when(n % 200 == F.col("item"), 2).otherwise(1).alias("grade"))
    report = bs.evaluate(index_rows(spark, sf_dir), vector_rows(spark, sf_dir), cases, qrels)
    return report.select("mode", "cases", *(F.round(c, 6).alias(c) for c in report.columns if c not in ("mode", "cases")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_results(spark, sf_dir)
