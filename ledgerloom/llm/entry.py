"""The operators' queries over the given tables, and their SQL."""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, packing, quality, secret_scan, substring_dedup, token_counts, vector_codes, warc
from .shared import crc_mod, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary's file; by default the one that packing counts in."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.FORMAT)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secret_scan.KINDS), _sha(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", _sha(F.col("line_dedup.kept")).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(docs.where(crc_mod("doc_id", 4) != 2))
    out = language_id.identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("language_id.lang").alias("lang_pred"), F.col("language_id.score").alias("score"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("item_ids", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), _sha(items).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "substring_dedup.n_words", "substring_dedup.n_removed", _sha(F.col("substring_dedup.kept")).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")
    known = token_counts.learn_table(token_counts.few_files(docs), path)
    return token_counts.count_tokens(docs.select("doc_id", "text"), path, known).select("doc_id", "token_count.n_bytes", "token_count.n_tokens", "token_count.over_limit")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))[0].drop("label")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_secrets, op3_line_dedup, op4_language_id, op5_warc, op6_decontaminate, op7_substring_dedup, op8_packing, op9_exact_dedup, op10_jaccard_join, op11_token_counts, op12_centroids, op13_vector_codes, pipeline)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_FLOOR = "(s - ((s % n) + n) % n) // n"  # exact floor(s / n), also of negative sums
_DISTANCE = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _whole(scale: int) -> str:
    return f"list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT)"


_FINITE = "embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))), true)"


def _centroid_sql() -> str:
    """Rounds written out one by one."""
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.x, c.c, {_DISTANCE} AS d FROM v, c{r} c) GROUP BY vec_id, x)"
    moved = lambda r: f"""m{r} AS (SELECT c, list({_FLOOR} ORDER BY i) AS x FROM (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{r - 1}, range(1, {centroids.COMPONENTS + 1}) t(i) GROUP BY c, i) GROUP BY c),
        c{r} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN m{r} m ON m.c = c.c)"""  # noqa: E731
    steps = [near(0)]
    for r in range(1, centroids.ROUNDS + 1):
        steps += [moved(r), near(r)]
    last = centroids.ROUNDS
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, {_whole(centroids.SCALE)} AS x FROM embeddings WHERE len(embedding) = {centroids.COMPONENTS} AND {_FINITE}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('1:' || vec_id) LIMIT {centroids.CENTROIDS}),
        {", ".join(steps)},
        h AS (SELECT c, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM c{last})
        SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{last} a JOIN h ON h.c = a.c"""


def _code_sql(width: int = 16) -> str:
    """Rounds written out one by one, for vectors of four parts of ``width`` components."""
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, part, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.vec_id, v.part, v.x, c.e, {_DISTANCE} AS d FROM p v JOIN c{r} c ON c.part = v.part) GROUP BY vec_id, part, x)"
    moved = lambda r: f"""m{r} AS (SELECT part, e, list({_FLOOR} ORDER BY i) AS x FROM (SELECT part, e, i, sum(x[i]) AS s, count(*) AS n FROM a{r - 1}, range(1, {width + 1}) t(i) GROUP BY part, e, i) GROUP BY part, e),
        c{r} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN m{r} m ON m.part = c.part AND m.e = c.e)"""  # noqa: E731
    steps = [near(0)]
    for r in range(1, vector_codes.ROUNDS + 1):
        steps += [moved(r), near(r)]
    last = vector_codes.ROUNDS
    return f"""
        WITH v AS (SELECT vec_id, {_whole(vector_codes.SCALE)} AS x FROM embeddings WHERE {_FINITE}),
        p AS MATERIALIZED (SELECT vec_id, part, x[{width} * part + 1:{width} * part + {width}] AS x FROM v, range(0, {vector_codes.PARTS}) t(part)),
        c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {vector_codes.ENTRIES}),
        {", ".join(steps)},
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{last}),
        o AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY vec_id)
        SELECT o.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN embeddings b ON b.vec_id = o.vec_id, h"""


SQL = {
    "op3_line_dedup": rf"""
        WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
        keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
        judged AS (SELECT k.doc_id, k.n, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op5_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND first <> page_id THEN first END AS refers_to FROM f""",
    "op6_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), {decontaminate.WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {decontaminate.WINDOW}) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        ks AS (SELECT DISTINCT k FROM bw),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
        m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
        hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op7_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + {substring_dedup.WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring_dedup.WINDOW - 2})) AS i FROM d WHERE len(w) >= {substring_dedup.WINDOW})),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring_dedup.WINDOW})) AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM win) WHERE first < doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE len(w) > 0),
        left_over AS (SELECT w.doc_id, count(g.p)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS kept FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over l ON d.doc_id = l.doc_id""",
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op10_jaccard_join": rf"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(s) AS h FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN ['short ' || array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: 'five ' || array_to_string(w[i:i + 4], ' ')) END) AS s FROM d)),
        n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM sh GROUP BY doc_id),
        links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
                  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id""",
    "op12_centroids": _centroid_sql(),
    "op13_vector_codes": _code_sql(),
}
