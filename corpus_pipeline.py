"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives documents with the columns it
got, but for the last, which gives pieces placed in sequences. Rows that repeat
a doc_id stay or go together; rows without one are known by a hash of their
text. Null texts have no language and go in the first stage. Other columns pass
through. An empty table gives an empty result. Tables that a stage writes for
itself are deleted when its documents are written; those that it compares texts
by (sets, groups, postings) as soon as it knows the keys of what goes. Stages set how many rows a Python worker
gets at once (``BATCH_ROWS``), for the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from ledgerloom.llm.entry import tokenizer_path
from ledgerloom.llm.shared import crc_mod, new_path, scratch, stage, stage_only, table

_KEY = "__pipeline_key"
#: Keys (8 bytes each) that are sent to all tasks at most.
BROADCAST_KEYS = 1_000_000
#: Rows that a Python worker gets at once, at most. Whole texts are among them, several copies of which are in memory while a batch is passed on.
BATCH_ROWS = 1_000
#: Words whose ids a worker of the last stage keeps: fewer than by itself, as what earlier stages took is still the executor's.
CACHE_WORDS = 100_000


def _small_batches(spark: SparkSession) -> None:
    """From now on the session's batches have BATCH_ROWS rows at most; a smaller number that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_KEY, F.coalesce(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less those whose keys ``gone`` (doc_id) has. Up to BROADCAST_KEYS keys are sent to the documents; beyond that both are shuffled, and only keys are built into hash tables."""
    keys = stage(gone.select(F.col("doc_id").alias(_KEY)).distinct(), "gone")
    few = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), _KEY, "left_anti").drop(_KEY)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty texts are such) and those that are no language that the documents name.

    Profiles are learned from three quarters of the documents with a ``lang``;
    the least score is what all but 1 in 1,000 reach of the fourth, held-out
    quarter's that are recognised. Where ``lang`` is null, the recognised
    language takes its place. Without any ``lang`` all documents go. Rows that
    repeat are judged alike.
    """
    _small_batches(spark)
    fold = F.coalesce(crc_mod("doc_id", 4), F.lit(0))
    profiles = language_id.learn_profiles(docs.where(fold != 2))
    least = language_id.fit_threshold(docs.where(fold == 2), profiles)
    found = language_id.identify(docs, profiles)
    kept = found.where((F.col("language_id.lang") != language_id.UNKNOWN) & (F.col("language_id.score") >= least))
    return kept.withColumn("lang", F.coalesce("lang", "language_id.lang")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that many documents share out of the texts; n_chars follows. No document goes: one that loses all its lines, or had none, has an empty text. Rows that repeat a doc_id lose the same lines."""
    _small_batches(spark)
    out = line_dedup.dedup_lines(docs)
    new = {"text": F.col("line_dedup.kept"), "n_chars": F.length("line_dedup.kept").cast("long")}
    return out.withColumns({c: e for c, e in new.items() if c in docs.columns}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each class of linked ones. Texts without words are linked with nothing and stay; of linked rows without doc_id, the one with the smallest hash stays, unless some row has one."""
    _small_batches(spark)
    keyed = _keyed(docs)
    gone = stage_only(spark, "copies", lambda: jaccard_join.near_duplicates(keyed, id_col=_KEY).where("doc_id <> component_id").select("doc_id"))
    return _without(keyed, gone).select(docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item. Texts without words hold none; without items nothing goes."""
    _small_batches(spark)
    keyed = _keyed(docs)
    gone = stage_only(spark, "hit", lambda: decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=_KEY).where("n_hit > 0").select("doc_id"))
    return _without(keyed, gone).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left into sequences, a row for each piece. An empty text is the end id alone."""
    _small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path(), cache_words=CACHE_WORDS)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack),
]

#: Language profiles and the tokenizer have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        with scratch(spark) as kept:
            docs = f(spark, docs, sf_dir)
            path = new_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            kept.append(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return docs
