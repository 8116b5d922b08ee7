"""Turns, their context and selection, logs and change capture."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ids import feedstock_id
from ..operators import documents as dc
from ..operators import runs, sync, turns
from ..operators.vector_store import VectorStore
from ..session import checkpoint, shared_path
from ..sources import logs
from ..sources.log_cache import LogCache
from ..streaming.managed import assemble_managed
from ..streaming.turns import assemble_stream
from .registry import query
from .tables import table

TURNS = """n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations),
    tn AS (SELECT conv_id, turn_no::BIGINT AS turn_no, arg_min(text, turn) FILTER (WHERE role = 'user') AS user_text, arg_max(text, turn) FILTER (WHERE role = 'assistant' AND trim(text) <> '') AS assistant_text, min(turn) AS first_position FROM n WHERE turn_no > 0 GROUP BY conv_id, turn_no),
    c AS (SELECT *, 'fs-' || substr(sha256('feedstock-v1' || chr(0) || 'claude' || chr(0) || conv_id || chr(0) || turn_no), 1, 32) AS id, conv_id * 100 + turn_no AS ts FROM tn),
    f AS (SELECT id, quality = 1 AS extracted FROM c JOIN labels ON doc_id = conv_id)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.assemble_messages(table(spark, sf_dir, "conversations"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return t.withColumns({"id": feedstock_id(F.lit("claude"), F.col("conv_id").cast("string"), F.col("turn_no").cast("string")), "agent": F.lit("claude"), "session_id": F.col("conv_id").cast("string"), "timestamp": F.col("conv_id") * 100 + F.col("turn_no"), "source_sequence": F.col("turn_no")})


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of labelled conversations are acquired; those of good ones are extracted."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), F.when(F.col("quality") == 1, F.lit(1)).alias("extracted_at"))
    return _candidates(spark, sf_dir).select("id", "conv_id").join(labels, "conv_id").select("id", "extracted_at")


@query(f"WITH {TURNS} SELECT conv_id, turn_no, user_text, assistant_text, first_position FROM tn")
def turn_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir)


@query(f"WITH {TURNS} SELECT conv_id, turn_no, id FROM c")
def turn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("conv_id", "turn_no", "id")


_OFFSETS = "CASE WHEN {0} IS NULL THEN '' ELSE '{1}:' || {0} END"


@query(f"WITH {TURNS} SELECT id, concat_ws('|', {', '.join(f'''CASE WHEN lag(user_text, {k}) OVER w IS NOT NULL THEN '-{k}:' || lag(user_text, {k}) OVER w END''' for k in (3, 2, 1))}) AS prior FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no)")
def prior_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with up to three turns before it in its session."""
    rows = turns.with_context(_candidates(spark, sf_dir), ["agent", "session_id"], ["turn_no"], 3, content=F.col("user_text"))
    return rows.select("id", F.array_join(F.transform("before", lambda x: F.concat_ws(":", x["offset"].cast("string"), x["content"])), "|").alias("prior"))


@query(f"WITH {TURNS} SELECT id, (lag(turn_no) OVER w IS NOT NULL)::INTEGER + (lag(turn_no, 2) OVER w IS NOT NULL)::INTEGER AS n_before, (lead(turn_no) OVER w IS NOT NULL)::INTEGER + (lead(turn_no, 2) OVER w IS NOT NULL)::INTEGER AS n_after, lead(user_text) OVER w AS next_text FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no)")
def both_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns before and after."""
    rows = turns.with_context(_candidates(spark, sf_dir), ["agent", "session_id"], ["turn_no"], 2, 2, content=F.col("user_text"))
    return rows.select("id", F.size("before").alias("n_before"), F.size("after").alias("n_after"), F.get("after", F.lit(0))["content"].alias("next_text"))


@query(f"WITH {TURNS}, u AS (SELECT c.*, f.id IS NOT NULL AS resumable FROM c LEFT JOIN f USING (id) WHERE f.id IS NULL OR NOT extracted) SELECT id, resumable, row_number() OVER (ORDER BY resumable DESC, ts DESC, id)::INTEGER AS rank FROM u QUALIFY rank <= 200")
def resumable_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of 200 turns takes: begun ones first, then new ones, the newest first."""
    rows = turns.select_unfinished(_candidates(spark, sf_dir), _known(spark, sf_dir), limit=200)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("resumable"), F.desc("timestamp"), "id"))).select("id", "resumable", "rank")


@query(f"WITH {TURNS}, u AS (SELECT c.* FROM c LEFT JOIN f USING (id) WHERE f.id IS NULL OR NOT extracted) SELECT id FROM u QUALIFY row_number() OVER (ORDER BY ts DESC, turn_no DESC, id DESC) > 1")
def hook_excludes_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All unfinished turns but the latest, which may still be open."""
    return turns.select_unfinished(_candidates(spark, sf_dir), _known(spark, sf_dir), hook=True).select("id")


@query(f"WITH {TURNS} SELECT count(*) AS pending FROM c LEFT JOIN f USING (id) WHERE f.id IS NULL OR NOT extracted")
def pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.pending_count(_candidates(spark, sf_dir), _known(spark, sf_dir))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in two files: the second copy of toxic conversations differs."""
    c = _candidates(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("toxic"))
    other = c.join(toxic, "conv_id", "left").withColumn("user_text", F.when(F.col("toxic"), F.upper("user_text")).otherwise(F.col("user_text"))).drop("toxic")
    return c.withColumn("path", F.lit("a.jsonl")).unionByName(other.withColumn("path", F.lit("b.jsonl")))


@query(f"WITH {TURNS}, bad AS (SELECT DISTINCT conv_id FROM tn WHERE conv_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND user_text <> upper(user_text)) SELECT id, row_number() OVER (PARTITION BY conv_id ORDER BY ts, turn_no)::BIGINT AS source_sequence FROM c WHERE conv_id NOT IN (SELECT conv_id FROM bad)")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies merged, without sessions that have a turn whose copies differ."""
    return turns.merge_copies(_copies(spark, sf_dir), ["session_id", "timestamp", "user_text", "assistant_text"])[0].select("id", "source_sequence")


@query(f"WITH {TURNS}, u AS (SELECT c.*, f.id IS NOT NULL AS resumable FROM c LEFT JOIN f USING (id) WHERE (f.id IS NULL OR NOT extracted) AND conv_id NOT IN (SELECT conv_id FROM tn WHERE conv_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND user_text <> upper(user_text))) SELECT id, resumable FROM u")
def draw_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run without limit draws from two copies of all logs."""
    own = _copies(spark, sf_dir).withColumn("source_owner_session_id", F.col("session_id"))
    return runs.draw(own, _known(spark, sf_dir), same=["session_id", "timestamp", "user_text", "assistant_text"])[0].select("id", "resumable")


_ROOM = tx.RESPONSE_BYTES - len(tx.RESPONSE_MARKER.encode())
_LONG = f"left(a, list_max(list_filter(range({tx.RESPONSE_BYTES}), lambda n: strlen(left(a, n)) <= {_ROOM} // 2))) || '{tx.RESPONSE_MARKER}' || right(a, list_max(list_filter(range({tx.RESPONSE_BYTES}), lambda n: strlen(right(a, n)) <= {_ROOM} - {_ROOM} // 2)))"


@query(f"WITH {TURNS}, p AS (SELECT *, coalesce(assistant_text, '') AS a FROM c) SELECT id, user_text AS user_input, CASE WHEN strlen(a) <= {tx.RESPONSE_BYTES} THEN a ELSE {_LONG} END AS agent_response, least(turn_no - 1, 3)::INTEGER AS n_prior, coalesce(lag(user_text) OVER (PARTITION BY conv_id ORDER BY turn_no), '') AS last_prior FROM p")
def draw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all turns, read back from their JSON; long answers are shortened."""
    c = _candidates(spark, sf_dir)
    say = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    dialogue = F.when(F.col("assistant_text").isNull(), F.array(say("user", "user_text"))).otherwise(F.array(say("user", "user_text"), say("assistant", "assistant_text")))
    rows = c.withColumns({"dialogue": dialogue, "cwd": F.lit(""), "repo": F.lit(""), "source_owner_session_id": F.lit("")})
    p = F.from_json("payload", "user_input string, agent_response string, prior_turns array<struct<turn_offset:int,user_input:string,agent_response:string>>")
    out = runs.draw_payloads(rows).select("id", p.alias("p"))
    return out.select("id", "p.user_input", F.coalesce("p.agent_response", F.lit("")).alias("agent_response"), F.size("p.prior_turns").alias("n_prior"), F.coalesce(F.try_element_at("p.prior_turns", F.lit(-1))["user_input"], F.lit("")).alias("last_prior"))


_NAME = "trim(regexp_replace(lower(host), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages),
    k AS (SELECT host, 'https://' || host || '/' || host AS repo, '/work/' || host AS cwd, CASE WHEN host LIKE '%.com' THEN 'com' WHEN starts_with(host, 'm') THEN 'mobile' END AS owner FROM p)
    SELECT name, list_sort(list_distinct(flatten(list([repo, cwd] || extra)))) AS aliases, bool_and(owner IS NULL) AS is_new
    FROM (SELECT *, coalesce(owner, {_NAME}) AS name, CASE WHEN owner = 'com' THEN ['/work/*.com'] WHEN owner = 'mobile' THEN ['/work/m*', '/[a-c]?/*'] ELSE [] END AS extra FROM k) GROUP BY name
    UNION ALL SELECT 'unseen', ['https://nowhere.example/x'], false""")
def repository_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects after the hosts of all pages were seen as repositories: some are known by wild cards, the first by name wins, others are new."""
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    seen = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://"), host, F.lit("/"), host).alias("repo"), F.concat(F.lit("/work/"), host).alias("cwd"))
    known = spark.createDataFrame([("com", ["/work/*.com"]), ("mobile", ["/work/m*", "/[a-c]?/*"]), ("unseen", ["https://nowhere.example/x"])], "name string, aliases array<string>")
    return runs.repository_subjects(seen, known).withColumn("aliases", F.array_sort("aliases"))


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the lines of logs: one file each, in which system messages are meta records."""
    c = table(spark, sf_dir, "conversations")
    ts = F.date_format(F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    message = F.struct(kind.alias("role"), F.col("text").alias("content"), F.lit("end_turn").alias("stop_reason"))
    raw = F.to_json(F.struct(kind.alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), ts.alias("timestamp"), (F.col("role") == "system").alias("isMeta"), message.alias("message")))
    return c.select(F.lit("claude").alias("agent"), F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), raw.alias("raw"), F.lit(True).alias("terminated"))


_LOG_SQL = f"WITH {TURNS} SELECT conv_id::VARCHAR AS session_id, conv_id || '-' || first_position AS turn_id, user_text, coalesce(assistant_text, '') AS assistant_text FROM tn"


@query(f"{_LOG_SQL} WHERE assistant_text IS NOT NULL OR (conv_id, turn_no) NOT IN (SELECT (conv_id, max(turn_no)) FROM tn GROUP BY conv_id)")
def log_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines decoded to events and assembled by the state machine; a last turn without an answer is still open."""
    lines, _ = logs.usable_lines(_log_lines(spark, sf_dir))
    done = turns.assemble_events(logs.decode_claude(lines))
    return done.where("error is null").select("session_id", "turn_id", "user_text", F.coalesce("assistant_text", F.lit("")).alias("assistant_text"))


def _codex_lines(c: DataFrame) -> DataFrame:
    """(conv_id, at, raw): conversations as log lines of the dialect of typed payloads, each after its session's metadata."""
    ts = lambda n: F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    session = F.col("conv_id").cast("string")
    blank = F.lit(None).cast("string")
    line = lambda kind, **p: F.to_json(F.struct(F.lit(kind).alias("type"), ts(F.col("conv_id") * 1000 + F.coalesce("turn", F.lit(0))).alias("timestamp"), F.struct(*(v.alias(k) for k, v in p.items())).alias("payload")))
    blocks = F.array(F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text")))
    said = F.when(F.col("role") == "user", line("event_msg", type=F.lit("user_message"), turn_id=F.concat_ws("-", "conv_id", "turn"), message=F.col("text"))).otherwise(line("response_item", type=F.lit("message"), role=F.lit("assistant"), phase=F.lit("final_answer"), content=blocks))
    head = c.select("conv_id").distinct().withColumn("turn", F.lit(None).cast("int")).select("conv_id", F.lit(-1).alias("at"), line("session_meta", id=session, cwd=F.lit("/work"), source=F.lit("cli"), x=blank).alias("raw"))
    return head.unionByName(c.select("conv_id", F.col("turn").alias("at"), said.alias("raw")))


def _codex_files(spark: SparkSession, sf_dir: str) -> str:
    """These lines as log files, one a session, written to the shared folder."""
    rows = _codex_lines(table(spark, sf_dir, "conversations").where("role <> 'system'"))
    # One file a session: its lines, in order, as one row of text.
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("lines")).select(F.array_join(F.transform("lines", lambda x: x["raw"]), "\n").alias("value"), F.concat_ws("-", F.lit("s"), "conv_id").alias("session"))
    folder = shared_path(spark, "codex-logs")

    def write(it):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        for pdf in it:
            for session, value in zip(pdf["session"], pdf["value"], strict=True):
                with system.open_output_stream(f"{at}/{session}.jsonl") as f:
                    f.write((value + "\n").encode())
            yield pdf[["session"]]

    # Tasks write whole files under names of their own, also when they are run again.
    whole.mapInPandas(write, "session string").write.format("noop").mode("overwrite").save()
    return folder


@query(f"{_LOG_SQL} WHERE assistant_text IS NOT NULL OR (conv_id, turn_no) NOT IN (SELECT (conv_id, max(turn_no)) FROM tn GROUP BY conv_id)")
def codex_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files of the second dialect: written, read, decoded and assembled."""
    folder = _codex_files(spark, sf_dir)
    # Files are opened once: what they hold is looked at several times.
    lines, _ = logs.usable_lines(checkpoint(logs.read_lines(spark, [folder], "codex")))
    done = turns.assemble_events(logs.decode_codex(lines)[0])
    return done.where("error is null").select("session_id", "turn_id", "user_text", F.coalesce("assistant_text", F.lit("")).alias("assistant_text"))


#: Sessions that one log of ``_growing_logs`` holds, and what becomes of a log between two runs, by its number.
_SESSIONS_A_LOG, _FATES = 10, ("reuse", "resume", "relocate", "reparse")


def _growing_logs(spark: SparkSession, sf_dir: str, root: str, later: bool) -> DataFrame:
    """Logs of ten sessions each below ``root``, as they are at first, or later: by their number they stay, grow from an incomplete line on, move or are rewritten. Files of the last two kinds have another name or beginning at first."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    lines = _codex_lines(c).withColumn("log", F.floor(F.col("conv_id") / _SESSIONS_A_LOG))

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        rows = pdf.sort_values(["conv_id", "at"])["raw"].to_list()
        body, first = ("\n".join(rows) + "\n").encode(), len(rows[0].encode())
        system, at = fs.FileSystem.from_uri(f"{root}/{key[0]}.jsonl")
        old, fate = at.removesuffix(".jsonl") + "-old.jsonl", _FATES[key[0] % 4]
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        if fate == "relocate" and later:
            if system.get_file_info(at).type == fs.FileType.NotFound:
                system.move(old, at)
        elif not (fate == "reuse" and later):
            if not later and fate == "resume":
                body = body[: max(len(body) // 2, first + 2)]
            if not later and fate == "reparse":
                body = b'{"type":"session_meta"}\n' + body[: len(body) // 3].rpartition(b"\n")[0] + b"\n"
            with system.open_output_stream(old if fate == "relocate" else at) as f:
                f.write(body)
        return pd.DataFrame({"log": [key[0]]})

    return lines.groupBy("log").applyInPandas(write, "log long")


def _ingested_twice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(turns, report) of a second run, after logs grew, moved and were rewritten."""
    root, kept = shared_path(spark, "growing-logs"), LogCache(spark, shared_path(spark, "log-cache"))
    out = None
    for later in (False, True):
        _growing_logs(spark, sf_dir, root, later).count()
        out = kept.run(logs.find_logs(spark, {"codex": [root]}))
    return out[0], out[1]


@query(f"{_LOG_SQL} WHERE assistant_text IS NOT NULL OR (conv_id, turn_no) NOT IN (SELECT (conv_id, max(turn_no)) FROM tn GROUP BY conv_id)")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of logs that were read, then grew, moved or were rewritten, and were read on: the same as of a full parse."""
    done = _ingested_twice(spark, sf_dir)[0]
    return done.select("session_id", "turn_id", "user_text", F.coalesce("assistant_text", F.lit("")).alias("assistant_text"))


@query(f"WITH l AS (SELECT DISTINCT conv_id // {_SESSIONS_A_LOG} AS log FROM conversations WHERE role <> 'system') SELECT log::BIGINT AS log, CASE log % 4 {' '.join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(_FATES))} END AS decision, CASE log % 4 WHEN 1 THEN 'part' WHEN 3 THEN 'all' ELSE 'none' END AS bytes_read FROM l")
def ingest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second run decided for each log, and how much of it was read."""
    report = _ingested_twice(spark, sf_dir)[1]
    log = F.regexp_extract("path", "([0-9]+)[.]jsonl$", 1).cast("long")
    share = F.when(F.col("bytes_read") == 0, "none").when(F.col("start") > 0, "part").otherwise("all")
    return report.select(log.alias("log"), "decision", share.alias("bytes_read"))


@query(f"WITH {TURNS} SELECT id, user_text FROM c WHERE assistant_text IS NOT NULL OR (conv_id, turn_no) NOT IN (SELECT (conv_id, max(turn_no)) FROM tn GROUP BY conv_id)".replace("'feedstock-v1' || chr(0) || 'claude' || chr(0) || conv_id || chr(0) || turn_no", "'feedstock-v1' || chr(0) || 'claude' || chr(0) || conv_id || chr(0) || conv_id || '-' || first_position"))
def log_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as feedstock candidates with ids and dialogue."""
    lines, _ = logs.usable_lines(_log_lines(spark, sf_dir))
    c = turns.as_candidates(turns.assemble_events(logs.decode_claude(lines)))
    return c.select("id", F.get("dialogue", F.lit(0))["content"].alias("user_text"))


def _message_events(source: DataFrame) -> DataFrame:
    """Messages as events of one stream for each conversation."""
    kind = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    null = F.lit(None)
    return source.where("role <> 'system'").select(
        F.lit("claude").alias("agent"), F.col("conv_id").cast("string").alias("path"), F.lit("").alias("stream"), F.col("turn").alias("line"), F.lit(0).alias("ord"), kind.alias("kind"), F.col("conv_id").cast("string").alias("session_id"),
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), null.cast("string").alias("fallback_turn_id"), F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), null.cast("string").alias("cwd"), null.cast("string").alias("repo"), null.cast("string").alias("branch"),
        "text", F.lit(turns.FINAL_TEXT).alias("priority"), (F.col("role") == "assistant").alias("completes"),
    )


@query(f"{_LOG_SQL} WHERE assistant_text IS NOT NULL OR (conv_id, turn_no) NOT IN (SELECT (conv_id, max(turn_no)) FROM tn GROUP BY conv_id)")
def stream_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over the conversations' files, with each session's state kept between micro-batches."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = shared_path(spark, "stream-turns")
    events = _message_events(spark.readStream.schema(c.schema).parquet(f"{sf_dir}/conversations.parquet*"))
    run = assemble_stream(events).writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.schema(turns.TURN_SCHEMA).parquet(f"{out}/rows")
    return done.where("error is null").select("session_id", "turn_id", "user_text", F.coalesce("assistant_text", F.lit("")).alias("assistant_text"))


#: Parts in which the messages of ``stream_restarts`` come: the last one has all that follow.
_STREAM_PARTS = 6


@query(f"{_LOG_SQL} WHERE assistant_text IS NOT NULL OR (conv_id, turn_no) NOT IN (SELECT (conv_id, max(turn_no)) FROM tn GROUP BY conv_id)")
def stream_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from messages that come in six parts. After each the stream is stopped, and started again from its checkpoint, so that managed state is taken up in each micro-batch."""
    c, out = table(spark, sf_dir, "conversations"), shared_path(spark, "stream-restarts")
    for k in range(_STREAM_PARTS):
        c.where(F.least("turn", F.lit(_STREAM_PARTS - 1)) == k).write.mode("append").parquet(f"{out}/messages")
        events = _message_events(spark.readStream.schema(c.schema).parquet(f"{out}/messages"))
        run = assemble_managed(events).writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    done = spark.read.schema(turns.TURN_SCHEMA).parquet(f"{out}/rows")
    return done.where("error is null").select("session_id", "turn_id", "user_text", F.coalesce("assistant_text", F.lit("")).alias("assistant_text"))


SNAPSHOTS = """cur AS (SELECT doc_id AS record_key, length(coalesce(d.text, '')) AS size FROM documents d),
    old AS (SELECT d.doc_id AS record_key, length(coalesce(d.text, '')) + CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS size FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 0 UNION ALL SELECT -1 - item_id, length(text) FROM benchmark),
    ch AS (SELECT coalesce(c.record_key, o.record_key) AS record_key, CASE WHEN o.record_key IS NULL THEN 'new' WHEN c.record_key IS NULL THEN 'deleted' WHEN c.size = o.size THEN 'same' ELSE 'changed' END AS change FROM cur c FULL JOIN old o ON c.record_key = o.record_key)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents now, and an index in which bad ones are missing, toxic ones differ and benchmark items are left over."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_key"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_key"), "quality", "toxic")
    old = d.join(labels, "record_key", "left").where("quality is null or quality <> 0").select("record_key", (F.col("size") + F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("size"))
    gone = table(spark, sf_dir, "benchmark").select((F.lit(-1) - F.col("item_id")).alias("record_key"), F.length("text").cast("long").alias("size"))
    return d, old.unionByName(gone)


@query(f"WITH {SNAPSHOTS} SELECT record_key, change FROM ch")
def change_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.changes(*_snapshots(spark, sf_dir), versions=("size",))


@query(f"WITH {SNAPSHOTS} SELECT record_key, size FROM old WHERE record_key NOT IN (SELECT record_key FROM cur)")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, indexed = _snapshots(spark, sf_dir)
    return sync.stale(indexed, current)


@query(f"WITH {SNAPSHOTS} SELECT count(*) FILTER (WHERE change <> 'new') AS indexed, count(*) FILTER (WHERE change = 'new') AS new, count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'deleted') AS deleted, count(*) FILTER (WHERE change <> 'same') AS unsynchronized FROM ch")
def unsynchronized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.index_status(*_snapshots(spark, sf_dir), versions=("size",))


@query(f"WITH {SNAPSHOTS} SELECT record_key, c.size, CASE WHEN change = 'same' THEN 'kept' ELSE 'written' END AS origin FROM cur c JOIN ch USING (record_key)")
def synchronized_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a run, and where its rows come from: those whose version is the same are the index's own."""
    current, indexed = (d.withColumn("origin", F.lit(o)) for d, o in zip(_snapshots(spark, sf_dir), ("written", "kept"), strict=True))
    return sync.synchronize(current, indexed, versions=("size",))


def _lengths(texts: list[str]) -> list[list[float]]:
    """A plain encoder: how many characters and how many blanks a text has."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("SELECT doc_id, length(trim(text))::DOUBLE AS characters, (length(trim(text)) - length(replace(trim(text), ' ', '')))::DOUBLE AS blanks FROM documents WHERE trim(coalesce(text, '')) <> ''")
def committed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents' texts from two runs: the second one encodes the other half, and what changed since the first."""
    n, text = F.col("doc_id"), F.col("text")
    kind = F.lit("knowledge").alias("kind")
    row = lambda size: table(spark, sf_dir, "documents").select("doc_id", n.cast("string").alias("record_key"), n.cast("string").alias("id"), kind, F.lit(1).cast("long").alias("mtime_ns"), size.cast("long").alias("size"), F.lit("").alias("summary"), text.alias("claim"))
    store, now = VectorStore(spark, shared_path(spark, "vectors")), row(F.coalesce(F.octet_length("text"), F.lit(0)))
    before = row(F.when(n % 3 == 0, -1).otherwise(F.coalesce(F.octet_length("text"), F.lit(0)))).where(n % 2 == 0).withColumn("claim", F.when(n % 3 == 0, "old").otherwise(F.col("claim")))
    store.run(before, _lengths, "lengths")
    got = store.run(now, _lengths, "lengths")
    return got.select(F.col("record_key").cast("long").alias("doc_id"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("characters", "blanks"))))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS record_key, url AS path FROM pages QUALIFY url = min(url) OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]*)', 1))")
def duplicate_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages of one host the first url owns the host's key."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("record_key"), F.col("url").alias("path"))
    return sync.key_owners(pages)[0].select("page_id", "record_key", "path")


@query(f"WITH {TURNS}, bad AS (SELECT DISTINCT conv_id FROM tn WHERE conv_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND user_text <> upper(user_text)), u AS (SELECT f.id IS NOT NULL AS resumable FROM c LEFT JOIN f USING (id) WHERE (f.id IS NULL OR NOT extracted) AND conv_id NOT IN (SELECT conv_id FROM bad)) SELECT count(*) AS pending, count(*) FILTER (WHERE resumable) AS resumable, (SELECT count(*) FROM tn WHERE conv_id IN (SELECT conv_id FROM bad) AND user_text <> upper(user_text)) AS conflicts FROM u")
def draw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a run that draws from two copies of all logs."""
    own = _copies(spark, sf_dir).withColumn("source_owner_session_id", F.col("session_id"))
    return runs.draw(own, _known(spark, sf_dir), same=["session_id", "timestamp", "user_text", "assistant_text"])[2]


_CUT = f"(400 - {len(tx.RESPONSE_MARKER.encode())})"
_HEAD = f"left(text, list_max(list_filter(range(401), lambda n: strlen(left(text, n)) <= {_CUT} // 2)))"
_TAIL = f"CASE WHEN {_CUT} > 0 THEN right(text, list_max(list_filter(range(401), lambda n: strlen(right(text, n)) <= {_CUT} - {_CUT} // 2))) END"


@query(f"SELECT conv_id, turn, CASE WHEN strlen(text) <= 400 THEN text ELSE {_HEAD} || '{tx.RESPONSE_MARKER}' || {_TAIL} END AS text FROM conversations")
def truncate_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in at most 400 bytes, both ends kept."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.limit_both_ends(F.col("text"), 400).alias("text"))


@query(f"SELECT doc_id, CASE WHEN strlen(text) <= 300 THEN text ELSE left(text, list_max(list_filter(range(301), lambda n: strlen(left(text, n)) <= {300 - len(tx.END_MARKER.encode()) - 1}))) || '{tx.END_MARKER}' || chr(10) END AS text FROM documents")
def truncate_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in at most 300 bytes, their beginning kept."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.limit_end(F.col("text"), 300).alias("text"))


@query()
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues in pages of 1,000 bytes."""
    c = table(spark, sf_dir, "conversations")
    d = c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("dialogue"))
    return dc.pages_of(d, 1000)
