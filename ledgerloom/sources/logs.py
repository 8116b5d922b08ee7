"""Session logs: JSON lines of two dialects, decoded to events by column expressions.

Readers return (rows, warnings). A malformed line that is terminated fails its
file: the file gives no events and one warning. An unterminated last line counts
once it is valid JSON. Other oddities are warnings and are skipped.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import path_within, record_turn_id, session_from_path
from ..functions.text import join_text_blocks
from ..operators.turns import EVENT_TEXT, FALLBACK_TEXT, FINAL_TEXT

# The formats' names and limits.
MAX_RECORD_BYTES = 64 << 20
SKIPPED_FOLDERS = ("tool-results", "subagents")
INTERRUPTED = ["[Request interrupted by user]", "[Request interrupted by user for tool use]"]
DEFAULT_LOOKBACK = timedelta(hours=24)
FINGERPRINT_BYTES = 64 << 10

_MESSAGE = "struct<role:string,content:string,stop_reason:string>"
CLAUDE = f"type string, uuid string, sessionId string, timestamp string, cwd string, gitBranch string, isMeta boolean, isSidechain boolean, isCompactSummary boolean, isVisibleInTranscriptOnly boolean, message {_MESSAGE}"
_GIT = "struct<branch:string,repository_url:string,repo_url:string>"
_BLOCKS = "array<struct<type:string,text:string>>"
CODEX = f"type string, timestamp string, payload struct<type:string,id:string,turn_id:string,session_id:string,timestamp:string,cwd:string,message:string,role:string,phase:string,content:string,source:string,thread_source:string,item:struct<type:string,content:{_BLOCKS}>,git:{_GIT}>, id string, role string, record_type string, content {_BLOCKS}, git {_GIT}"


def find_logs(spark: SparkSession, roots: dict[str, list[str]], since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """(agent, path, mtime, size) of all ``*.jsonl`` below each agent's roots, without tool results and subagents; modification times between the bounds, both inclusive. A path counts once; roots that don't exist are left out."""
    found = None
    for agent, paths in roots.items():
        for p in paths:
            if not exists(spark, p):
                continue
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(p).select(F.lit(agent).alias("agent"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
            found = files if found is None else found.unionByName(files)
    if found is None:
        if not any(roots.values()):
            raise ValueError("no source roots")
        return spark.createDataFrame([], "agent string, path string, mtime timestamp, size long")
    for folder in SKIPPED_FOLDERS:
        found = found.where(~F.contains("path", F.lit(f"/{folder}/")))
    if since is not None:
        found = found.where(F.col("mtime") >= F.lit(since))
    if until is not None:
        found = found.where(F.col("mtime") <= F.lit(until))
    return found.dropDuplicates(["path"])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or any that a glob names) is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def outside_roots(files: DataFrame, roots: dict[str, list[str]]) -> DataFrame:
    """Explicit files (path) that lie in no root of any agent, which a run refuses."""
    inside = F.lit(False)
    for paths in roots.values():
        for p in paths:
            inside = inside | path_within(F.col("path"), p)
    return files.where(~inside)


def lookback(maximum: int = 0, since: datetime | None = None, until: datetime | None = None, paths: list[str] | None = None, source: str | None = None, now: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """The modification window of a run: a day back where nothing else bounds it. ValueError for a source together with paths."""
    if source and paths:
        raise ValueError("a source and paths exclude each other")
    if maximum or since or until or paths:
        return since, until
    return (now or datetime.now(timezone.utc)) - DEFAULT_LOOKBACK, None


def parse_boundary(text: str, now: datetime, end_of_day: bool = False) -> datetime:
    """24h, 7d or 2w before ``now``, an RFC 3339 time, or a date (its end if an upper bound)."""
    units = {"h": 1, "d": 24, "w": 168}
    if text[:-1].isdigit() and text[-1:] in units:
        return now - timedelta(hours=int(text[:-1]) * units[text[-1]])
    t = datetime.fromisoformat(text)
    if len(text) == 10:
        return t.replace(tzinfo=timezone.utc) + (timedelta(days=1, microseconds=-1) if end_of_day else timedelta(0))
    if t.tzinfo is None:
        raise ValueError("a time needs an offset")
    return t


def read_lines(spark: SparkSession, files: list[str], agent: str) -> DataFrame:
    """(agent, path, line, raw, terminated): a row for each non-blank line; CRLF counts as a line break. A log is one session's and is read whole by one task."""
    whole = spark.read.text(files, wholetext=True).select(F.lit(agent).alias("agent"), F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("lines"))
    lines = whole.select("agent", "path", F.size("lines").alias("_n"), F.posexplode("lines").alias("_at", "raw"))
    out = lines.select("agent", "path", (F.col("_at") + 1).cast("long").alias("line"), F.regexp_replace("raw", "\r$", "").alias("raw"), (F.col("_at") < F.col("_n") - 1).alias("terminated"))
    return out.where(F.trim("raw") != "")


def failed_files(lines: DataFrame) -> DataFrame:
    """(path, reason) of files with a malformed terminated line or one that is too long."""
    reason = F.when(F.octet_length("raw") > MAX_RECORD_BYTES, F.format_string("line %d: record too long", "line")).when(F.col("terminated") & F.try_parse_json("raw").isNull(), F.format_string("line %d: malformed record", "line"))
    return lines.withColumn("reason", reason).where("reason is not null").groupBy("path").agg(F.min_by("reason", "line").alias("reason"))


def usable_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of good files, warnings). An unterminated last line that is not JSON yet is left for later."""
    bad = failed_files(lines)
    good = lines.join(bad.select("path"), "path", "left_anti").where(F.col("terminated") | F.try_parse_json("raw").isNotNull())
    return good, bad


def _event(kind: str, when: Column, **fields: Column) -> Column:
    names = {"session_id": "string", "turn_id": "string", "fallback_turn_id": "string", "ts": "timestamp", "cwd": "string", "repo": "string", "branch": "string", "text": "string", "priority": "int", "completes": "boolean"}
    value = F.struct(F.lit(kind).alias("kind"), *(fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()))
    return F.when(when, value)


def _events(lines: DataFrame, stream: Column, *choices: Column) -> DataFrame:
    # A generator keeps the optimizer from copying the choices into each field and filter.
    out = lines.select("agent", "path", stream.alias("stream"), "line", F.posexplode(F.array_compact(F.array(*choices))).alias("ord", "e"))
    return out.select("agent", "path", "stream", "line", "ord", "e.*")


def _text_of(content: Column, kind: str) -> Column:
    """A message's content: a string, or the texts of an array's blocks of one type."""
    blocks = F.from_json(content, _BLOCKS)
    return F.when(content.startswith("["), join_text_blocks(F.filter(blocks, lambda b: b["type"] == kind))).otherwise(content)


def decode_claude(lines: DataFrame) -> DataFrame:
    """Events of the dialect whose records are user and assistant messages. The stream is the file."""
    r = lines.withColumn("r", F.from_json("raw", CLAUDE))
    m = F.col("r.message")
    blocks = F.from_json(m["content"], _BLOCKS)
    text = _text_of(m["content"], "text")
    hidden = F.lit(False)
    for flag in ("isMeta", "isSidechain", "isCompactSummary", "isVisibleInTranscriptOnly"):
        hidden = hidden | F.coalesce(F.col(f"r.{flag}"), F.lit(False))
    tool = F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))
    user = (F.col("r.type") == "user") & (m["role"] == "user") & ~hidden & ~tool
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    turn = F.coalesce(F.nullif(F.col("r.uuid"), F.lit("")), record_turn_id(F.col("raw")))
    stopped = F.trim(text).isin(INTERRUPTED)
    return _events(
        r,
        F.lit(""),
        _event("complete", user & stopped),
        _event("user", user & ~stopped & ~blank, session_id=F.col("r.sessionId"), turn_id=turn, ts=F.try_to_timestamp("r.timestamp"), cwd=F.col("r.cwd"), branch=F.col("r.gitBranch"), text=text),
        _event("assistant", (F.col("r.type") == "assistant") & (m["role"] == "assistant") & ~F.coalesce(F.col("r.isSidechain"), F.lit(False)), text=F.coalesce(text, F.lit("")), priority=F.lit(FINAL_TEXT), completes=F.coalesce(m["stop_reason"] == "end_turn", F.lit(False))),
    )


def codex_shapes(lines: DataFrame) -> DataFrame:
    """``lines`` with shape: current, header, state or item by the keys that a record has; null if none or several fit."""
    has = lambda k: F.array_contains(F.col("_keys"), k)
    fits = F.array_compact(F.array(
        F.when(has("type") & has("timestamp") & has("payload"), "current"),
        F.when(~has("type") & has("id") & has("timestamp") & (has("instructions") | has("git")), "header"),
        F.when(has("record_type"), "state"),
        F.when(has("type") & ~has("timestamp") & ~has("payload"), "item"),
    ))
    keyed = lines.withColumn("_keys", F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")))
    return keyed.withColumn("_fits", fits).withColumn("shape", F.when(F.size("_fits") == 1, F.get("_fits", F.lit(0)))).drop("_keys", "_fits")


def codex_records(lines: DataFrame) -> DataFrame:
    """``lines`` with shape, record (r), the session that a record names (_own) and, where it is a session's metadata, whether that is a subagent's (_sub)."""
    r = codex_shapes(lines).withColumn("r", F.from_json("raw", CODEX))
    p, meta = F.col("r.payload"), (F.col("shape") == "current") & (F.col("r.type") == "session_meta")
    own = F.when(meta, F.coalesce(F.nullif(p["id"], F.lit("")), p["session_id"])).when(F.col("shape") == "header", F.col("r.id"))
    sub = F.coalesce(p["source"].contains("subagent"), F.lit(False)) | F.coalesce(p["thread_source"] == "subagent", F.lit(False))
    return r.withColumn("_own", own).withColumn("_sub", F.when(meta, sub))


def decode_codex(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, warnings) of the dialect of typed payloads. Each session of a file is a stream; files that begin with a subagent's session are left out. Lines may have ``carried``: the session that a log was in where they begin."""
    carried = F.col("carried") if "carried" in lines.columns else F.lit(None).cast("string")
    r = codex_records(lines)
    kind, p = F.when(F.col("shape") == "current", F.col("r.type")), F.col("r.payload")
    meta = kind == "session_meta"
    w = Window.partitionBy("path").orderBy("line")
    r = r.withColumn("_stream", F.coalesce(F.last("_own", ignorenulls=True).over(w), carried, session_from_path(F.col("path"))))
    first = r.where(meta & carried.isNull()).groupBy("path").agg(F.min_by("_sub", "line").alias("_sub"))
    r = r.drop("_sub").join(first.where("_sub").select("path"), "path", "left_anti")
    item = F.col("shape") == "item"
    ts = F.try_to_timestamp("r.timestamp")
    fallback = record_turn_id(F.col("raw"))
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    completed = join_text_blocks(F.filter(p["item"]["content"], lambda b: b["type"] == "text"))
    answer = _text_of(p["content"], "output_text")
    said = lambda k: join_text_blocks(F.filter("r.content", lambda b: b["type"] == k))
    msg, response = kind == "event_msg", (kind == "response_item") & (p["type"] == "message") & (p["role"] == "assistant")
    legacy = item & (F.col("r.type") == "message")
    events = _events(
        r,
        F.col("_stream"),
        _event("session", meta, session_id=F.col("_own"), ts=F.try_to_timestamp(F.coalesce(F.nullif(p["timestamp"], F.lit("")), F.col("r.timestamp"))), cwd=p["cwd"], repo=F.coalesce(F.nullif(p["git"]["repository_url"], F.lit("")), p["git"]["repo_url"]), branch=p["git"]["branch"]),
        _event("session", F.col("shape") == "header", session_id=F.col("r.id"), ts=ts, repo=F.col("r.git.repository_url"), branch=F.col("r.git.branch")),
        _event("turn", kind == "turn_context", turn_id=p["turn_id"], cwd=p["cwd"]),
        _event("user", msg & (p["type"] == "user_message") & filled(p["message"]), turn_id=p["turn_id"], fallback_turn_id=fallback, ts=ts, text=p["message"]),
        _event("assistant", msg & (p["type"] == "agent_message"), text=p["message"], priority=F.lit(EVENT_TEXT)),
        _event("user", msg & (p["type"] == "item_completed") & (p["item"]["type"] == "UserMessage") & filled(completed), turn_id=p["turn_id"], fallback_turn_id=fallback, ts=ts, text=completed),
        _event("complete", msg & p["type"].isin("task_complete", "turn_aborted"), turn_id=p["turn_id"]),
        _event("assistant", response & (F.coalesce(p["phase"], F.lit("")) == "final_answer"), text=answer, priority=F.lit(FINAL_TEXT), completes=F.lit(True)),
        _event("assistant", response & (F.coalesce(p["phase"], F.lit("")) == ""), text=answer, priority=F.lit(FALLBACK_TEXT)),
        _event("user", legacy & (F.col("r.role") == "user") & filled(said("input_text")), turn_id=F.when(filled(F.col("r.id")), F.concat(F.lit("record-"), "r.id")), fallback_turn_id=fallback, text=said("input_text")),
        _event("assistant", legacy & (F.col("r.role") == "assistant"), text=said("output_text"), priority=F.lit(FINAL_TEXT), completes=F.lit(True)),
    )
    reason = (
        F.when(F.col("shape").isNull(), F.lit("unknown or ambiguous record shape"))
        .when((kind == "response_item") & (p["type"] == "message") & ~F.coalesce(p["role"], F.lit("")).isin("assistant", "user", "developer", "system"), F.lit("unknown message role"))
        .when(response & ~F.coalesce(p["phase"], F.lit("")).isin("", "final_answer", "commentary"), F.lit("unknown message phase"))
        .when(legacy & ~F.coalesce(F.col("r.role"), F.lit("")).isin("assistant", "user", "developer", "system"), F.lit("unknown message role"))
    )
    return events, r.withColumn("reason", reason).where("reason is not null").select("path", "reason").distinct()


def named_sessions(lines: DataFrame) -> DataFrame:
    """(agent, path, session_id): the first session that a log's own lines name, in either dialect; logs that name none have no row."""
    r = F.from_json("raw", "sessionId string, type string, id string, payload struct<id:string,session_id:string>")
    header = F.when(r["type"] == "session_meta", F.coalesce(F.nullif(r["payload"]["id"], F.lit("")), r["payload"]["session_id"])).when(r["type"].isNull(), r["id"])
    named = F.when(F.col("agent") == "codex", header).otherwise(r["sessionId"])
    return lines.withColumn("session_id", F.nullif(F.trim(named), F.lit(""))).where("session_id is not null").groupBy("agent", "path").agg(F.min_by("session_id", "line").alias("session_id"))


def session_catalog(files: DataFrame, named: DataFrame) -> DataFrame:
    """(agent, session_id, path) of logs (agent, path): the session that a log names (``named_sessions``), else the one of its file's name."""
    own = files.select("agent", "path").join(named, ["agent", "path"], "left")
    return own.select("agent", F.coalesce("session_id", session_from_path(F.col("path"))).alias("session_id"), "path")


def find_sessions(catalog: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files of the wanted sessions (agent, session_id), sessions that no configured log holds)."""
    keys = ["agent", "session_id"]
    return catalog.join(wanted.select(*keys).distinct(), keys, "left_semi"), wanted.select(*keys).distinct().join(catalog, keys, "left_anti")


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, size, first_record_hash, boundary_hash) of binary files: what tells a grown log from a rewritten one."""
    first = F.substring_index(F.col("content").cast("string"), "\n", 1)
    return files.select("path", F.col("length").alias("size"), F.sha2(first.cast("binary"), 256).alias("first_record_hash"), F.sha2(F.expr(f"substring(content, greatest(length(content) - {FINGERPRINT_BYTES}, 0) + 1)"), 256).alias("boundary_hash"))


def cache_decision(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, decision): ``reuse`` unchanged size and time, ``relocate`` a moved file, ``resume`` a grown one whose boundary is the same, else ``reparse``.

    ``files`` has path, size, mtime, first_record_hash and boundary_hash, where
    the boundary is at the cached size; ``cached`` the same as last seen.
    """
    own = files.alias("f").join(cached.alias("c"), F.col("f.path") == F.col("c.path"), "left")
    gone = cached.join(files.select("path"), "path", "left_anti").groupBy("first_record_hash", "size", "boundary_hash").agg(F.min("path").alias("moved_from"))
    out = own.join(gone.alias("g"), (F.col("f.first_record_hash") == F.col("g.first_record_hash")) & (F.col("f.size") == F.col("g.size")) & (F.col("f.boundary_hash") == F.col("g.boundary_hash")), "left")
    same = F.col("f.first_record_hash") == F.col("c.first_record_hash")
    decision = (
        F.when(F.col("c.path").isNull() & F.col("moved_from").isNotNull(), "relocate")
        .when(F.col("c.path").isNull(), "reparse")
        .when((F.col("f.size") == F.col("c.size")) & (F.col("f.mtime") == F.col("c.mtime")), "reuse")
        .when((F.col("f.size") > F.col("c.size")) & same & (F.col("f.boundary_hash") == F.col("c.boundary_hash")), "resume")
        .otherwise("reparse")
    )
    return out.select(F.col("f.path").alias("path"), decision.alias("decision"), "moved_from")


def merge_warnings(*warnings: DataFrame) -> DataFrame:
    """Warnings of several readers, once for each path and reason."""
    out = warnings[0].select("path", "reason")
    for w in warnings[1:]:
        out = out.unionByName(w.select("path", "reason"))
    return out.dropDuplicates(["path", "reason"])
