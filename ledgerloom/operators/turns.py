"""Dialogue turns: assembly from events, merging of copies, context and selection.

Clean role-tagged messages are assembled with windows alone. Logs with open
turns, priorities and resumed sessions go through a small state machine, one
session at a time in line order; streams use the same one.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import feedstock_id
from ..session import checkpoint
from .folds import fold

# Priorities of assistant texts.
EVENT_TEXT, FALLBACK_TEXT, FINAL_TEXT = 1, 2, 3

EVENT_SCHEMA = "agent string, path string, stream string, line long, ord int, kind string, session_id string, turn_id string, fallback_turn_id string, ts timestamp, cwd string, repo string, branch string, text string, priority int, completes boolean"
TURN_SCHEMA = "agent string, path string, stream string, session_id string, turn_id string, ts timestamp, cwd string, repo string, branch string, user_text string, assistant_text string, source_line long, error string"
STREAM = ["agent", "path", "stream"]
TURN_COLUMNS = [*STREAM, "session_id", "turn_id", "ts", "cwd", "repo", "branch", "user_text", "assistant_text", "source_line", "error"]


def assemble_messages(messages: DataFrame, conversation: str = "conv_id", position: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each user message of a conversation: turn number, its text, and the last non-blank assistant text before the next one. Windows and one aggregate over the same partitioning."""
    w = Window.partitionBy(conversation).orderBy(position)
    numbered = messages.withColumn("turn_no", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w)).where("turn_no > 0")
    answer = (F.col(role) == "assistant") & (F.trim(text) != "")
    return numbered.groupBy(conversation, "turn_no").agg(
        F.min_by(text, F.when(F.col(role) == "user", F.col(position))).alias("user_text"),
        F.max_by(text, F.when(answer, F.col(position))).alias("assistant_text"),
        F.min(position).alias("first_position"),
    )


class Assembler:
    """Turns of one stream of events. ``state`` is a plain dict, so that it can be stored and resumed in the middle of a turn."""

    def __init__(self, state: dict | None = None):
        self.state = state or {"session": "", "session_ts": None, "env": {}, "pending": "", "used": {}, "open": None}

    def apply(self, e: dict) -> list[dict]:
        """The turns that an event closes."""
        s, closed = self.state, []
        kind, turn = e["kind"], (e["turn_id"] or "").strip()
        if kind in ("session", "turn", "user"):
            s["env"].update({k: e[k] for k in ("cwd", "repo", "branch") if e[k]})
        if kind == "session":
            if e["session_id"]:
                if s["open"] and s["session"] and s["session"] != e["session_id"]:
                    raise ValueError(f"session changed from {s['session']!r} to {e['session_id']!r} within an open turn")
                s["session"] = e["session_id"]
            s["session_ts"] = e["ts"] or s["session_ts"]
        elif kind == "turn":
            if not turn:
                raise ValueError("turn context has no turn ID")
            now = s["open"]
            if now and not now["done"] and now["source"] == turn:
                now.update(s["env"])
            else:
                closed += self.close(True)
                s["pending"] = turn
        elif kind == "user":
            s["session"] = e["session_id"] or s["session"]
            closed += self.close(True)
            source = turn or s["pending"].strip() or (e["fallback_turn_id"] or "").strip()
            if not source:
                raise ValueError("user message has no source turn identity")
            ts = e["ts"] or s["session_ts"]
            if not ts:
                raise ValueError("user message has no timestamp")
            s["pending"] = ""
            s["open"] = {"source": source, "turn_id": self._own(source), "session_id": s["session"], "ts": ts, "user_text": e["text"], "assistant_text": None, "rank": 0, "done": False, "source_line": e["line"], **s["env"]}
        elif kind == "assistant" and s["open"]:
            if (e["text"] or "").strip() and e["priority"] >= s["open"]["rank"]:
                s["open"].update(assistant_text=e["text"], rank=e["priority"])
            s["open"]["done"] |= bool(e["completes"])
        elif kind == "complete" and s["open"] and turn in ("", s["open"]["source"]):
            s["open"]["done"] = True
        return closed

    def _own(self, source: str) -> str:
        """The source, or with the first free suffix from .2 on; ``used`` has the next suffix to try for each name."""
        used, name = self.state["used"], source
        while name in used:
            name, used[source] = f"{source}.{used[source]}", used[source] + 1
        used[name] = 2
        return name

    def close(self, complete: bool = False) -> list[dict]:
        """The open turn, if it is complete or taken as such; it is no longer open."""
        now, self.state["open"] = self.state["open"], None
        return [now] if now and (complete or now["done"]) else []


def dump_state(state: dict) -> str:
    """An assembler's state as text."""
    return json.dumps(state, default=lambda v: {"ts": v.isoformat()})


def load_state(text: str) -> dict:
    return json.loads(text, object_hook=lambda d: datetime.fromisoformat(d["ts"]) if [*d] == ["ts"] and isinstance(d["ts"], str) else d)


class _Turns:
    """A stream's turns as they close. After an event that can't be applied, the rest of the stream is not looked at."""

    def __init__(self, include_open: bool):
        self.assembler, self.include_open, self.failed = Assembler(), include_open, False

    def apply(self, row: dict) -> list[dict]:
        if self.failed:
            return []
        try:
            return self.assembler.apply(row)
        except ValueError as error:
            self.failed = True
            return [{"error": str(error)}]

    def end(self) -> list[dict]:
        return [] if self.failed else self.assembler.close(self.include_open)


def assemble_events(events: DataFrame, include_open: bool = False) -> DataFrame:
    """Turns of all streams (agent, path, stream), in line order within each. A stream with an event that can't be applied gives one row with its error and no turns.

    A task keeps an assembler's state, never a session's rows; turns that a stream
    closed before it failed are taken out by its error.
    """
    out = checkpoint(fold(events, STREAM, ["line", "ord"], lambda key: _Turns(include_open), TURN_SCHEMA, TURN_COLUMNS, ("ts",)))
    failed = out.where("error is not null").select(*STREAM, F.lit(True).alias("_failed"))
    return out.join(failed, STREAM, "left").where("_failed is null or error is not null").drop("_failed")


def as_candidates(turns: DataFrame) -> DataFrame:
    """Assembled turns as feedstock candidates with ids and dialogue."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    dialogue = F.when(F.trim(F.coalesce("assistant_text", F.lit(""))) == "", F.array(message("user", "user_text"))).otherwise(F.array(message("user", "user_text"), message("assistant", "assistant_text")))
    w = Window.partitionBy("agent", "path").orderBy("source_line")
    return turns.where("error is null").select(
        feedstock_id(F.col("agent"), F.col("session_id"), F.col("turn_id")).alias("id"),
        "turn_id", "session_id", F.col("ts").alias("timestamp"), "agent", *(F.coalesce(c, F.lit("")).alias(c) for c in ("cwd", "repo", "branch")),
        dialogue.alias("dialogue"), F.row_number().over(w).cast("long").alias("source_sequence"), F.first("session_id").over(w).alias("source_owner_session_id"), "path",
    )


SAME = ["turn_id", "session_id", "timestamp", "agent", "cwd", "repo", "branch", "dialogue"]


def merge_copies(candidates: DataFrame, same: list[str] = SAME) -> tuple[DataFrame, DataFrame]:
    """(merged turns with a new sequence in their session, conflicts).

    Copies of a turn in several files must agree; sessions with a turn whose
    copies differ are left out whole and their turns listed.
    """
    digest = F.sha2(F.to_json(F.struct(*same)), 256)
    counts = candidates.groupBy("id").agg(F.min(digest).alias("_lo"), F.max(digest).alias("_hi"), F.min(F.struct("path", "source_sequence")).alias("_at"), F.min("agent").alias("agent"), F.min("session_id").alias("session_id"))
    conflicts = counts.where("_lo <> _hi").select("id", "agent", "session_id")
    good = candidates.join(conflicts.select("agent", "session_id").distinct(), ["agent", "session_id"], "left_anti")
    first = good.join(counts.select("id", "_at"), "id").where((F.col("path") == F.col("_at.path")) & (F.col("source_sequence") == F.col("_at.source_sequence"))).drop("_at")
    w = Window.partitionBy("agent", "session_id").orderBy("timestamp", "path", "source_sequence")
    return first.withColumn("source_sequence", F.row_number().over(w).cast("long")), conflicts


def source_session() -> Column:
    """What turns are neighbours by: the owner of their lineage, else their own session."""
    return F.coalesce(F.nullif(F.trim("source_owner_session_id"), F.lit("")), F.col("session_id"))


def with_context(turns: DataFrame, keys: list[str], order: list[str], before: int, after: int = 0, content: Column | None = None) -> DataFrame:
    """``turns`` with ``before`` (and ``after``): the neighbours in their session with offsets from -1 down (1 up). Frames of so many rows, never whole sessions."""
    content = F.col("dialogue") if content is None else content
    w = Window.partitionBy(*keys).orderBy(*order)
    near = lambda lo, hi: F.collect_list(F.struct(content.alias("content"))).over(w.rowsBetween(lo, hi))
    out = turns
    if before:
        out = out.withColumn("before", near(-before, -1)).withColumn("before", F.transform("before", lambda x, i: F.struct((i - F.size("before")).alias("offset"), x["content"].alias("content"))))
    if after:
        out = out.withColumn("after", near(1, after)).withColumn("after", F.transform("after", lambda x, i: F.struct((i + 1).alias("offset"), x["content"].alias("content"))))
    return out


def unfinished(candidates: DataFrame, feedstocks: DataFrame) -> DataFrame:
    """Candidates that are not yet extracted, with ``resumable``: acquired before. ``feedstocks`` has id and extracted_at."""
    known = feedstocks.select("id", F.lit(True).alias("_known"), F.col("extracted_at").alias("_extracted"))
    out = candidates.join(known, "id", "left").where("_known is null or _extracted is null")
    return out.withColumn("resumable", F.coalesce("_known", F.lit(False))).drop("_known", "_extracted")


def select_unfinished(candidates: DataFrame, feedstocks: DataFrame, limit: int = 0, oldest: bool = False, hook: bool = False, ordered: bool = True) -> DataFrame:
    """Resumable turns first, then new ones, each by time (newest first, unless ``oldest``), source order and id; ``hook`` leaves out the latest turn, which may not be over. With a limit only so many rows are ordered in the end; without one and not ``ordered`` they are in any order."""
    out = unfinished(candidates, feedstocks)
    if hook:
        last = out.orderBy(F.desc("timestamp"), F.desc("source_sequence"), F.desc("id")).limit(1).select("id")
        out = out.join(F.broadcast(last), "id", "left_anti")
    way = F.asc if oldest else F.desc
    order = [F.desc("resumable"), way("timestamp"), way("agent"), way("session_id"), way("source_sequence"), F.asc("id")]
    out = out.orderBy(*order) if limit or ordered else out
    return out.limit(limit) if limit else out


def pending_count(candidates: DataFrame, feedstocks: DataFrame) -> DataFrame:
    return unfinished(candidates, feedstocks).agg(F.count(F.lit(1)).alias("pending"))
