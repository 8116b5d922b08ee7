"""Ingesting logs again and again: only what is new is read.

A folder keeps, for each log, how far it was read, what tells it from another
one, and the state of its streams' assemblers; and the turns that its streams
closed. A run decides for each log: ``reuse`` (same size and time), ``relocate``
(an unchanged log that moved), ``resume`` (it grew, and what was read is still
there; also if it moved) or ``reparse``. Turns belong to a source, not to a path,
so that logs which are reused, moved or resumed keep theirs as they are. Tables
are never changed in place; a pointer names those in force.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import session_from_path
from ..operators.folds import fold
from ..operators.turns import STREAM, TURN_COLUMNS, TURN_SCHEMA, Assembler, dump_state, load_state
from ..session import shared_path
from . import logs, ranges, sinks

SOURCES = "source string, agent string, path string, size long, mtime timestamp, offset long, lines long, first_record_hash string, boundary_hash string, carried string, subagent boolean, states string"
#: Runs whose tables are read side by side; beyond that they are written as one.
MOST_RUNS = 16
#: Kind of the event that hands an assembler its state from an earlier run.
STATE = "state"


class _Resumed:
    """A stream's turns as they close, and its state at the end, as a row with nothing else."""

    def __init__(self):
        self.assembler, self.failed = Assembler(), False

    def apply(self, row: dict) -> list[dict]:
        if self.failed:
            return []
        if row["kind"] == STATE:
            self.assembler = Assembler(load_state(row["text"]))
            return []
        try:
            return self.assembler.apply(row)
        except ValueError as error:
            self.failed = True
            return [{"error": str(error)}]

    def end(self) -> list[dict]:
        closed = []
        if not self.failed:
            if self.assembler.state["open"] and self.assembler.state["open"]["done"]:
                closed = self.assembler.close()
            closed.append({"state": dump_state(self.assembler.state)})
        return closed


class LogCache:
    """The kept state of logs in a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def state(self) -> dict:
        return sinks.read_pointer(self.spark, self.root) or {"version": 0, "sources": None, "turns": [], "states": []}

    def _read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def sources(self) -> DataFrame:
        name = self.state()["sources"]
        return self._read([name] if name else [], SOURCES)

    def turns(self) -> DataFrame:
        """TURN_SCHEMA of all sources in force, under the paths that they have now."""
        own = self._read(self.state()["turns"], f"source string, {TURN_SCHEMA}")
        return own.drop("path", "agent").join(self.sources().select("source", "agent", "path"), "source").select(*TURN_COLUMNS)

    def decide(self, files: DataFrame) -> DataFrame:
        """Files (agent, path, mtime, size) with decision and what is known of their source (known, start, lines, carried, subagent, moved_from). Hashes are taken of logs alone that are new or changed."""
        known = self.sources()
        own = known.select("agent", "path", *(F.col(c).alias(f"_{c}") for c in ("source", "size", "mtime", "offset", "lines", "first_record_hash", "boundary_hash", "carried", "subagent")))
        joined = files.select("agent", "path", "mtime", "size").join(own, ["agent", "path"], "left")
        same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
        reused = joined.where(same).withColumns({"decision": F.lit("reuse"), "moved_from": F.lit(None).cast("string"), "first_record_hash": F.col("_first_record_hash")})
        changed = joined.where(~F.coalesce(same, F.lit(False)))
        # A new path may be a log that is no longer where it was: one with the same first record.
        gone = known.join(files.select("agent", "path"), ["agent", "path"], "left_anti")
        gone = gone.groupBy("agent", "first_record_hash").agg(F.min_by(F.struct("path", "source", "size", "mtime", "offset", "lines", "boundary_hash", "carried", "subagent"), "path").alias("g"))
        first = ranges.fingerprints(changed.where("_source is null").select("agent", "path", "mtime", "size", F.lit(None).cast("long").alias("at")), "at").drop("at", "boundary_hash")
        moved = first.join(gone, ["agent", "first_record_hash"], "left").withColumn("moved_from", F.col("g.path"))
        fresh = moved.select("agent", "path", "mtime", "size", *(F.col(f"g.{c}").alias(f"_{c}") for c in ("source", "size", "mtime", "offset", "lines")), F.when(F.col("moved_from").isNotNull(), F.col("first_record_hash")).alias("_first_record_hash"), *(F.col(f"g.{c}").alias(f"_{c}") for c in ("boundary_hash", "carried", "subagent")), "moved_from")
        asked = changed.where("_source is not null").withColumn("moved_from", F.lit(None).cast("string")).unionByName(fresh)
        asked = ranges.fingerprints(asked.withColumn("at", F.col("_size")), "at").drop("at")
        whole = (F.col("first_record_hash") == F.col("_first_record_hash")) & (F.col("boundary_hash") == F.col("_boundary_hash"))
        decision = F.when(whole & (F.col("size") == F.col("_size")) & F.col("moved_from").isNotNull(), "relocate").when(whole & (F.col("size") > F.col("_size")) & (F.col("_offset") <= F.col("_size")), "resume").otherwise("reparse")
        decided = asked.withColumn("decision", decision).drop("boundary_hash").unionByName(reused.drop("boundary_hash"))
        kept, resumed = F.col("decision") != "reparse", F.col("decision") == "resume"
        return decided.select(
            "agent", "path", "mtime", "size", "first_record_hash", "decision", F.when(kept, F.col("moved_from")).alias("moved_from"), F.when(kept, F.col("_source")).alias("known"), F.when(resumed, F.col("_offset")).otherwise(0).alias("start"), F.when(resumed, F.col("_lines")).otherwise(0).alias("lines"),
            F.when(kept, F.col("_carried")).alias("carried"), F.when(kept, F.coalesce("_subagent", F.lit(False))).otherwise(False).alias("subagent"), F.when(kept & ~resumed, F.col("_offset")).alias("end_offset"), F.when(kept & ~resumed, F.col("_lines")).alias("end_lines"), F.when(kept & ~resumed, F.col("_boundary_hash")).alias("boundary_hash"),
        )

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def run(self, files: DataFrame, range_bytes: int = ranges.RANGE_BYTES, limit: int = logs.MAX_RECORD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(turns, report, warnings) after a run over files (agent, path, mtime, size), as ``find_logs`` lists them.

        The report has path, decision, moved_from, start and bytes_read (of records from start on; hashes
        take the first record and 64 KiB of a log more). A log with a record that is
        malformed or too long, or with an event that can't be applied, gives a warning
        and is as it was before the run, but its turns are not in the result. What
        was known of logs that are not listed is forgotten, unless they moved.
        """
        before, tag = self.state(), uuid.uuid4().hex[:8]
        version = before["version"] + 1
        plan = self._stage(self.decide(files).withColumn("source", F.coalesce("known", F.sha2(F.concat_ws("\0", F.lit(f"{version}-{tag}"), "agent", "path"), 256))), "log-plan")
        read = plan.where(F.col("decision").isin("resume", "reparse") & ~F.col("subagent"))
        records = self._stage(ranges.read(ranges.split(read.select("agent", "path", "start", "size", "lines"), range_bytes), limit).join(plan.select("path", "source", "carried"), "path").withColumn("whole", F.try_parse_json("raw").isNotNull()), "log-records")
        # Records are parsed to be judged once, where they are read.
        usable = F.col("terminated") | F.col("whole")
        reason = F.when(F.col("too_long"), F.format_string("line %d: record too long", "line")).when(F.col("terminated") & ~F.col("whole"), F.format_string("line %d: malformed record", "line"))
        bad = records.withColumn("reason", reason).where("reason is not null").groupBy("path").agg(F.min_by("reason", "line").alias("reason"))
        good = records.where(usable & ~F.col("too_long")).join(bad.select("path"), "path", "left_anti").drop("whole")
        claude = logs.decode_claude(good.where("agent <> 'codex'"))
        codex, odd = logs.decode_codex(good.where("agent = 'codex'"))
        events = claude.unionByName(codex)
        made = self._stage(self._assemble(events, plan, before), "log-turns")
        failed = made.where("error is not null").groupBy("path").agg(F.min("error").alias("reason"))
        bad = self._stage(bad.unionByName(failed), "log-failed")
        fine = made.join(bad.select("path"), "path", "left_anti").join(plan.select("path", "source"), "path")
        names = {k: f"{k}-{version}-{tag}" for k in ("sources", "turns", "states")}
        fine.where("state is null").select("source", *TURN_COLUMNS).write.parquet(f"{self.root}/{names['turns']}")
        fine.where("state is not null").select("source", "stream", "state").write.parquet(f"{self.root}/{names['states']}")
        self._sources(plan, good, bad, names["states"]).write.parquet(f"{self.root}/{names['sources']}")
        sinks.write_pointer(self.spark, self.root, {"version": version, "sources": names["sources"], "turns": [*before["turns"], names["turns"]], "states": [*before["states"], names["states"]]}, before["version"] or None)
        if len(before["turns"]) >= MOST_RUNS:
            self.compact()
        size = F.when(F.col("decision").isin("resume", "reparse") & ~F.col("subagent"), F.col("size") - F.col("start")).otherwise(0)
        report = plan.select("path", "decision", "moved_from", "start", size.alias("bytes_read"))
        return self.turns().join(bad.select("path"), "path", "left_anti").select(*TURN_COLUMNS), report, logs.merge_warnings(bad, odd)

    def compact(self) -> None:
        """Write the turns and states in force as one table each."""
        state, tag = self.state(), uuid.uuid4().hex[:8]
        version = state["version"] + 1
        names = {k: f"{k}-{version}-{tag}" for k in ("sources", "turns", "states")}
        own = self.sources()
        self._read(state["turns"], f"source string, {TURN_SCHEMA}").join(own.select("source"), "source", "left_semi").write.parquet(f"{self.root}/{names['turns']}")
        self._states(state).write.parquet(f"{self.root}/{names['states']}")
        own.withColumn("states", F.lit(names["states"])).write.parquet(f"{self.root}/{names['sources']}")
        sinks.write_pointer(self.spark, self.root, {"version": version, "sources": names["sources"], "turns": [names["turns"]], "states": [names["states"]]}, state["version"])

    def vacuum(self) -> list[str]:
        """Delete tables that are no longer in force; no run may be under way."""
        state = self.state()
        used = {state["sources"], *state["turns"], *state["states"]}
        old = sorted(n for n in sinks.folders(self.spark, self.root) if n not in used)
        for n in old:
            sinks.delete_folder(self.spark, f"{self.root}/{n}")
        return old

    def _states(self, state: dict) -> DataFrame:
        """(source, stream, state) of the streams of all sources in force."""
        shape = "source string, stream string, state string"
        tables = [self._read([n], shape).withColumn("table", F.lit(n)) for n in state["states"]]
        return reduce(DataFrame.unionByName, tables).join(self.sources().select("source", F.col("states").alias("table")), ["source", "table"], "left_semi").drop("table")

    def _assemble(self, events: DataFrame, plan: DataFrame, before: dict) -> DataFrame:
        """Turns that close and states, resumed streams going on from where they were."""
        if before["states"]:
            resumed = self._states(before).join(plan.where("decision = 'resume'").select("agent", "path", "source"), "source")
            given = {"kind": F.lit(STATE), "text": F.col("state"), "line": F.lit(-1).cast("long"), "ord": F.lit(0)}
            types = dict(events.dtypes)
            events = events.unionByName(resumed.select(*(given[c].alias(c) if c in given else F.col(c) if c in STREAM else F.lit(None).cast(types[c]).alias(c) for c in events.columns)))
        return fold(events, STREAM, ["line", "ord"], lambda key: _Resumed(), f"{TURN_SCHEMA}, state string", [*TURN_COLUMNS, "state"], ("ts",))

    def _sources(self, plan: DataFrame, good: DataFrame, bad: DataFrame, states: str) -> DataFrame:
        """What is known of each log after the run; failed ones are as they were."""
        # The break that will end an unterminated record counts as that record's line.
        seen = good.groupBy("path").agg(F.max("next").alias("_offset"), F.max(F.col("line") - F.when(F.col("terminated"), 0).otherwise(1)).alias("_line"))
        told = logs.codex_records(good.where("agent = 'codex'")).groupBy("path")
        named = told.agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("line"))).alias("_session"), F.min_by("_sub", F.when(F.col("_sub").isNotNull(), F.col("line"))).alias("_first_sub"))
        ends = seen.join(named, "path", "left")
        done = plan.join(bad.select("path"), "path", "left_anti").join(ends, "path", "left")
        is_read = F.col("decision").isin("resume", "reparse")
        now = done.withColumns({
            "offset": F.when(is_read, F.coalesce("_offset", "start")).otherwise(F.col("end_offset")), "lines": F.when(is_read, F.coalesce("_line", "lines")).otherwise(F.col("end_lines")),
            "carried": F.coalesce("_session", "carried", F.when(F.col("agent") == "codex", session_from_path(F.col("path")))), "subagent": F.col("subagent") | F.coalesce(F.col("_first_sub") & (F.col("decision") == "reparse"), F.lit(False)),
        })
        hashed = ranges.fingerprints(now.where(is_read).drop("first_record_hash", "boundary_hash")).unionByName(now.where(~is_read))
        old = self.sources()
        of_states = hashed.join(old.select("source", F.col("states").alias("_states")), "source", "left").withColumn("states", F.when(is_read, F.lit(states)).otherwise(F.col("_states")))
        rows = of_states.select([c.split()[0] for c in SOURCES.split(", ")])
        kept = old.join(bad.select("path"), "path", "left_semi").join(rows.select("source"), "source", "left_anti")
        return rows.unionByName(kept.select(rows.columns))
