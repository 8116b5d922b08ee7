"""Tables that runs change, and the ledger of their steps, in one folder.

A table is a base and, for each commit, the rows that it changed or took away, so
that a step writes what it touched and not the table. One pointer names the parts
in force of all tables and of the ledger: a commit shows whole or not at all, and
a run that dies leaves parts that nothing names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks

DONE, FAILED, WAITING = "done", "failed", "waiting"
STEPS = "step string, key string, state string, reason string, run int"


class RunStore:
    """Tables by name, each with a key column, and steps (step, key, state, reason)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> dict:
        return sinks.read_pointer(self.spark, self.root) or {"version": 0, "tables": {}, "steps": []}

    @property
    def version(self) -> int:
        return self._pointer()["version"]

    def create(self, tables: Mapping[str, tuple[DataFrame, str]]) -> None:
        """Put whole tables (rows, key) in place of what the store has under these names."""
        p = self._pointer()
        v = p["version"] + 1
        for name, (rows, key) in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/base-{v}")
            p["tables"][name] = {"key": key, "base": v, "runs": []}
        sinks.write_pointer(self.spark, self.root, {**p, "version": v}, v - 1 if v > 1 else None)

    def table(self, name: str) -> DataFrame:
        """The table as it is now. Only rows of commits meet by key; the base is read as it lies, without those that changed."""
        t = self._pointer()["tables"][name]
        base = self.spark.read.parquet(f"{self.root}/{name}/base-{t['base']}")
        if not t["runs"]:
            return base
        parts = self.spark.read.schema(self._changes_schema(base)).parquet(*(f"{self.root}/{name}/run-{r}" for r in t["runs"]))
        last = parts.groupBy(t["key"]).agg(F.max_by(F.struct("_gone", *(c for c in base.columns if c != t["key"])), "_run").alias("_r"))
        kept = last.where("not _r._gone").select(*(F.col(c) if c == t["key"] else F.col("_r")[c].alias(c) for c in base.columns))
        return base.join(last.select(t["key"]), t["key"], "left_anti").select(base.columns).unionByName(kept)

    @staticmethod
    def _changes_schema(base: DataFrame):
        from pyspark.sql.types import BooleanType, IntegerType, StructType

        return StructType([*base.schema.fields]).add("_gone", BooleanType()).add("_run", IntegerType())

    def commit(self, outcomes: DataFrame, changes: Mapping[str, DataFrame] | None = None, gone: Mapping[str, DataFrame] | None = None) -> None:
        """Write outcomes (step, key, state, reason), changed rows by table, and keys of rows that go, then show all at once. Refused if another commit came between."""
        p = self._pointer()
        v, changes, gone = p["version"] + 1, changes or {}, gone or {}
        for name in sorted({*changes, *gone}):
            t = p["tables"][name]
            base = self.spark.read.parquet(f"{self.root}/{name}/base-{t['base']}")
            schema = self._changes_schema(base)
            parts = []
            if name in changes:
                # Null where a change has no such column.
                parts.append(changes[name].select(*(F.col(f.name).cast(f.dataType) if f.name in changes[name].columns else F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema), F.lit(False).alias("_gone")))
            if name in gone:
                parts.append(gone[name].select(*(F.col(f.name) if f.name == t["key"] else F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema), F.lit(True).alias("_gone")))
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            rows.withColumn("_run", F.lit(v)).select(schema.names).write.mode("overwrite").parquet(f"{self.root}/{name}/run-{v}")
            t["runs"].append(v)
        outcomes.select("step", "key", "state", "reason", F.lit(v).alias("run")).write.mode("overwrite").parquet(f"{self.root}/steps/run-{v}")
        sinks.write_pointer(self.spark, self.root, {**p, "version": v, "steps": [*p["steps"], v]}, v - 1)

    def steps(self) -> DataFrame:
        """The last state of each key in each step, with the run that left it."""
        runs = self._pointer()["steps"]
        if not runs:
            return self.spark.createDataFrame([], STEPS)
        rows = self.spark.read.schema(STEPS).parquet(*(f"{self.root}/steps/run-{r}" for r in runs))
        return rows.groupBy("step", "key").agg(F.max_by(F.struct("state", "reason", "run"), "run").alias("_r")).select("step", "key", "_r.state", "_r.reason", "_r.run")

    def open(self, step: str) -> DataFrame:
        """(key) of what failed or waits in a step."""
        return self.steps().where((F.col("step") == step) & (F.col("state") != DONE)).select("key")

    def compact(self) -> None:
        """Write each table and the ledger as one part, and delete those before; no run may be under way."""
        p = self._pointer()
        v = p["version"] + 1
        old = [f"{self.root}/{n}/base-{t['base']}" for n, t in p["tables"].items()] + [f"{self.root}/{n}/run-{r}" for n, t in p["tables"].items() for r in t["runs"]] + [f"{self.root}/steps/run-{r}" for r in p["steps"]]
        for name in p["tables"]:
            self.table(name).write.mode("overwrite").parquet(f"{self.root}/{name}/base-{v}")
        self.steps().write.mode("overwrite").parquet(f"{self.root}/steps/run-{v}")
        tables = {n: {**t, "base": v, "runs": []} for n, t in p["tables"].items()}
        sinks.write_pointer(self.spark, self.root, {"version": v, "tables": tables, "steps": [v]}, v - 1)
        for path in old:
            sinks.delete_folder(self.spark, path)


def outcomes(step: str, judged: DataFrame, key: str = "key") -> DataFrame:
    """Ledger rows of judged keys: waiting where ``missing``, failed where there is a ``reason``, else done."""
    state = F.when(F.col("missing"), WAITING).when(F.col("reason").isNotNull(), FAILED).otherwise(DONE)
    return judged.select(F.lit(step).alias("step"), F.col(key).alias("key"), state.alias("state"), F.when(~F.col("missing"), F.col("reason")).alias("reason"))


def counts(rows: DataFrame) -> dict[str, dict[str, int]]:
    """How many keys of each step are done, failed and waiting: a few rows."""
    out: dict[str, dict[str, int]] = {}
    for r in rows.groupBy("step", "state").count().collect():
        out.setdefault(r["step"], {})[r["state"]] = r["count"]
    return out

