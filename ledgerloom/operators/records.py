"""Records: validation, lookups and conditional changes, each a join or projection that returns new tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import IDENTIFIER, KNOWLEDGE_ID
from ..functions.text import ordered_set, set_normalize
from .lifecycle import effective_status

# Names of agents, injection modes and results of model calls.
AGENTS = ("claude", "codex")
INJECT = ("", "always", "subject")
RESULT_SCHEMAS = {
    "draw": "summary string, types array<string>",
    "extract": "knowledge array<struct<type:string,subject:string,statement:string,rationale:string>>",
    "brew": "actions array<struct<knowledge_id:string,resolution:struct<kind:string,knowledge_ids:array<string>,draft:struct<type:string,subject:string,statement:string,rationale:string>>>>",
    "distill_select": "knowledge_references array<string>",
    "distill_generate": "body string, knowledge_references array<string>",
}


def _first_error(*checks: tuple[Column, str]) -> Column:
    out = None
    for bad, reason in checks:
        bad = F.coalesce(bad, F.lit(True))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out


def split(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reason``)."""
    judged = rows.withColumn("reason", error)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def feedstock_error() -> Column:
    return _first_error(
        (~F.col("id").rlike(IDENTIFIER), "invalid id"), (~F.col("turn_id").rlike(IDENTIFIER), "invalid turn_id"), (_blank("session_id"), "session is required"),
        (F.col("timestamp").isNull(), "timestamp is required"), (~F.col("agent").isin(*AGENTS), "unknown agent"),
        (F.col("extracted_at").isNotNull() & F.col("drafted_at").isNull(), "extracted before drafted"), (F.col("drafted_at").isNotNull() & _blank("summary"), "summary is required"),
        (~F.col("types").eqNullSafe(set_normalize(F.col("types"))), "types must be unique and sorted"),
    )


def knowledge_error() -> Column:
    organized, superseded = F.col("organized_at").isNotNull(), ~_blank("superseded_by")
    return _first_error(
        (~F.col("id").rlike(KNOWLEDGE_ID), "invalid id"), (_blank("type"), "type is required"), (organized & _blank("subject"), "subject is required"), (F.size("feedstocks") < 1, "feedstocks are required"),
        (~F.array_contains("feedstocks", F.col("established_by")), "established_by is not among feedstocks"), (~organized & (F.coalesce("approved", F.lit(False)) | superseded | F.col("invalidated_at").isNotNull() | (F.size("supersedes") > 0)), "unorganized knowledge has no lifecycle"),
        (superseded != F.col("superseded_at").isNotNull(), "superseded_by and superseded_at go together"), (F.array_contains("supersedes", F.col("id")), "supersedes itself"), (_blank("statement"), "statement is required"),
    )


def master_error() -> Column:
    return _first_error((_blank("name"), "name is required"), (F.col("name").contains("/"), "name must not contain a slash"), (_blank("definition"), "definition is required"))


def template_error() -> Column:
    return _first_error((_blank("name"), "name is required"), (_blank("output"), "output is required"), (~F.col("output").endswith(".md"), "output must be Markdown"), (_blank("purpose"), "purpose is required"), (~F.coalesce("inject", F.lit("")).isin(*INJECT), "unknown inject mode"))


def document_error() -> Column:
    return _first_error((_blank("subject"), "subject is required"), (_blank("template"), "template is required"), (F.size("knowledge_ids") < 1, "knowledge is required"), (F.size(F.array_distinct("knowledge_ids")) != F.size("knowledge_ids"), "knowledge repeats"), (_blank("body"), "body is required"))


def semantic_subjects(masters: DataFrame) -> DataFrame:
    """What a model is told of subjects: names and their meaning, without aliases and documents."""
    return masters.select("name", "definition", "includes", "excludes")


def find(rows: DataFrame, ids: Sequence[str], key: str = "id") -> DataFrame:
    """The rows of some ids; a filter that reaches the scan."""
    return rows.where(F.col(key).isin([*ids]))


def missing_references(rows: DataFrame, references: str, targets: DataFrame, key: str = "id") -> DataFrame:
    """(key, reference): cited ids that do not exist."""
    cited = rows.select(F.col(key), F.explode(references).alias("reference"))
    return cited.join(targets.select(F.col(key).alias("reference")), "reference", "left_anti").select(key, "reference")


def with_established(knowledge: DataFrame, feedstocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(knowledge with its establishing turn, knowledge whose turn is missing)."""
    f = feedstocks.select(F.col("id").alias("established_by"), F.struct("timestamp", "session_id", "turn_id", "id").alias("established"))
    return knowledge.join(f, "established_by"), knowledge.join(f.select("established_by"), "established_by", "left_anti")


def last_evidence(knowledge: DataFrame, feedstocks: DataFrame) -> DataFrame:
    """(id, last_evidence): the time of the newest turn that knowledge cites."""
    cited = knowledge.select(F.col("id").alias("kid"), F.explode("feedstocks").alias("id"))
    return cited.join(feedstocks.select("id", "timestamp"), "id").groupBy(F.col("kid").alias("id")).agg(F.max("timestamp").alias("last_evidence"))


def _change(rows: DataFrame, keys: DataFrame, when: Column, key: str = "id", **new: Column) -> DataFrame:
    out = rows.join(keys.select(key, F.lit(True).alias("_named")).distinct(), key, "left").withColumn("_do", F.col("_named").isNotNull() & when)
    return out.withColumns({c: F.when(F.col("_do"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_named", "_do")


def approve(knowledge: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    return _change(knowledge, ids, F.col("organized_at").isNotNull() & (effective_status() == "pending"), approved=F.lit(True), updated=F.lit(now))


def invalidate(knowledge: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """Organized, unsuperseded rows are invalidated; those that are already keep their time."""
    return _change(knowledge, ids, F.col("organized_at").isNotNull() & effective_status().isin("pending", "active"), invalidated_at=F.lit(now), updated=F.lit(now))


def add_evidence(knowledge: DataFrame, evidence: DataFrame, now: datetime, retired: bool = False) -> DataFrame:
    """Feedstocks of ``evidence`` (id, feedstock) joined to each row's own; retired rows only if allowed."""
    more = evidence.groupBy("id").agg(F.collect_set("feedstock").alias("_more"))
    allowed = F.lit(retired) | effective_status().isin("pending", "active")
    out = knowledge.join(more, "id", "left").withColumn("_do", F.col("_more").isNotNull() & allowed)
    return out.withColumns({"feedstocks": F.when(F.col("_do"), F.array_sort(F.array_union("feedstocks", "_more"))).otherwise(F.col("feedstocks")), "updated": F.when(F.col("_do"), F.lit(now)).otherwise(F.col("updated"))}).drop("_more", "_do")


def supersede_pending(knowledge: DataFrame, successors: DataFrame, now: datetime) -> DataFrame:
    """Pending rows of ``successors`` (id, by) become superseded by them."""
    out = knowledge.join(successors.select("id", F.col("by").alias("_by")), "id", "left").withColumn("_do", F.col("_by").isNotNull() & (effective_status() == "pending"))
    new = {"superseded_by": F.col("_by"), "superseded_at": F.lit(now), "updated": F.lit(now)}
    return out.withColumns({c: F.when(F.col("_do"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_by", "_do")


def mark_extracted(feedstocks: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """Drafted rows are marked once."""
    return _change(feedstocks, ids, F.col("drafted_at").isNotNull() & F.col("extracted_at").isNull(), extracted_at=F.lit(now))


def merge_aliases(masters: DataFrame, additions: DataFrame) -> DataFrame:
    """Masters with aliases of ``additions`` (name, definition, aliases) joined to their own; unknown names are new rows."""
    more = additions.select("name", F.col("definition").alias("_definition"), F.col("aliases").alias("_more"))
    empty = F.array().cast("array<string>")
    out = masters.select("name", "definition", "aliases").join(more, "name", "full_outer")
    return out.select("name", F.coalesce("definition", "_definition").alias("definition"), ordered_set(F.concat(F.coalesce("aliases", empty), F.coalesce("_more", empty))).alias("aliases"))


def unknown_types(rows: DataFrame, vocabulary: Sequence[str], column: str = "types") -> DataFrame:
    """(id, unknown): types that no master defines."""
    unknown = F.array_except(column, F.array(*map(F.lit, vocabulary)))
    return rows.select("id", unknown.alias("unknown")).where(F.size("unknown") > 0)


def one_action_each(inputs: DataFrame, actions: DataFrame) -> DataFrame:
    """(knowledge_id, problem): omitted, unknown or repeated."""
    a = actions.groupBy("knowledge_id").agg(F.count(F.lit(1)).alias("n"))
    both = inputs.select(F.col("id").alias("knowledge_id"), F.lit(True).alias("_in")).join(a, "knowledge_id", "full_outer")
    problem = F.when(F.col("n").isNull(), "omitted").when(F.col("_in").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return both.select("knowledge_id", problem.alias("problem")).where("problem is not null")


def snapshot_digest(rows: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """(key, digest) of the rows that a plan was made for; joined again before it is applied."""
    return rows.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("digest"))


def changed_since(snapshot: DataFrame, now: DataFrame, key: str = "id") -> DataFrame:
    """Keys whose digest differs, or that came or went."""
    both = snapshot.select(key, F.col("digest").alias("_a")).join(now.select(key, F.col("digest").alias("_b")), key, "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def decoded_result(rows: DataFrame, task: str, column: str = "result") -> DataFrame:
    """All rows, with ``decoded``: null where the result is not exactly the task's object (unknown keys, trailing text and wrong types are refused)."""
    schema = RESULT_SCHEMAS[task]
    keys = F.array(*(F.lit(part.split()[0]) for part in _top_level(schema)))
    decoded = F.from_json(column, schema)
    found = F.json_object_keys(column)
    # As the only element of an array, a value can't have anything behind it.
    alone = F.try_parse_json(F.concat(F.lit("["), column, F.lit("]")))
    whole = alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull() & (F.size(F.array_except(found, keys)) == 0) & (F.size(F.array_except(keys, found)) == 0)
    complete = F.lit(True)
    for part in _top_level(schema):
        complete = complete & decoded[part.split()[0]].isNotNull()
    return rows.withColumn("decoded", F.when(F.coalesce(whole & complete, F.lit(False)), decoded))


def decode_result(rows: DataFrame, task: str, column: str = "result") -> tuple[DataFrame, DataFrame]:
    """(rows with ``decoded``, rows whose result is not exactly the task's object)."""
    judged = decoded_result(rows, task, column)
    return judged.where("decoded is not null"), judged.where("decoded is null").drop("decoded")


def _top_level(schema: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(now.strip())
            now = ""
        else:
            now += c
    return [*parts, now.strip()]


def model_usage(results: DataFrame, dialect: str, column: str = "usage") -> DataFrame:
    """``results`` with input, cached, cache_write and output tokens. ``claude`` counts cache reads and writes beside the input, the others within it; cached tokens never exceed the input."""
    u = F.from_json(column, "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long, cached_input_tokens long, prompt_tokens long, completion_tokens long")
    n = lambda *names: F.coalesce(*(u[x] for x in names), F.lit(0).cast("long"))
    if dialect == "claude":
        read, write = n("cache_read_input_tokens"), n("cache_creation_input_tokens")
        return results.withColumns({"input": n("input_tokens") + read + write, "cached": read, "cache_write": write, "output": n("output_tokens")})
    total = n("input_tokens", "prompt_tokens")
    return results.withColumns({"input": total, "cached": F.least(n("cached_input_tokens"), total), "cache_write": F.lit(0).cast("long"), "output": n("output_tokens", "completion_tokens")})
