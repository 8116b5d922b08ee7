"""Whole runs, composed of the other operators: drawing turns, their payloads, subjects of repositories, documents.

Model calls lie between the steps: payloads go out as JSON columns and results
come back as tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ADJACENT_BYTES, ADJACENT_MARKER, RESPONSE_BYTES, RESPONSE_MARKER, canonical_repo, glob_regex, is_glob, limit_both_ends, ordered_set, slug
from . import search, sync, turns

THRESHOLD_DEPTH, THRESHOLD_LIMIT, AGENT_LIMIT = 100, 200, 20


def draw(candidates: DataFrame, feedstocks: DataFrame, limit: int = 0, oldest: bool = False, hook: bool = False, same: list[str] = turns.SAME, ordered: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected turns, turns of sessions whose copies conflict, one row of counts). Only turns that their own session's file holds are acquired. Without a limit selected turns need not be ``ordered``."""
    own = candidates.where(F.col("source_owner_session_id").isNull() | (F.trim("source_owner_session_id") == "") | (F.col("source_owner_session_id") == F.col("session_id")))
    merged, conflicts = turns.merge_copies(own, same)
    selected = turns.select_unfinished(merged, feedstocks, limit, oldest, hook, ordered)
    todo = turns.unfinished(merged, feedstocks).agg(F.count(F.lit(1)).alias("pending"), F.count_if("resumable").alias("resumable"))
    counts = todo.crossJoin(conflicts.agg(F.count(F.lit(1)).alias("conflicts")))  # one row each
    return selected, conflicts, counts


def message(role: str, dialogue: str = "dialogue") -> Column:
    """The last content of a role in a dialogue; null if there is none."""
    return F.try_element_at(F.transform(F.filter(dialogue, lambda m: m["role"] == role), lambda m: m["content"]), F.lit(-1))


def draw_payloads(candidates: DataFrame, context: int = 3) -> DataFrame:
    """(id, payload): each turn's input and response, at most RESPONSE_BYTES, and its prior turns, whose responses have ADJACENT_BYTES at most."""
    short = candidates.select("id", "agent", turns.source_session().alias("_who"), "source_sequence", "cwd", "repo", message("user").alias("user_input"), message("assistant").alias("_answer"))
    cut = short.withColumns({"agent_response": limit_both_ends(F.col("_answer"), RESPONSE_BYTES, RESPONSE_MARKER), "_near": limit_both_ends(F.col("_answer"), ADJACENT_BYTES, ADJACENT_MARKER)})
    around = turns.with_context(cut, ["agent", "_who"], ["source_sequence"], context, content=F.struct(F.col("user_input"), F.col("_near").alias("agent_response")))
    prior = F.transform("before", lambda x: F.struct(x["offset"].alias("turn_offset"), x["content"]["user_input"].alias("user_input"), x["content"]["agent_response"].alias("agent_response")))
    environment = F.struct(F.nullif("cwd", F.lit("")).alias("cwd"), F.nullif("repo", F.lit("")).alias("repo"))
    payload = F.struct(F.col("id").alias("feedstock_id"), "user_input", "agent_response", prior.alias("prior_turns"), environment.alias("target_environment"))
    return around.select("id", F.to_json(payload).alias("payload"))


def alias_owners(places: DataFrame, subjects: DataFrame) -> DataFrame:
    """(repo, cwd, name): the first subject by name with an alias that matches either. Equal aliases and equal repositories are equi-joins; aliases with wild cards are joined by what stands before the first one, whose lengths are few."""
    values = places.select("repo", "cwd", F.explode(F.array("repo", "cwd")).alias("value")).where("coalesce(value, '') <> ''")
    known = subjects.select("name", F.explode("aliases").alias("alias"))
    exact = values.join(known.withColumnRenamed("alias", "value"), "value")
    host = values.withColumn("_host", canonical_repo(F.col("value"))).where("_host <> ''").join(known.select("name", canonical_repo(F.col("alias")).alias("_host")).where("_host <> ''"), "_host")
    globs = known.where(is_glob(F.col("alias"))).withColumns({"_regex": glob_regex("alias"), "_stem": F.regexp_extract("alias", r"^[^*?\[\\]*", 0)}).withColumn("_n", F.length("_stem"))
    lengths = globs.agg(F.collect_set("_n").alias("_ns"))  # one row of lengths of stems
    begun = values.crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode("_ns")).withColumn("_stem", F.substring(F.col("value"), F.lit(1), F.col("_n")))
    wild = begun.join(globs, ["_n", "_stem"]).where(F.rlike("value", F.col("_regex")))
    parts = [d.select("repo", "cwd", "name") for d in (exact, host, wild)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("repo", "cwd").agg(F.min("name").alias("name"))


def repository_subjects(turns_: DataFrame, subjects: DataFrame) -> DataFrame:
    """(name, aliases, is_new): what subjects become after turns (cwd, repo) were seen.

    A turn whose repository or directory an alias matches adds both to the first
    such subject by name. Other repositories make a new subject from their last
    part; where another repository has that name already, a hash of the address
    follows it. Turns without a repository change nothing by themselves.
    """
    places = turns_.select("repo", "cwd").where("coalesce(repo, '') <> ''").distinct()
    owner = alias_owners(places, subjects)
    found = places.join(owner, ["repo", "cwd"], "left")
    base = subjects.select(F.col("name").alias("_base"), F.col("aliases").alias("_theirs"))
    new = found.where("name is null").withColumn("_base", slug(F.col("repo"))).join(base, "_base", "left")
    taken = F.coalesce(F.exists("_theirs", lambda a: (canonical_repo(a) != "") & (canonical_repo(a) != canonical_repo(F.col("repo")))), F.lit(False))
    first = F.first("repo").over(Window.partitionBy("_base").orderBy("repo"))
    other = taken | (F.col("_theirs").isNull() & (canonical_repo(first) != canonical_repo(F.col("repo"))))
    named = new.withColumn("name", F.when(other, F.concat_ws("-", "_base", F.substring(F.sha2(F.col("repo").cast("binary"), 256), 1, 8))).otherwise(F.col("_base")))
    added = found.where("name is not null").select("name", "repo", "cwd").unionByName(named.select("name", "repo", "cwd"))
    places_of = added.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("repo", "cwd"))))).alias("_new"))
    empty = F.array().cast("array<string>")
    out = subjects.select("name", "aliases").withColumn("_old", F.lit(True)).join(places_of, "name", "full_outer")
    aliases = ordered_set(F.concat(F.coalesce("aliases", empty), F.filter(F.coalesce("_new", empty), lambda a: a.isNotNull())))
    return out.select("name", aliases.alias("aliases"), F.col("_old").isNull().alias("is_new"))


def threshold_hybrid(index: DataFrame, vectors: DataFrame, o: search.Options, least: float, depth: int = THRESHOLD_DEPTH, limit: int = THRESHOLD_LIMIT) -> DataFrame:
    """Hybrid search whose vector branch only counts scores of ``least`` and above."""
    return search.fuse({"text": search.text_branch(index, o, depth), "vector": search.vector_branch(index, vectors, o, depth, least)}, limit)


def agent_candidates(index: DataFrame, vectors: DataFrame, o: search.Options) -> DataFrame:
    """What an agent is shown to choose from: the first twenty of both branches, fused."""
    return search.fuse({"text": search.text_branch(index, o, THRESHOLD_DEPTH), "vector": search.vector_branch(index, vectors, o, THRESHOLD_DEPTH)}, AGENT_LIMIT)


def write_documents(documents: DataFrame, written: DataFrame, emptied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents after a run, those deleted): written ones (subject, template, knowledge_ids, body) replace their predecessors, those without evidence any more go."""
    key = F.concat_ws("/", "subject", "template")
    old, new, gone = (d.withColumn("record_key", key) for d in (documents, written, emptied))
    deleted = old.join(gone.select("record_key"), "record_key", "left_semi")
    return sync.delete(sync.upsert(old, new.select(old.columns)), gone).drop("record_key"), deleted.drop("record_key")


def show(index: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Records by id, of any kind and status."""
    return index.where(F.col("id").isin([*ids]))
