"""Organizing knowledge: a chronological fold of actions, a subject at a time.

Each action depends on what earlier ones of its subject left, so a subject is one
group of one fold: its new inputs, its current heads and their
active predecessors, and one action for each input. Subjects run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .folds import Gathered, fold
from .lifecycle import with_status

INPUT = "subject string, id string, type string, statement string, rationale string, feedstocks array<string>, status string, supersedes array<string>, is_input boolean, order_key string, action string, targets array<string>, draft struct<type:string,subject:string,statement:string,rationale:string>"
RESULT = "subject string, input_id string, knowledge_id string, outcome string, type string, knowledge_subject string, statement string, rationale string, feedstocks array<string>, supersedes array<string>, retires string, error string"
_COLUMNS = ["subject", "input_id", "knowledge_id", "outcome", "type", "knowledge_subject", "statement", "rationale", "feedstocks", "supersedes", "retires", "error"]
DRAFT = ("type", "subject", "statement", "rationale")
# How many targets an action names, and whether it brings a draft.
ACTIONS = {"discard": (0, False), "new": (0, False), "equivalent": (1, False), "complements": (1, True), "conflicts": (1, False)}


def organize(inputs: DataFrame, knowledge: DataFrame, actions: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Results of all actions, in order within a subject; a subject with an error has one row that says so and changes nothing.

    ``inputs``: id, subject, type, statement, feedstocks, order_key (sorts as the
    establishing turns do) and, if there is one, rationale. ``knowledge``:
    organized rows, with order_key. ``actions``: knowledge_id, kind,
    knowledge_ids, draft_type, draft_statement and, where they are there,
    draft_subject (of the same subject) and draft_rationale; one for each input.
    ``types`` is the vocabulary that types of inputs and drafts are held against.
    Actions for unknown inputs are not seen here: ``records.one_action_each``
    lists them.
    """
    empty = F.lit(None).cast("string")
    of = lambda d, c: F.col(c) if c in d.columns else empty
    draft = F.struct(*(of(actions, f"draft_{c}").alias(c) for c in DRAFT))
    acts = actions.select(F.col("knowledge_id").alias("id"), F.col("kind").alias("action"), F.col("knowledge_ids").alias("targets"), draft.alias("draft"))
    own = inputs.select("subject", "id", "type", "statement", of(inputs, "rationale").alias("rationale"), "feedstocks", F.lit("pending").alias("status"), F.array().cast("array<string>").alias("supersedes"), F.lit(True).alias("is_input"), "order_key")
    new = own.join(acts, "id", "left").select(own.columns + ["action", "targets", "draft"])
    old = with_status(knowledge).where("status in ('active', 'pending')").join(inputs.select("subject").distinct(), "subject", "left_semi")
    old = old.select("subject", "id", "type", "statement", of(old, "rationale").alias("rationale"), "feedstocks", "status", "supersedes", F.lit(False).alias("is_input"), "order_key")
    return fold(new.unionByName(old, allowMissingColumns=True), ["subject"], ["id"], lambda key: Gathered(key, partial(_fold, types=types)), RESULT, _COLUMNS)


CHANGED = "knowledge of the subject changed since the plan was made"


def subject_digests(inputs: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(subject, digest): what a plan for a subject's inputs is made from, its inputs and active or pending knowledge, as a multiset. Tasks send sums of parts of each row's hash, never the rows."""
    columns = ["id", "type", "statement", "feedstocks", "status", "supersedes"]
    new = inputs.select("subject", "id", "type", "statement", "feedstocks", F.lit("input").alias("status"), F.array().cast("array<string>").alias("supersedes"))
    old = with_status(knowledge).where("status in ('active', 'pending')").join(inputs.select("subject").distinct(), "subject", "left_semi").select("subject", *columns)
    rows = new.unionByName(old).select("subject", F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    part = lambda k: F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = rows.groupBy("subject").agg(F.count(F.lit(1)).cast("string").alias("n"), *(part(k).alias(f"p{k}") for k in range(4)))
    return sums.select("subject", F.sha2(F.concat_ws("|", "n", *(f"p{k}" for k in range(4))), 256).alias("digest"))


def organize_planned(inputs: DataFrame, knowledge: DataFrame, actions: DataFrame, planned: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """``organize`` for subjects whose digest is still that of ``planned`` (subject, digest); each other subject has one row with CHANGED as its error, and nothing of its plan is applied."""
    now = subject_digests(inputs, knowledge)
    # Written: it is asked twice, and what is judged must be what is applied.
    fresh = checkpoint(now.join(planned.select("subject", F.col("digest").alias("_planned")), "subject", "left"))
    same = fresh.where("digest = _planned").select("subject")
    applied = organize(inputs.join(same, "subject", "left_semi"), knowledge, actions, types)
    refused = fresh.where("_planned is null or digest <> _planned").select("subject", F.lit(CHANGED).alias("error"))
    return applied.unionByName(refused, allowMissingColumns=True)


def _fold(key: tuple, rows: list[dict], types: Sequence[str] | None) -> list[dict]:
    try:
        return _apply(key[0], rows, types)
    except ValueError as e:
        return [{"error": str(e)}]


def _as_list(v) -> list:
    return [] if v is None else [*v]


def _checked(subject: str, of: str, r: dict, types: Sequence[str] | None) -> dict:
    """A draft's trimmed fields, if they are a claim of the subject."""
    out = {c: (r[c] or "").strip() for c in DRAFT}
    if types is not None and out["type"] not in types:
        raise ValueError(f"{of} has the unknown type {out['type']!r}")
    if out["subject"] not in ("", subject):
        raise ValueError(f"{of} belongs to subject {out['subject']!r}")
    if not out["statement"] or "\r" in out["statement"]:
        raise ValueError(f"{of} has no proper statement")
    return {**out, "subject": subject}


def _apply(subject: str, rows: list[dict], types: Sequence[str] | None) -> list[dict]:
    seen: set[str] = set()
    for r in rows:
        if r["is_input"]:
            if r["id"] in seen:
                raise ValueError(f"several actions for {r['id']}")
            seen.add(r["id"])
            _checked(subject, r["id"], r, types)
    live = {r["id"]: {**r, "feedstocks": {*_as_list(r["feedstocks"])}, "supersedes": _as_list(r["supersedes"])} for r in rows if not r["is_input"]}
    named = {p for r in live.values() for p in r["supersedes"]}
    leads = {i: i for i in live if i not in named}  # what an id stands for now
    out = []
    for r in sorted((r for r in rows if r["is_input"]), key=lambda r: (r["order_key"], r["id"])):
        targets, me = _as_list(r["targets"]), r["id"]
        if r["action"] not in ACTIONS:
            raise ValueError(f"no valid action for {me}")
        n, draft = ACTIONS[r["action"]]
        brought = r["draft"] if r["draft"] and r["draft"]["statement"] is not None else None
        if len(targets) != n or draft != (brought is not None):
            raise ValueError(f"{r['action']} of {me} has the wrong targets or draft")
        row = {"input_id": me, "knowledge_id": me}
        record = {**r, "feedstocks": {*_as_list(r["feedstocks"])}, "supersedes": []}
        if r["action"] == "discard":
            out.append({**row, "outcome": "discarded"})
            continue
        if r["action"] == "new":
            live[me], leads[me] = record, me
            out.append(_result(row, record, "created"))
            continue
        at, passed = targets[0], set()
        while at in leads and leads[at] != at and at not in passed:
            passed.add(at)
            at = leads[at]
        if leads.get(at) != at:
            raise ValueError(f"target {targets[0]} of {me} is not a current head")
        target = live[at]
        if r["action"] == "equivalent":
            target["feedstocks"] |= record["feedstocks"]
            leads[me] = at
            out.append(_result({**row, "knowledge_id": at}, target, "evidence_added"))
            continue
        if r["action"] == "conflicts":
            if target["feedstocks"] & record["feedstocks"] or target["order_key"] == r["order_key"]:
                raise ValueError(f"{me} conflicts with {at} from the same source")
            if r["order_key"] < target["order_key"]:
                leads[me] = at
                out.append({**row, "knowledge_id": at, "outcome": "historical_conflict_ignored"})
                continue
        else:
            record.update(_checked(subject, f"the draft of {me}", brought, types), feedstocks=record["feedstocks"] | target["feedstocks"])
        record["supersedes"] = sorted({at, *(p for p in target["supersedes"] if p in live and live[p]["status"] == "active")})
        live[me], leads[at], leads[me] = record, me, me
        retires = at if target["status"] == "pending" else None
        if retires:
            target["status"] = "superseded"
        out.append(_result({**row, "retires": retires}, record, "merged" if draft else "replaced"))
    claims: dict[str, str] = {}
    for i in sorted(i for i, lead in leads.items() if i == lead):
        key = " ".join(live[i]["statement"].split()).lower()
        if key in claims:
            raise ValueError(f"duplicate current claims: {claims[key]} and {i}")
        claims[key] = i
    return out


def _result(row: dict, record: dict, outcome: str) -> dict:
    return {**row, "outcome": outcome, "type": record["type"], "knowledge_subject": record["subject"], "statement": record["statement"], "rationale": record["rationale"] or None, "feedstocks": sorted(record["feedstocks"]), "supersedes": record["supersedes"]}


def extract(feedstocks: DataFrame, drafts: DataFrame, types: list[str], subjects: list[str]) -> tuple[DataFrame, DataFrame]:
    """(unorganized knowledge, feedstocks with an invalid draft). All drafts of a feedstock count, or none.

    ``feedstocks``: id, drafted_at, extracted_at; only drafted, unextracted ones
    are taken. ``drafts``: feedstock_id, ordinal, type, subject, statement, rationale.
    """
    trimmed = drafts.select("feedstock_id", "ordinal", *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("type", "subject", "statement", "rationale")))
    pending = feedstocks.where("drafted_at is not null and extracted_at is null").select(F.col("id").alias("feedstock_id"))
    own = trimmed.join(pending, "feedstock_id", "left_semi")
    good = F.col("type").isin(types) & (F.col("subject").isin(subjects) | (F.col("subject") == "")) & (F.col("statement") != "") & ~F.contains("statement", F.lit("\r"))
    verdict = own.groupBy("feedstock_id").agg(F.bool_and(good).alias("ok"))
    rows = own.join(verdict.where("ok").select("feedstock_id"), "feedstock_id", "left_semi")
    key = F.substring(F.sha2(F.concat_ws("\x00", "feedstock_id", F.col("ordinal").cast("string")), 256), 1, 32)
    knowledge = rows.select(key.alias("id"), F.col("feedstock_id").alias("established_by"), "type", "subject", "statement", "rationale", F.array("feedstock_id").alias("feedstocks"))
    return knowledge, verdict.where("not ok").select("feedstock_id")


def apply_drafts(feedstocks: DataFrame, drafts: DataFrame, now) -> DataFrame:
    """Feedstocks with summary, types and drafted_at set once; drafts (id, summary, types) for drafted ones change nothing."""
    d = drafts.select("id", F.col("summary").alias("_summary"), F.col("types").alias("_types"))
    first = F.col("drafted_at").isNull() & F.col("_summary").isNotNull() & (F.trim("_summary") != "")
    out = feedstocks.join(d, "id", "left").withColumn("_first", first)
    return out.withColumns({"summary": F.when(F.col("_first"), F.trim("_summary")).otherwise(F.col("summary")), "types": F.when(F.col("_first"), F.array_sort(F.array_distinct("_types"))).otherwise(F.col("types")), "drafted_at": F.when(F.col("_first"), F.lit(now)).otherwise(F.col("drafted_at"))}).drop("_first", "_summary", "_types")


def pending_subjects(knowledge: DataFrame) -> DataFrame:
    """Subjects with knowledge that is not organized yet, in order."""
    return knowledge.where("organized_at is null and coalesce(trim(subject), '') <> ''").select("subject").distinct().orderBy("subject")


def summary(results: DataFrame) -> DataFrame:
    """One row of a run: subjects, those that failed, and how often each outcome came about."""
    outcomes = ("created", "evidence_added", "merged", "replaced", "historical_conflict_ignored", "discarded")
    failed = F.count_distinct(F.when(F.col("error").isNotNull(), F.col("subject"))).alias("failed")
    return results.agg(F.count_distinct("subject").alias("subjects"), failed, *(F.count_if(F.coalesce(F.col("outcome") == o, F.lit(False))).alias(o) for o in outcomes), F.count("retires").alias("retired"))
