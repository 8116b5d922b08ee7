"""Whole runs over a ``RunStore``: drawing turns, brewing knowledge, distilling documents.

Model calls stay outside: a run takes results (task, key, result), says in the
ledger which keys wait for one and which have a bad one, and applies all others.
The next run takes up what is open; what is done is not touched again. A key's
failure changes nothing of its own and nothing of the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from . import documents, lifecycle, organize, records, runs, turns
from .run_store import DONE, FAILED, WAITING, RunStore, counts, outcomes

NO_OBJECT = "result is not exactly the task's object"


def judged_results(keys: DataFrame, results: DataFrame, task: str) -> DataFrame:
    """``keys`` (key, ...) with ``decoded``, ``missing`` and ``reason``; a key's results are all refused if it has several."""
    own = results.where(F.col("task") == task).groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("result").alias("result"))
    told = records.decoded_result(own, task).select("key", "_n", "decoded")
    reason = F.when(F.col("_n") > 1, "several results").when(F.col("_n").isNotNull() & F.col("decoded").isNull(), NO_OBJECT)
    return keys.join(told, "key", "left").withColumns({"missing": F.col("_n").isNull(), "reason": reason}).drop("_n")


def draw_run(store: RunStore, candidates: DataFrame, results: DataFrame, types: Sequence[str], subjects: Sequence[str], now: datetime, limit: int = 0, oldest: bool = False, hook: bool = False) -> dict[str, int]:
    """Acquire selected turns, draft and extract them, and return a summary.

    ``store`` has ``feedstocks`` (id, ..., types, summary, drafted_at, extracted_at)
    and ``knowledge``; ``results`` of ``draw`` and ``extract`` have turns' ids as
    keys. A draft needs a summary and known types; a turn that is drafted without
    types is extracted without a call. All drafts of a turn become knowledge, or none.
    """
    feedstocks = store.table("feedstocks")
    selected, conflicts, totals = runs.draw(candidates, feedstocks, limit, oldest, hook, ordered=False)
    chosen = checkpoint(selected)
    acquired = chosen.where("not resumable")
    ids = chosen.select(F.col("id").alias("key"))
    done = acquired.select(F.lit("acquire").alias("step"), F.col("id").alias("key"), F.lit(DONE).alias("state"), F.lit(None).cast("string").alias("reason"))
    lost = conflicts.select(F.lit("acquire"), F.concat_ws("/", "agent", "session_id"), F.lit(FAILED), F.lit("copies of a turn differ")).distinct()
    store.commit(done.union(lost), {"feedstocks": acquired})

    own = store.table("feedstocks").join(ids.withColumnRenamed("key", "id"), "id", "left_semi")
    judged = judged_results(own.where("drafted_at is null").select(F.col("id").alias("key")), results, "draw")
    unknown = F.array_except("decoded.types", F.array(*map(F.lit, types)).cast("array<string>"))
    wrong = F.when(F.trim("decoded.summary") == "", "summary is required").when(F.size(unknown) > 0, F.concat(F.lit("unknown types: "), F.array_join(unknown, ", ")))
    drafted = checkpoint(judged.withColumn("reason", F.coalesce("reason", wrong)))
    good = drafted.where("not missing and reason is null").select(F.col("key").alias("id"), "decoded.summary", "decoded.types")
    changed = organize.apply_drafts(own.join(good.select("id"), "id", "left_semi"), good, now)
    store.commit(outcomes("draft", drafted), {"feedstocks": changed})

    own = store.table("feedstocks").join(ids.withColumnRenamed("key", "id"), "id", "left_semi").where("drafted_at is not null and extracted_at is null")
    todo = own.select(F.col("id").alias("key"), (F.size(F.coalesce("types", F.array().cast("array<string>"))) == 0).alias("_empty"))
    judged = judged_results(todo, results, "extract").withColumns({"missing": F.col("missing") & ~F.col("_empty"), "reason": F.when(~F.col("_empty"), F.col("reason"))})
    judged = checkpoint(judged)
    drafts = judged.where("not _empty and reason is null").select(F.col("key").alias("feedstock_id"), F.posexplode("decoded.knowledge").alias("ordinal", "_d")).select("feedstock_id", (F.col("ordinal") + 1).alias("ordinal"), "_d.*")
    made, invalid = organize.extract(own, drafts, [*types], [*subjects])
    verdict = checkpoint(judged.join(invalid.select(F.col("feedstock_id").alias("key"), F.lit("a draft is not a claim of a known type and subject").alias("_bad")), "key", "left").withColumn("reason", F.coalesce("reason", "_bad")))
    over = verdict.where("not missing and reason is null").select(F.col("key").alias("id"))
    made = checkpoint(made.withColumns({"approved": F.lit(False), "supersedes": F.array().cast("array<string>"), "created": F.lit(now), "updated": F.lit(now)}))
    store.commit(outcomes("extract", verdict), {"feedstocks": records.mark_extracted(own.join(over, "id", "left_semi"), over, now), "knowledge": made})

    state = counts(store.steps().where(F.col("run") > store.version - 3))
    n = lambda step, s: state.get(step, {}).get(s, 0)
    taken = chosen.count()
    # Without a limit all that is pending was selected: copies need not be merged once more to be counted.
    pending = totals.first()["pending"] if limit or hook else taken
    return {
        "turns_selected": taken, "turns_pending": pending - n("extract", DONE), "sources_failed": n("acquire", FAILED), "feedstocks_acquired": n("acquire", DONE), "feedstocks_drawn": n("draft", DONE),
        "feedstocks_extracted": n("extract", DONE), "knowledge_created": made.count(), "feedstocks_failed": n("draft", FAILED) + n("extract", FAILED), "waiting": n("draft", WAITING) + n("extract", WAITING),
    }


def apply_organized(knowledge: DataFrame, results: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(changed rows of knowledge, ids of consumed inputs that go) of what ``organize`` resulted in. Of several results for a record the one with most evidence is its last state, as evidence only grows."""
    fine = results.where("error is null")
    content = ["type", "knowledge_subject", "statement", "rationale", "feedstocks", "supersedes"]
    last = fine.where("statement is not null").groupBy(F.col("knowledge_id").alias("id")).agg(F.max_by(F.struct(*content), F.size("feedstocks")).alias("_r"))
    retired = fine.where("retires is not null").groupBy(F.col("retires").alias("id")).agg(F.max("knowledge_id").alias("_by"))
    touched = last.join(retired, "id", "full_outer")
    out = knowledge.join(touched, "id")
    new, by = F.col("_r").isNotNull(), F.col("_by").isNotNull()
    take = {c: F.when(new, F.col("_r")[c]).otherwise(F.col(c)) for c in ("type", "statement", "rationale", "feedstocks", "supersedes")}
    take |= {"organized_at": F.coalesce("organized_at", F.lit(now)), "updated": F.lit(now), "superseded_by": F.when(by, F.col("_by")).otherwise(F.col("superseded_by")), "superseded_at": F.when(by, F.lit(now)).otherwise(F.col("superseded_at"))}
    consumed = fine.select(F.col("input_id").alias("id")).distinct().join(last.select("id"), "id", "left_anti")
    return out.withColumns(take).select(knowledge.columns), consumed


def brew_run(store: RunStore, results: DataFrame, types: Sequence[str], now: datetime, limit: int = 0, retry: bool = False) -> dict[str, int]:
    """Reconcile, then organize the pending knowledge of up to ``limit`` subjects (0: all), and return a summary.

    ``store`` has ``knowledge`` with order_key; ``results`` of ``brew`` have
    subjects as keys and, in ``digest``, what ``organize.subject_digests`` said
    when their payload was made: where it has changed, the subject fails and is
    left alone. ``retry`` takes only subjects that failed or waited before.
    """
    changed, issues = lifecycle.reconcile(store.table("knowledge"), now)
    changed = checkpoint(changed)
    told = issues.groupBy(F.col("id").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("issue")), "; ").alias("reason")).withColumn("missing", F.lit(False))
    store.commit(outcomes("reconcile", told), {"knowledge": changed})

    knowledge = store.table("knowledge")
    pending = organize.pending_subjects(knowledge)
    available = pending.count()
    if retry:
        pending = pending.join(store.open("organize").select(F.col("key").alias("subject")), "subject", "left_semi").orderBy("subject")
    subjects = checkpoint(pending.limit(limit) if limit else pending)
    inputs = knowledge.where("organized_at is null").join(subjects, "subject", "left_semi")
    judged = checkpoint(judged_results(subjects.select(F.col("subject").alias("key")), results, "brew"))
    plans = judged.where("not missing and reason is null").select(F.col("key").alias("subject"), F.explode("decoded.actions").alias("a"))
    draft = F.col("a.resolution.draft")
    actions = plans.select("subject", "a.knowledge_id", "a.resolution.kind", F.coalesce("a.resolution.knowledge_ids", F.array().cast("array<string>")).alias("knowledge_ids"), *(draft[c].alias(f"draft_{c}") for c in organize.DRAFT))
    # One action for each input: an unknown one is of the subject that brought it.
    asked = inputs.select("subject", F.col("id").alias("knowledge_id"), F.lit(1).alias("_in")).join(judged.where("not missing and reason is null").select(F.col("key").alias("subject")), "subject", "left_semi")
    both = asked.join(actions.groupBy("subject", "knowledge_id").agg(F.count(F.lit(1)).alias("_n")), ["subject", "knowledge_id"], "full_outer")
    off = both.where("_in is null or _n is null or _n > 1").groupBy(F.col("subject").alias("key")).agg(F.min(F.concat(F.when(F.col("_in").isNull(), "unknown").when(F.col("_n").isNull(), "omitted").otherwise("repeated"), F.lit(" action: "), "knowledge_id")).alias("_off"))
    judged = checkpoint(judged.drop("decoded").join(off, "key", "left").withColumn("reason", F.coalesce("reason", "_off")).drop("_off"))
    ready = judged.where("not missing and reason is null").select(F.col("key").alias("subject"))
    planned = results.where("task = 'brew'").select(F.col("key").alias("subject"), "digest").join(ready, "subject", "left_semi")
    mine = inputs.join(ready, "subject", "left_semi")
    out = checkpoint(organize.organize_planned(mine, knowledge.where("organized_at is not null"), actions.join(ready, "subject", "left_semi").drop("subject"), planned, types))
    failed = out.where("error is not null").groupBy(F.col("subject").alias("key")).agg(F.min("error").alias("_error"))
    verdict = judged.join(failed, "key", "left").withColumn("reason", F.coalesce("reason", "_error"))
    changed, consumed = apply_organized(knowledge, out, now)
    store.commit(outcomes("organize", verdict), {"knowledge": changed}, {"knowledge": consumed})

    state = counts(store.steps().where(F.col("run") == store.version)).get("organize", {})
    kinds = organize.summary(out).first()
    done = state.get(DONE, 0)
    return {"subjects_selected": subjects.count(), "subjects_pending": available - done, "subjects_processed": done, "subjects_failed": state.get(FAILED, 0), "waiting": state.get(WAITING, 0), **{k: kinds[k] for k in ("created", "evidence_added", "merged", "replaced", "discarded", "retired")}}


def document_key(subject: str = "subject", template: str = "template") -> Column:
    return F.concat_ws("/", subject, template)


def job_evidence(jobs: DataFrame, documents_: DataFrame, knowledge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, candidates), both (key, subject, template, id, type, statement, rationale): active knowledge of each job's subject that its document cites already, and all other."""
    active = lifecycle.with_status(knowledge.where("organized_at is not null")).where("status = 'active'").select("subject", "id", "type", "statement", "rationale")
    rows = jobs.withColumn("key", document_key()).join(active, "subject")
    cited = documents_.select("subject", "template", F.explode("knowledge_ids").alias("id")).distinct()
    on = ["subject", "template", "id"]
    return rows.join(cited, on, "left_semi"), rows.join(cited, on, "left_anti")


def selection_evidence(candidates: DataFrame, size: int = documents.SELECTION_BATCH) -> DataFrame:
    """Candidates with their batch, its result's key (subject/template/batch, from 1) and their reference in it."""
    w = Window.partitionBy("key").orderBy("id")
    out = candidates.withColumn("_p", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("_p") / size).cast("int") + 1)
    return out.withColumns({"batch_key": F.concat_ws("/", "key", "batch"), "reference": F.format_string("K%03d", F.col("_p") % size + 1)}).drop("_p")


def _named(decoded: DataFrame, evidence: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(evidence that results name, (key, reason) of results that name what they were not given, or one thing twice)."""
    told = decoded.select(F.col("key").alias(key), F.explode("decoded.knowledge_references").alias("reference")).groupBy(key, "reference").agg(F.count(F.lit(1)).alias("_n"))
    both = told.join(evidence, [key, "reference"], "left")
    bad = both.where("id is null or _n > 1").groupBy(key).agg(F.min(F.concat(F.when(F.col("id").isNull(), "unknown").otherwise("repeated"), F.lit(" reference: "), "reference")).alias("_bad"))
    return both.where("id is not null").drop("_n"), bad


def distill_run(store: RunStore, subjects: DataFrame, templates: DataFrame, results: DataFrame, limit: int = 0, cursor: tuple[str, str] | None = None, retry: bool = False) -> dict[str, int]:
    """Select evidence in batches, write or delete documents, and return a summary.

    ``store`` has ``documents`` (key, subject, template, knowledge_ids, body) and
    ``knowledge``. Keys of ``distill_select`` are subject/template/batch, of
    ``distill_generate`` subject/template. A job whose batches don't all have a good
    result goes no further. Without evidence its document is deleted, as it is
    when a result uses none of it and has no body.
    """
    good, absent = documents.jobs(subjects, templates)
    every = good.withColumn("_absent", F.lit(False)).unionByName(absent.withColumn("_absent", F.lit(True)))
    available = every.count()
    if retry:
        every = every.join(store.open("distill").select("key"), document_key() == F.col("key"), "left_semi")
    todo = checkpoint(documents.next_jobs(every, limit, cursor) if limit else every)
    now, knowledge = store.table("documents"), store.table("knowledge")
    jobs = todo.where("not _absent").select("subject", "template")
    root, candidates = job_evidence(jobs, now, knowledge)
    batches = checkpoint(selection_evidence(candidates))
    asked = checkpoint(judged_results(batches.select(F.col("batch_key").alias("key"), F.col("key").alias("job")).distinct(), results, "distill_select"))
    chosen, bad = _named(asked.where("not missing and reason is null"), batches, "batch_key")
    asked = asked.drop("decoded").join(bad.withColumnRenamed("batch_key", "key"), "key", "left").withColumn("reason", F.coalesce("reason", "_bad"))
    selecting = asked.groupBy(F.col("job").alias("key")).agg(F.bool_or("missing").alias("missing"), F.min(F.concat(F.lit("selection: "), "reason")).alias("reason"))
    # A failure counts for more than a result that is not there yet.
    prepared = F.when(F.col("_absent"), "preparation: template is not defined")
    state = todo.withColumn("key", document_key()).join(selecting, "key", "left").withColumn("reason", F.coalesce(prepared, "reason")).withColumn("missing", F.coalesce("missing", F.lit(False)) & F.col("reason").isNull())
    state = checkpoint(state.select("key", "subject", "template", "missing", "reason"))
    on = state.where("not missing and reason is null").select("key")

    evidence = root.unionByName(chosen.select(root.columns)).join(on, "key", "left_semi")
    evidence = checkpoint(evidence.withColumn("reference", F.format_string("K%03d", F.row_number().over(Window.partitionBy("key").orderBy("id")))))
    empty = on.join(evidence.select("key").distinct(), "key", "left_anti")
    made = checkpoint(judged_results(evidence.select("key").distinct(), results, "distill_generate"))
    used, bad = _named(made.where("not missing and reason is null"), evidence, "key")
    ids = used.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("knowledge_ids"))
    made = made.join(bad, "key", "left").join(ids, "key", "left").withColumn("body", F.col("decoded.body"))
    blank, none = F.trim(F.regexp_replace("body", r"\s", " ")) == "", F.col("knowledge_ids").isNull()
    wrong = F.when(none & ~blank, "body without knowledge").when(~none & blank, "body is required")
    made = checkpoint(made.withColumn("reason", F.concat(F.lit("generation: "), F.coalesce("reason", "_bad", wrong))).select("key", "missing", "reason", "knowledge_ids", "body"))
    fine = made.where("not missing and reason is null")
    written = fine.where("knowledge_ids is not null").join(state.select("key", "subject", "template"), "key").select("key", "subject", "template", "knowledge_ids", "body")
    gone = checkpoint(empty.unionByName(fine.where("knowledge_ids is null").select("key")).join(now.select("key"), "key", "left_semi"))
    existed = written.join(now.select("key"), "key", "left_semi").count()
    verdict = state.select("key", F.col("missing").alias("_m"), F.col("reason").alias("_r")).join(made.select("key", "missing", "reason"), "key", "left")
    verdict = verdict.select("key", (F.col("_m") | F.coalesce("missing", F.lit(False))).alias("missing"), F.coalesce("_r", "reason").alias("reason"))
    totals = written.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("knowledge_ids")).alias("used")).first()
    store.commit(outcomes("distill", verdict), {"documents": written}, {"documents": gone})

    after = counts(store.steps().where(F.col("run") == store.version)).get("distill", {})
    return {
        "documents_available": available, "documents_selected": todo.count(), "documents_created": totals["n"] - existed, "documents_updated": existed, "documents_deleted": gone.count(),
        "documents_failed": after.get(FAILED, 0), "waiting": after.get(WAITING, 0), "knowledge_selected": chosen.join(on, "key", "left_semi").count(), "knowledge_used": totals["used"] or 0,
    }


# Payloads of the calls that runs wait for; ``runs.draw_payloads`` makes those of drafts.


def _list(*columns: str | Column, order: str = "id") -> Column:
    """A group's rows as structs of ``columns``, ordered."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_v")))), lambda x: x["_v"])


def extract_payloads(feedstocks: DataFrame, masters: DataFrame, types: DataFrame, before: int = 3, after: int = 1) -> DataFrame:
    """(key, payload) of drafted, unextracted turns that have types: their summary and dialogue, and the turns around them in their session. Masters of subjects and types are a few hundred rows."""
    near = turns.with_context(feedstocks, ["agent", "session_id"], ["source_sequence"], before, after).where("drafted_at is not null and extracted_at is null and size(types) > 0")
    turn = lambda c: F.transform(c, lambda x: F.struct(x["offset"].alias("turn_offset"), x["content"].alias("dialogue")))
    known = records.semantic_subjects(masters).agg(_list("name", "definition", "includes", "excludes", order="name").alias("subject_master"))
    kinds = types.agg(_list("name", "definition", order="name").alias("knowledge_type_master"))
    rows = near.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(kinds))  # one row each
    payload = F.struct(F.col("id").alias("feedstock_id"), "summary", F.col("dialogue").alias("target_dialogue"), turn("before").alias("context_before"), turn("after").alias("context_after"), "subject_master", "knowledge_type_master")
    return rows.select(F.col("id").alias("key"), F.to_json(payload).alias("payload"))


def brew_payloads(knowledge: DataFrame, masters: DataFrame, types: DataFrame) -> DataFrame:
    """(key, payload, digest) of each subject with pending knowledge: its inputs in order, its heads, its master; the digest is what a result is held against."""
    inputs = knowledge.where("organized_at is null and coalesce(trim(subject), '') <> ''")
    columns = ["id", "type", "subject", "statement", "rationale", "feedstocks", "supersedes"]
    asked = inputs.groupBy("subject").agg(_list(*columns, order="order_key").alias("unorganized_knowledge"))
    heads = lifecycle.heads(knowledge).join(inputs.select("subject").distinct(), "subject", "left_semi").groupBy("subject").agg(_list(*columns).alias("organized_heads"))
    known = records.semantic_subjects(masters).select(F.col("name").alias("subject"), F.array(F.struct("name", "definition", "includes", "excludes")).alias("subject_master"))
    kinds = types.agg(_list("name", "definition", order="name").alias("knowledge_type_master"))
    rows = asked.join(heads, "subject", "left").join(known, "subject", "left").crossJoin(F.broadcast(kinds))
    digests = organize.subject_digests(inputs, knowledge.where("organized_at is not null"))
    none = lambda c, like: F.coalesce(F.col(c), F.filter(F.col(like), lambda x: F.lit(False)))
    payload = F.struct("subject", "unorganized_knowledge", none("organized_heads", "unorganized_knowledge").alias("organized_heads"), F.coalesce("subject_master", F.array().cast(known.schema["subject_master"].dataType)).alias("subject_master"), "knowledge_type_master")
    return rows.join(digests, "subject").select(F.col("subject").alias("key"), F.to_json(payload).alias("payload"), "digest")


def _template(templates: DataFrame) -> DataFrame:
    return templates.select(F.col("name").alias("template"), F.struct(*templates.columns).alias("_template"))


def _evidence() -> Column:
    return _list("reference", "type", F.col("statement").alias("claim"), F.nullif("rationale", F.lit("")).alias("rationale"))


def selection_payloads(jobs: DataFrame, templates: DataFrame, documents_: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(key, payload) of each job's batches of candidates."""
    rows = selection_evidence(job_evidence(jobs, documents_, knowledge)[1])
    grouped = rows.groupBy(F.col("batch_key").alias("key"), "template").agg(_evidence().alias("unselected_knowledge"))
    return grouped.join(_template(templates), "template").select("key", F.to_json(F.struct(F.col("_template").alias("template"), "unselected_knowledge")).alias("payload"))


def generation_payloads(evidence: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, payload) of each job's evidence (key, template, id, type, statement, rationale): what its document cites and what was selected."""
    rows = evidence.withColumn("reference", F.format_string("K%03d", F.row_number().over(Window.partitionBy("key").orderBy("id"))))
    grouped = rows.groupBy("key", "template").agg(_evidence().alias("knowledge"))
    return grouped.join(_template(templates), "template").select("key", F.to_json(F.struct(F.col("_template").alias("template"), "knowledge")).alias("payload"))
