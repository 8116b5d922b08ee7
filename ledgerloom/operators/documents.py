"""Documents derived from knowledge: jobs, selection batches, evidence and session context.

Subjects and templates are dimensions of some hundred rows; documents and
knowledge are tables of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_matches, glob_regex, shorten_end
from .lifecycle import with_status

# Sizes of batches and of injected context.
SELECTION_BATCH, CONTEXT_TOKENS, BYTES_PER_TOKEN = 50, 2000, 4
ALWAYS, SUBJECT = "always", "subject"
ALWAYS_HEADING = "## Always-injected documents"


def jobs(subjects: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subject, template) of all assigned templates, and those assigned but missing. ``subjects`` has name and documents (template names)."""
    pairs = subjects.select(F.col("name").alias("subject"), F.explode(F.array_distinct("documents")).alias("template"))
    known = templates.select(F.col("name").alias("template"), F.lit(True).alias("_known"))
    judged = pairs.join(F.broadcast(known), "template", "left")
    return judged.where("_known").select("subject", "template"), judged.where("_known is null").select("subject", "template")


def next_jobs(all_jobs: DataFrame, limit: int, cursor: tuple[str, str] | None = None) -> DataFrame:
    """``limit`` jobs behind the cursor in order of subject and template, going on from the beginning."""
    order = [F.asc("subject"), F.asc("template")]
    if cursor is None:
        return all_jobs.orderBy(*order).limit(limit)
    behind = F.struct("subject", "template") > F.struct(F.lit(cursor[0]).alias("subject"), F.lit(cursor[1]).alias("template"))
    return all_jobs.orderBy(F.desc(behind), *order).limit(limit)


def selection_batches(knowledge: DataFrame, size: int = SELECTION_BATCH) -> DataFrame:
    """Distillable knowledge with its place in its subject, batch number and reference (K001, ...)."""
    own = with_status(knowledge.where("organized_at is not null")).where("status = 'active'")
    w = Window.partitionBy("subject").orderBy("id")
    out = own.withColumn("place", F.row_number().over(w)).withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int"))
    return out.withColumn("reference", F.format_string("K%03d", "place"))


def resolve_references(references: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subject, id) of supplied references, and those unknown or repeated (subject, reference, reason)."""
    counted = references.groupBy("subject", "reference").agg(F.count(F.lit(1)).alias("n"))
    judged = counted.join(batches.select("subject", "reference", "id"), ["subject", "reference"], "left")
    good = judged.where("id is not null and n = 1").select("subject", "id")
    bad = judged.where("id is null or n > 1").select("subject", "reference", F.when(F.col("id").isNull(), "unknown").otherwise("repeated").alias("reason"))
    return good, bad


def document_evidence(documents: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(subject, template, cited, current): how many claims a document cites, and how many of them are still active in its subject."""
    active = with_status(knowledge.where("organized_at is not null")).where("status = 'active'").select("subject", F.col("id").alias("kid"), F.lit(1).alias("_ok"))
    cited = documents.select("subject", "template", F.explode_outer("knowledge_ids").alias("kid"))
    return cited.join(active, ["subject", "kid"], "left").groupBy("subject", "template").agg(F.count("kid").alias("cited"), F.count("_ok").alias("current"))


def matched_subjects(subjects: DataFrame, cwd: str = "", repo: str = "") -> DataFrame:
    """Names of subjects with an alias that matches the working directory or the repository."""
    rows = subjects.select("name", F.explode("aliases").alias("alias")).withColumn("regex", glob_regex("alias"))
    named = [alias_matches(F.col("alias"), F.lit(v), F.col("regex")) for v in (cwd, repo)]
    return rows.where(named[0] | named[1]).select("name").distinct()


def context_blocks(subjects: DataFrame, templates: DataFrame, documents: DataFrame, cwd: str = "", repo: str = "") -> DataFrame:
    """(section, subject, template, heading, block): what a session is given, in order of section, subject and template. The repository counts only where no alias matches the directory."""
    by_cwd = matched_subjects(subjects, cwd).withColumn("_way", F.lit(0))
    matched = by_cwd if not repo else by_cwd.unionByName(matched_subjects(subjects, "", repo).withColumn("_way", F.lit(1)))
    best = matched.agg(F.min("_way").alias("_best"))
    matched = matched.join(F.broadcast(best), F.col("_way") == F.col("_best")).select(F.col("name").alias("subject"), F.lit(True).alias("_m")).distinct()
    pairs = subjects.select(F.col("name").alias("subject"), F.explode(F.array_distinct("documents")).alias("template"))
    t = templates.where(F.col("inject").isin(ALWAYS, SUBJECT)).select(F.col("name").alias("template"), "inject", "output")
    rows = pairs.join(F.broadcast(t), "template").join(matched, "subject", "left").where((F.col("inject") == ALWAYS) | F.col("_m"))
    rows = documents.select("subject", "template", F.trim("body").alias("body")).join(rows, ["subject", "template"])
    always = F.col("inject") == ALWAYS
    block = F.concat(F.lit("### "), "subject", F.lit(" / "), "template", F.lit("\nSource: documents/"), "subject", F.lit("/"), "output", F.lit("\n\n"), "body", F.lit("\n"))
    heading = F.when(always, F.lit(ALWAYS_HEADING)).otherwise(F.concat(F.lit("## Working context: "), "subject", F.lit(" (resolved from cwd)")))
    return rows.select(F.when(always, 0).otherwise(1).alias("section"), "subject", "template", heading.alias("heading"), block.alias("block"))


def omitted_notice(omitted: int, max_tokens: int, hint: str = "") -> str:
    """What ends a context from which documents were left out."""
    return f"\n---\nContext budget reached: {omitted} document(s) were omitted (context.max_tokens = {max_tokens}).\n{hint}" if omitted else ""


def inject(sessions: DataFrame, preamble: str, max_tokens: int = CONTEXT_TOKENS, hint: str = "") -> DataFrame:
    """(session, context, included, omitted) from blocks (session, section, subject, template, heading, block).

    A block that does not fit is left out and later, smaller ones may still fit,
    which is a fold and no window; a session's blocks are one small group. If the
    first does not fit, it is cut. Where documents are left out, a notice with
    ``hint`` ends the context, beyond the budget. Without blocks there is no row.
    """
    budget = max_tokens * BYTES_PER_TOKEN

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, included, omitted, headed = preamble, 0, 0, None
        for r in pdf.sort_values(["section", "subject", "template"]).itertuples(index=False):
            head = "always" if r.section == 0 else r.subject
            part = "\n" + r.block if headed == head else f"\n{r.heading}\n\n{r.block}"
            room = budget - len(out.encode())
            if len(part.encode()) > room:
                part = shorten_end(part, room) if not included else ""
                if not part:
                    omitted += 1
                    continue
            out, included, headed = out + part, included + 1, head
        return pd.DataFrame([(*key, out + omitted_notice(omitted, max_tokens, hint), included, omitted)], columns=["session", "context", "included", "omitted"])

    return sessions.groupBy("session").applyInPandas(fold, "session string, context string, included int, omitted int")


def pages_of(dialogues: DataFrame, size: int) -> DataFrame:
    """(id, page, role, content) of dialogues (id, dialogue) in pages of at most ``size`` bytes."""
    from ..functions.text import pages

    def cut(dialogue: pd.Series) -> pd.Series:
        return dialogue.map(lambda d: [[{"role": r, "content": c} for r, c in p] for p in pages([(m["role"], m["content"] or "") for m in d], size)])

    page = F.pandas_udf(cut, "array<array<struct<role:string,content:string>>>")("dialogue")
    rows = dialogues.select("id", F.posexplode(page).alias("page", "messages"))
    return rows.select("id", (F.col("page") + 1).alias("page"), F.posexplode("messages").alias("place", "m")).select("id", "page", "place", "m.role", "m.content")


def draw_payload(columns: Sequence[str]):
    """A prompt's payload as JSON of the given columns, without nulls."""
    return F.to_json(F.struct(*columns))
