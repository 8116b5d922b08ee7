"""Identifiers of turns and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_NAMESPACE = "feedstock-v1"
# The patterns of identifiers.
KNOWLEDGE_ID = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,254}$"


def feedstock_id(agent: Column, session: Column, turn: Column, namespace: str = ID_NAMESPACE) -> Column:
    """fs- and the first 16 bytes of the SHA-256 of namespace, agent, session and turn, joined by NUL. Records that another system named keep their names under its namespace."""
    nul = F.char(F.lit(0))
    return F.concat(F.lit("fs-"), F.substring(F.sha2(F.concat(F.lit(namespace), nul, agent, nul, session, nul, turn).cast("binary"), 256), 1, 32))


def record_turn_id(raw: Column) -> Column:
    """A turn's name from its raw record, where the log gives none."""
    return F.concat(F.lit("record-"), F.substring(F.sha2(raw.cast("binary"), 256), 1, 32))


def session_from_path(path: Column) -> Column:
    """The file's stem; of ``rollout-`` names with eight dash-separated parts or more, the last five."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.jsonl$", "")
    return F.when(stem.rlike(r"^rollout-") & (F.size(F.split(stem, "-")) >= 8), F.regexp_extract(stem, r"((?:[^-]*-){4}[^-]*)$", 1)).otherwise(stem)


def infer_agent(path: Column) -> Column:
    return F.when(path.contains("/.codex/") | path.rlike(r"/rollout-[^/]*$"), "codex").otherwise("claude")


def path_within(path: Column, root: str) -> Column:
    base = root.rstrip("/")
    return (path == base) | path.startswith(base + "/")
