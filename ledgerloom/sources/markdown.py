"""Markdown records with YAML front matter: readers and writers of whole folders.

Files are read as rows by Spark; YAML of a file's head is decoded in Arrow
batches. A bad file is a warning and the rest go on.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before the body, which is not matched: a pattern goes through it far slower than it is cut.
HEAD = r"^---\r?\n([\s\S]*?\r?\n)---\r?\n"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, mtime_ns, size) of all ``*.md`` below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    stem = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return files.select(stem.alias("id"), "path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def read_records(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records with path, id from the file's name, the fields of ``schema`` and body; warnings (path, reason)). Unknown keys are refused."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return decode_records(whole, schema)


def decode_records(whole: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """As ``read_records``, for rows (path, content)."""
    rows = judged_records(whole, schema)
    return rows.where("_reason is null").drop("_reason"), rows.where("_reason is not null").select("path", F.col("_reason").alias("reason"))


def judged_records(whole: DataFrame, schema: str, error=None) -> DataFrame:
    """Rows (path, content) as path, id, the fields of ``schema``, body and _reason, which says of each that is no record why. ``error``: what it says of those without content."""
    fields = [part.split()[0] for part in _parts(schema)]

    def head(text: pd.Series) -> pd.DataFrame:
        import yaml

        out = []
        for t in text:
            try:
                value = yaml.safe_load(t or "")
                if not isinstance(value, dict):
                    raise ValueError("front matter is not a mapping")
                unknown = sorted({*map(str, value)} - {*fields})
                if unknown:
                    raise ValueError(f"unknown keys: {', '.join(unknown)}")
                out.append((json.dumps(value, default=lambda v: v.isoformat()), None))
            except (yaml.YAMLError, ValueError, TypeError) as e:
                out.append((None, str(e).splitlines()[0]))
        return pd.DataFrame(out, columns=["json", "reason"])

    before = F.length(F.regexp_extract("content", HEAD, 0))
    split = whole.select("path", F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("id"), F.regexp_extract("content", HEAD, 1).alias("_head"), F.when(before > 0, F.substring("content", before + 1, F.length("content"))).otherwise("").alias("body"), F.coalesce(before > 0, F.lit(False)).alias("_ok"), (F.lit(None).cast("string") if error is None else error).alias("_error"))
    # Not deterministic for Spark, which else decodes heads anew for each filter and column.
    decoded = split.withColumn("_h", F.when(F.col("_ok"), F.pandas_udf(head, "json string, reason string").asNondeterministic()("_head")))
    reason = F.coalesce(F.col("_error"), F.when(~F.col("_ok"), "no front matter").otherwise(F.col("_h.reason")))
    rows = decoded.withColumn("_r", F.from_json("_h.json", schema))
    return rows.select("path", "id", *(F.col(f"_r.{f}").alias(f) for f in fields if f != "id"), "body", reason.alias("_reason"))


def _parts(schema: str) -> list[str]:
    from ..operators.records import _top_level

    return _top_level(schema)


def claim_sections(body):
    """(statement, rationale) columns of a body with ``## Claim`` and ``## Rationale``."""
    statement = F.trim(F.regexp_extract(body, r"(?:^|\n)## Claim\s*\n([\s\S]*?)(?:\n## Rationale\s*\n|$)", 1))
    rationale = F.trim(F.regexp_extract(body, r"\n## Rationale\s*\n([\s\S]*)$", 1))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return trim(statement).alias("statement"), trim(rationale).alias("rationale")


def claim_body(statement, rationale):
    return F.concat(F.lit("## Claim\n\n"), statement, F.when(F.coalesce(rationale, F.lit("")) != "", F.concat(F.lit("\n\n## Rationale\n\n"), rationale)).otherwise(""), F.lit("\n"))


def render(columns: list[str], body):
    """A record as text: front matter of JSON values, which YAML reads as well, and the body."""
    values = [F.concat(F.lit(f"{c}: "), F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":([\s\S]*)\}$', 1)) for c in columns]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *values), F.lit("\n---\n"), body)
