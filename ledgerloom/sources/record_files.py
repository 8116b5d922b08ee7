"""Folders of Markdown records as a data source whose filters decide what is opened.

Below a root lie folders of a fixed depth, whose names are columns (agent, year and
month of turns; the subject of documents), and in them one file for each record.
Filters on these columns and on the id are pushed down: other folders are not
listed, and a record that is asked for by id is opened without any list. The driver
lists folders only, and holds LISTED of them at most: where a level has more, tasks
list it, and each takes the folders that hash to it. Tasks list files and read them,
several tasks a folder.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..operators import records
from ..operators.lifecycle import with_status
from .markdown import claim_sections, judged_records

#: Tasks that share a folder's files.
SPLITS = 4
#: Folders that the driver holds at most.
LISTED = 4_096
#: Whether Spark passes filters to Python sources at all.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")


def _anything(name: str) -> bool:
    return True


def _listed(system, folder: str, mine: Callable[[str], bool] = _anything) -> Iterator:
    """What lies in a folder under names that are ``mine``. A local folder's list is gone through, not held; other systems' clients hold it whole."""
    from pyarrow import fs

    if not isinstance(system, fs.LocalFileSystem):
        yield from (i for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if mine(i.base_name))
        return
    try:
        entries = os.scandir(folder)
    except FileNotFoundError:
        return
    with entries:
        paths = (f"{folder}/{e.name}" for e in entries if mine(e.name))
        while some := [*islice(paths, 1_000)]:
            yield from system.get_file_info(some)


def _named(system, folder: str, names: Iterable[str]) -> list:
    """Names are looked at, not searched for. One that leads elsewhere is none."""
    return system.get_file_info([f"{folder}/{x}" for x in names if x not in ("", ".", "..") and "/" not in x])


@dataclass
class Share(InputPartition):
    """A share of the files of some folders (path, names of the levels), or some of them by id. Of folders above the last level, a share of the folders below them and all files of these."""

    folders: tuple[tuple[str, tuple[str, ...]], ...]
    ids: tuple[str, ...] | None
    part: int
    parts: int


class RecordFiles(DataSource):
    """Rows (a column for each level, id, path, mtime_ns, size, content, error). Options: ``path``, ``levels`` (names, comma-joined, may be empty), ``content`` (false: files are listed, not opened), ``splits``, ``tasks``, ``listed`` (folders that the driver holds at most)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def levels(self) -> list[str]:
        return [x for x in self.options.get("levels", "").split(",") if x]

    def schema(self) -> str:
        return ", ".join([*(f"{x} string" for x in self.levels()), "id string", "path string", "mtime_ns long", "size long", "content string", "error string"])

    def reader(self, schema) -> RecordReader:
        kind = PushedReader if self.options.get("push") == "true" else RecordReader
        return kind(self.options["path"], self.levels(), self.options.get("content", "true") != "false", int(self.options.get("splits", SPLITS)), int(self.options.get("tasks", 64)), int(self.options.get("listed", LISTED)))


class RecordReader(DataSourceReader):
    def __init__(self, root: str, levels: Sequence[str], content: bool = True, splits: int = SPLITS, tasks: int = 64, listed: int = LISTED):
        self.root, self.levels, self.content, self.splits, self.tasks, self.listed = root.rstrip("/"), [*levels], content, splits, tasks, listed
        self.wanted: dict[str, set[str]] = {}

    def _below(self, system, found: Iterable[tuple[str, tuple[str, ...]]], level: str, mine: Callable[[str], bool] = _anything) -> Iterator[tuple[str, tuple[str, ...]]]:
        """The folders of a level below those found above it."""
        from pyarrow import fs

        asked = self.wanted.get(level)
        for path, names in found:
            infos = _listed(system, path, mine) if asked is None else _named(system, path, filter(mine, sorted(asked)))
            yield from ((i.path, (*names, i.base_name)) for i in infos if i.type == fs.FileType.Directory)

    def partitions(self) -> Sequence[InputPartition]:
        system, at = _open(self.root)
        found: list[tuple[str, tuple[str, ...]]] = [(at, ())]
        ids = tuple(sorted(self.wanted["id"])) if "id" in self.wanted else None
        parts = 1 if ids is not None else self.splits
        for level in self.levels:
            below = [*islice(self._below(system, found, level), self.listed + 1)]
            if len(below) > self.listed:
                parts = max(self.splits, -(-self.tasks // len(found)))
                break
            found = sorted(below)
        size = max(1, -(-len(found) * parts // self.tasks))
        bundles = [tuple(found[lo : lo + size]) for lo in range(0, len(found), size)]
        return [Share(b, ids, k, parts) for b in bundles for k in range(parts)] or [Share((), ids, 0, 1)]

    def read(self, partition: Share) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = _open(self.root)

        def mine(name: str) -> bool:
            return partition.parts == 1 or zlib.crc32(name.encode()) % partition.parts == partition.part

        found: Iterable[tuple[str, tuple[str, ...]]] = partition.folders
        for level in self.levels[len(partition.folders[0][1]) if partition.folders else 0 :]:
            # The first level that the driver left is dealt; what lies below a folder is its task's.
            found, mine = self._below(system, found, level, mine), _anything
        for folder, names in found:
            infos = _listed(system, folder, mine) if partition.ids is None else _named(system, folder, (f"{i}.md" for i in partition.ids))
            for info in infos:
                if info.type == fs.FileType.File and info.base_name.endswith(".md"):
                    yield (*names, info.base_name.removesuffix(".md"), info.path, info.mtime_ns, info.size, *self._content(system, info.path))

    def _content(self, system, path: str) -> tuple[str | None, str | None]:
        if not self.content:
            return None, None
        try:
            with system.open_input_stream(path) as f:
                return f.read().decode(), None
        except (OSError, UnicodeDecodeError) as e:
            return None, str(e).splitlines()[0]


class PushedReader(RecordReader):
    """With filters. Spark refuses it where PUSHDOWN is off."""

    def pushFilters(self, filters) -> Iterator:
        """Equality and membership on levels and the id are used up; all other filters go back to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else {*f.value} if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in (*self.levels, "id"):
                yield f
                continue
            column, values = f.attribute[0], {v for v in values if v is not None}
            self.wanted[column] = self.wanted[column] & values if column in self.wanted else values


def files(spark: SparkSession, root: str, levels: Sequence[str] = (), content: bool = True, splits: int = SPLITS, tasks: int | None = None) -> DataFrame:
    """The files below ``root`` as rows of ``RecordFiles``. Filters are pushed where the session's PUSHDOWN is on (``get_session`` turns it on); else Spark applies them to what was read. Many folders are bundled for ``tasks`` tasks, four for each core if that is not given."""
    spark.dataSource.register(RecordFiles)
    push = spark.conf.get(PUSHDOWN, "false").lower()
    return spark.read.format("record_files").options(path=root, push=push, levels=",".join(levels), content=str(content).lower(), splits=splits, tasks=tasks or 4 * spark.sparkContext.defaultParallelism).load()


def decode(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, warnings (path, reason)) of read files, which may be filtered before. An id that the head has must be the file's."""
    judged = _judge(rows, schema)
    return judged.where("_reason is null").drop("_reason"), judged.where("_reason is not null").select("path", F.col("_reason").alias("reason"))


def _judge(rows: DataFrame, schema: str) -> DataFrame:
    # The head's fields follow the path; the levels' names are joined again by it.
    return judged_records(rows, schema, F.col("error"))


def read_knowledge(spark: SparkSession, root: str, schema: str, include_pending: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(knowledge, warnings), bodies as statement and rationale. With ``include_pending`` given, only organized knowledge in force: active, and pending if it is true."""
    good, bad = decode(files(spark, f"{root}/knowledge"), schema)
    good = good.select(*(c for c in good.columns if c != "body"), *claim_sections(F.col("body")))
    if include_pending is None:
        return good, bad
    own = with_status(good.where("organized_at is not null"))
    return own.where(F.col("status").isin("active", *(["pending"] if include_pending else []))), bad


MASTER = "definition string, example string, includes array<string>, excludes array<string>, documents array<string>, aliases array<string>"
TEMPLATE = "description string, output string, purpose string, readers array<string>, covers array<string>, excludes array<string>, completion array<string>, inject string"
DOCUMENT = "subject string, template string, knowledge array<string>"


def _split(rows: DataFrame, bad: DataFrame, error) -> tuple[DataFrame, DataFrame]:
    good, wrong = records.split(rows, error)
    return good.drop("path", "id"), bad.unionByName(wrong.select("path", "reason"))


def load_masters(spark: SparkSession, root: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(masters by name, warnings) of ``subjects`` or ``types``; a name is its file's. Types have no aliases and need a definition."""
    if kind not in ("subjects", "types"):
        raise ValueError(f"unsupported master kind {kind!r}")
    rows, bad = decode(files(spark, f"{root}/masters/{kind}"), MASTER)
    rows = rows.withColumn("name", F.col("id")).drop("body")
    return _split(rows.drop("aliases"), bad, records.master_error()) if kind == "types" else _split(rows, bad, F.when(F.trim("name") == "", "name is required"))


def load_templates(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(templates by name with their structure, warnings)."""
    rows, bad = decode(files(spark, f"{root}/masters/templates"), TEMPLATE)
    rows = rows.withColumns({"name": F.col("id"), "structure": F.trim("body"), **{c: F.trim(c) for c in ("description", "output", "purpose", "inject")}}).drop("body")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    more = F.when(empty("description"), "description is required").when(F.contains("output", F.lit("/")), "output must be one file's name").when(empty("structure"), "structure is required")
    return _split(rows, bad, F.coalesce(records.template_error(), more))


def read_documents(spark: SparkSession, root: str, templates: DataFrame, subject: str | None = None, template: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents (subject, template, knowledge_ids, body), warnings (path, reason)), as ``judged_documents`` has them."""
    rows = judged_documents(spark, root, templates, subject, template)
    return rows.where("reason is null").drop("path", "reason"), rows.where("reason is not null").select("path", "reason")


def judged_documents(spark: SparkSession, root: str, templates: DataFrame, subject: str | None = None, template: str | None = None) -> DataFrame:
    """Files as (path, subject, template, knowledge_ids, body, reason), read once; ``reason`` says of each that is no document why. A document lies in its subject's folder under its template's output, and its head must say so.

    With a subject only its folder is listed, with a template too only one file is
    opened; its output comes from ``templates``, of which there are some hundred.
    """
    rows = files(spark, f"{root}/documents", ["subject"])
    if subject is not None:
        rows = rows.where(F.col("subject") == subject)
    if template is not None:
        outputs = [r["output"] for r in templates.where(F.col("name") == template).select("output").limit(2).collect()]
        if len(outputs) != 1:
            raise ValueError(f"template {template!r} is not defined once")
        rows = rows.where(F.col("id") == outputs[0].removesuffix(".md"))
    place = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    known = templates.select(F.col("name").alias("template"), F.regexp_replace("output", r"\.md$", "").alias("_file"))
    # Most documents may share one template, so they don't move to it: the templates go to all tasks.
    own = _judge(rows, DOCUMENT).join(F.broadcast(known), "template", "left").withColumnRenamed("knowledge", "knowledge_ids")
    told = F.when(~F.col("subject").eqNullSafe(place), F.concat(F.lit("subject is "), F.coalesce("subject", F.lit("missing")), F.lit(", want "), place))
    told = told.when(F.col("_file").isNull(), F.concat(F.lit("template "), F.coalesce("template", F.lit("missing")), F.lit(" is not defined"))).when(F.col("_file") != F.col("id"), F.concat(F.lit("template "), "template", F.lit(" has another output")))
    return own.select("path", "subject", "template", "knowledge_ids", "body", F.coalesce("_reason", told, records.document_error()).alias("reason"))


WRITTEN, EDITED = "written", "edited outside"
OUTCOME = "path string, outcome string"


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """(path, outcome) of files (path below ``root``, content, expected): each is put in place at once by the task that has it.

    ``expected`` is the SHA-256 of what the file held when the change was made, null
    where it was not there. A file that holds something else by now, and not the
    new content either (a task's second attempt), was edited outside and stays.
    """

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, at = _open(root.rstrip("/"))
        for pdf in it:
            out = []
            for path, content, expected in zip(pdf["path"], pdf["content"], pdf["expected"], strict=True):
                target, data = f"{at}/{path}", content.encode()
                there = None
                if system.get_file_info(target).type == fs.FileType.File:
                    with system.open_input_stream(target) as f:
                        there = digest(f.read())
                if there not in (expected, digest(data)):
                    out.append((path, EDITED))
                    continue
                if there != digest(data):
                    folder, name = target.rsplit("/", 1)
                    system.create_dir(folder, recursive=True)
                    fresh = f"{folder}/.{name}.{digest(data)[:16]}"
                    with system.open_output_stream(fresh) as f:
                        f.write(data)
                    system.move(fresh, target)
                out.append((path, WRITTEN))
            yield pd.DataFrame(out, columns=["path", "outcome"])

    return rows.select("path", "content", "expected").repartition("path").mapInPandas(write, OUTCOME)
