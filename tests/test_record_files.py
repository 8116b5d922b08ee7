import os
import pickle
import re

import pytest
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from ledgerloom.sources import markdown
from ledgerloom.sources import record_files as rf

LEVELS = ["agent", "year", "month"]


def put(root, path, text):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text if isinstance(text, bytes) else text.encode())


def head(body="", **fields):
    import json

    return "---\n" + "\n".join(f"{k}: {json.dumps(v)}" for k, v in fields.items()) + f"\n---\n{body}"


@pytest.fixture
def pushing(spark):
    spark.conf.set(rf.PUSHDOWN, "true")
    yield spark
    spark.conf.unset(rf.PUSHDOWN)


def feedstocks(root):
    for agent in ("claude", "codex"):
        for month in ("01", "02"):
            for i in range(6):
                put(root, f"{agent}/2024/{month}/{agent}-{month}-{i}.md", f"text {i}")
    put(root, "claude/2024/01/note.txt", "no record")
    put(root, "claude/2024/01/bad.md", b"\xff\xfe")
    put(root, "claude/2024/deep.md", "not at the right depth")


def ids(df):
    return [r["id"] for r in df.orderBy("path").collect()]


def test_filters_decide_what_is_opened(pushing, tmp_path):
    """Equal and listed names reach the source; the rest of the filters stay with Spark; results are those of plain filters."""
    feedstocks(tmp_path)
    rows = rf.files(pushing, str(tmp_path), LEVELS)
    every = ids(rows)
    assert len(every) == 25 and every == sorted(every, key=lambda i: (i[:6] if i != "bad" else "claude", i))
    assert ids(rows.where("agent = 'codex' and month in ('02', '09')")) == [f"codex-02-{i}" for i in range(6)]
    assert ids(rows.where("agent = 'codex' and id in ('codex-01-3', 'claude-01-1', 'none')")) == ["codex-01-3"]
    assert ids(rows.where("startswith(id, 'claude-02') and agent <> 'codex'")) == [f"claude-02-{i}" for i in range(6)]
    assert ids(rows.where("agent = 'codex' and agent = 'claude'")) == [] and ids(rows.where("id = '../01/claude-01-1'")) == [] and ids(rows.where("agent = '..'")) == []
    bad = rows.where("error is not null").collect()
    assert [(r["id"], r["content"]) for r in bad] == [("bad", None)]
    assert rows.where("agent = 'claude' and content = 'text 2'").count() == 2
    pushing.conf.set(rf.PUSHDOWN, "false")
    assert ids(rf.files(pushing, str(tmp_path), LEVELS).where("agent = 'codex' and id = 'codex-01-3'")) == ["codex-01-3"]


def test_what_the_reader_touches(tmp_path):
    """A record by id is one file of one folder; unnamed folders are not listed; files of a folder are shared by tasks."""
    feedstocks(tmp_path)
    own, other = EqualTo(("agent",), "codex"), StringStartsWith(("id",), "c")
    reader = rf.PushedReader(str(tmp_path), LEVELS)
    assert [*reader.pushFilters([own, EqualTo(("year",), "2024"), In(("month",), ("01", "07")), EqualTo(("id",), "codex-01-2"), other, EqualTo(("size",), 3)])] == [other, EqualTo(("size",), 3)]
    parts = reader.partitions()
    assert [(os.path.relpath(p.folders[0][0], tmp_path), p.ids) for p in parts] == [("codex/2024/01", ("codex-01-2",))]
    assert [r[3] for r in reader.read(parts[0])] == ["codex-01-2"]
    shared = rf.RecordReader(str(tmp_path), LEVELS, content=False, splits=3)
    got = [[r[3] for r in shared.read(p)] for p in shared.partitions()]
    assert len(got) == 12 and sorted(sum(got, [])) == sorted({i for part in got for i in part}) and len(sum(got, [])) == 25
    few = rf.RecordReader(str(tmp_path), LEVELS, content=False, splits=2, tasks=4)
    assert len(few.partitions()) == 4 and sorted(r[3] for p in few.partitions() for r in few.read(p)) == sorted(sum(got, []))
    assert all(r[7] is None and r[8] is None for p in shared.partitions() for r in shared.read(p))


def test_a_missing_root_has_no_records(spark, tmp_path):
    assert rf.files(spark, str(tmp_path / "none"), LEVELS).count() == 0 and rf.files(spark, str(tmp_path / "none")).count() == 0


def test_documents_by_subject_and_template(pushing, tmp_path):
    """Heads are held against folders and outputs; a lookup reads one file, so that others' faults are not met."""
    put(tmp_path, "masters/templates/guide.md", head("# {{subject}}", description="d", output="guide.md", purpose="p", inject="always"))
    put(tmp_path, "masters/templates/log.md", head("# log", description="d", output="changes.md", purpose="p"))
    put(tmp_path, "masters/templates/flat.md", head("", description="d", output="f.md", purpose="p"))
    put(tmp_path, "masters/templates/odd.md", head("x", description="d", output="a/b.md", purpose="p"))
    put(tmp_path, "masters/subjects/a.md", head(aliases=["x"], documents=["guide"]))
    put(tmp_path, "masters/types/rule.md", head(definition="a rule"))
    put(tmp_path, "masters/types/empty.md", head(example="none"))
    templates, bad = rf.load_templates(pushing, str(tmp_path))
    assert sorted((r["name"], r["structure"]) for r in templates.collect()) == [("guide", "# {{subject}}"), ("log", "# log")]
    assert sorted((os.path.basename(r["path"]), r["reason"]) for r in bad.collect()) == [("flat.md", "structure is required"), ("odd.md", "output must be one file's name")]
    subjects, none = rf.load_masters(pushing, str(tmp_path), "subjects")
    assert (subjects.first()["name"], subjects.first()["aliases"], none.count()) == ("a", ["x"], 0)
    types, bad = rf.load_masters(pushing, str(tmp_path), "types")
    assert [r["name"] for r in types.collect()] == ["rule"] and [r["reason"] for r in bad.collect()] == ["definition is required"]
    with pytest.raises(ValueError, match="unsupported"):
        rf.load_masters(pushing, str(tmp_path), "other")
    put(tmp_path, "documents/a/guide.md", head("body", subject="a", template="guide", knowledge=["k"]))
    put(tmp_path, "documents/a/changes.md", head("body", subject="b", template="log", knowledge=["k"]))
    put(tmp_path, "documents/b/guide.md", head("body", subject="b", template="log", knowledge=["k"]))
    put(tmp_path, "documents/b/changes.md", head("body", subject="b", template="gone", knowledge=["k"]))
    put(tmp_path, "documents/c/guide.md", head("body", subject="c", template="guide", knowledge=[]))
    put(tmp_path, "documents/c/changes.md", "no head")
    good, bad = rf.read_documents(pushing, str(tmp_path), templates)
    assert [(r["subject"], r["template"], r["knowledge_ids"]) for r in good.collect()] == [("a", "guide", ["k"])]
    reasons = {"/".join(r["path"].split("/")[-2:]): r["reason"] for r in bad.collect()}
    assert reasons == {"a/changes.md": "subject is b, want a", "b/guide.md": "template log has another output", "b/changes.md": "template gone is not defined", "c/guide.md": "knowledge is required", "c/changes.md": "no front matter"}
    good, bad = rf.read_documents(pushing, str(tmp_path), templates, "a", "guide")
    assert good.count() == 1 and bad.count() == 0
    good, bad = rf.read_documents(pushing, str(tmp_path), templates, "a", "log")
    assert good.count() == 0 and [r["reason"] for r in bad.collect()] == ["subject is b, want a"]
    assert rf.read_documents(pushing, str(tmp_path), templates, "zz", "guide")[0].count() == 0
    with pytest.raises(ValueError, match="not defined"):
        rf.read_documents(pushing, str(tmp_path), templates, "a", "nope")


def test_knowledge_in_force(spark, tmp_path):
    schema = "type string, subject string, approved boolean, superseded_by string, invalidated_at string, organized_at string"
    body = "## Claim\n\nsay\n\n## Rationale\n\nwhy\n"
    for name, fields in {"a": {"approved": True, "organized_at": "2024"}, "p": {"organized_at": "2024"}, "u": {}, "s": {"organized_at": "2024", "superseded_by": "a"}, "i": {"organized_at": "2024", "approved": True, "invalidated_at": "2024"}}.items():
        put(tmp_path, f"knowledge/{name}.md", head(body, type="rule", subject="s", **fields))
    put(tmp_path, "knowledge/broken.md", "---\n: [\n---\n")
    read = lambda pending: {r["id"]: (r["statement"], r["rationale"]) for r in rf.read_knowledge(spark, str(tmp_path), schema, pending)[0].collect()}
    assert {*read(None)} == {*"apusi"} and read(False) == {"a": ("say", "why")} and {*read(True)} == {"a", "p"}
    assert rf.read_knowledge(spark, str(tmp_path), schema)[1].count() == 1


def test_files_edited_outside_stay(spark, tmp_path):
    """A change is made to what it was made from, or not at all; a second attempt finds its own work."""
    put(tmp_path, "d/same.md", "old")
    put(tmp_path, "d/edited.md", "someone's")
    put(tmp_path, "d/done.md", "new")
    old = rf.digest(b"old")
    rows = spark.createDataFrame([("d/same.md", "new", old), ("d/edited.md", "new", old), ("d/done.md", "new", old), ("e/fresh.md", "new", None), ("d/lost.md", "new", old), ("d/same.md.x", "new", None)], "path string, content string, expected string")
    got = {r["path"]: r["outcome"] for r in rf.write_files(rows, str(tmp_path)).collect()}
    assert got == {p: rf.EDITED if p in ("d/edited.md", "d/lost.md") else rf.WRITTEN for p in got} and len(got) == 6
    assert (tmp_path / "d/edited.md").read_text() == "someone's" and (tmp_path / "d/same.md").read_text() == "new" and not (tmp_path / "d/lost.md").exists()
    assert sorted(os.listdir(tmp_path / "e")) == ["fresh.md"]


def test_documents_of_one_template_are_not_gathered(pushing, tmp_path):
    """Templates go to the documents, which are not shuffled by a template that all of them may share."""
    put(tmp_path, "documents/a/guide.md", head("body", subject="a", template="guide", knowledge=["k"]))
    templates = pushing.createDataFrame([("guide", "guide.md")], "name string, output string")
    good, bad = rf.read_documents(pushing, str(tmp_path), templates)
    for rows in (good, bad):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert good.count() == 1 and bad.count() == 0


def test_the_driver_does_not_hold_many_folders(tmp_path):
    """More folders than the driver may hold are listed by tasks, each of which takes its own; shares don't grow with them."""
    n = rf.LISTED + 100
    for i in range(n):
        os.makedirs(tmp_path / f"documents/s{i}")
        (tmp_path / f"documents/s{i}/page.md").write_text(str(i))
    (tmp_path / "documents/s7/other.md").write_text("other")
    (tmp_path / "documents/stray.md").write_text("not in a folder")
    reader = rf.RecordReader(str(tmp_path / "documents"), ["subject"], tasks=8)
    parts = reader.partitions()
    assert len(parts) == 8 and sum(len(pickle.dumps(p)) for p in parts) < 8_000
    got = [[(r[0], r[1], r[5]) for r in reader.read(p)] for p in parts]
    assert sorted(sum(got, [])) == sorted([*((f"s{i}", "page", str(i)) for i in range(n)), ("s7", "other", "other")])
    assert max(map(len, got)) < 2 * n / 8
    by_id = rf.PushedReader(str(tmp_path / "documents"), ["subject"], tasks=8)
    assert [*by_id.pushFilters([In(("id",), ("other", "none"))])] == []
    assert [r[:2] for p in by_id.partitions() for r in by_id.read(p)] == [("s7", "other")]


@pytest.mark.parametrize("listed", [0, 1, 2, 3, 7, 4_096])
def test_who_lists_folders_makes_no_difference(pushing, tmp_path, listed):
    """On whichever level tasks go on from what the driver listed, rows and pushed filters are the same, and no record is read twice."""
    feedstocks(tmp_path)
    rows = lambda **more: pushing.read.format("record_files").options(path=str(tmp_path), levels=",".join(LEVELS), push="true", tasks=5, **more).load()
    pushing.dataSource.register(rf.RecordFiles)
    here = rows(listed=listed)
    for what in ("true", "agent = 'codex' and month in ('02', '09')", "year in ('2023', '2024', '..') and id in ('codex-01-3', 'none')", "agent in ('claude', 'codex', 'x') and month = '01'", "agent = 'none'"):
        assert sorted(map(tuple, here.where(what).drop("error").collect()), key=str) == sorted(map(tuple, rf.files(pushing, str(tmp_path), LEVELS).where(what).drop("error").collect()), key=str), what
    reader = rf.RecordReader(str(tmp_path), LEVELS, listed=listed)
    assert len({path for p in reader.partitions() for path, _ in p.folders}) <= max(1, listed)


def test_documents_are_read_once(pushing, tmp_path):
    """Good documents and warnings are each one scan, and heads are decoded once in it."""
    put(tmp_path, "documents/a/guide.md", head("body", subject="a", template="guide", knowledge=["k"]))
    put(tmp_path, "documents/a/broken.md", "---\n: [\n---\n")
    put(tmp_path, "documents/b/guide.md", b"\xff\xfe")
    put(tmp_path, "documents/c/guide.md", "no head")
    templates = pushing.createDataFrame([("guide", "guide.md")], "name string, output string")
    for rows in (rf.judged_documents(pushing, str(tmp_path), templates), *rf.read_documents(pushing, str(tmp_path), templates)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchScan record_files") == 1 and plan.count("ArrowEvalPython") == 1
    reasons = {"/".join(r["path"].split("/")[-2:]): r["reason"] for r in rf.judged_documents(pushing, str(tmp_path), templates).collect()}
    assert reasons.pop("b/guide.md").startswith("'utf-8' codec") and reasons.pop("a/broken.md").startswith("while parsing")
    assert reasons == {"a/guide.md": None, "c/guide.md": "no front matter"}


def test_heads_are_cut_as_one_pattern_for_the_whole_cuts_them(spark):
    """Texts are searched for their head only; what follows is the body, whatever it holds."""
    whole = re.compile(r"^---\r?\n([\s\S]*?\r?\n)---\r?\n([\s\S]*)\Z")
    texts = [a + h + b for a in ("---\n", "---\r\n", "--\n", "") for h in ("a: é😀\n---\n", "a: x\r\n---\r\n", "\n---\n", "---\n", "a: x---\n") for b in ("", "b", "b\n---\nc\n", "\r\n\u2028é😀\r\n", "---\n")]
    rows = markdown.judged_records(spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts)], "path string, content string"), "a string")
    assert r"([\s\S]*)$" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {int(r["id"]): (r["body"], r["_reason"]) for r in rows.collect()}
    found = [whole.match(t) for t in texts]
    assert [got[i][1] != "no front matter" for i in range(len(texts))] == [m is not None for m in found]
    assert all(got[i][0] == m[2] for i, m in enumerate(found) if m) and sum(m is not None for m in found) > 20
