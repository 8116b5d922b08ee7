import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import organize as og
from ledgerloom.operators import run_plans as rp
from ledgerloom.operators.run_store import DONE, FAILED, RunStore
from ledgerloom.sources import sinks

NOW = datetime(2024, 6, 1)
TURN = "id string, turn_id string, session_id string, timestamp timestamp, agent string, cwd string, repo string, branch string, dialogue array<struct<role:string,content:string>>, source_sequence long, source_owner_session_id string, path string"
FEEDSTOCK = "id string, turn_id string, session_id string, timestamp timestamp, agent string, dialogue array<struct<role:string,content:string>>, source_sequence long, summary string, types array<string>, drafted_at timestamp, extracted_at timestamp"
KNOWLEDGE = "id string, subject string, type string, statement string, rationale string, feedstocks array<string>, established_by string, approved boolean, supersedes array<string>, superseded_by string, superseded_at timestamp, invalidated_at timestamp, organized_at timestamp, updated timestamp, created timestamp, order_key string"
DOCUMENT = "key string, subject string, template string, knowledge_ids array<string>, body string"
RESULT = "task string, key string, result string, digest string"


def results(spark, *rows):
    return spark.createDataFrame([(t, k, r if isinstance(r, str) else json.dumps(r), d) for t, k, r, d in rows], RESULT)


def states(store, step):
    return {r["key"]: (r["state"], r["reason"]) for r in store.steps().where(F.col("step") == step).collect()}


def store_of(spark, tmp_path, feedstocks=(), knowledge=(), documents=()):
    store = RunStore(spark, str(tmp_path / "store"))
    frame = lambda rows, schema: spark.createDataFrame([*rows], schema)
    store.create({"feedstocks": (frame(feedstocks, FEEDSTOCK), "id"), "knowledge": (frame(knowledge, KNOWLEDGE), "id"), "documents": (frame(documents, DOCUMENT), "key")})
    return store


def claim(i, subject="s", organized=True, approved=True, statement=None, fs=None, supersedes=(), order=None):
    return (i, subject, "rule", statement or f"claim {i}", "", [fs or f"f-{i}"], fs or f"f-{i}", approved and organized, [*supersedes], None, None, None, NOW if organized else None, NOW, NOW, order or i)


def turn(i, session="a", content="hi"):
    return (f"t{i}", f"turn{i}", session, datetime(2024, 1, 1 + i), "claude", "/w", "", "", [("user", content)], i, session, f"/{session}.jsonl")


def test_tables_change_by_rows(spark, tmp_path):
    """A commit writes its rows only; a compacted store is the same; a commit in between is refused; unnamed parts don't count."""
    store = store_of(spark, tmp_path, documents=[(f"s/{i}", "s", str(i), ["a"], f"b{i}") for i in range(6)])
    none = spark.createDataFrame([], "step string, key string, state string, reason string")
    of = lambda rows: spark.createDataFrame(rows, DOCUMENT)
    store.commit(none, {"documents": of([("s/1", "s", "1", ["b"], "new"), ("s/9", "s", "9", ["c"], "more")])}, {"documents": of([("s/2", "s", "2", [], "")])})
    store.commit(none, {"documents": of([("s/1", "s", "1", ["b"], "newer"), ("s/2", "s", "2", ["z"], "back")])}, {"documents": of([("s/9", "s", "9", [], "")])})
    want = {"s/0": "b0", "s/1": "newer", "s/2": "back", "s/3": "b3", "s/4": "b4", "s/5": "b5"}
    got = lambda: {r["key"]: r["body"] for r in store.table("documents").collect()}
    assert got() == want
    assert spark.read.parquet(f"{store.root}/documents/run-3").count() == 3
    of([("s/0", "s", "0", [], "lost")]).withColumns({"_gone": F.lit(False), "_run": F.lit(4)}).write.parquet(f"{store.root}/documents/run-4")
    assert got() == want
    store.commit(none, {"documents": of([("s/0", "s", "0", ["a"], "0")])})
    assert got() == {**want, "s/0": "0"}
    store.compact()
    assert got() == {**want, "s/0": "0"} and sorted(sinks.folders(spark, f"{store.root}/documents")) == [f"base-{store.version}"]
    before = store._pointer()
    store.commit(none)
    with pytest.raises(RuntimeError, match="no longer current"):
        sinks.write_pointer(spark, store.root, {**before, "version": before["version"] + 1}, before["version"])


def test_drawing_goes_on_where_it_failed(spark, tmp_path):
    """Turns with a bad or no result stay open, alone; the next run takes them up."""
    old = ("t9", "turn9", "a", datetime(2024, 1, 10), "claude", [("user", "x")], 9, "done", ["rule"], NOW, NOW)
    store = store_of(spark, tmp_path, feedstocks=[old])
    both = [turn(i) for i in range(6)] + [turn(9)] + [turn(7, "b", "one"), (*turn(7, "b", "two")[:-1], "/copy.jsonl")]
    candidates = spark.createDataFrame(both, TURN)
    good = {"summary": " ok ", "types": ["rule"]}
    drafts = [("draw", "t0", good, None), ("draw", "t1", {"summary": "", "types": []}, None), ("draw", "t2", {"summary": "s", "types": ["odd"]}, None), ("draw", "t3", '{"summary": "s"}', None), ("draw", "t4", {"summary": "none", "types": []}, None)]
    told = {"knowledge": [{"type": "rule", "subject": "s", "statement": "a", "rationale": ""}, {"type": "rule", "subject": "", "statement": "b", "rationale": "r"}]}
    first = rp.draw_run(store, candidates, results(spark, *drafts, ("extract", "t0", told, None)), ["rule"], ["s"], NOW)
    assert first == {"turns_selected": 6, "turns_pending": 4, "sources_failed": 1, "feedstocks_acquired": 6, "feedstocks_drawn": 2, "feedstocks_extracted": 2, "knowledge_created": 2, "feedstocks_failed": 3, "waiting": 1}
    assert states(store, "draft") == {"t0": (DONE, None), "t1": (FAILED, "summary is required"), "t2": (FAILED, "unknown types: odd"), "t3": (FAILED, rp.NO_OBJECT), "t4": (DONE, None), "t5": ("waiting", None)}
    assert {r["id"] for r in store.table("feedstocks").collect()} == {"t9", *(f"t{i}" for i in range(6))}
    assert store.table("feedstocks").where("id = 't0'").first()["summary"] == "ok"
    bad = {"knowledge": [{"type": "rule", "subject": "other", "statement": "a", "rationale": ""}]}
    again = [("draw", f"t{i}", good, None) for i in (0, 1, 2, 3)] + [("extract", "t0", told, None), ("extract", "t1", told, None), ("extract", "t2", bad, None), ("extract", "t3", told, None), ("extract", "t3", told, None)]
    second = rp.draw_run(store, candidates, results(spark, *again), ["rule"], ["s"], NOW)
    assert second == {"turns_selected": 4, "turns_pending": 3, "sources_failed": 1, "feedstocks_acquired": 0, "feedstocks_drawn": 3, "feedstocks_extracted": 1, "knowledge_created": 2, "feedstocks_failed": 2, "waiting": 1}
    assert states(store, "extract")["t2"][0] == FAILED and states(store, "extract")["t3"] == (FAILED, "several results")
    assert store.table("knowledge").groupBy("established_by").count().orderBy("established_by").collect() == [("t0", 2), ("t1", 2)]


def action(i, kind, *targets, statement=None):
    draft = {"type": "rule", "subject": "s", "statement": statement, "rationale": "why"} if statement else None
    return {"knowledge_id": i, "resolution": {"kind": kind, "knowledge_ids": [*targets], "draft": draft}}


def test_brewing_touches_failed_subjects_only(spark, tmp_path):
    """Results are applied to knowledge; subjects whose knowledge changed since, or whose actions are incomplete, are left as they were."""
    own = [claim("h1", order="00"), claim("h2", order="01", approved=False)]
    own += [claim(f"n{i}", organized=False, order=f"1{i}") for i in range(6)] + [claim("p1", "p", organized=False), claim("q1", "q", organized=False), claim("r1", "r", organized=False), claim("w1", "w", organized=False)]
    store = store_of(spark, tmp_path, knowledge=own)
    asked = rp.brew_payloads(store.table("knowledge"), spark.createDataFrame([("s", "d", ["i"], [])], "name string, definition string, includes array<string>, excludes array<string>"), spark.createDataFrame([("rule", "a rule")], "name string, definition string"))
    sent = {r["key"]: (json.loads(r["payload"]), r["digest"]) for r in asked.collect()}
    assert [x["id"] for x in sent["s"][0]["unorganized_knowledge"]] == [f"n{i}" for i in range(6)] and [x["id"] for x in sent["s"][0]["organized_heads"]] == ["h1", "h2"]
    assert sent["p"][0]["organized_heads"] == [] and sent["p"][0]["subject_master"] == [] and sent["s"][0]["subject_master"][0]["definition"] == "d"
    acts = [action("n0", "new"), action("n1", "discard"), action("n2", "equivalent", "h1"), action("n3", "equivalent", "h1"), action("n4", "complements", "h2", statement="whole"), action("n5", "conflicts", "n0")]
    rows = [("brew", "s", {"actions": acts}, sent["s"][1]), ("brew", "p", {"actions": [action("p1", "new"), action("x", "new")]}, sent["p"][1]), ("brew", "q", {"actions": [action("q1", "new")]}, "made before"), ("brew", "r", {"actions": []}, sent["r"][1])]
    got = rp.brew_run(store, results(spark, *rows), ["rule"], NOW)
    assert got == {"subjects_selected": 5, "subjects_pending": 4, "subjects_processed": 1, "subjects_failed": 3, "waiting": 1, "created": 1, "evidence_added": 2, "merged": 1, "replaced": 1, "discarded": 1, "retired": 2}
    assert states(store, "organize") == {"s": (DONE, None), "p": (FAILED, "unknown action: x"), "q": (FAILED, og.CHANGED), "r": (FAILED, "omitted action: r1"), "w": ("waiting", None)}
    k = {r["id"]: r for r in store.table("knowledge").collect()}
    assert {*k} == {"h1", "h2", "n0", "n4", "n5", "p1", "q1", "r1", "w1"}
    assert k["h1"]["feedstocks"] == ["f-h1", "f-n2", "f-n3"]
    assert (k["h2"]["superseded_by"], k["n0"]["superseded_by"]) == ("n4", "n5") and (k["n4"]["statement"], k["n4"]["supersedes"]) == ("whole", ["h2"])
    assert all(k[i]["organized_at"] is None for i in ("p1", "q1", "r1", "w1")) and k["n0"]["organized_at"] and not k["n4"]["approved"]
    mended = [("brew", s, {"actions": [action(f"{s}1", "new")]}, sent[s][1]) for s in "pqr"]
    store_version = store.version
    got = rp.brew_run(store, results(spark, *mended), ["rule"], NOW, limit=2, retry=True)
    assert (got["subjects_selected"], got["subjects_processed"], got["subjects_pending"], got["created"]) == (2, 2, 2, 2)
    assert {r["key"] for r in store.steps().where(F.col("run") > store_version).collect()} == {"p", "q"}
    assert rp.brew_run(store, results(spark, *mended), ["rule"], NOW)["subjects_processed"] == 1


def test_distilling(spark, tmp_path):
    """Batches choose evidence; documents are written, deleted or left; each failure names its stage."""
    known = [claim(f"k{i:02d}", "s") for i in range(7)] + [claim("z1", "z"), claim("z2", "z", approved=False)] + [claim("y1", "y")]
    docs = [("s/a", "s", "a", ["k00", "gone"], "old"), ("e/a", "e", "a", ["gone"], "old"), ("y/a", "y", "a", ["y1"], "old")]
    store = store_of(spark, tmp_path, knowledge=known, documents=docs)
    subjects = spark.createDataFrame([("s", ["a", "b", "nope"]), ("e", ["a"]), ("z", ["a", "b"]), ("y", ["a"])], "name string, documents array<string>")
    templates = spark.createDataFrame([("a", "a.md"), ("b", "b.md")], "name string, output string")
    sent = rp.selection_payloads(spark.createDataFrame([("s", "a"), ("z", "a")], "subject string, template string"), templates, store.table("documents"), store.table("knowledge"))
    assert {r["key"]: [x["claim"] for x in json.loads(r["payload"])["unselected_knowledge"]] for r in sent.collect()} == {"s/a/1": [f"claim k0{i}" for i in range(1, 7)], "z/a/1": ["claim z1"]}
    picks = lambda *refs: {"knowledge_references": [*refs]}
    rows = [("distill_select", "s/a/1", picks("K002", "K006")), ("distill_select", "s/b/1", picks("K001", "K099")), ("distill_select", "z/a/1", picks())]
    rows += [("distill_generate", "s/a", {"body": "text", **picks("K001", "K003")}), ("distill_generate", "y/a", {"body": " ", **picks()})]
    got = rp.distill_run(store, subjects, templates, results(spark, *((*r, None) for r in rows)))
    assert got == {"documents_available": 7, "documents_selected": 7, "documents_created": 0, "documents_updated": 1, "documents_deleted": 2, "documents_failed": 2, "waiting": 1, "knowledge_selected": 2, "knowledge_used": 2}
    assert states(store, "distill") == {"s/a": (DONE, None), "s/b": (FAILED, "selection: unknown reference: K099"), "s/nope": (FAILED, "preparation: template is not defined"), "e/a": (DONE, None), "z/a": (DONE, None), "z/b": ("waiting", None), "y/a": (DONE, None)}
    assert [(r["key"], r["knowledge_ids"], r["body"]) for r in store.table("documents").collect()] == [("s/a", ["k00", "k06"], "text")]
    rows = [("distill_select", "s/b/1", picks("K001")), ("distill_generate", "s/b", {"body": "more", **picks("K001")}), ("distill_select", "z/b/1", picks("K001")), ("distill_generate", "z/b", {"body": "b", **picks("K001", "K001")})]
    got = rp.distill_run(store, subjects, templates, results(spark, *((*r, None) for r in rows)), retry=True)
    assert (got["documents_selected"], got["documents_created"], got["documents_failed"]) == (3, 1, 2)
    assert states(store, "distill")["z/b"] == (FAILED, "generation: repeated reference: K001") and states(store, "distill")["s/b"] == (DONE, None)


def test_payloads_of_extraction(spark):
    rows = [(f"t{i}", f"turn{i}", "a", NOW, "claude", [("user", f"u{i}")], i, "sum", ["rule"] if i != 3 else [], NOW, NOW if i == 1 else None) for i in range(5)]
    masters = spark.createDataFrame([("s", "d", ["i"], [])], "name string, definition string, includes array<string>, excludes array<string>")
    got = {r["key"]: json.loads(r["payload"]) for r in rp.extract_payloads(spark.createDataFrame(rows, FEEDSTOCK), masters, spark.createDataFrame([("rule", "x")], "name string, definition string"), 2, 1).collect()}
    assert {*got} == {"t0", "t2", "t4"}
    assert [t["turn_offset"] for t in got["t2"]["context_before"]] == [-2, -1] and got["t2"]["context_after"][0]["dialogue"][0]["content"] == "u3"
    assert got["t4"]["context_after"] == [] and got["t4"]["subject_master"][0]["name"] == "s"


def test_drawing_merges_copies_once(spark, tmp_path, monkeypatch):
    """Without a limit the turns are neither sorted nor merged once more to be counted; results are decoded in one pass."""
    seen = []

    class Unasked:
        def first(self):
            raise AssertionError("counted by merging again")

    draw = rp.runs.draw
    monkeypatch.setattr(rp.runs, "draw", lambda *a, **k: (seen.append(draw(*a, **k)), (*seen[-1][:2], Unasked()))[1])
    out = rp.draw_run(store_of(spark, tmp_path), spark.createDataFrame([turn(i) for i in range(3)], TURN), results(spark, ("draw", "t0", {"summary": "x", "types": []}, None)), ["rule"], [], NOW)
    assert out["turns_selected"] == 3 and out["turns_pending"] == 2 and out["waiting"] == 2
    assert "Sort [resumable" not in seen[0][0]._jdf.queryExecution().optimizedPlan().toString()
    keys = spark.createDataFrame([("t0",), ("t1",)], "key string")
    judged = rp.judged_results(keys, results(spark, ("draw", "t0", {"summary": "x", "types": []}, None), ("draw", "t1", "{}", None)), "draw")
    assert "Union" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert {r["key"]: (r["decoded"] is None, r["reason"]) for r in judged.collect()} == {"t0": (False, None), "t1": (True, rp.NO_OBJECT)}
