from datetime import datetime

import pytest

from ledgerloom.operators import documents as dc
from ledgerloom.operators import evaluation as ev
from ledgerloom.operators import sync
from ledgerloom.sources import markdown, sinks
from ledgerloom.sources.settings import load_settings

V = "record_key string, mtime_ns long, size long"


def test_change_capture(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], V)
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("d", 1, 1)], V)
    assert {r.record_key: r.change for r in sync.changes(now, old).collect()} == {"a": "same", "b": "changed", "c": "new", "d": "deleted"}
    assert sync.index_status(now, old).first().asDict() == {"indexed": 3, "new": 1, "changed": 1, "deleted": 1, "unsynchronized": 3}
    assert sorted(map(tuple, sync.synchronize(now, old).collect())) == sorted(map(tuple, now.collect()))
    assert sync.synchronize(now, old, version=2, indexed_version=1) is now
    assert [r.record_key for r in sync.stale(old, now).collect()] == ["d"]
    assert sorted(map(tuple, sync.upsert(old, now).collect())) == [("a", 1, 1), ("b", 2, 1), ("c", 1, 1), ("d", 1, 1)]
    assert sync.delete(old, now).count() == 1
    assert [r.size for r in sync.latest(spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], V), "record_key", ["mtime_ns"]).collect()] == [6]


def test_key_owners(spark):
    df = spark.createDataFrame([("k", "2"), ("k", "1"), ("j", "3")], "record_key string, path string")
    own, others = sync.key_owners(df)
    assert {(r.record_key, r.path) for r in own.collect()} == {("k", "1"), ("j", "3")} and [tuple(r) for r in others.collect()] == [("k", "2", "1")]
    assert {r.path for r in sync.key_owners(df.where("path <> '1'"))[0].collect()} == {"2", "3"}


def test_vectors_follow_rows(spark):
    rows = spark.createDataFrame([("a", "a", "knowledge", 1, 1, "", "claim"), ("b", "b", "feedstock", 2, 1, "sum", ""), ("c", "c", "knowledge", 1, 1, "s", " ")], "record_key string, id string, kind string, mtime_ns long, size long, summary string, claim string")
    seen = []
    encode = lambda texts: [[float(len(t))] for t in texts]
    empty = spark.createDataFrame([], "record_key string, id string, kind string, mtime_ns long, size long, model_id string, embedding array<float>")
    first = sync.synchronize_vectors(rows, empty, encode, "m1", batch=1).persist()
    assert {r.id: r.embedding for r in first.collect()} == {"a": [5.0], "b": [3.0]}
    refuse = lambda texts: seen.append(1) or 1 / 0
    assert sync.synchronize_vectors(rows, first, refuse, "m1").count() == 2
    moved = rows.where("id <> 'b'").unionByName(rows.where("id = 'b'").selectExpr("record_key", "id", "kind", "9L mtime_ns", "size", "'longer' summary", "claim"))
    assert {r.id: r.embedding for r in sync.synchronize_vectors(moved, first, encode, "m1").collect()} == {"a": [5.0], "b": [6.0]}
    assert sync.synchronize_vectors(rows.where("id = 'a'"), first, encode, "m1").count() == 1
    assert {r.model_id for r in sync.synchronize_vectors(rows, first, encode, "m2").collect()} == {"m2"}
    assert [r.id for r in sync.vectors_without_rows(first, rows.where("id = 'a'")).collect()] == ["b"]


def test_metrics(spark):
    q = spark.createDataFrame([("c", "a", 2), ("c", "b", 1), ("c", "z", 0)], "case_id string, id string, grade int")
    r = spark.createDataFrame([("c", "b", 1), ("c", "a", 2)], "case_id string, id string, rank int")
    m = ev.case_metrics(r, q).first()
    assert (m.recall_5, m.mrr) == (1.0, 0.5) and 0 < m.ndcg_5 < 1
    curve = ev.recall_curve(r, q, [1, 2, 3])
    assert {x.cutoff: x.micro for x in curve.collect()} == {1: 0.5, 2: 1.0, 3: 1.0} and ev.plateau(curve).first()["cutoff"] == 2
    other = spark.createDataFrame([("c", "a", 1), ("c", "n", 2)], "case_id string, id string, rank int")
    assert tuple(ev.compare_rankings(r, other).first()) == ("c", False, pytest.approx(1 / 3), 20)


def test_thresholds_and_digests(spark):
    s = spark.createDataFrame([(float(i),) for i in range(100)], "score double")
    t = ev.threshold(s).first()["threshold"]
    assert 94 < t < 94.001 and ev.distribution(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double"), "x").first()["p95"] == pytest.approx(2.9)
    rows = [("a", "x\ty"), ("b", None)]
    one, two = (ev.payload_digest(spark.createDataFrame(r, "k string, v string"), ["k", "v"]).first()["digest"] for r in (rows, rows[::-1]))
    assert one == two != ev.payload_digest(spark.createDataFrame([("a", "x y"), ("b", None)], "k string, v string"), ["k", "v"]).first()["digest"]
    a = spark.createDataFrame([("positive", True, 1, 2, 2), ("negative", True, 3, 1, 0), ("negative", False, 1, 0, 0)], "kind string, ok boolean, attempts int, selected int, correct int")
    m = ev.selection_metrics(a).first()
    assert (m.success_rate, m.precision, m.false_acceptance, m.recall, m.retries) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5, 1.0, 2)


def test_jobs_and_cursor(spark):
    subjects = spark.createDataFrame([("b", ["t2", "t1"]), ("a", ["t1", "gone"])], "name string, documents array<string>")
    templates = spark.createDataFrame([("t1",), ("t2",)], "name string")
    good, missing = dc.jobs(subjects, templates)
    pairs = lambda d: [tuple(r) for r in d.collect()]
    assert pairs(missing) == [("a", "gone")] and pairs(dc.next_jobs(good, 2)) == [("a", "t1"), ("b", "t1")]
    assert pairs(dc.next_jobs(good, 2, ("b", "t1"))) == [("b", "t2"), ("a", "t1")] and pairs(dc.next_jobs(good, 9, ("z", "")))[0] == ("a", "t1")


def test_references(spark):
    batches = spark.createDataFrame([("s", "K001", "k1"), ("s", "K002", "k2")], "subject string, reference string, id string")
    refs = spark.createDataFrame([("s", "K001"), ("s", "K002"), ("s", "K002"), ("s", "K009")], "subject string, reference string")
    good, bad = dc.resolve_references(refs, batches)
    assert [r.id for r in good.collect()] == ["k1"] and {(r.reference, r.reason) for r in bad.collect()} == {("K002", "repeated"), ("K009", "unknown")}


def test_context(spark):
    subjects = spark.createDataFrame([("web", ["rules", "notes"], ["/work/web*", "git@h.com:a/web.git"]), ("api", ["notes", "rules"], ["/work/api"])], "name string, documents array<string>, aliases array<string>")
    templates = spark.createDataFrame([("rules", "always", "rules.md"), ("notes", "subject", "notes.md"), ("off", "", "off.md")], "name string, inject string, output string")
    docs = spark.createDataFrame([("web", "rules", " R1 "), ("api", "rules", "R2"), ("web", "notes", "N1"), ("api", "notes", "N2" * 100)], "subject string, template string, body string")
    names = lambda **k: [(r.section, r.subject, r.template) for r in dc.context_blocks(subjects, templates, docs, **k).orderBy("section", "subject", "template").collect()]
    assert names(cwd="/work/web1") == [(0, "api", "rules"), (0, "web", "rules"), (1, "web", "notes")]
    assert names(cwd="/else", repo="https://h.com/a/web") == [(0, "api", "rules"), (0, "web", "rules"), (1, "web", "notes")]
    assert names(cwd="/work/api", repo="https://h.com/a/web")[-1] == (1, "api", "notes")
    blocks = dc.context_blocks(subjects, templates, docs, cwd="/work/api").selectExpr("'x' session", "*")
    full = dc.inject(blocks, "Preamble\n").first()
    assert full.included == 3 and full.omitted == 0 and full.context.startswith("Preamble\n\n## Always-injected documents\n\n### api / rules\nSource: documents/api/rules.md\n\nR2\n\n### web / rules")
    small = dc.inject(blocks, "P\n", 40).first()
    assert small.omitted == 1 and len(small.context.split("\n---\n")[0].encode()) <= 160 and "1 document(s) were omitted" in small.context
    tiny = dc.inject(blocks.where("template = 'notes'"), "P\n", 20).first()
    assert tiny.included == 1 and tiny.context.endswith("…[truncated]\n") and len(tiny.context.encode()) <= 80
    assert dc.inject(blocks.limit(0), "P\n").count() == 0


def test_markdown_round_trip(spark, tmp_path):
    schema = "id string, type string, feedstocks array<string>, approved boolean"
    df = spark.createDataFrame([("k1", "decision", ["b", 'a "q"'], True, "Claim: one", "why\nnot"), ("k2", "intent", [], None, "two", "")], schema + ", statement string, rationale string")
    text = df.select("id", markdown.render(["id", "type", "feedstocks", "approved"], markdown.claim_body(df.statement, df.rationale)).alias("content")).collect()
    for r in text:
        (tmp_path / f"{r.id}.md").write_text(r.content)
    (tmp_path / "bad.md").write_text("---\nid: bad\nstrange: 1\n---\nx")
    (tmp_path / "none.md").write_text("plain")
    (tmp_path / "broken.md").write_text("---\nid: [\n---\nx")
    good, warnings = markdown.read_records(spark, str(tmp_path), schema)
    got = {r.id: r for r in good.select("*", *markdown.claim_sections(good.body)).collect()}
    assert {*got} == {"k1", "k2"} and got["k1"].feedstocks == ["b", 'a "q"'] and got["k1"].approved and got["k1"].statement == "Claim: one" and got["k1"].rationale == "why\nnot" and got["k2"].rationale == ""
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in warnings.collect()}
    assert {*reasons} == {"bad.md", "none.md", "broken.md"} and "strange" in reasons["bad.md"] and reasons["none.md"] == "no front matter"
    assert sorted(r.id for r in markdown.list_files(spark, str(tmp_path)).collect()) == ["bad", "broken", "k1", "k2", "none"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert sinks.current_version(spark, root) is None
    sinks.publish(spark.range(3), root, 1)
    sinks.publish(spark.range(5), root, 2, expected=1)
    assert sinks.current_version(spark, root) == 2 and sinks.read_current(spark, root).count() == 5
    with pytest.raises(RuntimeError):
        sinks.publish(spark.range(1), root, 3, expected=1)
    assert sinks.read_current(spark, root).count() == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "claude", datetime(2025, 3, 1), "<x>&"), ("b", "codex", datetime(2024, 1, 1), "y")], "id string, agent string, timestamp timestamp, text string")
    sinks.write_feedstocks(df, str(tmp_path / "f"))
    assert (tmp_path / "f" / "agent=claude" / "year=2025" / "month=03").is_dir() and spark.read.parquet(str(tmp_path / "f")).count() == 2
    sinks.write_results(df, str(tmp_path / "r"), ["id", "text"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect())[0] == '{"id":"a","text":"\\u003cx\\u003e\\u0026"}'


def test_settings():
    s = load_settings('search_mode = "text"\n[roots]\nclaude = ["/logs"]\n')
    assert s.search_mode == "text" and s.roots == {"claude": ["/logs"]} and s.context_turns == 3
    with pytest.raises(ValueError):
        load_settings("strange = 1")


def test_encoding(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import vectors

    df = spark.createDataFrame([("ab",), (" ",), (None,), ("abcd",)], "t string")
    got = [r.v for r in df.select(vectors.encode(F.col("t"), lambda texts: [[len(t), 0.0] for t in texts], "query: ", 1).alias("v")).collect()]
    assert got == [[1.0, 0.0], None, None, [1.0, 0.0]]


def test_sync_state(spark):
    one = sync.sync_state(None, spark, datetime(2025, 1, 1))
    two = sync.sync_state(one, spark, datetime(2025, 1, 2), "locked")
    assert tuple(two.first()) == (datetime(2025, 1, 2), datetime(2025, 1, 1), "locked")
