import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import turns as tn
from ledgerloom.sources import logs

LINES = "agent string, path string, line long, raw string, terminated boolean"


def lines(spark, records, agent="claude", path="/logs/s.jsonl", last_open=False):
    raw = [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records]
    return spark.createDataFrame([(agent, path, i + 1, r, not (last_open and i == len(raw) - 1)) for i, r in enumerate(raw)], LINES)


def user(text, n, **more):
    return {"type": "user", "uuid": f"u{n}", "sessionId": "s1", "timestamp": f"2025-01-01T00:00:{n:02d}Z", "message": {"role": "user", "content": text}} | more


def answer(text, stop="end_turn", **more):
    return {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": text}, {"type": "tool_use"}], "stop_reason": stop}} | more


def turns(df, **how):
    return [(r.turn_id, r.user_text, r.assistant_text) for r in tn.assemble_events(df, **how).orderBy("source_line").collect()]


def test_claude_log(spark):
    df = lines(spark, [
        {"type": "summary"}, user("first", 1, cwd="/w", gitBranch="main"), answer("thinking", None), answer("done"), user("meta", 2, isMeta=True), user([{"type": "tool_result", "content": "x"}], 3), user([{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}], 4),
        answer("half", None), user("[Request interrupted by user]", 5), user("  ", 6), user("third", 7), answer("side", isSidechain=True), user("open", 8),
    ])
    ev = logs.decode_claude(df)
    assert turns(ev) == [("u1", "first", "done"), ("u4", "a\nb", "half"), ("u7", "third", None)]
    assert turns(ev, include_open=True)[-1] == ("u8", "open", None)
    c = tn.as_candidates(tn.assemble_events(ev)).orderBy("source_sequence").collect()
    assert [(r.source_sequence, r.cwd, r.branch, len(r.dialogue)) for r in c] == [(1, "/w", "main", 2), (2, "/w", "main", 2), (3, "/w", "main", 1)]


def meta(session, n=0, **more):
    return {"type": "session_meta", "timestamp": f"2025-01-01T00:00:{n:02d}Z", "payload": {"id": session, "timestamp": "2025-01-01T00:00:00Z", "cwd": "/w", "git": {"branch": "b", "repository_url": "git@h.com:a/b.git"}} | more}


def codex(kind, n=0, **payload):
    return {"type": kind, "timestamp": f"2025-01-01T00:00:{n:02d}Z", "payload": payload}


def say(text, n=1, **more):
    return codex("event_msg", n, type="user_message", message=text, **more)


def reply(text, phase="final_answer"):
    return codex("response_item", type="message", role="assistant", content=[{"type": "output_text", "text": text}], **({"phase": phase} if phase else {}))


def test_codex_turns(spark):
    df = lines(spark, [
        meta("S"), codex("turn_context", turn_id="X"), say("one"), codex("event_msg", type="agent_message", message="event"), reply("fallback", ""), reply("ignored", "commentary"), codex("turn_context", turn_id="X", cwd="/other"), reply("final"), codex("event_msg", type="agent_message", message="later event"),
        codex("turn_context", turn_id="Y"), say("two", 2), codex("event_msg", type="task_complete", turn_id="Z"), codex("event_msg", type="task_complete", turn_id="Y"), codex("turn_context", turn_id="X"), say("three", 3), reply("again"), say("four", 4, turn_id="X"), say("open", 5),
    ], "codex")
    ev, warnings = logs.decode_codex(df)
    assert turns(ev) == [("X", "one", "final"), ("Y", "two", None), ("X.2", "three", "again"), ("X.3", "four", None)]
    assert warnings.count() == 0
    assert {r.cwd for r in tn.assemble_events(ev).where("user_text = 'one'").collect()} == {"/other"}


def test_codex_shapes_and_warnings(spark):
    df = lines(spark, [
        {"id": "L", "timestamp": "2025-01-01T00:00:00Z", "git": {"branch": "b"}}, {"record_type": "state"}, {"type": "message", "id": "m1", "role": "user", "content": [{"type": "input_text", "text": "hi"}]},
        {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "yes"}]}, {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "more"}]}, {"what": 1}, {"type": "x", "timestamp": "t", "payload": {}, "record_type": "y"}, {"type": "message", "role": "robot"},
        codex("response_item", type="message", role="ghost"), codex("response_item", type="message", role="assistant", phase="odd"), codex("event_msg", 3, type="item_completed", turn_id="q", item={"type": "UserMessage", "content": [{"type": "text", "text": "item"}, {"type": "text", "text": "two"}]}),
    ], "codex")
    ev, warnings = logs.decode_codex(df)
    got = turns(ev, include_open=True)
    assert got[0] == ("record-m1", "hi", "yes") and got[1][0].startswith("record-") and got[2] == ("q", "item\ntwo", None)
    assert {r.reason for r in warnings.collect()} == {"unknown or ambiguous record shape", "unknown message role", "unknown message phase"}


def test_codex_sessions_and_subagents(spark):
    df = lines(spark, [meta("A"), say("a1", 1, turn_id="t"), meta("B"), say("b1", 2, turn_id="t"), reply("rb")], "codex").unionByName(lines(spark, [meta("C", source={"subagent": "x"}), say("c", turn_id="t"), reply("r")], "codex", "/logs/sub.jsonl"))
    done = tn.assemble_events(logs.decode_codex(df)[0], include_open=True).collect()
    assert {(r.session_id, r.turn_id, r.assistant_text) for r in done} == {("A", "t", None), ("B", "t", "rb")}


def test_lines_of_files(spark, tmp_path):
    good = json.dumps(user("x", 1))
    (tmp_path / "a.jsonl").write_bytes((good + "\r\n\n" + json.dumps(answer("y")) + "\n{\"type\": \"us").encode())
    (tmp_path / "b.jsonl").write_text(good + "\nbroken\n")
    (tmp_path / "c.jsonl").write_text(good)
    (tmp_path / "tool-results").mkdir()
    (tmp_path / "tool-results" / "d.jsonl").write_text(good)
    found = logs.find_logs(spark, {"claude": [str(tmp_path)]})
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.jsonl", "b.jsonl", "c.jsonl"]
    read = logs.read_lines(spark, [str(tmp_path / n) for n in ("a.jsonl", "b.jsonl", "c.jsonl")], "claude")
    kept, failed = logs.usable_lines(read)
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in failed.collect()] == [("b.jsonl", "line 2: malformed record")]
    assert sorted((r.path.rsplit("/", 1)[1], r.line) for r in kept.collect()) == [("a.jsonl", 1), ("a.jsonl", 3), ("c.jsonl", 1)]


def test_modification_window(spark, tmp_path):
    import os

    (tmp_path / "a.jsonl").write_text("{}")
    os.utime(tmp_path / "a.jsonl", (1_700_000_000, 1_700_000_000))
    at = datetime.fromtimestamp(1_700_000_000)
    n = lambda **k: logs.find_logs(spark, {"claude": [str(tmp_path)]}, **k).count()
    from datetime import timedelta

    assert n() == 1 and n(since=at + timedelta(hours=30)) == 0 and n(until=at - timedelta(hours=30)) == 0
    with pytest.raises(ValueError):
        logs.lookback(source="claude", paths=["x"])
    now = datetime(2025, 1, 8).astimezone()
    assert logs.lookback(now=now)[0] == now - timedelta(hours=24) and logs.lookback(maximum=3, now=now) == (None, None)
    assert logs.parse_boundary("2d", now) == now - timedelta(days=2) and logs.parse_boundary("2025-01-01", now, True).microsecond == 999_999


def test_cache_decisions(spark):
    schema = "path string, size long, mtime long, first_record_hash string, boundary_hash string"
    now = spark.createDataFrame([("same", 5, 1, "f1", "b1"), ("grown", 9, 2, "f2", "b2"), ("rewritten", 5, 2, "f3", "x"), ("moved", 7, 9, "f4", "b4"), ("new", 1, 1, "f5", "b5")], schema)
    seen = spark.createDataFrame([("same", 5, 1, "f1", "b1"), ("grown", 5, 1, "f2", "b2"), ("rewritten", 5, 1, "f3", "b3"), ("old", 7, 1, "f4", "b4")], schema)
    got = {r.path: r.decision for r in logs.cache_decision(now, seen).collect()}
    assert got == {"same": "reuse", "grown": "resume", "rewritten": "reparse", "moved": "relocate", "new": "reparse"}


def test_errors_fail_their_stream_only(spark):
    df = lines(spark, [codex("turn_context"), say("x")], "codex", "/bad.jsonl").unionByName(lines(spark, [meta("S"), say("y", 1, turn_id="t"), reply("z")], "codex", "/good.jsonl"))
    got = {r.path: (r.error, r.user_text) for r in tn.assemble_events(logs.decode_codex(df)[0]).collect()}
    assert got["/good.jsonl"] == (None, "y") and "no turn ID" in got["/bad.jsonl"][0]


def candidate(i, session, ts, path, text="t", seq=1):
    return (i, i, session, ts, "claude", "", "", "", [{"role": "user", "content": text}], seq, session, path)


CANDIDATE = "id string, turn_id string, session_id string, timestamp long, agent string, cwd string, repo string, branch string, dialogue array<struct<role:string,content:string>>, source_sequence long, source_owner_session_id string, path string"


def test_merge(spark):
    rows = [candidate("a", "s", 2, "1"), candidate("a", "s", 2, "2"), candidate("b", "s", 1, "2", seq=2), candidate("c", "x", 1, "1"), candidate("c", "x", 1, "2", "other"), candidate("d", "x", 3, "1")]
    merged, conflicts = tn.merge_copies(spark.createDataFrame(rows, CANDIDATE))
    assert [(r.id, r.source_sequence) for r in merged.orderBy("source_sequence").collect()] == [("b", 1), ("a", 2)]
    assert [r.id for r in conflicts.collect()] == ["c"]


def test_selection(spark):
    c = spark.createDataFrame([candidate(i, "s", t, "1", seq=q) for i, t, q in (("a", 1, 1), ("b", 2, 2), ("c", 2, 3), ("d", 9, 4))], CANDIDATE)
    known = spark.createDataFrame([("a", None), ("b", 1)], "id string, extracted_at int")
    ids = lambda **k: [r.id for r in tn.select_unfinished(c, known, **k).collect()]
    assert ids() == ["a", "d", "c"] and ids(oldest=True) == ["a", "c", "d"] and ids(hook=True) == ["a", "c"] and ids(limit=2) == ["a", "d"]
    assert tn.pending_count(c, known).first()["pending"] == 3


def test_context(spark):
    c = spark.createDataFrame([candidate(f"t{i}", "s" if i < 4 else "z", i, "1", f"x{i}", i) for i in range(6)], CANDIDATE)
    out = tn.with_context(c.withColumn("who", tn.source_session()), ["agent", "who"], ["source_sequence"], 2, 1, content=F.col("dialogue")[0]["content"]).orderBy("id").collect()
    assert [[(x.offset, x.content) for x in r.before] for r in out] == [[], [(-1, "x0")], [(-2, "x0"), (-1, "x1")], [(-2, "x1"), (-1, "x2")], [], [(-1, "x4")]]
    assert [[(x.offset, x.content) for x in r.after] for r in out][:2] == [[(1, "x1")], [(1, "x2")]]


def test_assembler_resumes_from_stored_state():
    from ledgerloom.streaming.turns import _dump, _load

    base = dict.fromkeys(["session_id", "turn_id", "fallback_turn_id", "ts", "cwd", "repo", "branch", "text", "priority", "completes"])
    a = tn.Assembler()
    a.apply({**base, "kind": "user", "line": 1, "session_id": "s", "turn_id": "t", "ts": datetime(2025, 1, 1), "text": "hello"})
    b = tn.Assembler(_load(_dump(a.state)))
    b.apply({**base, "kind": "assistant", "line": 2, "text": "hi", "priority": 3, "completes": True})
    assert [(r["user_text"], r["assistant_text"], r["ts"]) for r in b.close()] == [("hello", "hi", datetime(2025, 1, 1))]


def test_draw_run(spark):
    from ledgerloom.operators import runs

    rows = [candidate("a", "s", 2, "1"), candidate("b", "s", 1, "1", seq=2), candidate("c", "x", 1, "1"), candidate("c", "x", 1, "2", "other")]
    borrowed = (*candidate("d", "z", 5, "1")[:10], "owner", "1")
    known = spark.createDataFrame([("b", None)], "id string, extracted_at int")
    selected, conflicts, counts = runs.draw(spark.createDataFrame([*rows, borrowed], CANDIDATE), known)
    assert [r.id for r in selected.collect()] == ["b", "a"] and [r.id for r in conflicts.collect()] == ["c"]
    assert counts.first().asDict() == {"pending": 2, "resumable": 1, "conflicts": 1}


def test_payloads(spark):
    from ledgerloom.operators import runs

    rows = [("t1", "s", 1, [("user", "u1"), ("assistant", "x" * 5000)]), ("t2", "s", 2, [("user", "u2")])]
    c = spark.createDataFrame([(i, i, s, q, "claude", "/w", "", "", [{"role": r, "content": t} for r, t in d], q, s, "p") for i, s, q, d in rows], CANDIDATE)
    got = {r.id: json.loads(r.payload) for r in runs.draw_payloads(c).collect()}
    assert got["t1"]["agent_response"] == "x" * 5000 and got["t1"]["prior_turns"] == [] and got["t1"]["target_environment"] == {"cwd": "/w"}
    near = got["t2"]["prior_turns"][0]
    assert near["turn_offset"] == -1 and near["user_input"] == "u1" and len(near["agent_response"]) <= 4000 and "agent_response" not in got["t2"]


def test_payloads_query_shortens(spark, tmp_path):
    """Turns of conversations with long answers are there, shortened by bytes."""
    from ledgerloom.plans.queries import QUERIES

    answers = {1: ["short", "é" * 2500, "z" * 20_000, "end"], 2: ["y" * 4000, "ok"], 3: ["日" * 4001]}
    rows = [(c, 2 * k + j, r, t) for c, a in answers.items() for k, x in enumerate(a) for j, (r, t) in enumerate((("user", f"u{k}"), ("assistant", x)))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def brute(t, limit, marker):
        if len(t.encode()) <= limit:
            return t
        room = limit - len(marker.encode())
        a, z = t, t
        while len(a.encode()) > room // 2:
            a = a[:-1]
        while len(z.encode()) > room - room // 2:
            z = z[1:]
        return a + marker + z

    want = sorted((f"u{k}", brute(x, 12_000, "\n[assistant response truncated]\n"), min(k, 3), f"u{k - 1}" if k else "") for a in answers.values() for k, x in enumerate(a))
    got = QUERIES["draw_payloads"](spark, str(tmp_path)).collect()
    assert sorted((r.user_input, r.agent_response, r.n_prior, r.last_prior) for r in got) == want
    assert max(len(r.agent_response.encode()) for r in got) <= 12_000 < 20_000


def test_repository_subjects(spark):
    from ledgerloom.operators import runs

    subjects = spark.createDataFrame([("web", ["git@h.com:a/web.git"]), ("api", ["/work/api*"])], "name string, aliases array<string>")
    seen = spark.createDataFrame([("https://h.com/a/web", "/w1"), ("https://h.com/b/web", "/w2"), ("https://h.com/c/new.git", "/w3"), ("https://h.com/d/api", "/work/api1"), ("", "/nowhere")], "repo string, cwd string")
    got = {r.name: (r.aliases, r.is_new) for r in runs.repository_subjects(seen, subjects).collect()}
    assert got["web"] == (["git@h.com:a/web.git", "/w1", "https://h.com/a/web"], False) and got["api"][0] == ["/work/api*", "/work/api1", "https://h.com/d/api"]
    assert got["new"] == (["/w3", "https://h.com/c/new.git"], True)
    (other,) = {*got} - {"web", "api", "new"}
    assert other.startswith("web-") and len(other) == 12 and got[other] == (["/w2", "https://h.com/b/web"], True)


def test_documents_are_replaced_and_deleted(spark):
    from ledgerloom.operators import runs

    schema = "subject string, template string, knowledge_ids array<string>, body string"
    old = spark.createDataFrame([("a", "t", ["k"], "old"), ("b", "t", ["k"], "gone"), ("c", "t", ["k"], "kept")], schema)
    new = spark.createDataFrame([("a", "t", ["k"], "new"), ("d", "t", ["k"], "more")], schema)
    after, deleted = runs.write_documents(old, new, old.where("subject = 'b'"))
    assert {r.subject: r.body for r in after.collect()} == {"a": "new", "c": "kept", "d": "more"} and [r.body for r in deleted.collect()] == ["gone"]


def test_missing_roots_are_left_out(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text("{}")
    found = logs.find_logs(spark, {"claude": [str(tmp_path / "a"), str(tmp_path / "none")], "codex": [str(tmp_path / "gone")]})
    assert [r.agent for r in found.collect()] == ["claude"]
    assert logs.find_logs(spark, {"codex": [str(tmp_path / "gone")]}).count() == 0
    with pytest.raises(ValueError):
        logs.find_logs(spark, {})
    files = spark.createDataFrame([("/r/a.jsonl",), ("/ra/b.jsonl",), ("/q/c.jsonl",)], "path string")
    assert {r.path for r in logs.outside_roots(files, {"claude": ["/r"], "codex": ["/q/"]}).collect()} == {"/ra/b.jsonl"}


def test_sessions_by_name(spark):
    """A log's own session comes before the one of its file's name, in both dialects."""
    rows = [("claude", "/l/a.jsonl", 1, '{"type": "summary"}'), ("claude", "/l/a.jsonl", 2, '{"sessionId": "S"}'), ("claude", "/l/b.jsonl", 1, "broken"), ("codex", "/l/rollout-2024-01-02-b-c-d-e-f.jsonl", 1, '{"type": "turn_context"}'), ("codex", "/l/c.jsonl", 1, '{"type": "session_meta", "payload": {"id": "", "session_id": "C"}}'), ("codex", "/l/d.jsonl", 1, '{"id": "D", "timestamp": "t", "git": {}}')]
    lines_ = spark.createDataFrame(rows, "agent string, path string, line long, raw string")
    catalog = logs.session_catalog(lines_.select("agent", "path").distinct(), logs.named_sessions(lines_))
    assert {r.path: r.session_id for r in catalog.collect()} == {"/l/a.jsonl": "S", "/l/b.jsonl": "b", "/l/rollout-2024-01-02-b-c-d-e-f.jsonl": "b-c-d-e-f", "/l/c.jsonl": "C", "/l/d.jsonl": "D"}
    found, missing = logs.find_sessions(catalog, spark.createDataFrame([("codex", "C"), ("claude", "C"), ("claude", "S")], "agent string, session_id string"))
    assert {r.path for r in found.collect()} == {"/l/c.jsonl", "/l/a.jsonl"} and [(r.agent, r.session_id) for r in missing.collect()] == [("claude", "C")]


def test_a_failed_stream_loses_its_earlier_turns(spark):
    df = lines(spark, [meta("S"), say("one", 1, turn_id="t"), reply("z"), codex("turn_context")], "codex", "/bad.jsonl")
    got = tn.assemble_events(logs.decode_codex(df)[0]).collect()
    assert len(got) == 1 and got[0].error and got[0].user_text is None


def test_names_of_turns_get_suffixes():
    a = tn.Assembler()
    assert [a._own(x) for x in ("t", "t", "t.2", "t", "u", "t.2", "t.2.2")] == ["t", "t.2", "t.2.2", "t.3", "u", "t.2.3", "t.2.2.2"]


def test_codex_files_are_one_a_session(spark):
    """Log files of whole sessions, written by tasks under the sessions' names, each line ended."""
    from pathlib import Path

    from ledgerloom.plans import turn_queries as q

    sf = "/root/testdata/sf0.001"
    want = {f"s-{r.conv_id}.jsonl" for r in spark.read.parquet(f"{sf}/conversations.parquet").where("role <> 'system'").select("conv_id").distinct().collect()}
    for _ in range(2):
        files = [p for p in Path(q._codex_files(spark, sf).removeprefix("file://")).rglob("*") if p.is_file() and not p.name.startswith(".")]
        assert {p.name for p in files} == want and len(files) == len(want)
        assert all(p.read_text().startswith('{"type":"session_meta"') and p.read_text().endswith("}\n") for p in files)
