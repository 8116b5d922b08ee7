import io
import json
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from test_turns import answer, codex, meta, reply, say, user

from ledgerloom.operators import turns as tn
from ledgerloom.sources import logs, ranges
from ledgerloom.sources.log_cache import LogCache


@given(st.binary(max_size=200).map(lambda b: b.replace(b"\x00", b"\n")), st.integers(1, 40), st.integers(1, 30))
def test_ranges_give_each_record_once(data, step, block):
    """Whatever the ranges and the blocks, records are those that splitting at line breaks gives."""
    before, ranges.BLOCK_BYTES = ranges.BLOCK_BYTES, block
    try:
        got = [x for lo in range(0, len(data), step) for x in ranges.records(io.BytesIO(data), lo, min(lo + step, len(data)), len(data), lo == 0)]
    finally:
        ranges.BLOCK_BYTES = before
    parts = data.split(b"\n")
    want, at = [], 0
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if not (last and not part):
            want.append((at, at + len(part) + (not last), part.removesuffix(b"\r"), not last))
        at += len(part) + 1
    assert got == want


def test_long_records_stop_early():
    got = [*ranges.records(io.BytesIO(b"ab\n" + b"x" * 50 + b"\ncd\n"), 0, 99, 57, limit=10)]
    assert [(r[0], r[2]) for r in got] == [(0, b"ab"), (3, None)]
    assert [r[2] for r in ranges.records(io.BytesIO(b"x" * 10 + b"\r\ny"), 0, 99, 13, limit=10)] == [b"x" * 10, b"y"]


def text(records, end="\n"):
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records[:-1]) + json.dumps(records[-1], ensure_ascii=False) + end


def put(path, content, when):
    path.write_text(content)
    os.utime(path, (when, when))


def listed(spark, root):
    return logs.find_logs(spark, {"claude": [f"{root}/claude"], "codex": [f"{root}/codex"]})


def whole(spark, root):
    """Turns of a full parse."""
    files = listed(spark, root)
    out = []
    for agent in ("claude", "codex"):
        names = [r.path for r in files.where(f"agent = '{agent}'").collect()]
        if names:
            lines, _ = logs.usable_lines(logs.read_lines(spark, names, agent))
            events = logs.decode_claude(lines) if agent == "claude" else logs.decode_codex(lines)[0]
            out += rows(tn.assemble_events(events).where("error is null"))
    return sorted(out)


def rows(df):
    return sorted((r.path.split("/")[-1], r.stream, r.session_id, r.turn_id, str(r.ts), r.cwd or "", r.user_text, r.assistant_text or "", r.source_line) for r in df.collect())


def decisions(report):
    return {r.path.split("/")[-1]: (r.decision, r.bytes_read) for r in report.collect()}


@pytest.fixture
def root(tmp_path):
    for agent in ("claude", "codex"):
        (tmp_path / agent).mkdir()
    return tmp_path


@pytest.mark.parametrize("range_bytes", [100, 1 << 27])
def test_runs_equal_a_full_parse(spark, root, range_bytes):
    """Reused, grown, moved, moved and grown, and rewritten logs; open turns, sessions and suffixes go on; only new bytes are read."""
    c, x = root / "claude", root / "codex"
    long = [r for n in range(1, 9) for r in (user(f"é question {n}", n, uuid="same"), answer(f"answer {n}"))]
    put(c / "same.jsonl", text(long[:4]), 1000)
    put(c / "grown.jsonl", text(long[:5]) + '{"type": "assi', 1000)
    put(c / "old.jsonl", text([user("moved", 1), answer("yes"), user("open", 2)]), 1000)
    put(c / "rewritten.jsonl", text([user("before", 1), answer("x")]), 1000)
    put(c / "tail.jsonl", text([user("tail", 1), answer("t")], end=""), 1000)
    put(x / "two.jsonl", text([meta("S"), say("one", turn_id="a"), reply("1"), meta("T"), say("two", turn_id="b")]), 1000)
    put(x / "rollout-x-0a1b2c3d-0000-1111-2222-333344445555.jsonl", text([say("nameless", turn_id="n"), reply("r"), say("open", 2, turn_id="o")]), 1000)
    put(x / "sub.jsonl", text([meta("U", source={"subagent": "x"}), say("no", turn_id="q")]), 1000)
    kept = LogCache(spark, f"{root}/cache")
    turns, report, warnings = kept.run(listed(spark, root), range_bytes)
    assert rows(turns) == whole(spark, root) and {d for d, _ in decisions(report).values()} == {"reparse"} and warnings.count() == 0
    put(c / "grown.jsonl", text(long), 2000)
    (c / "old.jsonl").rename(c / "new.jsonl")
    put(c / "rewritten.jsonl", text([user("after", 3), answer("y"), user("z", 4), answer("z")]), 2000)
    put(c / "tail.jsonl", text([user("tail", 1), answer("t")]) + text([user("more", 2), answer("m")]), 2000)
    before = (x / "two.jsonl").read_text()
    (x / "two.jsonl").unlink()
    put(x / "moved.jsonl", before + text([reply("2"), codex("turn_context", turn_id="c"), say("three"), reply("3")]), 2000)
    grown = text([say("nameless", turn_id="n"), reply("r"), say("open", 2, turn_id="o"), reply("late"), say("again", 3, turn_id="o"), reply("a")])
    put(x / "rollout-x-0a1b2c3d-0000-1111-2222-333344445555.jsonl", grown, 2000)
    put(x / "sub.jsonl", text([meta("U", source={"subagent": "x"}), say("no", turn_id="q"), reply("n"), meta("V"), say("no", turn_id="w"), reply("n")]), 2000)
    turns, report, warnings = kept.run(listed(spark, root), range_bytes)
    assert rows(turns) == whole(spark, root) and warnings.count() == 0
    got = decisions(report)
    assert {k: d for k, (d, _) in got.items()} == {"same.jsonl": "reuse", "grown.jsonl": "resume", "new.jsonl": "relocate", "rewritten.jsonl": "reparse", "tail.jsonl": "resume", "moved.jsonl": "resume", "rollout-x-0a1b2c3d-0000-1111-2222-333344445555.jsonl": "resume", "sub.jsonl": "resume"}
    assert got["grown.jsonl"][1] == len(text(long).encode()) - len(text(long[:5]).encode()) and got["same.jsonl"][1] == got["new.jsonl"][1] == got["sub.jsonl"][1] == 0
    assert {r.path.split("/")[-1]: r.moved_from.split("/")[-1] for r in report.collect() if r.moved_from} == {"new.jsonl": "old.jsonl", "moved.jsonl": "two.jsonl"}
    kept.compact()
    assert rows(kept.turns()) == whole(spark, root) and kept.vacuum() and not kept.vacuum()
    put(c / "new.jsonl", (c / "new.jsonl").read_text() + text([answer("closed")]), 3000)
    (c / "same.jsonl").unlink()
    turns, report, _ = kept.run(listed(spark, root), range_bytes)
    assert rows(turns) == whole(spark, root) and decisions(report)["new.jsonl"][0] == "resume" and [d for d, _ in decisions(report).values()].count("reuse") == 6


def test_failed_logs_stay_as_they_were(spark, root):
    """Malformed and too long records, and events that can't be applied, are warnings; the next run goes on from the last good one."""
    c, x = root / "claude", root / "codex"
    put(c / "good.jsonl", text([user("one", 1), answer("1")]), 1000)
    put(c / "bad.jsonl", text([user("one", 1), answer("1"), user("two", 2)]), 1000)
    put(c / "long.jsonl", text([user("x" * 4000, 1), answer("1")]), 1000)
    put(x / "no-id.jsonl", text([meta("S"), codex("turn_context"), say("x", turn_id="a")]), 1000)
    kept = LogCache(spark, f"{root}/cache")
    turns, _, warnings = kept.run(listed(spark, root), limit=2000)
    assert {r.path.split("/")[-1]: r.reason for r in warnings.collect()} == {"long.jsonl": "line 1: record too long", "no-id.jsonl": "turn context has no turn ID"}
    assert [r[:1] + r[3:4] for r in rows(turns)] == [("bad.jsonl", "u1"), ("good.jsonl", "u1")]
    before = (c / "bad.jsonl").read_text()
    put(c / "bad.jsonl", before + "not json\n", 2000)
    turns, report, warnings = kept.run(listed(spark, root), limit=10_000)
    assert decisions(report)["bad.jsonl"][0] == "resume" and {r.path.split("/")[-1]: r.reason for r in warnings.collect()}["bad.jsonl"] == "line 4: malformed record"
    assert [r[0] for r in rows(turns)] == ["good.jsonl", "long.jsonl"]
    put(c / "bad.jsonl", before + text([answer("2")]), 3000)
    turns, report, _ = kept.run(listed(spark, root))
    assert decisions(report)["bad.jsonl"][0] == "resume" and [r for r in rows(turns) if r[0] == "bad.jsonl"] == [r for r in whole_of(spark, c / "bad.jsonl")]


def whole_of(spark, path):
    lines, _ = logs.usable_lines(logs.read_lines(spark, [str(path)], "claude"))
    return rows(tn.assemble_events(logs.decode_claude(lines)))


def test_no_logs(spark, root):
    kept = LogCache(spark, f"{root}/cache")
    empty = spark.createDataFrame([], "agent string, path string, mtime timestamp, size long")
    turns, report, warnings = kept.run(empty)
    assert turns.count() == report.count() == warnings.count() == 0
    put(root / "claude" / "blank.jsonl", "", 1000)
    put(root / "claude" / "a.jsonl", text([user("one", 1), answer("1")]), 1000)
    turns, _, _ = kept.run(listed(spark, root))
    assert len(rows(turns)) == 1


def test_records_are_judged_once(spark, root, monkeypatch):
    """What is staged of records says which ones are whole: later passes don't parse them again for that."""
    put(root / "codex" / "two.jsonl", text([meta("S"), say("one", turn_id="a"), reply("1")]) + '{"type": "respo', 1000)
    put(root / "claude" / "odd.jsonl", text([user("odd", 1)]) + "no record\n", 1000)
    staged, stage = {}, LogCache._stage
    monkeypatch.setattr(LogCache, "_stage", lambda self, df, name: staged.setdefault(name, stage(self, df, name)))
    turns, _, warnings = LogCache(spark, f"{root}/cache").run(listed(spark, root))
    assert [(r.session_id, r.turn_id, r.assistant_text) for r in turns.collect()] == [("S", "a", "1")]
    assert [r.reason for r in warnings.collect()] == ["line 2: malformed record"]
    assert sorted((r.line, r.terminated, r.whole) for r in staged["log-records"].collect()) == [(1, True, True), (1, True, True), (2, True, False), (2, True, True), (3, True, True), (4, False, False)]
