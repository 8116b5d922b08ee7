from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle as lc
from ledgerloom.operators import organize as og
from ledgerloom.operators import records as rc

T0, NOW = datetime(2024, 1, 1), datetime(2025, 1, 1)
K = "id string, subject string, type string, statement string, feedstocks array<string>, approved boolean, supersedes array<string>, superseded_by string, superseded_at timestamp, invalidated_at timestamp, organized_at timestamp, updated timestamp, order_key string, established_by string"


def k(i, supersedes=(), approved=False, by="", invalid=False, organized=True, statement=None, subject="s", feedstocks=None, order="0"):
    f = feedstocks or [f"fs-{i}"]
    return (i, subject, "decision", statement or f"claim {i}", f, approved, [*supersedes], by, T0 if by else None, T0 if invalid else None, T0 if organized else None, T0, order, f[0])


def frame(spark, *rows):
    return spark.createDataFrame([*rows], K)


def test_status_precedence(spark):
    df = lc.with_status(frame(spark, k("a", by="b", invalid=True, approved=True), k("b", invalid=True, approved=True), k("c", approved=True), k("d")))
    assert [r.status for r in df.orderBy("id").collect()] == ["superseded", "invalidated", "active", "pending"]


def test_heads(spark):
    df = frame(spark, k("a", approved=True), k("b", ["a"]), k("c", ["b"], invalid=True), k("d", organized=False), k("e", subject="t"))
    assert {r.id for r in lc.heads(df).collect()} == {"b", "e"} and {r.id for r in lc.heads(df, "t").collect()} == {"e"}


def test_graph_issues(spark):
    df = frame(spark, k("a", ["a"]), k("b", ["missing"]), k("c", by="b"), k("d"), k("e", ["d"]), k("f", ["d"]), k("g", ["h"]), k("h", ["i"]), k("i", ["g"]), k("x", statement="Same  claim"), k("y", statement="same claim"), k("z", ["g"]))
    got = {(r.id, r.issue) for r in lc.validate_graph(df).collect()}
    assert got == {
        ("a", "supersedes itself"), ("b", "supersedes missing knowledge"), ("c", "inconsistent superseded_by"), ("d", "multiple current successors"), ("g", "multiple current successors"),
        ("g", "supersession cycle"), ("h", "supersession cycle"), ("i", "supersession cycle"), ("x", "duplicate current claim"), ("y", "duplicate current claim"),
    }


def test_reconcile(spark):
    df = frame(
        spark, k("a"), k("b", ["a"]), k("c", ["b"]), k("p", approved=True), k("q", ["p"]), k("r", approved=True), k("s", ["r"], approved=True), k("lost", by="gone"), k("kept", by="inv", approved=True), k("inv", ["held"], invalid=True), k("held", by="inv"),
        k("u"), k("v", ["u"]), k("w", ["u"]), k("m", ["nowhere"]), k("n1", ["n2"]), k("n2", ["n1"]), k("o", organized=False), k("taken", by="t1"), k("t1", ["taken"], invalid=False), k("t2", ["taken"], approved=True),
    )
    changed, issues = lc.reconcile(df, NOW)
    got = {r.id: (r.status, r.superseded_by or "") for r in changed.collect()}
    assert got == {"a": ("superseded", "b"), "b": ("superseded", "c"), "r": ("superseded", "s"), "lost": ("pending", ""), "held": ("pending", "")}
    assert {(r.id, r.issue) for r in issues.collect()} == {("u", "multiple eligible successors"), ("m", "target does not exist"), ("n1", "supersession cycle"), ("n2", "supersession cycle"), ("taken", "already superseded by another")}


def test_long_chains_and_cycles(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)]
    g = spark.createDataFrame([*chain, ("x", "y"), ("y", "z"), ("z", "x"), ("n000", "x")], "src string, dst string")
    assert {r.id for r in lc.on_cycles(g).collect()} == {"x", "y", "z"}
    assert lc.reachable(spark.createDataFrame(chain, "src string, dst string")).count() == 71 * 70 // 2


ACTIONS = "knowledge_id string, kind string, knowledge_ids array<string>, draft_type string, draft_statement string"


def run(spark, inputs, heads, actions):
    rows = og.organize(frame(spark, *inputs), frame(spark, *heads) if heads else spark.createDataFrame([], K), spark.createDataFrame([(*a, *[None] * (5 - len(a))) for a in actions], ACTIONS)).collect()
    return {r.input_id or "error": r for r in rows}


def test_organize_outcomes(spark):
    heads = [k("h1", approved=True, order="5", feedstocks=["f1"]), k("h2", order="5", feedstocks=["f2"])]
    inputs = [k(i, organized=False, order=o) for i, o in (("a", "6"), ("b", "7"), ("c", "8"), ("d", "1"), ("e", "9"))]
    got = run(spark, inputs, heads, [("a", "equivalent", ["h1"]), ("b", "complements", ["a"], "decision", "merged text"), ("c", "conflicts", ["h2"]), ("d", "conflicts", ["h2"]), ("e", "discard", [])])
    assert {i: r.outcome for i, r in got.items()} == {"a": "evidence_added", "b": "merged", "c": "replaced", "d": "historical_conflict_ignored", "e": "discarded"}
    assert got["a"].knowledge_id == "h1" and got["a"].feedstocks == ["f1", "fs-a"]
    assert got["b"].supersedes == ["h1"] and got["b"].retires is None and got["b"].statement == "merged text" and got["b"].feedstocks == ["f1", "fs-a", "fs-b"]
    assert got["c"].supersedes == ["h2"] and got["c"].retires == "h2"


@pytest.mark.parametrize(("inputs", "actions", "why"), [
    (["a"], [], "no valid action"), (["a"], [("a", "new", ["h"])], "wrong targets"), (["a"], [("a", "equivalent", ["zz"])], "not a current head"), (["a", "b"], [("a", "discard", []), ("b", "equivalent", ["a"])], "not a current head"),
    (["a"], [("a", "complements", ["h"])], "wrong targets"), (["h!"], [("h!", "new", [])], "duplicate current claims"),
])
def test_organize_errors_reject_the_subject(spark, inputs, actions, why):
    got = run(spark, [k(i, organized=False, order="9", statement="Claim  H" if i == "h!" else None) for i in inputs], [k("h", statement="claim h")], actions)
    assert [*got] == ["error"] and why in got["error"].error


def test_organize_keeps_drafts_and_checks_them(spark):
    """A complement has its draft's type, subject, statement and rationale; types and statements are checked; one action an input."""
    head = frame(spark, k("h", order="1"))
    own = frame(spark, k("a", organized=False, order="2")).withColumn("rationale", F.lit("mine"))
    schema = "knowledge_id string, kind string, knowledge_ids array<string>, draft_type string, draft_subject string, draft_statement string, draft_rationale string"

    def result(*acts, types=("decision", "rule"), inputs=own):
        return og.organize(inputs, head, spark.createDataFrame([*acts], schema), types).collect()

    (r,) = result(("a", "complements", ["h"], "rule", "s", " both ", "because"))
    assert (r.outcome, r.type, r.knowledge_subject, r.statement, r.rationale) == ("merged", "rule", "s", "both", "because")
    (r,) = result(("a", "new", [], None, None, None, None))
    assert (r.outcome, r.rationale, r.statement) == ("created", "mine", "claim a")
    bad = ("a", "complements", ["h"], "rule", "s", "both", None)
    for act, why in ((bad[:3] + ("odd",) + bad[4:], "unknown type"), (bad[:4] + ("t",) + bad[5:], "belongs to subject"), (bad[:5] + (" ",) + bad[6:], "no proper statement")):
        (r,) = result(act)
        assert why in r.error and r.outcome is None
    (r,) = result(bad, bad)
    assert "several actions" in r.error
    (r,) = result(bad, types=("rule",))
    assert "unknown type" in r.error


def test_reachable_from_some(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 8)], "src int, dst int")
    got = {(r.src, r.dst) for r in lc.reachable(chain, spread=spark.createDataFrame([(1,), (6,)], "src int")).collect()}
    assert got == {(1, i) for i in range(2, 9)} | {(6, 7), (6, 8)}
    with pytest.raises(RuntimeError):
        lc.reachable(chain, rounds=2)


def test_subjects_fail_alone(spark):
    got = run(spark, [k("a", organized=False), k("b", organized=False, subject="t")], [], [("a", "new", [])])
    assert got["a"].outcome == "created" and "b" in got["error"].error


def test_extract_is_all_or_nothing(spark):
    f = spark.createDataFrame([("f1", T0, None), ("f2", T0, None), ("f3", None, None), ("f4", T0, T0)], "id string, drafted_at timestamp, extracted_at timestamp")
    d = spark.createDataFrame([("f1", 1, "decision", "s", " one ", ""), ("f1", 2, "decision", "", "two", "why"), ("f2", 1, "decision", "s", "ok", ""), ("f2", 2, "strange", "s", "x", ""), ("f3", 1, "decision", "s", "x", ""), ("f4", 1, "decision", "s", "x", "")], "feedstock_id string, ordinal int, type string, subject string, statement string, rationale string")
    good, bad = og.extract(f, d, ["decision"], ["s"])
    assert sorted(r.statement for r in good.collect()) == ["one", "two"] and [r.feedstock_id for r in bad.collect()] == ["f2"]


def test_drafts_apply_once(spark):
    f = spark.createDataFrame([("a", None, None, None), ("b", "old", ["x"], T0)], "id string, summary string, types array<string>, drafted_at timestamp")
    d = spark.createDataFrame([("a", " new ", ["z", "y", "z"]), ("b", "new", ["y"])], "id string, summary string, types array<string>")
    got = {r.id: (r.summary, r.types, r.drafted_at) for r in og.apply_drafts(f, d, NOW).collect()}
    assert got == {"a": ("new", ["y", "z"], NOW), "b": ("old", ["x"], T0)}


def test_changes_of_records(spark):
    df = frame(spark, k("a"), k("b", by="c"), k("c", approved=True), k("d", organized=False))
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    status = lambda x: {r.id: r.status for r in lc.with_status(x).collect()}
    assert status(rc.invalidate(df, ids, NOW)) == {"a": "invalidated", "b": "superseded", "c": "invalidated", "d": "pending"}
    assert status(rc.approve(df, ids, NOW)) == {"a": "active", "b": "superseded", "c": "active", "d": "pending"}
    assert status(rc.supersede_pending(df, ids.selectExpr("id", "'z' by"), NOW)) == {"a": "superseded", "b": "superseded", "c": "active", "d": "superseded"}
    more = spark.createDataFrame([("a", "n"), ("a", "fs-a"), ("b", "n")], "id string, feedstock string")
    assert {r.id: r.feedstocks for r in rc.add_evidence(df, more, NOW).where("id in ('a', 'b')").collect()} == {"a": ["fs-a", "n"], "b": ["fs-b"]}
    assert {r.id: r.feedstocks for r in rc.add_evidence(df, more, NOW, retired=True).where("id = 'b'").collect()} == {"b": ["fs-b", "n"]}


def test_validators(spark):
    good, bad = rc.split(frame(spark, k("a"), k("B"), k("c", organized=False, approved=True), k("d", ["d"]), k("e", feedstocks=["x"]), k("f", statement=" ")), rc.knowledge_error())
    assert {r.id for r in good.collect()} == {"a", "e"}
    assert {r.id: r.reason for r in bad.collect()} == {"B": "invalid id", "c": "unorganized knowledge has no lifecycle", "d": "supersedes itself", "f": "statement is required"}
    t = spark.createDataFrame([("n", "o.md", "p", "always"), ("n", "o.txt", "p", ""), ("n", "o.md", "p", "never")], "name string, output string, purpose string, inject string")
    assert [r.reason for r in t.select(rc.template_error().alias("reason")).collect()] == [None, "output must be Markdown", "unknown inject mode"]


def test_results_are_checked(spark):
    rows = [(1, '{"summary": "s", "types": ["a"]}'), (2, '{"summary": "s", "types": [], "more": 1}'), (3, '{"summary": "s"}'), (4, "no json"), (5, '{"summary": "s", "types": []} x')]
    good, bad = rc.decode_result(spark.createDataFrame(rows, "id int, result string"), "draw")
    assert [r.id for r in good.collect()] == [1] and good.first().decoded.types == ["a"] and {r.id for r in bad.collect()} == {2, 3, 4, 5}


def test_usage(spark):
    df = spark.createDataFrame([('{"input_tokens": 5, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 2, "output_tokens": 3}',)], "usage string")
    r = rc.model_usage(df, "claude").first()
    assert (r.input, r.cached, r.cache_write, r.output) == (14, 7, 2, 3)
    r = rc.model_usage(spark.createDataFrame([('{"prompt_tokens": 5, "cached_input_tokens": 9, "completion_tokens": 1}',)], "usage string"), "codex").first()
    assert (r.input, r.cached, r.output) == (5, 5, 1)


def test_snapshots(spark):
    a, b = frame(spark, k("a"), k("b"), k("c")), frame(spark, k("a"), k("b", statement="new"), k("d"))
    digest = lambda x: rc.snapshot_digest(x, ["statement", "supersedes"])
    assert {r.id for r in rc.changed_since(digest(a), digest(b)).collect()} == {"b", "c", "d"}
    f = spark.createDataFrame([("fs-a", T0, "s", "t")], "id string, timestamp timestamp, session_id string, turn_id string")
    found, missing = rc.with_established(a, f)
    assert [r.id for r in found.collect()] == ["a"] and {r.id for r in missing.collect()} == {"b", "c"}


def test_run_summaries(spark):
    inputs = frame(spark, k("a", organized=False, order="5"), k("b", organized=False, order="6"), k("c", organized=False, subject="t"))
    actions = spark.createDataFrame([("a", "new", [], None, None), ("b", "conflicts", ["a"], None, None)], ACTIONS)
    r = og.summary(og.organize(inputs, spark.createDataFrame([], K), actions)).first()
    assert (r.subjects, r.failed, r.created, r.replaced, r.retired, r.discarded) == (2, 1, 1, 1, 1, 0)
    assert [x.subject for x in og.pending_subjects(frame(spark, k("a", organized=False, subject="z"), k("b", organized=False), k("c", organized=False), k("d", subject="q"))).collect()] == ["s", "z"]


def test_omitted_documents_are_named(spark):
    from ledgerloom.operators import documents as dc

    blocks = spark.createDataFrame([("x", 1, "s", t, "## h", b) for t, b in (("a", "aaaa\n"), ("b", "b" * 400), ("c", "cc\n"))], "session string, section int, subject string, template string, heading string, block string")
    (r,) = dc.inject(blocks, "# p\n", 20, "Ask for them.\n").collect()
    assert (r.included, r.omitted) == (2, 1) and r.context == "# p\n\n## h\n\naaaa\n\ncc\n" + "\n---\nContext budget reached: 1 document(s) were omitted (context.max_tokens = 20).\nAsk for them.\n"
