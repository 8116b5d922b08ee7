from test_knowledge import ACTIONS, K, frame, k

from ledgerloom.operators import organize as og


def test_plans_of_changed_subjects_are_refused(spark):
    """A head that changed, came or went, or an input that came, refuses its subject's plan whole; others are applied as without the check."""
    inputs = frame(spark, *(k(f"n{i}", organized=False, subject=f"s{i}", order="9") for i in range(6)))
    heads = [k(f"h{i}", approved=True, subject=f"s{i}", order="1") for i in range(6)]
    actions = spark.createDataFrame([(f"n{i}", "conflicts", [f"h{i}"], None, None) for i in range(6)] + [("x", "new", [], None, None)], ACTIONS)
    old = frame(spark, *heads)
    planned = og.subject_digests(inputs, old)
    whole = {r.subject: r for r in og.organize(inputs, old, actions).collect()}
    assert {r.subject: r for r in og.organize_planned(inputs, old, actions, planned).collect()} == whole and len(whole) == 6
    now = frame(spark, heads[0], k("h1", approved=True, subject="s1", order="1", statement="other"), k("h2", approved=True, invalid=True, subject="s2", order="1"), heads[3], k("new", subject="s3"), heads[4], heads[5])
    later = inputs.unionByName(frame(spark, k("x", organized=False, subject="s4", order="9")))
    got = {(r.subject, r.input_id): r for r in og.organize_planned(later, now, actions, planned.where("subject <> 's5'")).collect()}
    assert {s for (s, i), r in got.items() if r.error == og.CHANGED} == {"s1", "s2", "s3", "s4", "s5"}
    assert [r for r in got.values() if r.error is None] == [whole["s0"]]


def test_digests_know_no_order(spark):
    rows = [k(f"h{i}", subject="s", order="1") for i in range(9)]
    one = frame(spark, k("n", organized=False))
    a, b = (og.subject_digests(one, frame(spark, *r).repartition(3)).collect() for r in (rows, rows[::-1]))
    assert a == b and len(a) == 1
    assert og.subject_digests(one, frame(spark, *rows, rows[0])).collect() != a
    assert og.subject_digests(spark.createDataFrame([], K), frame(spark, *rows)).count() == 0
