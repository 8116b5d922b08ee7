import random

import pytest
from test_search import ROWS, row

from ledgerloom.operators import batch_search as bs
from ledgerloom.operators import search as s

WORDS = "parser retry policy École aaaa cache 設定ファイル x1 No".split()


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        kind = rng.choice(["knowledge", "knowledge", "feedstock", "document"])
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))
        rows.append(row(f"{kind[0]}{i:03d}", text, kind=kind, ts=rng.randrange(20), summary=rng.choice(["", "Parser retry"]) if kind == "feedstock" else "", status=rng.choice(["active", "active", "pending", "invalidated"]), subjects=[rng.choice("ab")], types=[rng.choice(["decision", "intent"])], session=rng.choice("xy"), agent=rng.choice(["claude", "codex"])))
    vectors = [(r[0], r[1], rng.choice([[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [rng.random() for _ in range(3)]])) for r in rows if rng.random() < 0.8]
    return spark.createDataFrame(rows, ROWS).repartition(3).persist(), spark.createDataFrame(vectors, "id string, kind string, embedding array<float>").repartition(2).persist()


def some_cases(n=24):
    rng, out = random.Random(5), {}
    for i in range(n):
        kind = rng.choice(["knowledge", "feedstock", "document"])
        own = {"knowledge": {"subject": rng.choice([None, "a"]), "include_pending": rng.random() < 0.5}, "feedstock": {"session": rng.choice([None, "x"]), "agent": rng.choice([None, "codex"])}, "document": {"template": rng.choice([None, "intent"])}}[kind]
        words = rng.choice([[rng.choice(WORDS)], ["parser", rng.choice(WORDS)], ["école"], ["par", "arse"], ["x1"], ["PA", "no"], [], ["missing"]])
        mode = rng.choice(s.MODES)
        out[f"c{i}"] = s.Options(kind, words, mode, limit=rng.choice([3, 3, 60]), since_ns=rng.choice([None, 4]), until_ns=rng.choice([None, 15]), query_vector=rng.choice([[1.0, 0.0, 0.0], [0.1, 0.7, 0.2]]) if mode == "vector" or rng.random() < 0.7 else None, **own)
    return out


def test_rankings_are_those_of_single_searches(data):
    index, vectors = data
    cases = some_cases()
    got = {}
    for r in bs.rankings(index, vectors, cases).collect():
        got.setdefault(r.case_id, {})[r.rank] = r.id
    for k, o in cases.items():
        want = {r.rank: r.id for r in s.candidates(index, vectors, o).collect()}
        assert got.get(k, {}) == want, (k, o)


def test_scores_are_those_of_single_searches(data):
    index, vectors = data
    o = s.Options("knowledge", ["parser", "RETRY"], "text", include_pending=True)
    got = bs.text_rankings(index, {"a": o, "b": s.Options("knowledge", ["x1"], "text")}, {"a": 50, "b": 5}).collect()
    want = {r.id: r.score for r in s.text_branch(index, o, 50).collect()}
    assert {r.id: r.score for r in got if r.case_id == "a"} == pytest.approx(want) and want
    assert all(r.score is None for r in got if r.case_id == "b")


def test_small_blocks_and_many_ties(data, monkeypatch):
    index, vectors = data
    monkeypatch.setattr(bs, "ROWS", 7)
    monkeypatch.setattr(bs, "VECTORS", 5)
    for mode in s.MODES:
        o = s.Options("knowledge", ["parser"], mode, limit=5, query_vector=[1.0, 0.0, 0.0])
        got = [r.id for r in bs.rankings(index, vectors, {"one": o}).orderBy("rank").collect()]
        assert got == [r.id for r in s.candidates(index, vectors, o).orderBy("rank").collect()] and len(got) == 6


def test_no_cases_and_refusals(data, monkeypatch):
    index, vectors = data
    assert bs.rankings(index, vectors, {}).count() == 0
    with pytest.raises(ValueError):
        bs.rankings(index, vectors, {"l": s.Options("feedstock", last=3)})
    monkeypatch.setattr(bs, "MOST_CASES", 1)
    with pytest.raises(ValueError):
        bs.rankings(index, vectors, some_cases(3))


def test_report(spark, data):
    index, vectors = data
    cases = {f"c{i}": s.Options("knowledge", [w], "hybrid", include_pending=True, query_vector=[0.6, 0.8, 0.0]) for i, w in enumerate(["parser", "retry"])}
    text = {k: [r.id for r in s.text_branch(index, o, 50).orderBy("rank").collect()] for k, o in cases.items()}
    qrels = spark.createDataFrame([("c0", text["c0"][0], 2), ("c0", "nowhere", 1), ("c1", text["c1"][1], 2), ("other", "x", 2)], "case_id string, id string, grade int")
    report = {r["mode"]: r for r in bs.evaluate(index, vectors, cases, qrels).collect()}
    assert {*report} == {*s.MODES} and report["text"]["cases"] == 2
    assert report["text"]["recall_5"] == pytest.approx((0.5 + 1) / 2) and report["text"]["mrr"] == pytest.approx((1 + 0.5) / 2)
