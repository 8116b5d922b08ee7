import sqlite3

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import search as s

ROWS = "id string, kind string, session string, agent string, timestamp_ns long, summary string, searchable string, claim string, subjects array<string>, types array<string>, status string, path string"


def row(i, text, kind="knowledge", ts=0, summary="", status="active", subjects=("s",), types=("decision",), session="x", agent="claude"):
    return (i, kind, session, agent, ts, summary, text, text, [*subjects], [*types], status, f"{i}.md")


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        row("a", "the parser is reliable", ts=5), row("b", "reliable reliable parser", ts=4), row("c", "ÉCOLE et parser", ts=3, status="pending"), row("d", "設定ファイル parser 50% done", ts=2, status="invalidated"),
        row("e", "something else", ts=1, subjects=["t"]), row("f", "parser in a turn", kind="feedstock", ts=9, summary="parser reliable"), row("g", "aaaa", ts=7, types=["intent"]), row("h", "old claim", status="superseded", ts=8),
    ]
    return spark.createDataFrame(rows, ROWS).persist()


@pytest.fixture(scope="module")
def vectors(spark):
    data = {"a": [1.0, 0.0], "b": [0.6, 0.8], "e": [0.0, 1.0], "g": [0.6, 0.8], "d": [1.0, 0.0]}
    return spark.createDataFrame([(i, "knowledge", v) for i, v in data.items()], "id string, kind string, embedding array<float>")


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def fts(index, terms):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, kind unindexed, summary, searchable, tokenize='trigram')")
    db.executemany("insert into t values (?,?,?,?)", [(r.id, r.kind, r.summary, r.searchable) for r in index.collect()])
    match = " ".join('"' + t.replace('"', '""') + '"' for t in terms)
    return dict(db.execute("select id, -bm25(t) from t where t match ? and kind = 'knowledge'", [match]).fetchall())


@pytest.mark.parametrize("terms", [["parser"], ["reliable"], ["parser", "reliable"], ["école"], ["liable"], ["aaa"], ["設定ファ"], ["missing"]])
def test_bm25_is_that_of_the_text_index(index, terms):
    want = fts(index, terms)
    o = s.Options("knowledge", terms, "text", include_pending=True, include_retired=True)
    got = {r.id: r.score for r in s.text_branch(index, o, 50).collect()}
    assert got == pytest.approx(want)


def test_short_terms_fall_back(index):
    o = lambda *k: s.Options("knowledge", k, "text", include_pending=True, include_retired=True)
    assert ids(s.candidates(index, None, o("0%"))) == ["d"] and ids(s.candidates(index, None, o("PA", "ser"))) == ["a", "b", "c", "d"]
    assert ids(s.candidates(index, None, o("É"))) == ["c"] and ids(s.candidates(index, None, o("é"))) == []


def test_status_and_filters(index):
    o = lambda **k: s.Options("knowledge", ["parser"], "text", **k)
    got = lambda x: {*ids(s.candidates(index, None, x))}
    assert got(o()) == {"a", "b"} and got(o(include_pending=True)) == {"a", "b", "c"} and got(o(include_retired=True)) == {"a", "b", "d"}
    assert got(o(since_ns=5)) == {"a"} and got(o(until_ns=4)) == {"b"} and got(o(since_ns=4, until_ns=5)) == {"a", "b"}
    assert got(s.Options("knowledge", subject="t")) == {"e"} and got(s.Options("knowledge", type="intent")) == {"g"}
    assert s.end_of_day_ns(0) == 86_399_999_999_999


def test_fusion_ties(spark):
    frame = lambda x: spark.createDataFrame([*x.items()], "id string, rank int")
    got = s.fuse({"text": frame({"a": 1, "b": 2, "c": 3}), "vector": frame({"b": 1, "a": 2, "d": 3})})
    assert ids(got) == ["a", "b", "c", "d"]
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, rank int")
    assert s.fuse({"text": twice}).where("id = 'a'").first()["score"] == pytest.approx(1 / 61)


def test_vector_search_filters_first(index, vectors):
    o = s.Options("knowledge", ["x"], "vector", query_vector=[1.0, 0.0], limit=3)
    assert ids(s.candidates(index, vectors, o)) == ["a", "b", "g", "e"]
    assert ids(s.vector_branch(index, vectors, o, 9, least=0.5)) == ["a", "b", "g"]
    assert s.total(index, vectors, o).first()["total"] == 4


def test_hybrid(index, vectors):
    o = s.Options("knowledge", ["parser"], "hybrid", query_vector=[0.0, 1.0])
    results, summary = s.search(index, vectors, o)
    assert {r.id for r in results.collect()} == {"a", "b", "e", "g"}
    assert summary.first().asDict() == {"total": 4, "returned": 4, "has_more": False, "truncated": False}
    plain = s.Options("knowledge", ["parser"], "hybrid")
    assert {*ids(s.candidates(index, vectors, plain))} == {"a", "b"}


def test_budget_and_totals(spark):
    rows = spark.createDataFrame([row(f"r{i:02d}", "same words", ts=i) for i in range(73)], ROWS)
    results, summary = s.search(rows, None, s.Options("knowledge", ["words"], "text", limit=20))
    assert results.count() == 20 and summary.first().asDict() == {"total": 73, "returned": 20, "has_more": True, "truncated": False}
    results, summary = s.search(rows, None, s.Options("knowledge", ["words"], "text", limit=20, max_tokens=1))
    assert results.count() == 0 and summary.first().asDict() == {"total": 73, "returned": 0, "has_more": True, "truncated": True}


def test_json_bytes(spark):
    df = spark.createDataFrame([("a<b>&", "", None, [])], "id string, x string, y string, z array<string>")
    assert df.select(s.json_bytes(df, ["id", "x", "y", "z"]).alias("n")).first()["n"] == len('{"id":"a\\u003cb\\u003e\\u0026"}')


def test_last_is_oldest_first(index, spark):
    rows = spark.createDataFrame([row(f"f{i}", "t", kind="feedstock", ts=i) for i in range(5)], ROWS)
    assert ids(s.candidates(rows, None, s.Options("feedstock", last=3))) == ["f2", "f3", "f4"]
    assert ids(s.candidates(rows, None, s.Options("feedstock", limit=2))) == ["f4", "f3", "f2"]


@pytest.mark.parametrize("bad", [
    dict(kind="x"), dict(kind="knowledge", limit=101), dict(kind="knowledge", limit=-1), dict(kind="knowledge", mode="y"), dict(kind="document", type="t"), dict(kind="feedstock", include_pending=True),
    dict(kind="feedstock", last=2, keywords=["a"]), dict(kind="knowledge", keywords=["a"], mode="vector"), dict(kind="knowledge", since_ns=2, until_ns=1), dict(kind="knowledge", session="s"),
])
def test_validation(bad):
    with pytest.raises(ValueError):
        s.validate(s.Options(**bad))


def test_plan_takes_ordered_rows_only(index):
    plan = s.candidates(index, None, s.Options("knowledge", ["parser"], "text"))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
    assert index.select(F.lit(1)).count() == 8
