import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_search import ROWS, fts, row

from ledgerloom.functions import postings as p
from ledgerloom.operators import search as s
from ledgerloom.operators import text_index as ti
from ledgerloom.operators.text_index import TextIndex


@given(st.lists(st.integers(0, (1 << 62) - 1), max_size=50))
def test_varints_round_trip(values):
    data, size = p.varints(np.array(values, np.uint64))
    assert size.sum() == len(data) and p.unvarints(data.tobytes()).tolist() == values


@settings(max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4095), st.integers(0, 1 << 33)), unique=True, max_size=60))
def test_lists_round_trip(places):
    if not places:
        return
    own = p.Lists(*(np.array(c, np.int64) for c in zip(*places, strict=True)))
    got = []
    for gram, n, docs, at in own.each():
        of, doc, place = p.decode(np.array([n]), docs, at)
        got += [(gram, d, x) for d, x in zip(doc.tolist(), place.tolist(), strict=True)]
        assert not of.any() and n == len(np.unique(doc))
    assert got == sorted(places)
    of, doc, place = p.decode(own.n_docs, own.docs.tobytes(), own.places.tobytes())
    assert [*zip(own.grams[of].tolist(), doc.tolist(), place.tolist(), strict=True)] == sorted(places)


@settings(max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 9), st.text(min_size=3, max_size=3), st.integers(0, 1 << 30)), max_size=60), st.sampled_from([0, 1 << 40]))
def test_places_in_order_whether_they_fit_one_number_or_not(rows, far):
    """Wide alphabets and long texts don't fit 63 bits; the order is the same."""
    code = lambda t: ord(t[0]) << 42 | ord(t[1]) << 21 | ord(t[2])
    want = sorted((b, code(t), at + far) for b, t, at in rows)
    bucket, gram, place = (np.array([r[k] for r in want][::-1], np.int64) for k in range(3))
    assert [*zip(*(c.tolist() for c in p.in_order([bucket], gram, [place])), strict=True)] == want


def test_removed_rows_are_cleaned_in_one_go_by_bits():
    """Lists keep what isn't removed; those that lose all go; blocks without removed rows stay as they are."""
    lists = {(7, 0): {0: [2, 4], 4095: [6]}, (7, 1): {5: [8]}, (9, 0): {4095: [10]}, (9, 2): {1: [0, 2]}}
    rows = []
    for (gram, block), docs in lists.items():
        places = [(gram, d, x) for d, own in docs.items() for x in own]
        rows += [(g, block, n, d, a) for g, n, d, a in p.Lists(*(np.array(c, np.int64) for c in zip(*places, strict=True))).each()]
    gone = np.zeros(4096, bool)
    gone[[4095, 17]] = True
    bits = {0: np.packbits(gone, bitorder="little").tobytes(), 1: bytes(512)}
    pdf = pd.DataFrame(rows, columns=["gram", "block", "n_docs", "docs", "places"])
    got = ti._without_gone(pdf.assign(gone=[bits.get(b) for b in pdf["block"]]))
    left = {}
    for gram, block, n, docs, places in got.itertuples(index=False):
        for d, x in zip(*(c.tolist() for c in p.decode(np.array([n]), docs, places)[1:]), strict=True):
            left.setdefault((gram, block), {}).setdefault(d, []).append(x)
    assert left == {(7, 0): {0: [2, 4]}, (7, 1): {5: [8]}, (9, 2): {1: [0, 2]}}
    assert len(ti._without_gone(pdf.assign(gone=None))) == 4 and ti._without_gone(pdf.iloc[2:3].assign(gone=[bits[0]])).empty


def test_cover_holds_every_character():
    for n in range(3, 20):
        held = {k + i for _, k in p.cover("x" * n) for i in range(3)}
        assert held == {*range(n)} and len(p.cover("x" * n)) == -(-n // 3)


@pytest.fixture(scope="module")
def rows(spark):
    texts = [
        row("a", "the parser is reliable", ts=5), row("b", "reliable reliable parser", ts=4), row("c", "ÉCOLE et parser", ts=3, status="pending"), row("d", "設定ファイル parser 50% done", ts=2, status="invalidated"),
        row("e", "something else", ts=1, subjects=["t"]), row("f", "parser in a turn", kind="feedstock", ts=9, summary="parser reliable"), row("g", "aaaa", ts=7, types=["intent"]), row("h", "old claim", status="superseded", ts=8),
        row("i", ""), row("j", None), row("k", "ab"), row("l", "pars", summary="er reliable"),
    ]
    return spark.createDataFrame(texts, ROWS).repartition(3).persist()


TERMS = [["parser"], ["reliable"], ["parser", "reliable"], ["école"], ["liable"], ["aaa"], ["設定ファ"], ["missing"], ["parser", "parser"]]


def scores(kept, terms):
    o = s.Options("knowledge", terms, "text", include_pending=True, include_retired=True)
    return {r.id: r.score for r in kept.text_branch(o, 50).collect()}


def test_scores_are_those_of_a_scan(spark, rows, tmp_path):
    kept = TextIndex(spark, str(tmp_path / "i"))
    kept.update(rows)
    for terms in TERMS:
        want = fts(rows, terms) if "parser" != terms[-1] or len(terms) == 1 else scores_of_scan(rows, terms)
        assert scores(kept, terms) == pytest.approx(want), terms
    assert kept.text_branch(s.Options("knowledge", ["é"], "text", include_pending=True), 9).count() == 0
    with pytest.raises(ValueError):
        kept.counts(["ab"])


def scores_of_scan(rows, terms):
    o = s.Options("knowledge", terms, "text", include_pending=True, include_retired=True)
    return {r.id: r.score for r in s.text_branch(rows, o, 50).collect()}


def test_updates_merge_and_leave_nothing(spark, rows, tmp_path, monkeypatch):
    """Changed, removed and added rows count as if the index were built anew, before and after a merge, small chunks or not."""
    monkeypatch.setattr(ti, "CHUNK_CHARS", 30)
    kept = TextIndex(spark, str(tmp_path / "i"))
    kept.update(rows.where("id < 'e'"))
    kept.update(rows.where("id >= 'e'"))
    changed = spark.createDataFrame([row("a", "nothing of the kind", ts=5), row("m", "a reliable parser parser", ts=6)], ROWS)
    kept.update(changed, rows.where("id in ('b', 'i', 'j')").select("id"))
    kept.update(None, spark.createDataFrame([("not there",), ("d",)], "id string"))
    now = rows.where("id not in ('a', 'b', 'd', 'i', 'j')").unionByName(changed).persist()
    for merged in (False, True):
        if merged:
            before = len(kept.state()["generations"])
            kept.merge()
            assert len(kept.state()["generations"]) == 2 < before
            assert kept.vacuum() and not kept.vacuum()
        assert kept.totals() == pytest.approx(now.selectExpr("count(*)", "avg(greatest(length(summary) - 2, 0) + greatest(coalesce(length(searchable), 0) - 2, 0))").first())
        assert sorted(r.id for r in kept.rows().collect()) == sorted(r.id for r in now.collect())
        for terms in TERMS:
            assert scores(kept, terms) == pytest.approx(scores_of_scan(now, terms)), terms
    o = s.Options("knowledge", ["reliable"], "text")
    results, summary = s.search(kept.rows(), None, o, kept)
    assert {r.id for r in results.collect()} == {"m", "l"} and summary.first()["total"] == 2


def test_many_updates_merge_by_themselves(spark, rows, tmp_path):
    kept = TextIndex(spark, str(tmp_path / "i"))
    for i in "abcdefgl":
        kept.update(rows.where(f"id = '{i}'"))
    assert len(kept.state()["generations"]) <= ti.MOST_GENERATIONS and kept.totals()[0] == 8
    assert {*scores(kept, ["parser"])} == {"a", "b", "c", "d"}


def test_only_touched_lists_are_read(spark, rows, tmp_path):
    """A search reads folders of its grams alone and no text; an update of no row writes no list."""
    kept = TextIndex(spark, str(tmp_path / "i"))
    kept.update(rows)
    plan = kept.text_branch(s.Options("knowledge", ["parser"], "text"), 9)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "PushedFilters: [Or(EqualTo(gram" in plan
    reads = [x.split("ReadSchema: ")[1].split("\n")[0] for x in plan.splitlines() if "ReadSchema" in x]
    assert not any("searchable" in x or "summary" in x for x in reads)
    kept.update(rows.limit(0))
    assert len(kept.state()["generations"]) == 1


def test_stale_writers_are_refused(spark, rows, tmp_path, monkeypatch):
    one, two = (TextIndex(spark, str(tmp_path / "i")) for _ in range(2))
    one.update(rows.where("id = 'a'"))
    old = two.state()
    one.update(rows.where("id = 'b'"))
    monkeypatch.setattr(two, "state", lambda: old)
    with pytest.raises(RuntimeError):
        two.update(rows.where("id = 'c'"))
    assert one.totals()[0] == 2


def test_empty_index(spark, rows, tmp_path):
    kept = TextIndex(spark, str(tmp_path / "i"))
    with pytest.raises(FileNotFoundError):
        kept.rows()
    kept.update(rows.limit(0))
    assert kept.totals() == (0, 0.0)
