import sys
import tempfile
import zlib
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402

from ledgerloom.llm import language_id as li  # noqa: E402
from ledgerloom.llm import packing as pk  # noqa: E402
from ledgerloom.llm.entry import tokenizer_path  # noqa: E402
from test_packing_warc import check_packing  # noqa: E402
from test_search_scan import brute_profile  # noqa: E402

SF = brute.SF


def brute_languages(rows, missing):
    """Documents that the first stage keeps: profiles of three quarters, the least score of the fourth."""
    fold = lambda r: missing if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4
    known = [r for r in rows if r.text is not None and r.lang is not None]
    by_lang = {lang: brute_profile([r.text for r in known if r.lang == lang and fold(r) != 2])[:300] for lang in sorted({r.lang for r in known})}
    d, some = li.distances([r.text for r in rows], by_lang)
    best = {id(r): ([*by_lang][x.argmin()], 1 - x.min()) for r, x, s in zip(rows, d, some, strict=True) if s}
    own = sorted(best[id(r)][1] for r in known if fold(r) == 2 and id(r) in best and best[id(r)][0] == r.lang)
    least = np.floor(own[int(np.ceil(0.001 * len(own))) - 1] * 100) / 100 if own else 0
    return [r.doc_id for r in rows if id(r) in best and best[id(r)][1] >= least]


def test_run_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = set(brute_languages(table.collect(), 0))
    rows = [(r.doc_id, r.text) for r in table.collect() if r.doc_id in kept]
    rows = [(i, text) for i, text, _, _ in brute.line_dedup(rows)]
    least = {i: c for i, _, c in brute.near(rows)}
    rows = [(i, t) for i, t in rows if least[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, _, n, _ in brute.contamination(rows, items) if n}
    rows = [r for r in rows if r[0] not in hit]
    out = cp.run(spark, SF).collect()
    assert hit and check_packing(out, rows, pk.CAPACITY) <= pk.lower_bound(np.array([r.length for r in out]), pk.CAPACITY) + 1


@pytest.mark.parametrize("name,f", cp.STAGES)
def test_stages_take_anything(spark, docs, empty, nameless, name, f):
    for d in (docs, empty, nameless):
        out = f(spark, d, SF)
        assert name == "packing" or out.columns == d.columns
        n = out.count()
        assert n <= d.count() or name == "packing"


def test_stage_decisions(spark, docs):
    kept = {r.doc_id for r in cp.identify_language(spark, docs, SF).collect()}
    assert 2000 not in kept  # null text
    dropped = cp.drop_near_duplicates(spark, docs.where("doc_id < 2000"), SF)
    assert dropped.where(F.length("text") > 0).groupBy("text").count().where("count > 1").count() <= 1  # rows that repeat a doc_id
    assert tokenizer_path().endswith(".json")


def test_language_stage_rejects_other_languages(spark):
    """Letters that no named language writes go; those without a language get one."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"))
    odd = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(("\u0416\u0443\u043a \u0441\u0438\u0434\u0438\u0442 \u043d\u0430 \u0432\u0435\u0442\u043a\u0435", "qxzq wqzx jqxz " * 9, "", None, "12 !!"))], table.schema)
    out = cp.identify_language(spark, table.unionByName(odd), SF)
    rows = {r.doc_id: r.lang for r in out.collect()}
    assert not {*rows} & {10**6 + i for i in range(5)} and None not in rows.values() and len(rows) >= 0.99 * table.count()
    assert {*rows} == {*brute_languages(table.unionByName(odd).collect(), 0)}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert np.mean([truth[i] == rows[i] for i in rows if i % 9 == 0]) > 0.95


def test_stages_against_brute_force(spark, docs, rows):
    """Rows and contents of the filtering stages on awkward rows."""
    own = [r[:2] for r in rows]
    out = {(r.doc_id, r.text, r.n_chars) for r in cp.dedup_lines(spark, docs, SF).collect()}
    assert out == {(i, t, len(t)) for i, t, _, _ in brute.line_dedup(own)}
    least = {}
    for i, _, c in brute.near(own):
        least.setdefault(i, set()).add(c)
    kept = Counter(r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect())
    assert kept == Counter(i for i, _ in own if least[i] == {i})
    items = spark.createDataFrame([(1, " ".join(brute.words(own[1][1])[:9])), (2, None)], "item_id long, text string")
    folder = tempfile.mkdtemp(prefix="spark-")
    items.write.parquet(f"{folder}/benchmark.parquet")
    hit = {i for i, _, n, _ in brute.contamination(own, [(1, " ".join(brute.words(own[1][1])[:9]))]) if n}
    assert hit and Counter(r.doc_id for r in cp.decontaminate_benchmark(spark, docs, folder).collect()) == Counter(i for i, _ in own if i not in hit)


def test_many_keys_are_joined(spark, docs, monkeypatch):
    keyed = cp._keyed(docs)
    gone = docs.where("doc_id < 500").select("doc_id")
    few = Counter(r.doc_id for r in cp._without(keyed, gone).collect())
    monkeypatch.setattr(cp, "BROADCAST_KEYS", 0)
    assert Counter(r.doc_id for r in cp._without(keyed, gone).collect()) == few and min(i for i in few if i is not None) >= 500


def test_scratch_deletes_what_was_staged(spark, docs):
    from ledgerloom.llm import shared

    with shared.scratch(spark) as kept:
        path = shared.new_path(spark, "a")
        docs.select("doc_id").write.parquet(path)
        kept.append(path)
        other = shared.stage(docs.select("doc_id"), "b").inputFiles()[0].removeprefix("file://")
        assert Path(other).exists()
    assert spark.read.parquet(path).count() == docs.count() and not Path(other).exists()


def test_clusters_need_a_shared_folder(monkeypatch):
    from ledgerloom.llm import shared

    class Fake:
        class sparkContext:  # noqa: N801
            applicationId, master = "none", "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Fake)
    Fake.conf.get = staticmethod(lambda name, default: "hdfs://x/y/")
    assert shared.shared_dir(Fake) == "hdfs://x/y/ledgerloom/none"


@pytest.mark.parametrize("stage", [cp.drop_near_duplicates, cp.decontaminate_benchmark])
def test_only_keys_stay_of_what_a_stage_compares(spark, docs, stage):
    from ledgerloom.llm import shared

    folder = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = {*folder.iterdir()} if folder.exists() else set()
    out = stage(spark, docs.where("doc_id < 300"), SF)
    left = {p.name.split("-")[0]: p for p in {*folder.iterdir()} - before}
    assert {*left} <= {"copies", "hit", "gone"} and out.count() > 0
