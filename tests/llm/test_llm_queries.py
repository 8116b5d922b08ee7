import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import brute  # noqa: E402
from compare import compare  # noqa: E402

from ledgerloom.llm import entry  # noqa: E402
from ledgerloom.llm.shared import crc_mod, table  # noqa: E402

SF = brute.SF


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, SF, entry.QUERIES[name], entry.SQL[name])


def test_quality_query(spark):
    out = entry.op1_quality(spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = out.collect()
    held = {r.doc_id for r in table(spark, SF, "documents").where(crc_mod("doc_id", 5) == 0).collect()}
    assert len(rows) == table(spark, SF, "documents").count() and {r.doc_id for r in rows if r.held_out} == held
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_secret_query(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in entry.op2_secrets(spark, SF).collect():
        want = brute.secrets(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for n, _, _ in want) for k in ("assign", "access", "hex"))
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and {*joined.split(",")} - {""} <= {*r.spans.split(",")}


def test_language_query(spark):
    rows = entry.op4_language_id(spark, SF).collect()
    langs = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(langs) and np.mean([langs[r.doc_id] == r.lang_pred for r in rows if r.held_out]) >= 0.95


def test_packing_query(spark):
    from ledgerloom.llm import packing as pk
    from test_packing_warc import check_packing

    out = entry.op8_packing(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert check_packing(out, docs, pk.CAPACITY) <= pk.lower_bound(np.array([r.length for r in out]), pk.CAPACITY) + 1
