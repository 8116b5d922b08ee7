import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import entry
from ledgerloom.llm import token_counts as tc
from ledgerloom.llm.shared import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
EMPTY = tc.Table(np.zeros(0, np.uint64), np.zeros(0, np.int64))
PIECES = [" ", "  ", "\n", "\r\n", "\t", " ", " ", "\x1c", "'", "''", "s", "S", "t", "re", "ve", "ll", "ly", "d", "m", "A", "é", "1", "22", "٣", ".", "<|endoftext|>", "<|", "日本", "🙂", "́", "\U0001e903", "͸"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokens():
    return tc.Tokens(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.text(max_size=20)), max_size=6))
def test_counts_equal_the_librarys(texts):
    own, tk = tc.worker_tokens(PATH), Tokenizer.from_file(PATH)
    assert own.counts(texts, EMPTY).tolist() == [len(tk.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pretokens_of_all_usual_code_points(library):
    """Boundaries around every code point are those of the library's own splitter."""
    points = [i for i in np.flatnonzero(tc.classes()[:-1] != tc.ODD).tolist() if not 0xD800 <= i < 0xE000]
    for lo in range(0, len(points), 2000):
        text = "".join(f"a{c}1{c}!{c}'s{c} {c}{c}a" for c in map(chr, points[lo : lo + 2000]))
        pre = tc.PreTokens([text])
        assert [*zip((pre.starts - 1).tolist(), (pre.ends - 1).tolist(), strict=True)] == [o for _, o in library.pre_tokenizer.pre_tokenize_str(text)]


def test_long_texts_are_cut_between_words(tokens, library):
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta's", "x1", "...", "<|endoftext|>", "Ω"]) for _ in range(200_000))
    parts, of, specials = tokens.parts([long, "short"])
    assert max(map(len, parts)) < tc.CHUNK_CHARS + 1000 and of[-1] == 1 and specials[0] == long.count("<|endoftext|>")
    assert tokens.counts([long], EMPTY).tolist() == [len(library.encode(long, add_special_tokens=False).ids)]


def test_table_holds_what_it_is_given():
    rng = np.random.default_rng(4)
    h, n = rng.integers(1, 1 << 63, 3000).astype(np.uint64), rng.integers(1, 255, 3000)
    full = tc.Table(h, n, slots=4096)
    assert full.probes > 3 and (full.get(h) == n).all() and not full.get(rng.integers(1, 1 << 63, 3000).astype(np.uint64)).any()


def test_cache_is_bounded(tokens, monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 100)
    words = [f" w{i}" for i in range(1000)]
    assert tokens.misses(words) == tokens.encode(words) and len(tokens.cache) <= 100
    assert tokens.misses(["y" * 600]) and "y" * 600 not in tokens.cache


def test_awkward_rows(docs, rows, library):
    """Nulls, empty and very long texts, repeated rows, null doc_ids and columns of clashing names; with and without a table."""
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    for known in (EMPTY, tc.learn_table(docs, PATH)):
        out = tc.count_tokens(docs, PATH, known)
        assert out.columns == [*docs.columns, "token_count"]
        got = out.select("doc_id", "token_count.*").collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_empty_and_nameless(empty, nameless):
    known = tc.learn_table(empty, PATH)
    assert tc.count_tokens(empty, PATH, known).count() == 0
    assert sorted(r.n for r in tc.count_tokens(nameless, PATH, known).selectExpr("token_count.n_tokens n").collect())[0] == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_get_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    texts = ["Some text, isn't it?", None, "", "  two  ", "<|endoftext|> é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        want = [len(own.encode(t or "")) for t in texts]
    else:
        want = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert not tc.Tokens(path).by_pretoken
    got = tc.count_tokens(df, path, tc.learn_table(df, path)).selectExpr("doc_id", "token_count.n_tokens n").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_few_files(spark, tmp_path):
    spark.range(100).selectExpr("id doc_id", "'a b' text").repartition(10).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert len(tc.few_files(docs, 3).inputFiles()) == 3 and tc.few_files(docs, 10) is docs


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = sorted((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in table(spark, sf, "documents").collect())
    out = entry.op11_token_counts(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    rows = out.collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want and all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
