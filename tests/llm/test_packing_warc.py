import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing as pk
from ledgerloom.llm import warc
from ledgerloom.llm.entry import tokenizer_path


def check_packing(out, docs, capacity):
    tk = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in docs:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(docs, rows):
    out = pk.pack_documents(docs, tokenizer_path()).collect()
    n = check_packing(out, [r[:2] for r in rows], pk.CAPACITY)
    assert n <= pk.lower_bound(np.array([r.length for r in out]), pk.CAPACITY) + 1


def test_packing_in_parts(spark):
    """Small partitions with gaps exchange documents; few bins more than the bound are left."""
    rng = random.Random(5)
    docs = [(i, " ".join(["word"] * rng.choice([3, 10, 25, 33, 49, 51, 66]))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = pk.pack_documents(df, tokenizer_path(), capacity=100, partition_pieces=40).collect()
    n = check_packing(out, docs, 100)
    assert any(r.certified for r in out)
    at_once = pk.best_fit_decreasing(np.array([r.length for r in out]), 100).max() + 1
    assert n <= 1.03 * at_once + 1


def test_rounds_end_certified_or_without_gain(spark):
    """Pieces of all partitions but certified ones meet again; the last round's partitions are the only ones without certificate."""
    rng = np.random.default_rng(3)
    rows = [(i, 0, int(n)) for i, n in enumerate(rng.choice([13, 21, 34, 40, 55, 60, 71], 3000))]
    df = spark.createDataFrame(rows, "row long, piece int, length long")
    out = pk.pack_pieces(df, 100, partition_pieces=50, most_pieces=400).collect()
    assert sorted((r.row, r.piece) for r in out) == [(i, 0) for i, _, _ in rows]
    fill, rounds = {}, {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + rows[r.row][2]
        rounds.setdefault(r.sequence_id >> 56, set()).add(r.part_bins == r.part_bound)
    assert max(fill.values()) <= 100 and len(rounds) > 1
    # Before the last round, only full bins of uncertified partitions are left behind.
    for r in out:
        if r.sequence_id >> 56 < max(rounds):
            assert r.part_bins == r.part_bound or fill[r.sequence_id] == 100
    lengths = np.array([n for _, _, n in rows])
    assert len(fill) <= pk.best_fit_decreasing(lengths, 100).max() + 1 + len(rows) // 100
    assert pk.pack_pieces(df.limit(0)).count() == 0


def test_other_vocabularies(spark):
    """A vocabulary that neither lower-cases nor ends words gets whole texts."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens, tk = pk.WordTokens(path), Tokenizer.from_file(path)
    assert not tokens.by_word and pk.WordTokens(tokenizer_path()).by_word
    for s in ("Hello, World!  It's 12 o'clock.", " a\n\nB", "", "\u00e9t\u00e9"):
        assert np.frombuffer(tokens.ids(s), "<u4").tolist() == tk.encode(s, add_special_tokens=False).ids


def test_packing_edges(empty, nameless):
    assert pk.pack_documents(empty, tokenizer_path()).count() == 0
    out = pk.pack_documents(nameless, tokenizer_path()).collect()
    assert check_packing(out, [(None, "no name " * 20), (None, None)], pk.CAPACITY) == 1


def test_bound_and_best_fit():
    rng = np.random.default_rng(2)
    assert pk.lower_bound(np.array([51, 51, 51]), 100) == 3
    assert pk.lower_bound(np.array([34, 34, 34, 34, 34]), 100) == 3
    for _ in range(30):
        x = rng.integers(1, 101, rng.integers(1, 60))
        bins = pk.best_fit_decreasing(x, 100)
        fill = np.bincount(bins, x)
        assert fill.max() <= 100 and (fill > 0).all() and pk.lower_bound(x, 100) <= len(fill)
        order, naive = np.argsort(-x, kind="stable"), []
        for i in order:  # best fit, looked for in all bins
            fits = [b for b in range(len(naive)) if naive[b] + x[i] <= 100]
            if fits:
                naive[max(fits, key=lambda b: naive[b])] += x[i]
            else:
                naive.append(int(x[i]))
        assert sorted(naive) == sorted(fill.astype(int).tolist())


def test_tokens_like_the_tokenizer():
    tokens, tk, rng = pk.WordTokens(tokenizer_path(), cache_words=50), Tokenizer.from_file(tokenizer_path()), random.Random(1)
    parts = ["a", "B", "é", "Σ", "ς", "İ", "ß", "'s", "'", "!", ".", ",", "..", "1", "23", "\x85", " ", " ", "\x1c", "\n", "\t", "<|endoftext|>", "é", "中", "😀", "don't", "_", "<|", "word", "Words."]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert np.frombuffer(tokens.ids(s), "<u4").tolist() == tk.encode(s, add_special_tokens=False).ids


PAGES = "page_id long, url string, html string, digest string, first int, payload string"


def pages():
    big, other = "<p>" + "gleich" * 40, "ü" * 60
    rows = [(5, "http://a/ x\r\nY: z", big), (2, "http://b", big), (9, None, big), (2, "http://b", big), (3, "http://c", other), (4, "http://d", other), (6, "u", "small"), (7, "u", "small"), (8, "u", None), (10, "u", ""), (None, "n", big), (None, "n", "lonely" * 40), (11, "v", "x" * 300_000), (12, "w", "long " * 2_000_000)]
    return [(*r, "clash", 1, "clash") for r in rows]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(pages(), PAGES).repartition(3)
    index = warc.write_archives(df, archive_bytes=2000)
    out = warc.read_records(index, gap=10, most=1500).collect()
    first = {}
    for i, _, h, *_ in pages():
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h, *_ in pages():
        body = (h or "").encode()
        revisit = h in first and i != first[h]
        want.append((i or -1, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None, None if revisit else body))
    got = [(r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r.archive for r in index.collect()}) > 1


def test_warc_selection(spark):
    index = warc.write_archives(spark.createDataFrame(pages(), PAGES))
    assert warc.read_records(index).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    some = index.where("page_id in (3, 11)")
    assert {r.page_id for r in warc.read_records(some).collect()} == {3, 11}
    assert warc.write_archives(spark.createDataFrame([], PAGES)).count() == 0
    assert warc.read_records(index.limit(0)).count() == 0


def test_warc_is_readable_by_others(spark):
    """Whole archives decompress to records that begin with the version and end with two line breaks."""
    import gzip

    index = warc.write_archives(spark.createDataFrame(pages(), PAGES).coalesce(1))
    path = index.first()["archive"].removeprefix("file://")
    with gzip.open(path) as f:
        whole = f.read()
    assert whole.count(b"WARC/1.1\r\n") == len(pages()) and whole.endswith(b"\r\n\r\n")


def test_ranges():
    import pandas as pd

    rows = pd.DataFrame({"archive": ["a"] * 4 + ["b"], "offset": [0, 10, 100, 130, 0], "length": [10, 5, 20, 5, 7]})
    assert [(a, s, e, len(r)) for a, s, e, r in warc.ranges(rows, gap=20, most=60)] == [("a", 0, 15, 2), ("a", 100, 135, 2), ("b", 0, 7, 1)]
    assert [*warc.ranges(rows.head(0))] == []


@pytest.mark.parametrize("text", ["", "a" * 10])
def test_record_parses(text):
    raw = warc.record(1, "http://x", text.encode(), hashlib.sha256(text.encode()).hexdigest(), None, False)
    assert warc.parse(raw)["payload"] == text.encode() and warc.parse(raw)["page_id"] == 1


def test_words_that_are_met_again_stay():
    """Of more words than a worker keeps, those go that were not met since; the others are not made again."""
    made = []
    kept = pk._Kept(lambda w: made.append(w) or w.encode())
    for i in range(100):
        assert kept["often"] == b"often" and kept[f"once{i}"] == f"once{i}".encode()
        kept.shrink(10)
        assert len(kept) + len(kept.before) <= 22
    assert made.count("often") == 1
    kept.clear()
    assert not kept and not kept.before
