from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.jaccard_join import near_duplicates
from ledgerloom.llm.line_dedup import dedup_lines
from ledgerloom.llm.substring_dedup import FingerprintIndex, dedup_substrings


def pairs(rows):
    return [r[:2] for r in rows]


def test_exact(docs, rows):
    got = Counter(tuple(r) for r in exact_dedup(docs, digest_all=True).collect())
    assert got == brute.exact(pairs(rows))


def test_exact_digests_only_survivors(spark):
    df = spark.createDataFrame([(1, "alone"), (2, "twice"), (3, "twice"), (4, "other")], "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup(df).collect()}
    assert got[2].sha256 == got[3].sha256 and got[2].sha256 and got[1].sha256 is got[4].sha256 is None
    assert got[3].keep_id == 2 and not got[3].kept and got[1].kept


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_exact_reads_survivors_alone(spark, docs, rows, most):
    """Few or many surviving groups give the same rows; digests are there for copies only."""
    got = Counter(tuple(r) for r in exact_dedup(docs, broadcast_groups=most).collect())
    want = Counter()
    for k, n in brute.exact(pairs(rows)).items():
        want[k if k[2] > 1 else (*k[:4], None)] += n
    assert got == want


def test_exact_is_native(docs):
    for all_of_them in (True, False):
        plan = exact_dedup(docs, digest_all=all_of_them)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_exact_same_prefix_and_length(spark):
    a, b = "p" * 300 + "a", "p" * 300 + "b"
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_lines(docs, rows):
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "line_dedup"]
    got = Counter((r.doc_id, *r.line_dedup) for r in out.collect())
    assert got == brute.line_dedup(pairs(rows))


def test_lines_threshold(spark):
    line = "x" * 40
    df = spark.createDataFrame([(i, line) for i in range(4)], "doc_id long, text string")
    assert all(r.line_dedup.n_dropped == 0 for r in dedup_lines(df).collect())
    df = spark.createDataFrame([(i, f" {line.upper() if i % 2 else line}\r\n{line}") for i in range(5)], "doc_id long, text string")
    assert {r.doc_id: r.line_dedup.n_dropped for r in dedup_lines(df).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 0}


def test_substrings(docs, rows):
    out = dedup_substrings(docs)
    assert out.columns == [*docs.columns, "substring_dedup"]
    got = Counter((r.doc_id, *r.substring_dedup) for r in out.collect())
    want = brute.substrings(pairs(rows))
    assert {k[0] for k in got} == {k[0] for k in want} and got == want


def test_substrings_incrementally(spark, rows, monkeypatch):
    """Batch by batch, with compaction into more buckets and an index opened anew each time, gives what one run gives; history texts are only read where one document alone held a fingerprint."""
    from ledgerloom.llm import substring_dedup as sd

    monkeypatch.setattr(sd, "BUCKET_ROWS", 20)
    monkeypatch.setattr(sd, "LEAST_BUCKETS", 4)
    some = [r for r in pairs(rows) if r[0] is not None][:80]
    some = sorted({i: (i, t) for i, t in some}.values())
    index = FingerprintIndex(spark, fanout=2)
    got, before, seen = Counter(), None, set()
    for at in range(0, len(some), 16):
        batch = spark.createDataFrame(some[at : at + 16], "doc_id long, text string")
        out = dedup_substrings(batch, batches=1, index=index, history=before)
        got += Counter((r.doc_id, *r.substring_dedup) for r in out.collect())
        before = batch if before is None else before.unionByName(batch)
        for kind in ("fingerprints", "windows"):
            levels = [r.level for r in index.runs if r.kind == kind]
            assert max(levels.count(n) for n in levels) < 2
        seen |= {r.level for r in index.runs}
        index = FingerprintIndex.open(spark.newSession(), index.folder, fanout=2)
        index.spark = spark
    assert got == brute.substrings(some)
    assert index.batch == 5 and max(seen) == 2 and len({r.buckets for r in index.runs}) > 1


def test_substrings_without_filter(docs, rows):
    """Too many suspects for a filter, and other numbers of batches: the same rows."""
    got = Counter((r.doc_id, *r.substring_dedup) for r in dedup_substrings(docs, most_bits=0, batches=3).collect())
    assert got == brute.substrings(pairs(rows))


def test_sorted_values_are_packed():
    import numpy as np

    from ledgerloom.llm.shared import pack_sorted, unpack_sorted

    for a in (np.zeros(0, np.uint64), np.array([0, 0, 1, 2**64 - 1], np.uint64), np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))):
        assert (unpack_sorted(pack_sorted(a)) == a).all()


def test_substrings_of_one_id_with_two_texts(spark):
    """Each row loses the places of its own text, also where the other text is too short for them."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    own = [(1, a), (2, f"{b} {a}"), (2, c), (2, "one two three"), (2, f"{c} {b}"), (3, f"tail {c}"), (3, f"{b} tail"), (3, f"{b} tail")]
    want = brute.substrings(own)
    for parts in (1, 4):
        got = Counter((r.doc_id, *r.substring_dedup) for r in dedup_substrings(spark.createDataFrame(own, "doc_id long, text string").repartition(parts)).collect())
        assert got == want


def test_near(docs, rows):
    got = Counter(tuple(r) for r in near_duplicates(docs).collect())
    assert got == brute.near(pairs(rows))


def test_near_chain_of_many(spark):
    """A group in which many members only link through others, with one hub round."""
    w = [f"w{i}" for i in range(160)]
    docs = [(i, " ".join(w[3 * i : 3 * i + 60])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter(tuple(r) for r in near_duplicates(df, hubs_per_round=(1,)).collect())
    assert got == brute.near(docs) and len({k[2] for k in got}) < 30


@pytest.mark.parametrize("f", [exact_dedup, dedup_lines, dedup_substrings, near_duplicates])
def test_empty_and_nameless(f, empty, nameless):
    assert f(empty).count() == 0
    assert f(nameless).count() == 2


def test_nameless_rows(nameless):
    assert {r.doc_id for r in near_duplicates(nameless).collect()} == {None}
    assert all(r.kept for r in exact_dedup(nameless).collect())
    assert all(r.substring_dedup.n_removed == 0 for r in dedup_substrings(nameless).collect())
    assert nameless.select(F.lit(1)).count() == 2


def test_lines_in_all_ways(docs, rows, monkeypatch):
    """Many ranges and tasks, a filter or a join of suspects, keys sent or joined: the same rows."""
    from ledgerloom.llm import line_dedup as ld

    monkeypatch.setattr(ld, "TASK_KEYS", 3)
    want = brute.line_dedup(pairs(rows))
    for bits, keys in ((0, 0), (0, 100), (1 << 30, 0)):
        got = Counter((r.doc_id, *r.line_dedup) for r in dedup_lines(docs.repartition(40), most_bits=bits, broadcast_keys=keys).collect())
        assert got == want


def test_large_ids_beside_null(spark):
    """Identifiers beyond 2**53 stay exact where others are null."""
    big, line = 2**60 + 1, "y" * 50
    df = spark.createDataFrame([*((big + i, f"{line}\none two three four five six {i}") for i in range(5)), (None, line)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.line_dedup.n_dropped for r in dedup_lines(df).collect()} == {**{big + i: 1 for i in range(4)}, big + 4: 0, None: 1}
    assert {r.doc_id for r in near_duplicates(df).collect()} == {None, *(big + i for i in range(5))}


def test_near_in_all_ways(docs, rows):
    """Frequent shingles dealt out, no filter of nodes, pairs shuffled, few cells and many fragments: the same rows."""
    want = brute.near(pairs(rows))
    for how in ({"hot_count": 2, "broadcast_pairs": 0}, {"hot_count": 1, "most_bits": 0, "fragments": 16, "hubs_per_round": ()}):
        assert Counter(tuple(r) for r in near_duplicates(docs, **how).collect()) == want


def test_near_partial_overlaps(spark):
    """Overlaps of each fragment are those of the sets cut by hand, and sum up to the sets' overlap."""
    import numpy as np

    from ledgerloom.llm import jaccard_join as jj

    texts = [" ".join(f"w{i % 97}" for i in range(a, a + 80)) for a in (0, 5, 9)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    sketch = np.zeros(jj.PIECE, np.uint32)
    h, first = jj.shingle_sets(texts)
    np.add.at(sketch, (h >> np.uint64(50)).astype(np.int64), 1)
    assert (jj.whole_sketch(jj.measure(df.repartition(3), jj.PIECE, 5).where("kind = 1"), jj.PIECE) == sketch).all()
    order = jj.Order(sketch, 3)
    names, sets = jj._names(*jj.node_of(h, first)), [h[a:b] for a, b in zip(first, first[1:])]
    pairs_ = [(names[a], names[b], len(sets[a]), len(sets[b])) for a in range(3) for b in range(a)]
    rows = jj.fragment_rows(df, None, spark.sparkContext.broadcast(order), 3, 5)
    got = {(bytes(r.a), bytes(r.b), r.fragment): r.overlap for r in jj.partial_overlaps(spark.createDataFrame(pairs_, "a binary, b binary, a_size long, b_size long"), rows, 75).collect()}
    want = {}
    for a in range(3):
        for b in range(a):
            both = np.intersect1d(sets[a], sets[b])
            if 175 * len(both) >= 75 * (len(sets[a]) + len(sets[b])):
                for f in range(3):
                    want[names[a], names[b], f] = int((order.fragment(both) == f).sum())
    assert want and {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}
    links = jj.linked(spark.createDataFrame(pairs_, "a binary, b binary, a_size long, b_size long"), rows, 75)
    whole = {k[:2]: sum(n for j, n in want.items() if j[:2] == k[:2]) for k in want}
    assert {(bytes(r.a), bytes(r.b)) for r in links.collect()} == {(a, b) for a, b, x, y in pairs_ if 175 * whole.get((a, b), 0) >= 75 * (x + y)} != set()


def test_prefixes_of_several_chunks_share_rows(spark):
    """A bucket's row holds what a task has for it, not what one chunk of texts has: three chunks are no more rows than there are buckets."""
    import numpy as np

    from ledgerloom.llm import jaccard_join as jj
    from ledgerloom.llm.shared import CHUNK_CHARS

    texts = [" ".join(f"w{i * 7919 % 99991}x{d}" for i in range(a, a + 30_000)) for d, a in enumerate((0, 5, 9))]
    assert all(len(t) > CHUNK_CHARS / 2 for t in texts)
    sketch = np.zeros(jj.PIECE, np.uint32)
    h, first = jj.shingle_sets(texts)
    np.add.at(sketch, (h >> np.uint64(50)).astype(np.int64), 1)
    order = spark.sparkContext.broadcast(jj.Order(sketch, 4))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = [jj.unpack_sorted(bytes(r.tokens)) for r in jj.prefix_rows(df, order, 64, 5, 75).collect()]
    assert len(got) == 64 and sum(map(len, got)) >= len(h) // 4


@pytest.mark.parametrize("kind", ["uint32", "uint64"])
def test_planes(kind):
    import numpy as np

    from ledgerloom.llm.shared import pack_planes, unpack_planes

    for n in (0, 1, 1000):
        a = np.random.default_rng(n).integers(0, 2**30, n).astype(kind)
        assert (unpack_planes(pack_planes(a), kind) == a).all()
