import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from ledgerloom.llm import centroids as ce
from ledgerloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, x string, norm int, code string"


def floors(v, scale):
    return None if v is None or any(a is None or not math.isfinite(a) for a in v) else [math.floor(scale * float(np.float32(a))) for a in v]


def gap(a, b):
    return sum((p - q) ** 2 for p, q in zip(a, b, strict=True))


def mean(rows):
    return [sum(c) // len(rows) for c in zip(*rows, strict=True)]


def plain_clusters(rows, k=16, rounds=3, scale=64):
    kept = [(i, x) for i, v in rows if (x := floors(v, scale)) is not None and len(x) == 64]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    at = [x for _, x in first]
    assign = lambda: [min(range(len(at)), key=lambda c: (gap(x, at[c]), c)) for _, x in kept]
    for _ in range(rounds):
        own = assign()
        at = [mean(m) if (m := [x for (_, x), c in zip(kept, own, strict=True) if c == n]) else a for n, a in enumerate(at)]
    own = assign()
    d = [gap(x, at[c]) for (_, x), c in zip(kept, own, strict=True)]
    return [(i, c, g, sum(h for h, e in zip(d, own, strict=True) if e == c), sum(d), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for (i, _), c, g in zip(kept, own, d, strict=True)]


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, x, label) for i, v, label in rows if (x := floors(v, scale)) is not None]
    n = len(kept[0][1]) // parts
    cut = lambda x: [x[p * n : p * n + n] for p in range(parts)]
    first = [cut(x) for _, x in sorted((i, x) for i, x, _ in kept if i is not None)[:entries]]
    books = [[f[p] for f in first] for p in range(parts)]
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (gap(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [(cut(x)[p], near(p, cut(x)[p])) for _, x, _ in kept]
            books[p] = [mean(m) if (m := [x for x, e in own if e == k]) else b for k, b in enumerate(books[p])]
    told = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], {}
    for i, x, label in kept:
        own = [near(p, c) for p, c in enumerate(cut(x))]
        error = sum(gap(c, books[p][e]) for p, (c, e) in enumerate(zip(cut(x), own, strict=True)))
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in own), error, label))
    return [(i, code, error, total[label], told) for i, code, error, label in out]


def vectors(n, seed=3, size=64):
    """Clustered vectors with ties, repeated rows and ids, null ids and labels, and such that are dropped."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.3) for _ in range(size)] for _ in range(5)]
    rows = [(i * 3, [float(np.float32(m + rng.gauss(0, 0.05))) for m in middles[i % 5]], rng.choice([0, 1, None])) for i in range(n)]
    rows += [rows[-1], rows[-1], (3, rows[n // 2][1], 7), (None, rows[n // 3][1], None), (None, [0.0] * size, 1), ((1 << 60) + 1, [-0.001] * size, None), (900, [40.0, -900.5] * (size // 2), 1)]
    rows += [(901, [0.015625] * size, 2), (902, [-0.0] * size, 2)]
    bad = [(903, None, 1), (904, [None] + [0.1] * (size - 1), 1), (905, [float("nan")] * size, 1), (906, [float("inf")] + [0.0] * (size - 1), None)]
    return rows + bad


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 1, "clash") for i, v, label in rows], SCHEMA).repartition(3)


key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("n", [1, 9, 90])
def test_clusters_equal_plain_ones(spark, n):
    rows = [*vectors(n), (907, [0.5] * 63, 1), (908, [], 1)]
    out, at = ce.cluster(frame(spark, rows))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(plain_clusters([r[:2] for r in rows]), key=key)
    assert len(at) == min(16, sum(floors(v, 64) is not None and len(v) == 64 and i is not None for i, v, _ in rows))


def test_planes_are_exact():
    rng = np.random.default_rng(1)
    for top in (1, 3, 100, ce.MOST):
        x, y = rng.integers(-top, top, (50, 64)), rng.integers(-top, top, (7, 64))
        planes, weights = ce.planes_of(x)
        assert (ce.components_of(planes, weights) == x).all()
        assert (ce.dot_products(planes, weights, *ce.planes_of(y)) == x @ y.T).all()
    assert (ce.components_of(*ce.planes_of(np.zeros((2, 64), np.int64))) == 0).all()


@pytest.mark.parametrize("n", [1, 300])
def test_codes_equal_plain_ones(spark, n):
    rows = vectors(n, size=16)
    out, books = vc.compress(frame(spark, rows))
    assert sorted(map(tuple, out.drop("label").collect()), key=key) == sorted(plain_codes(rows), key=key)
    assert books.shape[2] == 4


def test_cells_keep_what_may_be_nearest(monkeypatch):
    """Cells of any side, forgotten or remembered, give the nearest entries, ties to the lower index."""
    rng = np.random.default_rng(2)
    entries = rng.integers(-40, 40, (64, 4))
    entries[10] = entries[40]
    x = np.concatenate([rng.integers(-50, 50, (800, 4)), entries, (entries[3:4] + entries[4:5]) // 2])
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    for side in (1, 8, 64, 4096):
        for cells in (0, 3, 20_000):
            monkeypatch.setattr(vc, "CELLS", cells)
            book = vc.Codebook(entries, side)
            for _ in range(2):
                best, least = book.nearest(x)
                assert (best == d.argmin(1)).all() and (least == d.min(1)).all()
            assert len(book.kept) <= cells
    book = vc.Codebook(entries, 8)
    book.nearest(x)
    assert book.evaluated < len(x) * 20  # of 64 entries each
    seen = book.bounded
    book.nearest(x[:100])
    assert book.bounded == seen  # all from memory


def test_other_lengths(spark):
    rows = [(1, [0.1] * 8, 0), (2, [0.2] * 8, 0), (3, [0.3] * 4, 0), (4, [], 0)]
    assert {r.vec_id for r in vc.compress(frame(spark, rows))[0].collect()} == {1, 2}
    assert vc.compress(frame(spark, [(1, [0.1] * 7, 0)]))[0].count() == 0
    got = vc.compress(frame(spark, [(1, [], 0), (2, [], None)]))[0].collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(1, "00000000", 0), (2, "00000000", 0)]


def test_empty_and_nameless(spark):
    for rows in ([], [(1, None, 1)], [(None, [0.5] * 64, 1)]):
        df = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
        assert ce.cluster(df)[0].count() == 0 and vc.compress(df)[0].count() == 0
        assert vc.compress(df)[0].columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_many_labels_are_joined(spark):
    """Beyond the bound the same sums come by a shuffled join."""
    coded = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5, "00", i) for i in range(60)], "vec_id long, label int, code string, error long")
    one, two = (sorted(map(tuple, vc.with_label_errors(coded, most).collect()), key=key) for most in (0, 100))
    assert one == two and len(one) == 60


def test_too_wide_components_are_refused(spark):
    for f, size in ((ce.cluster, 64), (vc.compress, 4)):
        with pytest.raises(PySparkException, match="beyond"):
            f(frame(spark, [(1, [1e30] * size, 0), (2, [0.0] * size, 0)]))[0].collect()
