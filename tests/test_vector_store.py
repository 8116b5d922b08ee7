import pytest
from pyspark.errors import PySparkException

from ledgerloom.operators.vector_store import VectorStore

ROWS = "record_key string, id string, kind string, mtime_ns long, size long, summary string, claim string"


def rows(spark, n, start=0, mtime=1):
    return spark.createDataFrame([(f"k{i:03d}", f"i{i}", "knowledge" if i % 2 else "feedstock", mtime, i, f"summary {i}", f"claim {i}" if i % 10 else None) for i in range(start, n)], ROWS)


def with_text(n, start=0):
    return {f"k{i:03d}" for i in range(start, n) if i % 2 == 0 or i % 10}


@pytest.fixture
def encoder(tmp_path):
    """Encodes lengths, notes each text in a file, and fails from the given text on as long as a file stands in its way."""
    log, stop = str(tmp_path / "log"), str(tmp_path / "stop")

    def encode(texts):
        import os

        if os.path.exists(stop) and any(t in open(stop).read().split(",") for t in texts):
            raise RuntimeError("the model is gone")
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    return encode, tmp_path / "log", tmp_path / "stop"


def test_a_failed_run_goes_on_behind_its_commits(spark, tmp_path, encoder):
    """Batches before the failure stay; no text is encoded twice; a batch is seen whole or not at all."""
    encode, log, stop = encoder
    store, own = VectorStore(spark, str(tmp_path / "v")), rows(spark, 60)
    stop.write_text("summary 30")
    with pytest.raises(PySparkException, match="the model is gone"):
        store.run(own.coalesce(1), encode, "m1", batch=4)
    done = len(log.read_text().split("\n")) - 1
    assert done == store.vectors(own, "m1").count() > 0
    stop.unlink()
    got = {r.record_key: r.embedding for r in store.run(own, encode, "m1", batch=4).collect()}
    texts = log.read_text().split("\n")[:-1]
    assert {*got} == with_text(60) and len(texts) == len(got) == len({*texts})
    assert got["k007"] == [float(len("claim 7")), 1.0]
    store.run(own, encode, "m1", batch=4)
    assert len(log.read_text().split("\n")) - 1 == len(texts)


def test_changes_models_and_compaction(spark, tmp_path, encoder):
    encode, log, _ = encoder
    store = VectorStore(spark, str(tmp_path / "v"))
    store.run(rows(spark, 20), encode, "m1")
    first = len(log.read_text().split("\n"))
    changed = rows(spark, 10, 5, mtime=2).unionByName(rows(spark, 25, 10))
    got = store.run(changed, encode, "m1")
    assert {r.record_key for r in got.collect()} == with_text(25, 5) and {r.mtime_ns for r in got.where("record_key < 'k010'").collect()} == {2}
    assert len(log.read_text().split("\n")) - first == len(with_text(10, 5)) + len(with_text(25, 20))
    assert {r.model_id for r in store.run(changed, encode, "m2").collect()} == {"m2"}
    store.compact(changed, "m2")
    assert store._all().count() == len(with_text(25, 5)) == store.vectors(changed, "m2").count()
    assert store.run(rows(spark, 0).limit(0), encode, "m2").count() == 0
