import json

from pyspark.sql import functions as F

from ledgerloom.operators.turns import EVENT_SCHEMA
from ledgerloom.sources import logs
from ledgerloom.streaming.tail import LogTail
from ledgerloom.streaming.turns import assemble_stream
from test_turns import answer, user


def test_growing_log(spark, tmp_path):
    """A turn that is open at the end of one batch closes in a later one; an incomplete line waits."""
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    log = folder / "s.jsonl"
    spark.dataSource.register(LogTail)

    def run():
        raw = spark.readStream.format("log_tail").load(str(folder))
        lines = raw.select(F.lit("claude").alias("agent"), "path", F.col("offset").alias("line"), "raw", F.lit(True).alias("terminated"))
        q = assemble_stream(logs.decode_claude(lines)).writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(str(out / "rows")).where("error is null") if (out / "rows").exists() else None
        return sorted((r.turn_id, r.user_text, r.assistant_text) for r in rows.collect())

    log.write_text(json.dumps(user("one", 1)) + "\n" + json.dumps(answer("1")) + "\n" + json.dumps(user("two", 2)) + "\n" + '{"type": "assis')
    assert run() == [("u1", "one", "1")]
    log.write_text(json.dumps(user("one", 1)) + "\n" + json.dumps(answer("1")) + "\n" + json.dumps(user("two", 2)) + "\n" + json.dumps(answer("2")) + "\n" + json.dumps(user("three", 3)) + "\n")
    assert run() == [("u1", "one", "1"), ("u2", "two", "2")]
    assert EVENT_SCHEMA.startswith("agent")
