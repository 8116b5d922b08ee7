"""Sinks: partitioned tables, snapshots that are published at once, Markdown and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current.json"


def write_feedstocks(rows: DataFrame, path: str) -> None:
    """Parquet by agent, year and month; rows meet by partition first, so that each has few files."""
    out = rows.withColumn("year", F.date_format("timestamp", "yyyy")).withColumn("month", F.date_format("timestamp", "MM"))
    out.repartition("agent", "year", "month", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("agent", "year", "month").parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_pointer(spark: SparkSession, root: str, content: dict, expected: int | None = None) -> None:
    """Put ``content``, which has a version, in the place of the folder's pointer, at once. With ``expected``, that version must still be the current one."""
    if expected is not None and current_version(spark, root) != expected:
        raise RuntimeError(f"snapshot {expected} is no longer current")
    jvm, fs, target = _fs(spark, f"{root}/{POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{root}/.{content['version']}.{POINTER}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    options = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options.rename(fresh, target, overwrite)


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    """What the folder's pointer holds; None if there is none."""
    _, fs, p = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(p):
        return None
    return json.loads(spark.read.text(f"{root}/{POINTER}", wholetext=True).first()["value"])


def delete_folder(spark: SparkSession, path: str) -> None:
    _, fs, p = _fs(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders right below ``root``."""
    _, fs, p = _fs(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]


def publish(rows: DataFrame, root: str, version: int, expected: int | None = None) -> None:
    """Write a snapshot beside the others, then move a pointer to it: readers see the old or the new one, never a part.

    With ``expected``, the snapshot that the change was made from must still be
    the current one. A run that dies before the pointer moves leaves the old
    snapshot in force and is simply run again.
    """
    spark = rows.sparkSession
    if expected is not None and current_version(spark, root) != expected:
        raise RuntimeError(f"snapshot {expected} is no longer current")
    rows.write.mode("overwrite").parquet(f"{root}/v={version}")
    write_pointer(spark, root, {"version": version}, expected)


def current_version(spark: SparkSession, root: str) -> int | None:
    found = read_pointer(spark, root)
    return found["version"] if found else None


def read_current(spark: SparkSession, root: str) -> DataFrame:
    v = current_version(spark, root)
    if v is None:
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{root}/v={v}")


def result_json(columns: list[str]):
    """A row as JSON with <, > and & escaped, as HTML wants it."""
    out = F.to_json(F.struct(*columns))
    for c in "<>&":
        out = F.replace(out, F.lit(c), F.lit(f"\\u00{ord(c):02x}"))
    return out


def write_results(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(result_json(columns).alias("value")).write.mode("overwrite").text(path)
