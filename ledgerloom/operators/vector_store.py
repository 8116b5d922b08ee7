"""Vectors of rows' texts, encoded in batches that are committed one by one.

A batch is a Parquet file that is named by a digest of its rows, their versions
and the model: the folder's files are the ledger. A task writes a batch when it is
encoded, at once; a run that fails leaves those before, and the next run, or the
task's next attempt, only encodes what no file has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from .sync import BATCH, Encoder, representative

VECTORS = "record_key string, id string, kind string, mtime_ns long, size long, model_id string, embedding array<float>"
_KEY = ["record_key", "mtime_ns", "size", "model_id"]


class VectorStore:
    """The vectors in a folder that the driver and all executors reach, through ``pyarrow.fs`` in tasks."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batches(self) -> str | None:
        found = sinks.read_pointer(self.spark, self.root)
        return found["batches"] if found else None

    def _all(self) -> DataFrame:
        name = self._batches()
        return self.spark.read.schema(VECTORS).parquet(f"{self.root}/{name}") if name else self.spark.createDataFrame([], VECTORS)

    @staticmethod
    def _wanted(rows: DataFrame, model: str) -> DataFrame:
        own = rows.withColumn("_text", representative()).where("coalesce(_text, '') <> ''").withColumn("model_id", F.lit(model))
        return own.select("record_key", "id", "kind", "mtime_ns", "size", "model_id", "_text")

    def vectors(self, rows: DataFrame, model: str) -> DataFrame:
        """The committed vectors of rows as they are now, by this model."""
        return self._all().join(self._wanted(rows, model).select(*_KEY), _KEY, "left_semi").dropDuplicates(_KEY)

    def run(self, rows: DataFrame, encoder: Encoder, model: str, batch: int = BATCH) -> DataFrame:
        """Encode what is new or changed, or of another model, and return ``vectors``. Rows without a text have none."""
        if self._batches() is None:
            name = "batches-1"
            self.spark.createDataFrame([], VECTORS).write.mode("overwrite").parquet(f"{self.root}/{name}")
            sinks.write_pointer(self.spark, self.root, {"version": 1, "batches": name})
        folder = f"{self.root}/{self._batches()}"
        todo = self._wanted(rows, model).join(self._all().select(*_KEY), _KEY, "left_anti")

        def encode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pyarrow as pa
            import pyarrow.parquet as pq
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
            schema = pa.schema([*((c, pa.string()) for c in ("record_key", "id", "kind")), ("mtime_ns", pa.int64()), ("size", pa.int64()), ("model_id", pa.string()), ("embedding", pa.list_(pa.float32()))])
            for pdf in it:
                for lo in range(0, len(pdf), batch):
                    part = pdf.iloc[lo : lo + batch]
                    name = hashlib.sha256("\0".join(f"{x}" for r in part[_KEY].itertuples(index=False) for x in r).encode()).hexdigest()
                    if system.get_file_info(f"{at}/{name}.parquet").type == fs.FileType.NotFound:
                        done = part.drop(columns="_text").assign(embedding=encoder(part["_text"].to_list()))
                        # Readers don't see names that begin with a dot; the other name comes with the whole file.
                        fresh = f"{at}/.{name}-{lo}.tmp"
                        with system.open_output_stream(fresh) as f:
                            pq.write_table(pa.Table.from_pandas(done, schema, preserve_index=False), f)
                        system.move(fresh, f"{at}/{name}.parquet")
                    yield pd.DataFrame({"batch": [name], "n": [len(part)]})

        # Sorted, so that an attempt after a lost task cuts the same batches.
        todo.repartition("record_key").sortWithinPartitions(*_KEY).mapInPandas(encode, "batch string, n long").agg(F.sum("n")).collect()
        return self.vectors(rows, model)

    def compact(self, rows: DataFrame, model: str) -> None:
        """Write the vectors in force as one table and delete the batches before; no run may be under way."""
        old = sinks.read_pointer(self.spark, self.root)
        name = f"batches-{old['version'] + 1}"
        self.vectors(rows, model).write.mode("overwrite").parquet(f"{self.root}/{name}")
        sinks.write_pointer(self.spark, self.root, {"version": old["version"] + 1, "batches": name}, old["version"])
        sinks.delete_folder(self.spark, f"{self.root}/{old['batches']}")
