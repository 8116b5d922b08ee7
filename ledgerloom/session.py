"""Sessions and lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders by application, where none is configured (one machine).
_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where that is unset, one machine (``local[...]``, as in tests) gets a temporary folder; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return _OWN[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``shared_root``."""
    return f"{shared_root(spark)}/ledgerloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` without lineage, in the checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def get_session(name: str = "ledgerloom", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution. Unions don't claim a partitioning: in Spark 4.1.2 they may claim one that their parts don't share after adaptive changes, and rows of a key then don't meet. Filters reach Python sources."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.unionOutputPartitioning", "false").config("spark.sql.python.filterPushdown.enabled", "true")
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
