"""Intermediate tables in the cluster's shared checkpoint folder.

Iterative plans must cut lineage. A written Parquet table survives the loss of an
executor, gives the next plan exact file sizes to choose join strategies from, and
is read column by column.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get(_CONF, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="rippletrace-")
    return _local_roots[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/rippletrace/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step",
                measure: Column | None = None) -> tuple[DataFrame, int]:
    """Write ``df`` once and return the table read back with its row count.

    ``measure`` replaces the row count by another aggregate taken during the write.
    """
    return _write(df, new_path(df.sparkSession, label), measure)


def _write(df: DataFrame, path: str, measure: Column | None) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    seen = Observation()
    metric = (F.count(F.lit(1)) if measure is None else measure).alias("metric")
    df.observe(seen, metric).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["metric"] or 0)


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    return materialize(df, label)[0]


def stored_by(df: DataFrame, label: str, column: str) -> DataFrame:
    """``stored`` with a folder per value of ``column``, so that a question for one value reads only its files."""
    path = new_path(df.sparkSession, label)
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The state of an iteration: each round is written, then the one before it is dropped.

    Only the newest round takes space. A round must be computed from the newest state and
    from tables stored elsewhere.
    """

    def __init__(self, label: str):
        self.label = label
        self.path: str | None = None

    def write(self, df: DataFrame, measure: Column | None = None) -> tuple[DataFrame, int]:
        """Like ``materialize``, and drops the round that this one replaces."""
        spark, before = df.sparkSession, self.path
        self.path = new_path(spark, self.label)
        out = _write(df, self.path, measure)
        if before:
            drop(spark, before)
        return out


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stored folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Drop every intermediate table of this application."""
    drop(spark, f"{scratch_root(spark)}/rippletrace/{spark.sparkContext.applicationId}")
