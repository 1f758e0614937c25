"""Intermediate tables of iterative plans, kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-itinera-")


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local one only in local mode without it."""
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    return _local_root()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, instead of when the driver's memory is next collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class TableStore:
    """Parquet tables of one run.

    A written table cuts the lineage, survives the loss of executors, is
    computed once (with its counters collected in the same job) and carries
    its real size, so later joins are planned on measured sizes.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/itinera/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, dict]:
        """Write ``df``, read it back, and return it with the observed counters."""
        observation = Observation() if counters else None
        if observation is not None:
            df = df.observe(observation, *[c.alias(k) for k, c in counters.items()])
        target = f"{self.path}/{name}"
        with _shuffles_removed(self.spark):
            df.write.mode("overwrite").parquet(target)
        table = self.spark.read.schema(df.schema).parquet(target)
        return table, (observation.get if observation is not None else {})

    def clear(self) -> None:
        """Delete all tables, once what was made of them is written elsewhere."""
        self._delete(self.path)

    def drop(self, name: str) -> None:
        """Delete a table that no later round reads."""
        self._delete(f"{self.path}/{name}")

    def _delete(self, place: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(place)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)
