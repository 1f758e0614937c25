"""Session settings used by tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", name: str = "itinera") -> SparkSession:
    """A local session; on a cluster the caller brings their own session."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a table that has fewer splits than there are cores.

    Meant for small files read by dear expressions. A large input has more
    splits than cores and is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
