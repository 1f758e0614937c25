"""Writers (A3, A4, A7-A10)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.operators.network import Network


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, found {df.columns}")


def _write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_flat(results: DataFrame, path: str) -> None:
    """A3: sentenceID, Departure, Destination."""
    _require(results, ["sentenceID", "Departure", "Destination"])
    _write_csv(results.select("sentenceID", "Departure", "Destination"), path)


def route_text(route) -> F.Column:
    """Route as comma-separated text."""
    return F.array_join(route, ",")


def wide_routes(results: DataFrame, width: int | None = None) -> DataFrame:
    """A4: one column per stop, left-aligned and padded with '' (P15).

    ``width`` is the longest route; without it one aggregate finds it.
    """
    _require(results, ["sentenceID", "route"])
    if width is None:
        width = results.agg(F.max(F.size("route"))).first()[0]
        if width is None:
            raise ValueError("no routes to write")
    width = max(width, 2)
    names = ["Departure", *[f"Step{i}" for i in range(1, width - 1)], "Destination"]
    return results.select("sentenceID", *[
        F.coalesce(F.get("route", i), F.lit("")).alias(n) for i, n in enumerate(names)])


def write_routes(results: DataFrame, path: str) -> None:
    """A4 sink."""
    _write_csv(wide_routes(results), path)


def write_sorted(df: DataFrame, order: Sequence, path: str) -> None:
    """table sorted by a range partition per file."""
    _write_csv(df.orderBy(*order), path)


def write_gazetteer_json(names: DataFrame, aliases: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """One JSON document with sorted names and the alias map.

    The format is a single document, so it is refused above ``limit`` rows;
    ``write_gazetteer_rows`` has no such bound.
    """
    for table in (names, aliases):
        if table.limit(limit + 1).count() > limit:
            raise ValueError(f"more than {limit} rows: use write_gazetteer_rows")
    lists = names.groupBy().agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "city", F.col("name")))).alias("cities"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "station", F.col("name")))).alias("stations"))
    grouped = aliases.groupBy("canonical_norm").agg(F.collect_list("alias").alias("a"))
    mapping = grouped.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("canonical_norm", "a"))))
    lists.withColumn("aliases", mapping.scalar()).write.mode("overwrite").json(path)


def write_gazetteer_rows(names: DataFrame, aliases: DataFrame, path: str) -> None:
    """A7 without a size bound: sorted names and alias rows as JSON lines."""
    names.orderBy("kind", "name").write.mode("overwrite").json(f"{path}/names")
    aliases.orderBy("canonical_norm", "alias").write.mode("overwrite").json(f"{path}/aliases")


def write_token_examples(examples: DataFrame, path: str) -> None:
    """Token examples as JSON lines."""
    _require(examples, ["tokens", "labels"])
    examples.write.mode("overwrite").json(path)


def evaluation_report(summary: DataFrame, slices: DataFrame, robustness: DataFrame, model: str,
                      dataset: str, info: dict | None = None) -> DataFrame:
    """One row with metadata, metrics, slice list and robustness map."""
    row = F.struct("slice_kind", "slice", "total", "correct", "accuracy")
    listed = slices.groupBy().agg(F.sort_array(F.collect_list(row))).scalar()
    scores = robustness.groupBy().agg(F.map_from_entries(F.sort_array(
        F.collect_list(F.struct("slice", "accuracy"))))).scalar()
    extra = F.create_map(*[F.lit(x) for kv in (info or {}).items() for x in kv]) if info \
        else F.create_map().cast("map<string,string>")
    meta = F.struct(F.lit(model).alias("model_name"), F.lit(dataset).alias("dataset_name"),
                    F.current_timestamp().alias("timestamp"), extra.alias("additional_info"))
    metrics = F.struct(*summary.columns)
    return summary.select(meta.alias("metadata"), metrics.alias("metrics"), listed.alias("slices"),
                          scores.alias("robustness"))


def write_report(report: DataFrame, path: str) -> None:
    """Report as JSON."""
    report.write.mode("overwrite").json(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """Error rows as CSV."""
    _write_csv(errors, path)


def save_network(network: Network, path: str) -> None:
    """A10: snapshot folder with nodes, edges and alias; a marker file completes it."""
    for name, table in network._asdict().items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    network.nodes.sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/complete")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_network(spark: SparkSession, path: str) -> Network:
    """A10: load a snapshot."""
    if not _exists(spark, f"{path}/complete/_SUCCESS"):
        raise FileNotFoundError(f"no complete network snapshot in {path}")
    return Network(*[spark.read.parquet(f"{path}/{name}") for name in Network._fields])


def get_or_build_network(spark: SparkSession, path: str, build: Callable[[], Network],
                         force_rebuild: bool = False) -> Network:
    """A10: load the snapshot, or build and save it."""
    if force_rebuild or not _exists(spark, f"{path}/complete/_SUCCESS"):
        save_network(build(), path)
    return load_network(spark, path)
