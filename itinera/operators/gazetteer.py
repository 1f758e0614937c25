"""Place dictionary: build, aliases, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera import constants as K
from itinera.functions import text as T


def default_names(spark: SparkSession) -> DataFrame:
    """Default city and station names as (name, kind, seq)."""
    rows = [(n, "city") for n in K.MAJOR_CITIES] + [(n, "station") for n in K.MULTI_WORD_STATIONS]
    return spark.createDataFrame([(n, k, i) for i, (n, k) in enumerate(rows)],
                                 "name string, kind string, seq bigint")


def build_gazetteer(names: DataFrame) -> DataFrame:
    """(norm, canonical, kind, seq) with one row per key, the last name winning.

    ``names`` has (name, kind, seq); ``seq`` is the order in which names are added.
    """
    entries = (names.filter(F.coalesce("name", F.lit("")) != "")
               .select(T.matching_form("name").alias("norm"),
                       F.struct("seq", F.col("name").alias("canonical"), "kind").alias("entry")))
    first = F.min("entry.seq").alias("seq")
    return (entries.groupBy("norm").agg(F.max("entry").alias("entry"), first)
            .select("norm", "entry.canonical", "entry.kind", "seq"))


def names_from_stations(stations: DataFrame, start: int = 0) -> DataFrame:
    """City name, then station name, of each station row as (name, kind, seq)."""
    pair = F.array(F.struct(F.col("city_name").alias("name"), F.lit("city").alias("kind"),
                            (F.lit(start) + F.col("seq") * 2).alias("seq")),
                   F.struct(F.col("station_name").alias("name"), F.lit("station").alias("kind"),
                            (F.lit(start) + F.col("seq") * 2 + 1).alias("seq")))
    return stations.select(F.explode(pair).alias("e")).select("e.*") \
        .filter(F.coalesce("name", F.lit("")) != "")


def default_aliases(spark: SparkSession) -> DataFrame:
    """Default alias rows (canonical_norm, alias)."""
    return spark.createDataFrame([(c, a) for c, alts in K.CITY_ALIASES.items() for a in alts],
                                 "canonical_norm string, alias string")


def add_aliases(aliases: DataFrame, extra: DataFrame) -> DataFrame:
    """Append (city, alias) rows, the city in matching form."""
    return aliases.unionByName(
        extra.select(T.matching_form("city").alias("canonical_norm"), "alias"))


def with_aliases(gazetteer: DataFrame, aliases: DataFrame) -> DataFrame:
    """Dictionary keys extended by alias keys; existing keys win."""
    keys = (aliases.withColumn("alias_norm", T.matching_form("alias"))
            .join(gazetteer.withColumnRenamed("norm", "canonical_norm"), "canonical_norm")
            .groupBy("alias_norm")
            .agg(F.min(F.struct("seq", "canonical", "kind")).alias("e"))
            .select(F.col("alias_norm").alias("norm"), "e.canonical", "e.kind", "e.seq"))
    return gazetteer.unionByName(keys.join(gazetteer, "norm", "left_anti")
                                 .select(*gazetteer.columns))


def lookup(df: DataFrame, name_col: str, gazetteer: DataFrame) -> DataFrame:
    """Add ``canonical`` (null when unknown) and ``is_member``."""
    keys = gazetteer.select(F.col("norm").alias("_norm"), "canonical")
    return (df.withColumn("_norm", T.matching_form(name_col)).join(keys, "_norm", "left")
            .withColumn("is_member", F.col("canonical").isNotNull()).drop("_norm"))


def gazetteer_stats(names: DataFrame, gazetteer: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct cities, distinct stations, keys, alias rows (one row)."""
    kinds = names.agg(
        F.count_distinct(F.when(F.col("kind") == "city", F.col("name"))).alias("cities"),
        F.count_distinct(F.when(F.col("kind") == "station", F.col("name"))).alias("stations"))
    long = (kinds.select(F.explode(F.create_map(F.lit("cities"), F.col("cities"),
                                                F.lit("stations"), F.col("stations")))
                         .alias("metric", "value"))
            .unionByName(gazetteer.agg(F.count(F.lit(1)).alias("value"))
                         .select(F.lit("total_locations").alias("metric"), "value"))
            .unionByName(aliases.agg(F.count(F.lit(1)).alias("value"))
                         .select(F.lit("aliases").alias("metric"), "value")))
    wanted = ["cities", "stations", "total_locations", "aliases"]
    return long.groupBy().pivot("metric", wanted).agg(F.first("value"))
