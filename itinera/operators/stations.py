"""Stations and the city -> station map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera import constants as K
from itinera.functions import text as T
from itinera.functions import transport as X
from itinera.functions.once import with_computed
from itinera.plans.ranking import first_in_group, rank_in_group


def build_stations(stops: DataFrame, prefix: str = K.NATIONAL_PREFIX, articles=()) -> DataFrame:
    """One row per national station code from (stop_id, stop_name, stop_lat, stop_lon, seq)."""
    coded = stops.withColumn("uic_code", X.station_code("stop_id")) \
        .filter(F.col("uic_code").startswith(prefix))
    first = first_in_group(coded, ["uic_code"], ["seq"])
    first = with_computed(first, _city=X.city_from_station("stop_name", articles=articles))
    city = F.col("_city")
    return first.select(
        "uic_code", F.col("stop_name").alias("station_name"),
        T.station_form("stop_name").alias("station_name_normalized"),
        city.alias("city_name"), T.station_form(city).alias("city_name_normalized"),
        F.col("stop_lat").cast("double").alias("latitude"),
        F.col("stop_lon").cast("double").alias("longitude"),
        F.lit(None).cast("string").alias("segment_drg"), "seq")


def primary_code(packed) -> Column:
    """First code of a packed ``a;b;c`` list."""
    packed = F.col(packed) if isinstance(packed, str) else packed
    return F.trim(F.split(packed, ";")[0])


def priority_class(name, segment) -> Column:
    """E5: 0 fast-line hubs, 1 national, 2 regional, 3 local."""
    lowered = F.lower(F.col(name) if isinstance(name, str) else name)
    segment = F.col(segment) if isinstance(segment, str) else segment
    drg = F.coalesce(primary_code(segment), F.lit("C"))
    hub = lowered.contains("tgv")
    for part in K.PRIORITY_HUBS:
        hub = hub | lowered.contains(part)
    main = drg == "A"
    for part in K.PRIORITY_MAIN:
        main = main | lowered.contains(part)
    return F.when(hub, 0).when(main, 1).when(drg == "B", 2).otherwise(3)


def station_priority(stations: DataFrame, **options) -> DataFrame:
    """E5: add ``priority`` and ``city_rank`` (order of a city's stations)."""
    ranked = stations.withColumn("priority", priority_class("station_name", "segment_drg")) \
        .withColumn("_name", F.lower("station_name"))
    return rank_in_group(ranked, ["city_name_normalized"], ["priority", "_name", "uic_code"],
                         "city_rank", **options).drop("_name")


def priority_distribution(ranked: DataFrame) -> DataFrame:
    """Stations per priority class."""
    return ranked.groupBy("priority").agg(F.count(F.lit(1)).alias("n_stations"))


def city_station_map(stations: DataFrame) -> DataFrame:
    """(city_norm, uic, seq), the first station per city in file order."""
    rows = stations.select(F.trim(F.lower("city_name_normalized")).alias("city_norm"),
                           primary_code("uic_code").alias("uic"), "seq")
    return first_in_group(rows, ["city_norm"], ["seq"])


def station_lookup(city_station: DataFrame) -> DataFrame:
    """C5 + C6 as one table: (city_norm, uic, match), unique per name.

    Every key also answers for each of its prefixes that ends at a hyphen or a
    space; an exact key beats a prefix and earlier keys beat later ones. That
    turns the prefix search into an equi-join on at most one row per name.
    """
    key = F.col("city_norm")
    cuts = F.filter(F.transform(F.split(key, ""), lambda ch, i: F.when(ch.isin("-", " "), i)),
                    lambda i: i.isNotNull() & (i > 0))
    exact = city_station.select(key, F.lit(0).alias("rank"), "seq", "uic")
    prefix = (city_station.select(F.explode(cuts).alias("cut"), key, "seq", "uic")
              .select(F.expr("substring(city_norm, 1, cut)").alias("city_norm"),
                      F.lit(1).alias("rank"), "seq", "uic"))
    return (exact.unionByName(prefix).groupBy("city_norm")
            .agg(F.min(F.struct("rank", "seq", "uic")).alias("b"))
            .select("city_norm", "b.uic",
                    F.when(F.col("b.rank") == 0, "exact").otherwise("prefix").alias("match")))


def map_cities(df: DataFrame, city_col: str, city_station: DataFrame, uic_col: str = "uic",
               match_col: str | None = None) -> DataFrame:
    """Add the station code of a city name (null when there is none)."""
    table = station_lookup(city_station)
    joined = (df.withColumn("_city", T.matching_form(city_col))
              .join(table.select(F.col("city_norm").alias("_city"), F.col("uic").alias(uic_col),
                                 F.col("match").alias(match_col or "_match")), "_city", "left"))
    return joined.drop("_city", "_match")


def is_foreign(city, names=tuple(K.FOREIGN_CITIES)) -> Column:
    """The name is a known city outside the network."""
    return T.matching_form(city).isin(list(names))


def flag_foreign(df: DataFrame, city_col: str, foreign: DataFrame) -> DataFrame:
    """B8 against a table of (norm) rows."""
    marks = foreign.select(F.col("norm").alias("_city")).distinct().withColumn("is_foreign", F.lit(True))
    return (df.withColumn("_city", T.matching_form(city_col)).join(marks, "_city", "left")
            .withColumn("is_foreign", F.coalesce("is_foreign", F.lit(False))).drop("_city"))


def station_stats(stations: DataFrame) -> DataFrame:
    """Rows, rows with coordinates, distinct cities (one row)."""
    return stations.agg(
        F.count(F.lit(1)).alias("stations"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .alias("with_coordinates"),
        F.count_distinct("city_name").alias("cities"))


def stations_per_city(stations: DataFrame, k: int | None = None) -> DataFrame:
    """Stations per city, optionally the k largest."""
    counts = stations.groupBy("city_name").agg(F.count(F.lit(1)).alias("n_stations"))
    return counts if k is None else counts.orderBy(F.desc("n_stations"), "city_name").limit(k)
