"""Timetable to network."""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera import constants as K
from itinera.functions import transport as X
from itinera.operators.stations import primary_code
from itinera.plans.ranking import next_in_group
from itinera.plans.tables import TableStore

PAIR = ["origin_uic", "destination_uic"]
CUBE = ["cx", "cy", "cz"]


# ------------------------------------------------------------- timetable -> edges

def trip_classes(trips: DataFrame, routes: DataFrame, rules=tuple(K.SERVICE_CLASS_RULES)) -> DataFrame:
    """(trip_id, line_code)."""
    classes = routes.select("route_id", X.service_class("route_short_name", "route_long_name", rules)
                            .alias("line_code"))
    return trips.select("trip_id", "route_id").join(classes, "route_id", "left") \
        .select("trip_id", F.coalesce("line_code", F.lit(K.DEFAULT_CLASS)).alias("line_code"))


def stop_segments(stop_times: DataFrame, max_seconds: int = K.MAX_SEGMENT_SECONDS, **options) -> DataFrame:
    """E1 + B4: consecutive stops per trip as (trip_id, origin_uic, destination_uic, seconds)."""
    calls = (stop_times.select("trip_id", "stop_sequence", X.station_code("stop_id").alias("uic"),
                               X.clock_to_seconds("departure_time").alias("dep_sec"))
             .filter(F.col("uic").isNotNull()))
    paired = next_in_group(calls, ["trip_id"], ["stop_sequence"], ["uic", "dep_sec"], **options)
    seconds = F.col("next_dep_sec") - F.col("dep_sec")
    return (paired.filter((F.col("next_uic") != F.col("uic")) & (seconds > 0) & (seconds <= max_seconds))
            .select("trip_id", F.col("uic").alias("origin_uic"),
                    F.col("next_uic").alias("destination_uic"), seconds.alias("seconds")))


def class_durations(segments: DataFrame, classes: DataFrame, approximate: bool = False) -> DataFrame:
    """C9 + D1: median seconds and trip count per (origin, destination, class)."""
    coded = segments.join(classes, "trip_id", "left") \
        .withColumn("line_code", F.coalesce("line_code", F.lit(K.DEFAULT_CLASS)))
    middle = F.percentile_approx("seconds", 0.5, 100000).cast("double") if approximate \
        else F.median("seconds")
    return coded.groupBy(*PAIR, "line_code").agg(
        middle.alias("median_seconds"), F.count(F.lit(1)).alias("trip_count"))


def fastest_per_pair(rows: DataFrame, measure: str) -> DataFrame:
    """The row with the smallest ``measure`` per pair (class name breaks ties)."""
    rest = [c for c in rows.columns if c not in PAIR + [measure, "line_code"]]
    best = F.min(F.struct(measure, "line_code", *rest)).alias("best")
    return rows.groupBy(*PAIR).agg(best).select(*PAIR, "best.*").select(*rows.columns)


def connections(segments: DataFrame, classes: DataFrame, min_trips: int = K.MIN_TRIPS,
                approximate: bool = False) -> DataFrame:
    """(origin_uic, destination_uic, duration_minutes, line_code, trip_count)."""
    timed = fastest_per_pair(class_durations(segments, classes, approximate), "median_seconds")
    return (timed.filter(F.col("trip_count") >= min_trips)
            .select(*PAIR, F.bround(F.col("median_seconds") / 60).cast("int").alias("duration_minutes"),
                    "line_code", "trip_count"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every row and its reversal (names exchanged too), from a single pass over the input."""
    swap = {"origin_uic": "destination_uic", "destination_uic": "origin_uic",
            "origin_name": "destination_name", "destination_name": "origin_name"}
    there = F.struct(*[F.col(c).alias(c) for c in edges.columns])
    back = F.struct(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns])
    return edges.select(F.inline(F.array(there, back)))


def symmetric(edges: DataFrame, measure: str = "duration_minutes") -> DataFrame:
    """Every pair in both directions, the faster row winning."""
    return fastest_per_pair(both_ways(edges), measure)


def with_names(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Names of both ends, from the first stop per code."""
    names = (stops.withColumn("uic", X.station_code("stop_id")).filter(F.col("uic").isNotNull())
             .groupBy("uic").agg(F.min_by("stop_name", "seq").alias("name")))
    side = lambda end: names.select(F.col("uic").alias(f"{end}_uic"),
                                    F.col("name").alias(f"{end}_name"))
    return edges.join(side("origin"), "origin_uic", "left").join(side("destination"), "destination_uic", "left")


def override_merge(current: DataFrame, override: DataFrame) -> DataFrame:
    """C11: rows of ``override`` replace rows of ``current`` with the same pair."""
    return current.join(override.select(*PAIR).distinct(), PAIR, "left_anti") \
        .select(*current.columns).unionByName(override.select(*current.columns))


def insert_missing(current: DataFrame, extra: DataFrame) -> DataFrame:
    """Add the rows of ``extra`` whose pair is not there yet."""
    fresh = extra.join(current.select(*PAIR).distinct(), PAIR, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def key_overlap(current: DataFrame, extra: DataFrame) -> DataFrame:
    """Pairs of ``extra`` marked ``existing`` or ``new``."""
    ours, theirs = current.select(*PAIR), extra.select(*PAIR)
    return (theirs.intersect(ours).withColumn("state", F.lit("existing"))
            .unionByName(theirs.subtract(ours).withColumn("state", F.lit("new"))))


def between_sets(edges: DataFrame, left: DataFrame | list[str], right: DataFrame | list[str]) -> DataFrame:
    """Edges from one station set to the other, in both directions."""
    def within(df: DataFrame, column: str, members) -> DataFrame:
        if isinstance(members, list):
            return df.filter(F.col(column).isin(members))
        return df.join(members.select(F.col("uic").alias(column)).distinct(), column, "left_semi")

    there = within(within(edges, "origin_uic", left), "destination_uic", right)
    back = within(within(edges, "origin_uic", right), "destination_uic", left)
    return (there.withColumn("direction", F.lit("there"))
            .unionByName(back.withColumn("direction", F.lit("back")).select(*there.columns, "direction")))


def subset_stations(stations: DataFrame, codes: DataFrame | list[str]) -> DataFrame:
    """Stations whose primary code is in a list or table of (uic)."""
    if isinstance(codes, list):
        return stations.filter(primary_code("uic_code").isin(codes))
    keys = codes.select(F.col("uic").alias("_primary")).distinct()
    return stations.withColumn("_primary", primary_code("uic_code")) \
        .join(keys, "_primary", "left_semi").drop("_primary")


def duration_summary(edges: DataFrame) -> DataFrame:
    """Count, mean, deviation, quartiles and extremes of the minutes (one row)."""
    m = F.col("duration_minutes")
    quantile = lambda p: F.percentile(m, F.lit(p))
    return edges.agg(F.count(m).alias("n"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"),
                     F.min(m).alias("min"), quantile(0.25).alias("p25"), quantile(0.5).alias("p50"),
                     quantile(0.75).alias("p75"), F.max(m).alias("max"))


def class_counts(edges: DataFrame) -> DataFrame:
    """Edges per class."""
    return edges.groupBy("line_code").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ network

class Network(NamedTuple):
    """Nodes, directed edges (both directions of every pair) and code aliases."""

    nodes: DataFrame
    edges: DataFrame
    alias: DataFrame


def station_alias(stations: DataFrame) -> DataFrame:
    """(alt_uic, uic) from packed code lists, the last row winning per alternate."""
    packed = stations.select(F.transform(F.split("uic_code", ";"), lambda c: F.trim(c)).alias("codes"), "seq")
    return (packed.select(F.get("codes", 0).alias("uic"), "seq",
                          F.explode(F.slice("codes", 2, F.size("codes"))).alias("alt_uic"))
            .groupBy("alt_uic").agg(F.max_by("uic", "seq").alias("uic")))


def resolve_alias(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """Both ends as primary codes."""
    for end in PAIR:
        codes = alias.select(F.col("alt_uic").alias("_code"), F.col("uic").alias("_primary"))
        edges = (edges.withColumn("_code", primary_code(end)).join(codes, "_code", "left")
                 .withColumn(end, F.coalesce("_primary", "_code")).drop("_code", "_primary"))
    return edges


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    codes = nodes.select("uic")
    for end in PAIR:
        edges = edges.join(codes.withColumnRenamed("uic", end), end, "left_semi")
    return edges


def default_transfers(spark: SparkSession) -> DataFrame:
    """Transfer groups as (city, uic, seq, minutes)."""
    rows = [(city, uic, i, minutes) for city, codes, minutes in K.CITY_TRANSFERS
            for i, uic in enumerate(codes)]
    return spark.createDataFrame(rows, "city string, uic string, seq bigint, minutes int")


def transfer_edges(groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One edge per i<j station pair of a city that has no edge yet.

    All pairs of a group are the definition of the operator; groups are the few
    main stations of one city.
    """
    present = groups.join(nodes.select("uic"), "uic", "left_semi")
    left = present.select("city", F.col("uic").alias("origin_uic"), F.col("seq").alias("_i"), "minutes")
    right = present.select("city", F.col("uic").alias("destination_uic"), F.col("seq").alias("_j"))
    pairs = left.join(right, "city").filter(F.col("_i") < F.col("_j"))
    return (pairs.join(both_ways(edges.select(*PAIR)), PAIR, "left_anti")
            .select(*PAIR, F.col("minutes").alias("duration_minutes"),
                    F.lit(K.TRANSFER_CLASS).alias("line_code"),
                    F.lit(None).cast("double").alias("distance_km")))


def build_network(stations: DataFrame, connection_rows: DataFrame, transfers: DataFrame | None = None,
                  subset: DataFrame | list[str] | None = None) -> Network:
    """Network from stations and connections.

    Codes are resolved before any filter; one edge per unordered pair, the
    smallest (minutes, class) winning (P6); each kept pair is emitted in both directions.
    """
    alias = station_alias(stations)
    if subset is not None:
        stations = subset_stations(stations, subset)
    nodes = stations.withColumn("uic", primary_code("uic_code")).drop("uic_code") \
        .select("uic", "station_name", "station_name_normalized", "city_name",
                "city_name_normalized", "latitude", "longitude", "segment_drg")
    if "distance_km" not in connection_rows.columns:
        connection_rows = connection_rows.withColumn("distance_km", F.lit(None).cast("double"))
    rows = known_ends(resolve_alias(connection_rows, alias), nodes) \
        .select(*PAIR, F.col("duration_minutes").cast("int"), "line_code", "distance_km") \
        .filter(F.col("origin_uic") != F.col("destination_uic"))
    low, high = F.least(*PAIR), F.greatest(*PAIR)
    single = (rows.groupBy(low.alias("origin_uic"), high.alias("destination_uic"))
              .agg(F.min(F.struct("duration_minutes", "line_code", "distance_km")).alias("b"))
              .select(*PAIR, "b.*"))
    if transfers is not None:
        single = single.unionByName(transfer_edges(transfers, nodes, single).select(*single.columns))
    edges = both_ways(single).select(
        F.col("origin_uic").alias("src"), F.col("destination_uic").alias("dst"),
        F.col("duration_minutes").alias("minutes"), "line_code", "distance_km",
        X.routing_cost("duration_minutes", "line_code").alias("cost"))
    return Network(nodes, edges, alias)


# ------------------------------------------------------------ geography

def _cube_cells(lat: str, lon: str, size: float) -> list[Column]:
    """Numbers of the cube cell, ``size`` earth radii wide, that holds a place as a point of the unit sphere."""
    phi, theta = F.radians(lat), F.radians(lon)
    return [F.floor(axis / F.lit(size)).alias(name) for name, axis in
            (("cx", F.cos(phi) * F.cos(theta)), ("cy", F.cos(phi) * F.sin(theta)), ("cz", F.sin(phi)))]


def nearest_station(points: DataFrame, stations: DataFrame, radius_km: float = 2.0, levels: int = 3) -> DataFrame:
    """Closest station within the radius, as (point_id, uic, distance_km); ties go to the smallest code.

    Places are points of the unit sphere in a grid of cubes as wide as the chord
    of the radius, so the 27 cells round a point hold every station in range, at
    the poles and at 180 degrees as elsewhere; a station is copied to those that
    touch the sphere. Levels go from a small radius to the full one by four: a point that finds
    a station on a level is done, so in a dense place it only meets the fine cells.
    Places without coordinates and points without a station in range have no row.
    """
    located = lambda lat, lon: F.col(lat).isNotNull() & F.col(lon).isNotNull()
    sites = (stations.filter(located("latitude", "longitude"))
             .groupBy(F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon")).agg(F.min("uic").alias("uic")))
    store = TableStore(points.sparkSession, "nearest")
    sites, _ = store.write(sites, "sites")
    left, seen = store.write(points.filter(located("lat", "lon")).select("point_id", "lat", "lon"), "left", n=F.count(F.lit(1)))
    found = []
    for level in reversed(range(levels)):
        if not seen["n"] and found:
            break
        reach = radius_km / 4 ** level
        size = 2 * math.sin(min(reach / (2 * K.EARTH_RADIUS_KM), math.pi / 2)) * (1 + 1e-6) + 1e-9
        step = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
        inner = sum((F.pow(F.greatest(F.col(c), -F.col(c) - 1, F.lit(0)) * F.lit(size), F.lit(2)) for c in CUBE), F.lit(0.0))
        outer = sum((F.pow(F.greatest(F.col(c) + 1, -F.col(c)) * F.lit(size), F.lit(2)) for c in CUBE), F.lit(0.0))
        copies = sites.select("*", *_cube_cells("s_lat", "s_lon", size))
        for axis in CUBE:
            copies = copies.withColumn(axis, step(axis))
        copies = copies.filter((inner <= 1 + 1e-9) & (outer >= 1 - 1e-9))
        near = (left.select("*", *_cube_cells("lat", "lon", size)).join(copies, CUBE)
                .withColumn("distance_km", X.haversine_km("lon", "lat", "s_lon", "s_lat"))
                .filter(F.col("distance_km") <= reach)
                .groupBy("point_id").agg(F.min(F.struct("distance_km", "uic")).alias("b"))
                .select("point_id", "b.uic", "b.distance_km"))
        near, _ = store.write(near, f"found-{level}")
        found.append(near)
        if level:
            left, seen = store.write(left.join(near, "point_id", "left_anti"), f"left-{level}", n=F.count(F.lit(1)))
    return reduce(DataFrame.unionByName, found)


def network_quality(network: Network, components: DataFrame | None = None) -> DataFrame:
    """Quality figures as (metric, value)."""
    nodes, edges = network.nodes, network.edges
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    inside = (F.col("longitude").between(K.BOUNDS["min_lon"], K.BOUNDS["max_lon"])
              & F.col("latitude").between(K.BOUNDS["min_lat"], K.BOUNDS["max_lat"]))
    ends = nodes.select(F.col("uic"), "latitude", "longitude")
    from_side = ends.select(F.col("uic").alias("src"), F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"))
    to_side = ends.select(F.col("uic").alias("dst"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    km = F.coalesce("distance_km", X.haversine_km("lon1", "lat1", "lon2", "lat2"))
    measured = edges.join(from_side, "src", "left").join(to_side, "dst", "left")
    orphans = nodes.join(edges.select(F.col("src").alias("uic")).distinct(), "uic", "left_anti")
    one_way = edges.select("src", "dst").join(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")

    def rows(row: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                          for c in row.columns])
        return row.select(F.explode(pairs).alias("m")).select("m.*")

    count = F.count(F.lit(1))
    out = (rows(nodes.agg(count.alias("stations"), F.count_if(located).alias("with_coordinates"),
                          F.count_if(located & inside).alias("inside_bounds")))
           .unionByName(rows(measured.agg(
               count.alias("directed_edges"), F.count("minutes").alias("with_duration"),
               F.avg("minutes").alias("avg_minutes"), F.min("minutes").alias("min_minutes"),
               F.max("minutes").alias("max_minutes"),
               F.count_if(km >= K.MAX_EDGE_KM).alias("too_long"))))
           .unionByName(rows(orphans.agg(count.alias("orphans"))))
           .unionByName(rows(one_way.agg(count.alias("one_way_edges")))))
    if components is not None:
        sizes = components.groupBy("component").agg(count.alias("size"))
        out = out.unionByName(rows(sizes.agg(count.alias("components"),
                                             F.max("size").alias("largest_component"))))
    return out


def in_main_component(components: DataFrame, named: DataFrame) -> DataFrame:
    """Whether each station of (uic) lies in the largest component."""
    main = (components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "component").limit(1).select("component", F.lit(True).alias("_main")))
    members = components.select(F.col("node").alias("uic"), "component").join(main, "component", "left")
    return named.join(members, "uic", "left").withColumn(
        "in_main_component", F.coalesce("_main", F.lit(False))).drop("_main", "component")
