"""Order resolution end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itinera.functions import text as T
from itinera.operators.extract import decode_spans, drop_person_names, extract_orders, is_complete
from itinera.operators.graph import shortest_paths
from itinera.operators.matching import resolve_entities
from itinera.operators.network import Network
from itinera.operators.stations import flag_foreign, map_cities
from itinera.plans.lookup import counted, left_lookup
from itinera.plans.tables import TableStore


def extract_from_labels(tokens: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Extraction from a labelled token table: E7, I7 and E9; valid when both ends are there."""
    store = TableStore(tokens.sparkSession, "labelled")
    named, _ = store.write(decode_spans(tokens).withColumn("_row", F.monotonically_increasing_id()), "spans")
    ends = named.select(F.explode(F.array("origin", "destination")).alias("query")).distinct()
    resolved = counted(resolve_entities(ends, gazetteer).select("query", "canonical"), "labelled-names")
    for end in ("origin", "destination"):
        named = left_lookup(named, resolved.select(F.col("query").alias(end), F.col("canonical").alias("_c")), [end], "_row") \
            .withColumn(end, F.col("_c")).drop("_c")
    named = named.drop("_row")
    kept = drop_person_names(named)
    valid = is_complete(F.col("origin"), F.col("destination"))
    return kept.withColumn("valid", valid).withColumn("method", F.when(valid, "labels").otherwise("invalid"))


def resolve_orders(extracted: DataFrame, city_station: DataFrame, network: Network,
                   foreign: DataFrame, mode: str = "nlp", routes: DataFrame | None = None) -> DataFrame:
    """13-column result per order.

    ``extracted`` has (sentenceID, sentence, origin, destination, valid) from the
    rules or from labels and is worked out once. Place names are mapped once per distinct name and paths
    are searched once per distinct pair of stations. ``mode='route'`` names every
    station on the way; ``mode='nlp'`` reports the two places and keeps them when
    no path exists. ``routes`` takes a ready J9 table instead of a search.
    """
    if mode not in ("nlp", "route"):
        raise ValueError(f"mode must be 'nlp' or 'route', not {mode!r}")
    store = TableStore(extracted.sparkSession, "resolve")
    base, _ = store.write(extracted.select(F.col("sentenceID").alias("sentence_id"), "sentence", "origin", "destination", "valid"), "orders")
    complete = F.col("valid") & is_complete(F.col("origin"), F.col("destination"))
    names = (base.filter(complete).select(F.explode(F.array("origin", "destination")).alias("city")).distinct())
    mapped = flag_foreign(map_cities(names, "city", city_station), "city", foreign)
    mapped, _ = store.write(mapped, "cities")
    rows = base.withColumn("_complete", complete)
    for end in ("origin", "destination"):
        rows = left_lookup(rows, mapped.select(F.col("city").alias(end), F.col("uic").alias(f"{end}_uic"),
                                               F.col("is_foreign").alias(f"_{end}_foreign")), [end], "sentence_id") \
            .withColumn(f"{end}_uic", F.when(F.col("_complete"), F.col(f"{end}_uic")))
    if routes is None:
        asked = rows.filter(F.col("origin_uic").isNotNull() & F.col("destination_uic").isNotNull())
        routes = shortest_paths(network.nodes, network.edges, asked.select("origin_uic", "destination_uic"))
    stops = (routes.filter(F.col("path").isNotNull())
             .select("origin_uic", "destination_uic", F.posexplode("path").alias("pos", "uic"))
             .join(network.nodes.select("uic", "station_name"), "uic", "left")
             .groupBy("origin_uic", "destination_uic")
             .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("station_name", "uic").alias("name")))).alias("s"))
             .select("origin_uic", "destination_uic", F.col("s.name").alias("_stations")))
    table = routes.select("origin_uic", "destination_uic", "path", "minutes", F.col("error").alias("_error")) \
        .join(stops, ["origin_uic", "destination_uic"], "left").withColumn("_asked", F.lit(True))
    table, _ = store.write(table, "routes")
    rows = left_lookup(rows, table, ["origin_uic", "destination_uic"], "sentence_id")

    def missing(end: str) -> tuple:
        lost = F.col("_complete") & F.col(f"{end}_uic").isNull()
        abroad = F.coalesce(f"_{end}_foreign", F.lit(False))
        return lost & abroad, lost & ~abroad

    o_abroad, o_lost = missing("origin")
    d_abroad, d_lost = missing("destination")
    error = (F.when(o_abroad, "ForeignCityError").when(o_lost, "CityMappingError")
             .when(d_abroad, "ForeignCityError").when(d_lost, "CityMappingError")
             .when(F.col("_complete"), F.coalesce("_error", F.when(F.col("_asked").isNull(), "NoPathError"))))
    failed = lambda end: F.concat(F.lit(f"{end}: "), end)
    message = (F.when(o_abroad | o_lost, failed("origin")).when(d_abroad | d_lost, failed("destination"))
               .when(F.col("error_type").isNotNull(),
                     F.concat_ws(" -> ", "origin_uic", "destination_uic")))
    success = F.col("_complete") & F.col("error_type").isNull()
    invalid = F.array(F.lit("INVALID"), F.lit("INVALID"))
    places = F.array("origin", "destination")
    if mode == "route":
        route = F.when(success, F.col("_stations")).otherwise(invalid)
    else:
        searched = F.col("_complete") & F.col("origin_uic").isNotNull() & F.col("destination_uic").isNotNull()
        route = F.when(searched, places).otherwise(invalid)
    return (rows.withColumn("error_type", error)
            .select("sentence_id", "sentence", "origin", "destination", "origin_uic", "destination_uic",
                    "valid", route.alias("route"),
                    F.when(success, F.col("path")).otherwise(F.array().cast("array<string>")).alias("path"),
                    F.when(success, F.col("minutes")).otherwise(F.lit(0)).cast("bigint").alias("total_time"),
                    success.alias("success"), "error_type", message.alias("error_message")))


def resolution_counters(results: DataFrame) -> DataFrame:
    """One row of counters; foreign cities have their own counter."""
    error = F.col("error_type").isNotNull()
    valid = F.coalesce("valid", F.lit(False))
    mapping, foreign = F.col("error_type") == "CityMappingError", F.col("error_type") == "ForeignCityError"
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"),
        F.count_if("success").alias("success"), F.count_if(error).alias("errors"),
        F.count_if(error & ~valid).alias("nlp_errors"),
        F.count_if(valid & mapping).alias("mapping_errors"), F.count_if(valid & foreign).alias("foreign_errors"),
        F.count_if(error & valid & ~mapping & ~foreign).alias("pathfinding_errors"))


def nlp_rows(results: DataFrame) -> DataFrame:
    """Rows of the flat sink (A3)."""
    shown = lambda c: F.coalesce(c, F.lit("INVALID"))
    return results.select(T.clean_id(F.col("sentence_id").cast("string")).alias("sentenceID"),
                          shown("origin").alias("Departure"), shown("destination").alias("Destination"))


def run_batch(input_path: str, output_path: str, mode: str, gazetteer: DataFrame,
              city_station: DataFrame, network: Network, foreign: DataFrame,
              token_match: bool = False) -> DataFrame:
    """Read orders, resolve them, write the mode's sink, return the counters."""
    from itinera.sources.readers import read_orders
    from itinera.sources.writers import write_flat, write_routes

    spark = gazetteer.sparkSession
    orders = read_orders(spark, input_path)
    extracted = extract_orders(orders, gazetteer, token_match=token_match)
    results, _ = TableStore(spark, "batch").write(
        resolve_orders(extracted, city_station, network, foreign, mode), "results")
    if mode == "nlp":
        write_flat(nlp_rows(results), output_path)
    else:
        write_routes(results.select(F.col("sentence_id").alias("sentenceID"), "route"), output_path)
    return resolution_counters(results)
