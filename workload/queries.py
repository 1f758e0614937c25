"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Arrays are shown as joined text and ratios rounded to 6 digits, so that two
engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.functions import text as T
from itinera.functions import transport as X
from itinera.operators import dataset as DS
from itinera.operators import evaluate as EV
from itinera.operators import extract as EX
from itinera.operators import gazetteer as GZ
from itinera.operators import graph as GR
from itinera.operators import labels as LB
from itinera.operators import matching as MT
from itinera.operators import network as NW
from itinera.operators import stations as ST
from itinera.plans import resolution as RS
from itinera.plans.tables import TableStore
from itinera.sources import readers as RD
from itinera.sources import writers as WR
from itinera.sources.writers import wide_routes
from itinera.streaming import orders as SM
from workload.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _r(col, digits: int = 6):
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(c) for c in columns})


def _joined(col, mark: str = "|"):
    return F.array_join(col, mark)


# ------------------------------------------------------------------------------- text

@query
def normalize_documents(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(T.normalize_text(t)).alias("normalized"), F.md5(T.remove_accents(t)).alias("no_accents"),
        F.md5(T.normalize_apostrophes(T.normalize_hyphens(t))).alias("marks"),
        F.md5(T.remove_non_alphanumeric(t)).alias("alphanumeric"), F.md5(T.matching_form(t)).alias("matching"),
        F.md5(T.fuzzy_key(t)).alias("fuzzy"), F.md5(T.station_form(t)).alias("station"))


@query
def tokenize_documents(spark, d):
    t = F.col("text")
    words, tokens, parts, labelled = T.tokenize(t), T.tokenize(t, True), T.split_name(t), T.label_tokens(t)
    return table(spark, d, "documents").select(
        "doc_id", F.size(words).cast("bigint").alias("n_words"), F.md5(_joined(words)).alias("words"),
        F.size(tokens).cast("bigint").alias("n_tokens"), F.md5(_joined(tokens)).alias("tokens"),
        F.size(parts).cast("bigint").alias("n_parts"), F.md5(_joined(parts)).alias("parts"),
        F.size(labelled).cast("bigint").alias("n_label_tokens"), F.md5(_joined(labelled)).alias("label_tokens"))


@query
def quoted_fragments(spark, d):
    both = (table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
            .unionByName(table(spark, d, "pages").select(
                F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))))
    found = T.quoted_fragments("text")
    return both.select("id", F.size(found).cast("bigint").alias("n"), F.md5(_joined(found)).alias("fragments"))


@query
def comparison_forms(spark, d):
    return table(spark, d, "preds").select(
        T.clean_id(F.concat(F.lit("  "), F.col("sentenceID").cast("string"), F.lit(" "))).alias("id"),
        T.comparison_form("origin").alias("origin_form"), T.comparison_form("destination").alias("destination_form"),
        T.output_line("sentenceID", "origin", "destination").alias("line"))


@query
def rebuild_names(spark, d):
    return table(spark, d, "orders_text").select(
        "sentenceID", T.join_tokens(T.label_tokens("sentence")).alias("rebuilt"),
        T.drop_leading_prepositions(F.concat(F.lit("De  à "), "origin")).alias("stripped"))


# -------------------------------------------------------------------------- gazetteer

def _gaz(spark, d, names: str = "place_names") -> DataFrame:
    return GZ.build_gazetteer(table(spark, d, names))


@query
def gazetteer_build(spark, d):
    extra = table(spark, d, "supplier").select(
        F.concat(F.lit("PARIS gare "), (F.col("s_suppkey") % 40).cast("string")).alias("name"),
        F.lit("station").alias("kind"), (F.col("s_suppkey") + 5000).alias("seq"))
    return GZ.build_gazetteer(table(spark, d, "all_names").unionByName(extra))


@query
def gazetteer_counts(spark, d):
    names = table(spark, d, "all_names")
    aliases = GZ.add_aliases(GZ.default_aliases(spark), table(spark, d, "typo_names").select(
        F.lit("Saint-Étienne").alias("city"), F.col("query").alias("alias")))
    return GZ.gazetteer_stats(names, GZ.build_gazetteer(names), aliases)


@query
def alias_matches(spark, d):
    gaz = _gaz(spark, d)
    aliases = GZ.add_aliases(GZ.default_aliases(spark).limit(0), table(spark, d, "supplier_aliases").select("city", "alias"))
    return GZ.lookup(table(spark, d, "typed_aliases"), "name", GZ.with_aliases(gaz, aliases)).select("id", "canonical", "is_member")


@query
def dictionary_lookup(spark, d):
    return GZ.lookup(table(spark, d, "preds").select("sentenceID", F.upper("origin").alias("name")), "name",
                     _gaz(spark, d))


@query
def dict_ngram_match(spark, d):
    return MT.place_mentions(table(spark, d, "orders_text"), _gaz(spark, d), "sentence", "sentenceID")


@query
def dict_ngram_match_join(spark, d):
    """C4 by n-gram equi-join, the way of a dictionary too large for the plan."""
    return MT.place_mentions(table(spark, d, "orders_text"), _gaz(spark, d), "sentence", "sentenceID", inline_keys=0)


# ------------------------------------------------------------------------- extraction

def _extracted(spark, d) -> DataFrame:
    return EX.extract_orders(table(spark, d, "orders_text"), _gaz(spark, d))


@query
def order_validity(spark, d):
    found = MT.find_places(table(spark, d, "orders_text"), _gaz(spark, d), "sentence", "sentenceID")
    return found.select("sentenceID", EX.is_order(F.col("norm"), F.col("places")).alias("is_order"))


@query
def extract_orders(spark, d):
    return _extracted(spark, d).select(
        "sentenceID", "origin", "destination", "valid", "method",
        EX.is_complete(F.col("origin"), F.col("destination")).alias("complete"))


@query
def extraction_methods(spark, d):
    return _extracted(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------------- labels

def _labelled(spark, d) -> DataFrame:
    return LB.bio_labels(table(spark, d, "orders_text"), _gaz(spark, d))


def _noisy(spark, d) -> DataFrame:
    """Tokens with labels drawn from a hash, so that every label transition occurs."""
    rows = table(spark, d, "orders_text").select("sentenceID", T.label_tokens("sentence").alias("tokens"))
    return rows.withColumn("labels", F.expr(
        "transform(tokens, (t, i) -> element_at(array('O','B-ORIGIN','I-ORIGIN','B-DEST','I-DEST'), "
        "(instr('0123456789abcdef', substring(md5(concat(cast(sentenceID as string), '|', cast(i as string))), 1, 1)) - 1) % 5 + 1))"))


@query
def bio_labels(spark, d):
    return _labelled(spark, d).select("sentenceID", _joined("tokens").alias("tokens"), _joined("labels").alias("labels"))


@query
def bio_decode(spark, d):
    return EX.decode_spans(_noisy(spark, d)).select("sentenceID", "origin", "destination")


@query
def bio_all_spans(spark, d):
    return EX.all_spans(_noisy(spark, d), "sentenceID")


@query
def person_filter(spark, d):
    names = GZ.build_gazetteer(table(spark, d, "person_orders").select(
        F.col("origin").alias("name"), F.lit("city").alias("kind"), F.col("sentenceID").alias("seq")))
    labelled = LB.bio_labels(table(spark, d, "person_orders"), names)
    spans = EX.decode_spans(labelled.drop("origin", "destination"))
    return EX.drop_person_names(spans).select("sentenceID", "origin", "destination")


def _subwords(labelled: DataFrame) -> DataFrame:
    """Each token cut into pieces of three letters, with a special sub-word at both ends."""
    pieces = F.flatten(F.transform("tokens", lambda t, w: F.transform(
        F.sequence(F.lit(1), F.ceil(F.length(t) / 3).cast("int")), lambda i: w)))
    special = F.array(F.lit(None).cast("int"))
    return labelled.select(F.col("sentenceID").alias("ex_id"),
                           F.posexplode(F.concat(special, pieces, special)).alias("pos", "word_id"))


def _written_labels(spark, d) -> DataFrame:
    """Labelled orders read more than once, so they are written."""
    return TableStore(spark, "labelled").write(_labelled(spark, d).select("sentenceID", "difficulty", "tokens", "labels"), "rows")[0]


@query
def subword_align(spark, d):
    labelled = _written_labels(spark, d)
    words = labelled.select(F.col("sentenceID").alias("ex_id"), F.posexplode("labels").alias("word_id", "label"))
    return LB.align_subwords(_subwords(labelled), words)


@query
def subword_stats(spark, d):
    labelled = _written_labels(spark, d)
    examples = labelled.select(F.col("sentenceID").alias("ex_id"), F.col("difficulty").alias("split"), "tokens")
    return _rounded(LB.subword_stats(_subwords(labelled), examples, max_length=10), "avg_subword_len") \
        .withColumn("max_subword_len", F.col("max_subword_len").cast("bigint"))


@query
def label_stats(spark, d):
    return _rounded(LB.label_stats(_labelled(spark, d)), "share")


@query
def label_example_stats(spark, d):
    return LB.example_stats(_labelled(spark, d))


@query
def label_problems(spark, d):
    broken = _labelled(spark, d).withColumn("labels", F.expr(
        "CASE sentenceID % 7 WHEN 0 THEN slice(labels, 2, size(labels)) WHEN 1 THEN transform(labels, x -> replace(x, 'DEST', 'CITY')) "
        "ELSE labels END"))
    return LB.label_problems(broken).select("sentenceID", "problem")


# --------------------------------------------------------------------------- stations

def _stations(spark, d) -> DataFrame:
    return ST.build_stations(table(spark, d, "stops"))


def _city_map(spark, d) -> DataFrame:
    return ST.city_station_map(table(spark, d, "city_rows"))


@query
def city_to_station_exact_prefix(spark, d):
    typed = table(spark, d, "typed_names")
    return ST.map_cities(typed, "query", _city_map(spark, d), match_col="match")


@query
def city_station_pairs(spark, d):
    return _city_map(spark, d)


@query
def stations_clean(spark, d):
    return _stations(spark, d).select("uic_code", "station_name", "station_name_normalized", "city_name",
                                      "city_name_normalized", _r("latitude").alias("latitude"),
                                      _r("longitude").alias("longitude"))


@query
def station_priority(spark, d):
    segments = table(spark, d, "packed_stations").select(
        ST.primary_code("uic_code").alias("uic_code"), F.col("segment_drg").alias("drg"))
    ranked = ST.station_priority(_stations(spark, d).join(segments, "uic_code").withColumn("segment_drg", F.col("drg")))
    return ranked.select("uic_code", "city_name_normalized", F.col("priority").cast("int").alias("priority"), "city_rank")


@query
def priority_counts(spark, d):
    ranked = table(spark, d, "packed_stations").withColumn("priority", ST.priority_class("station_name", "segment_drg"))
    return ST.priority_distribution(ranked)


@query
def station_stats(spark, d):
    return ST.station_stats(table(spark, d, "packed_stations"))


@query
def largest_cities(spark, d):
    return ST.stations_per_city(_stations(spark, d), 10)


@query
def foreign_flags(spark, d):
    foreign = GZ.build_gazetteer(table(spark, d, "part_names").select(
        "name", F.lit("city").alias("kind"), "seq")).select("norm")
    return ST.flag_foreign(table(spark, d, "typed_names").union(table(spark, d, "part_names").select("name")),
                           "query", foreign)


@query
def service_class(spark, d):
    return NW.trip_classes(table(spark, d, "trips"), table(spark, d, "routes"))


# --------------------------------------------------------------------------- matching

@query
def edit_distance_best(spark, d):
    names = table(spark, d, "all_names").select("name", "seq")
    return MT.closest_entry(table(spark, d, "typed_names"), names)


@query
def word_corrections(spark, d):
    """C14 with a dictionary that grows with the corpus: words of the benchmark against every word of the documents."""
    words = lambda name: table(spark, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    pairs = MT.edit_pairs(words("benchmark").withColumnRenamed("w", "q_key"), words("documents").withColumnRenamed("w", "c_key"), MT.EditBound(k=2))
    return (pairs.groupBy(F.col("q_key").alias("word")).agg(F.min(F.struct("distance", "c_key")).alias("best"), F.count(F.lit(1)).alias("n_near"))
            .select("word", F.col("best.c_key").alias("closest"), "best.distance", "n_near"))


@query
def similarity_topk(spark, d):
    found = MT.similar_entries(table(spark, d, "typed_names"), _gaz(spark, d, "all_names"))
    return _rounded(found, "similarity")


@query
def prefix_candidates(spark, d):
    return MT.prefix_candidates(table(spark, d, "typed_names"), _gaz(spark, d, "all_names"))


@query
def resolve_entities(spark, d):
    return MT.resolve_entities(table(spark, d, "typed_names"), _gaz(spark, d, "all_names"))


@query
def suggestions(spark, d):
    return MT.suggestions(table(spark, d, "typed_names"), _gaz(spark, d, "all_names")) \
        .withColumn("stage", F.col("stage").cast("int"))


@query
def suggestion_summary(spark, d):
    found = MT.suggestions(table(spark, d, "typed_names"), _gaz(spark, d, "all_names"))
    return MT.suggestion_summary(found, _city_map(spark, d), max_length=10)


# -------------------------------------------------------------------------- timetable

def _segments(spark, d) -> DataFrame:
    return NW.stop_segments(table(spark, d, "stop_times"))


def _classes(spark, d) -> DataFrame:
    return NW.trip_classes(table(spark, d, "trips"), table(spark, d, "routes"))


def _connections(spark, d) -> DataFrame:
    return NW.connections(_segments(spark, d), _classes(spark, d))


def _symmetric(spark, d) -> DataFrame:
    return NW.symmetric(_connections(spark, d))


def _stored(spark, network: NW.Network) -> NW.Network:
    store = TableStore(spark, "network")
    return NW.Network(*[store.write(t, name)[0] for name, t in network._asdict().items()])


def _flat_network(spark, d) -> NW.Network:
    """Network of the timetable stations, written once like a snapshot."""
    return _stored(spark, NW.build_network(_stations(spark, d), _symmetric(spark, d)))


def _packed_network(spark, d) -> NW.Network:
    """Network with alternate codes and transfers; edges refer to either code."""
    alternate = F.when(F.substring("origin_uic", -8, 8).cast("bigint") % 7 == 87000000 % 7,
                       (F.col("origin_uic").cast("bigint") + 1000000).cast("string"))
    rows = _symmetric(spark, d).withColumn("origin_uic", F.coalesce(alternate, "origin_uic"))
    return _stored(spark, NW.build_network(table(spark, d, "packed_stations"), rows, table(spark, d, "transfer_groups")))


@query
def stop_segments(spark, d):
    return _segments(spark, d)


@query
def class_durations(spark, d):
    return NW.class_durations(_segments(spark, d), _classes(spark, d))


@query
def connections(spark, d):
    return _connections(spark, d)


@query
def symmetric_edges(spark, d):
    return _symmetric(spark, d)


@query
def named_edges(spark, d):
    return NW.with_names(_connections(spark, d), table(spark, d, "stops"))


@query
def edge_costs(spark, d):
    return _symmetric(spark, d).select("origin_uic", "destination_uic", "line_code",
                                       X.routing_cost("duration_minutes", "line_code").cast("double").alias("cost"),
                                       X.clock_label("duration_minutes").alias("label"))


@query
def duration_summary(spark, d):
    out = NW.duration_summary(_symmetric(spark, d))
    return _rounded(out, "mean", "std", "p25", "p50", "p75")


@query
def class_counts(spark, d):
    return NW.class_counts(_symmetric(spark, d))


@query
def override_merge(spark, d):
    return NW.override_merge(_connections(spark, d), table(spark, d, "extra_edges"))


@query
def insert_missing(spark, d):
    return NW.insert_missing(_connections(spark, d), table(spark, d, "extra_edges"))


@query
def new_keys(spark, d):
    return NW.key_overlap(_connections(spark, d), table(spark, d, "extra_edges"))


@query
def set_connections(spark, d):
    city = lambda n: _stations(spark, d).filter(F.col("city_name") == n).select(F.col("uic_code").alias("uic"))
    return NW.between_sets(_connections(spark, d), city("Paris"), city("Lyon"))


@query
def station_aliases(spark, d):
    return NW.station_alias(table(spark, d, "packed_stations"))


@query
def alias_edges(spark, d):
    net = _packed_network(spark, d)
    return net.edges.filter(F.col("line_code") != "CORRESP").select(
        "src", "dst", "minutes", "line_code", F.col("cost").cast("double").alias("cost"))


@query
def transfer_edges(spark, d):
    net = _packed_network(spark, d)
    return net.edges.filter(F.col("line_code") == "CORRESP").select(
        "src", "dst", "minutes", F.col("cost").cast("double").alias("cost"))


@query
def subset_stations(spark, d):
    wanted = table(spark, d, "transfer_groups").select("uic")
    return NW.subset_stations(table(spark, d, "packed_stations"), wanted).select("uic_code", "station_name")


# ------------------------------------------------------------------------------ graph

def _support(spark, d) -> tuple[DataFrame, DataFrame]:
    edges, _ = TableStore(spark, "support").write(table(spark, d, "support_graph"), "edges")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes, edges


@query
def degree_stats(spark, d):
    net = _flat_network(spark, d)
    return _rounded(GR.degree_stats(net.nodes, net.edges), "avg_degree")


@query
def neighbours(spark, d):
    net = _flat_network(spark, d)
    return GR.neighbours(net.nodes, net.edges, net.nodes.select("uic"))


@query
def top_connected(spark, d):
    net = _flat_network(spark, d)
    return GR.top_connected(net.nodes, net.edges, 10)


@query
def station_lookup(spark, d):
    asked = table(spark, d, "extra_edges").select(F.col("destination_uic").alias("uic")).distinct()
    nodes = _flat_network(spark, d).nodes
    return GR.station_info(nodes, asked).select("uic", "station_name", "city_name", _r("latitude").alias("latitude"))


@query
def components(spark, d):
    return GR.connected_components(*_support(spark, d))


@query
def component_summary(spark, d):
    return GR.component_summary(GR.connected_components(*_support(spark, d)))


@query
def hop_diameter(spark, d):
    net = _flat_network(spark, d)
    linked = net.edges.select(F.col("src").alias("node")).distinct()
    return GR.hop_diameter(linked, net.edges).drop("searches")


def _od_pairs(spark, d) -> DataFrame:
    """Station pairs of the labelled orders (four stations of each place, by order), plus unknown codes."""
    code = lambda k, turn: (F.col(k) + 87000000 + 25 * (turn % 4)).cast("string")
    place = lambda end: table(spark, d, "places").select(F.col("name").alias(end), F.col("k").alias(f"{end}_k"))
    turn = F.col("sentenceID")
    rows = table(spark, d, "orders_text").filter(F.col("is_valid") == 1)
    return (rows.join(place("origin"), "origin").join(place("destination"), "destination")
            .select(code("origin_k", turn).alias("origin_uic"), code("destination_k", F.floor(turn / 4)).alias("destination_uic"))
            .unionByName(table(spark, d, "extra_edges").select(
                F.lit("87000003").alias("origin_uic"), (F.col("origin_uic").cast("bigint") + 900000).cast("string").alias("destination_uic")))
            .distinct())


def _paths(spark, d) -> tuple[NW.Network, DataFrame]:
    net = _flat_network(spark, d)
    return net, GR.shortest_paths(net.nodes, net.edges, _od_pairs(spark, d))


@query
def shortest_paths(spark, d):
    _, paths = _paths(spark, d)
    return paths.select("origin_uic", "destination_uic", _joined("path").alias("path"),
                        F.col("cost").cast("double").alias("cost"), "minutes", F.col("hops").cast("int").alias("hops"), "error")


@query
def route_records(spark, d):
    net, paths = _paths(spark, d)
    return GR.route_records(paths, net.nodes).select(
        "origin_uic", "destination_uic", "origin_name", "destination_name", "success", _joined("stations").alias("stations"),
        "total_time", F.col("num_stops").cast("int").alias("num_stops"), F.col("error").isNotNull().alias("failed"))


@query
def route_segments(spark, d):
    net, paths = _paths(spark, d)
    return GR.route_segments(paths, net.nodes, net.edges, ["origin_uic", "destination_uic"]).drop("distance_km")


@query
def given_route_time(spark, d):
    """The calls of every trip as a given route; some trips end at an unknown station."""
    net = _flat_network(spark, d)
    calls = table(spark, d, "stop_times").select("trip_id", F.col("stop_sequence").alias("pos"),
                                                 X.station_code("stop_id").alias("uic"))
    lost = calls.select("trip_id").distinct().filter(F.col("trip_id").cast("bigint") % 11 == 0).select(
        "trip_id", F.lit(2**63 - 1).alias("pos"), F.lit("99999999").alias("uic"))
    return GR.given_stops_time(calls.unionByName(lost), net.nodes, net.edges, "trip_id")


@query
def route_coordinates(spark, d):
    net, paths = _paths(spark, d)
    records = GR.route_records(paths, net.nodes).filter("success")
    renamed = F.transform("stations", lambda s, i: F.when(i % 2 == 0, F.upper(s)).otherwise(F.split(s, " ")[0]))
    places = _stations(spark, d).select("station_name", "city_name", "latitude", "longitude", "seq")
    found = GR.route_coordinates(records.withColumn("stations", renamed), places, ["origin_uic", "destination_uic"])
    return _rounded(found, "latitude", "longitude")


@query
def nearest_station(spark, d):
    sites = _stations(spark, d).select(F.col("uic_code").alias("uic"), "latitude", "longitude")
    return _rounded(NW.nearest_station(table(spark, d, "line_ends"), sites, radius_km=20.0), "distance_km")


@query
def nearest_station_world(spark, d):
    return _rounded(NW.nearest_station(table(spark, d, "world_points"), table(spark, d, "world_sites"), radius_km=500.0), "distance_km")


@query
def network_quality(spark, d):
    net = _packed_network(spark, d)
    parts = GR.connected_components(net.nodes.select(F.col("uic").alias("node")), net.edges.select("src", "dst"))
    return _rounded(NW.network_quality(net, parts), "value")


@query
def main_component_members(spark, d):
    parts = GR.connected_components(*_support(spark, d))
    named = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("uic"))
    return NW.in_main_component(parts, named)


# ------------------------------------------------------------------------- resolution

def _resolved(spark, d, mode: str) -> DataFrame:
    foreign = GZ.build_gazetteer(table(spark, d, "place_names").filter(F.col("name").isin("Nice", "Metz"))).select("norm")
    return RS.resolve_orders(_extracted(spark, d), _city_map(spark, d), _flat_network(spark, d), foreign, mode)


@query
def route_orders(spark, d):
    return _resolved(spark, d, "nlp").select(
        "sentence_id", "origin", "destination", "origin_uic", "destination_uic", "valid", _joined("route").alias("route"),
        _joined("path").alias("path"), "total_time", "success", "error_type")


@query
def resolution_counters(spark, d):
    return RS.resolution_counters(_resolved(spark, d, "nlp"))


@query
def wide_route_table(spark, d):
    rows, _ = TableStore(spark, "wide").write(
        _resolved(spark, d, "route").select(F.col("sentence_id").alias("sentenceID"), "route"), "rows")
    return wide_routes(rows)


@query
def resolve_from_labels(spark, d):
    labelled = LB.bio_labels(table(spark, d, "orders_text"), _gaz(spark, d)).drop("origin", "destination")
    return RS.extract_from_labels(labelled, _gaz(spark, d)).select("sentenceID", "origin", "destination", "valid")


# ------------------------------------------------------------------------- evaluation

def _compared(spark, d, how: str = "left", preds: str = "preds") -> DataFrame:
    return EV.compare(table(spark, d, "orders_text"), table(spark, d, preds), how)


@query
def accuracy(spark, d):
    return _rounded(EV.accuracy(_compared(spark, d)), "origin_accuracy", "destination_accuracy", "exact_match_accuracy")


@query
def validity_prf(spark, d):
    return _rounded(EV.validity(_compared(spark, d)), "validity_accuracy", "validity_precision", "validity_recall", "validity_f1")


@query
def confusion(spark, d):
    return EV.confusion(_compared(spark, d))


@query
def quality_confusion(spark, d):
    """D4 on document labels against a length rule."""
    truth = table(spark, d, "labels").select(F.col("doc_id").alias("sentenceID"), F.col("quality").alias("is_valid"),
                                             F.lit("").alias("origin"), F.lit("").alias("destination"))
    guess = F.when(F.col("n_chars") >= 200, F.col("lang")).otherwise(F.lit("INVALID"))
    preds = table(spark, d, "documents").select(F.col("doc_id").alias("sentenceID"), guess.alias("origin"),
                                                guess.alias("destination"))
    return EV.confusion(EV.compare(truth, preds))


@query
def robustness(spark, d):
    return _rounded(EV.robustness(_compared(spark, d)), "accuracy")


@query
def slice_breakdown(spark, d):
    return _rounded(EV.slice_breakdown(_compared(spark, d)), "accuracy")


@query
def evaluation_summary(spark, d):
    summary, _, _ = EV.full_evaluation(table(spark, d, "orders_text"), table(spark, d, "preds"))
    return _rounded(summary, *[c for c, t in summary.dtypes if t == "double"])


@query
def evaluation_slices(spark, d):
    return _rounded(EV.full_evaluation(table(spark, d, "orders_text"), table(spark, d, "preds"))[1], "accuracy")


@query
def evaluation_robustness(spark, d):
    return _rounded(EV.full_evaluation(table(spark, d, "orders_text"), table(spark, d, "preds"))[2], "accuracy")


@query
def simple_accuracy(spark, d):
    rows = _extracted(spark, d).select(F.col("origin"), F.col("destination"), "sentenceID")
    truth = table(spark, d, "orders_text").select(
        "sentenceID", F.nullif("origin", F.lit("")).alias("expected_origin"),
        F.nullif("destination", F.lit("")).alias("expected_destination"))
    return _rounded(EV.simple_accuracy(rows.join(truth, "sentenceID")), "accuracy", "origin_accuracy", "destination_accuracy")


@query
def whole_set_eval(spark, d):
    out = EV.whole_set(EV.compare(table(spark, d, "orders_text"), _extracted(spark, d)))
    return _rounded(out, "accuracy", "origin_accuracy", "dest_accuracy", "precision", "recall", "f1_score")


@query
def fuzzy_accuracy(spark, d):
    blur = lambda c: F.when(F.col("sentenceID") % 3 == 0, F.expr(f"substring({c}, 1, length({c}) - 1)")).otherwise(F.col(c))
    preds = table(spark, d, "preds").select("sentenceID", blur("origin").alias("origin"), blur("destination").alias("destination"))
    joined = EV.compare(table(spark, d, "orders_text"), preds)
    return _rounded(EV.fuzzy_accuracy(joined, _gaz(spark, d)), "accuracy")


@query
def error_distribution(spark, d):
    return EV.error_distribution(_compared(spark, d, "inner"))


@query
def error_kinds(spark, d):
    return EV.error_kinds(_compared(spark, d, "inner"))


@query
def misidentified_places(spark, d):
    return _rounded(EV.misidentified(_compared(spark, d, "inner"), 10), "error_rate")


@query
def slice_ranking(spark, d):
    return EV.slice_ranking(_compared(spark, d, "inner"))


@query
def difficulty_ranking(spark, d):
    return EV.slice_ranking(_compared(spark, d, "inner"), "difficulty")


@query
def worst_slices(spark, d):
    return _rounded(EV.worst_slices(EV.slice_breakdown(_compared(spark, d)), 3), "accuracy")


@query
def failure_examples(spark, d):
    return EV.failure_examples(_compared(spark, d, "inner"), 5).withColumn("rank", F.col("rank").cast("int"))


@query
def hard_failures(spark, d):
    return EV.failure_examples(_compared(spark, d), 10, difficulty="hard").withColumn("rank", F.col("rank").cast("int"))


@query
def model_comparison(spark, d):
    out = EV.compare_models(EV.slice_breakdown(_compared(spark, d)),
                            EV.slice_breakdown(_compared(spark, d, preds="other_preds")), 3)
    return _rounded(out, "base_accuracy", "other_accuracy", "improvement")


@query
def findings(spark, d):
    joined = _compared(spark, d)
    return _rounded(EV.findings(EV.metric_rows(joined), EV.finding_rules(spark)), "value", "threshold")


# ---------------------------------------------------------------------------- dataset

def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders_text")


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("sentenceID"), F.col("text").alias("sentence"), "lang")


@query
def dedupe_resequence(spark, d):
    return DS.dedupe_resequence(_orders(spark, d))


@query
def dedupe_documents(spark, d):
    return DS.dedupe_resequence(_documents(spark, d)).select(
        "sentenceID", F.md5("sentence").alias("sentence_md5"), "lang")


@query
def trim_exact(spark, d):
    return DS.trim_exact(_orders(spark, d), 1000).select("sentenceID", "sentence", "category")


@query
def shuffle_resequence(spark, d):
    return DS.shuffle_resequence(_orders(spark, d)).select("sentenceID", "sentence", "category")


@query
def top_up(spark, d):
    rows = _orders(spark, d)
    return DS.top_up(rows.filter(F.col("is_valid") == 0), rows.filter(F.col("is_valid") == 1), 2000) \
        .select("sentenceID", "sentence", "category")


@query
def sample_per_category(spark, d):
    return DS.sample_per_category(_orders(spark, d), 5).select("sentenceID", "sentence", "category")


@query
def stratified_split(spark, d):
    return DS.stratified_split(_orders(spark, d)).select("sentenceID", "is_valid", "split")


@query
def split_leakage(spark, d):
    """Splits of two different seeds put together, which must leak."""
    first = DS.stratified_split(_orders(spark, d)).select("sentenceID", "split")
    second = DS.stratified_split(_orders(spark, d), seed=7).select("sentenceID", "split")
    return DS.leaked_ids(first.unionByName(second))


@query
def split_overlap(spark, d):
    first = DS.stratified_split(_orders(spark, d)).filter(F.col("split") == "test")
    second = DS.stratified_split(_orders(spark, d), seed=7).filter(F.col("split") == "test")
    return DS.common_ids(first, second)


@query
def split_crosstab(spark, d):
    out = DS.split_crosstab(DS.stratified_split(_orders(spark, d)))
    return _rounded(out, "train_share", "val_share", "test_share")


@query
def split_stats(spark, d):
    return _rounded(DS.split_stats(DS.stratified_split(_orders(spark, d))), "avg_words_valid", "avg_words_invalid")


@query
def dataset_stats(spark, d):
    return _rounded(DS.dataset_stats(_orders(spark, d)), "percent")


@query
def length_stats(spark, d):
    return _rounded(DS.length_stats(_orders(spark, d)), "avg_words")


@query
def place_usage(spark, d):
    return DS.place_usage(_orders(spark, d), 20)


@query
def structure_check(spark, d):
    return _rounded(DS.structure_check(_orders(spark, d), 15000), "expected", "actual")


@query
def duplicate_sentences(spark, d):
    return DS.duplicate_sentences(_orders(spark, d))


@query
def sequence_check(spark, d):
    return DS.sequence_check(_orders(spark, d))


@query
def file_order_check(spark, d):
    shuffled = _orders(spark, d).select((F.col("sentenceID") + 1).alias("sentenceID"),
                                        (F.col("sentenceID") - 20 * (F.col("sentenceID") % 9)).alias("s"), "sentence")
    return DS.in_file_order(shuffled.withColumn("seq", F.col("s") * 1000000 + F.col("sentenceID")), "seq")


@query
def distribution_check(spark, d):
    return _rounded(DS.distribution_check(_orders(spark, d), table(spark, d, "targets"), table(spark, d, "shares")),
                    "expected", "actual")


@query
def expand_templates(spark, d):
    places = table(spark, d, "supplier_places")
    return DS.expand_templates(table(spark, d, "templates"), places, 3, places.count(),
                               marks=("[origin]", "[destination]")).drop("is_valid", "notes")


@query
def sample_templates(spark, d):
    places = table(spark, d, "supplier_places")
    size = places.count()
    return DS.expand_templates(table(spark, d, "templates"), places, 3, size, marks=("[origin]", "[destination]"),
                               n=20 * size).drop("is_valid", "notes")


@query
def misspelt_places(spark, d):
    variants = F.when(F.col("name") == "Paris", F.array(F.lit("Pari"), F.lit("Parris")))
    names = table(spark, d, "places").select("name").union(table(spark, d, "part").select("p_name")).distinct()
    return names.select("name", DS.misspell(F.col("name"), variants).alias("misspelt"))


# ------------------------------------------------- files out and in

def _folder(spark, label: str) -> str:
    return TableStore(spark, label).path


#: Most rows of a CSV file or so; it is one task's work.
_FILE_ROWS = 500_000


def _csv(df: DataFrame, path: str) -> str:
    """Several CSV files with a header each, as many as the counted rows need."""
    df.repartition(max(3, -(-df.count() // _FILE_ROWS))).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query
def orders_file(spark, d):
    return RD.read_orders(spark, _csv(_orders(spark, d).select("sentenceID", "sentence"), _folder(spark, "orders-file")))


@query
def orders_file_lines(spark, d):
    """Read in splits although values hold line breaks."""
    return RD.read_orders(spark, _csv(table(spark, d, "broken_lines"), _folder(spark, "orders-lines")), multi_line=True)


@query
def flat_file(spark, d):
    path = _folder(spark, "flat-file")
    WR.write_flat(_orders(spark, d).select("sentenceID", F.col("origin").alias("Departure"), F.col("destination").alias("Destination")), path)
    return spark.read.option("header", True).csv(path).na.fill("")


@query
def batch_counters(spark, d):
    orders = _csv(_orders(spark, d).select("sentenceID", "sentence"), _folder(spark, "batch-in"))
    foreign = GZ.build_gazetteer(table(spark, d, "place_names").filter(F.col("name").isin("Nice", "Metz"))).select("norm")
    return RS.run_batch(orders, _folder(spark, "batch-out"), "nlp", _gaz(spark, d), _city_map(spark, d), _flat_network(spark, d), foreign)


@query
def timetable_files(spark, d):
    folder = _folder(spark, "timetable")
    for name in ("stops", "routes", "trips", "stop_times"):
        _csv(table(spark, d, name).select(*[c.strip().split(" ")[0] for c in RD.GTFS_COLUMNS[name].split(",")]), f"{folder}/{name}.txt")
    read = {name: RD.read_gtfs(spark, folder, name) for name in ("routes", "trips", "stop_times")}
    return NW.connections(NW.stop_segments(read["stop_times"]), NW.trip_classes(read["trips"], read["routes"]))


@query
def station_file(spark, d):
    rows = RD.read_stations(spark, _csv(_stations(spark, d).drop("seq"), _folder(spark, "station-file")))
    return rows.select("uic_code", "station_name", "station_name_normalized", "city_name", "city_name_normalized",
                       _r("latitude").alias("latitude"), _r("longitude").alias("longitude"))


@query
def gazetteer_file(spark, d):
    path = _folder(spark, "gazetteer-file")
    aliases = table(spark, d, "place_names").select(F.lower("name").alias("canonical_norm"), F.upper("name").alias("alias"))
    WR.write_gazetteer_json(table(spark, d, "all_names"), aliases, path)
    names, read = RD.read_gazetteer_json(spark, path)
    return names.select("name", "kind").unionByName(read.select(F.col("alias").alias("name"), F.lit("alias").alias("kind")))


@query
def gazetteer_rows(spark, d):
    path = _folder(spark, "gazetteer-rows")
    aliases = table(spark, d, "place_names").select(F.lower("name").alias("canonical_norm"), F.upper("name").alias("alias"))
    WR.write_gazetteer_rows(table(spark, d, "all_names"), aliases, path)
    names, read = RD.read_gazetteer_rows(spark, path)
    return names.select("name", "kind", "seq").unionByName(
        read.select(F.col("alias").alias("name"), F.lit("alias").alias("kind"), F.lit(None).cast("bigint").alias("seq")))


@query
def connection_file(spark, d):
    rows = RD.read_connections(spark, _csv(_connections(spark, d), _folder(spark, "connection-file")))
    return rows.select("origin_uic", "destination_uic", "duration_minutes", "line_code", F.col("trip_count").cast("bigint").alias("trip_count"))


@query
def city_map_file(spark, d):
    path = _folder(spark, "city-map-file")
    WR.write_sorted(table(spark, d, "city_rows"), ["seq"], path)
    return ST.city_station_map(RD.read_city_map(spark, path)).select("city_norm", "uic")


@query
def report_file(spark, d):
    path = _folder(spark, "report-file")
    compared = EV.full_evaluation(_orders(spark, d), table(spark, d, "preds"))
    WR.write_report(WR.evaluation_report(*compared, "rules", "orders"), path)
    read = spark.read.json(path).select(F.explode("slices").alias("s")).select("s.*")
    return _rounded(read, "accuracy")


@query
def batch_route_counters(spark, d):
    orders = _csv(_orders(spark, d).select("sentenceID", "sentence"), _folder(spark, "batch-in"))
    foreign = GZ.build_gazetteer(table(spark, d, "place_names").filter(F.col("name").isin("Nice", "Metz"))).select("norm")
    return RS.run_batch(orders, _folder(spark, "batch-out"), "route", _gaz(spark, d), _city_map(spark, d), _flat_network(spark, d), foreign)


@query
def utf8_files(spark, d):
    """Raw bytes written as they are, a file for each part, with faults of five kinds."""
    path = _folder(spark, "utf8-files")
    fault = F.coalesce(F.get(F.array(*[F.unhex(F.lit(h)) for h in ("C3", "C0AF", "EDA080", "80", "F09F98")]), F.col("fault").cast("int") - 1), F.unhex(F.lit("")))
    mark = F.when(F.col("marked") == 1, F.unhex(F.lit("EFBFBD"))).otherwise(F.unhex(F.lit("")))
    line = F.concat(F.encode("body", "UTF-8"), mark, fault, F.encode(F.lit(" end"), "UTF-8")).cast("string")
    (table(spark, d, "broken_texts").select("part", "doc_id", line.alias("value")).repartition("part")
     .sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path))
    bad = RD.invalid_utf8_files(spark, f"{path}/*/*.txt")
    return bad.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("bigint").alias("part"), "length", "first_bad_byte")


@query
def sorted_file(spark, d):
    path = _folder(spark, "sorted-file")
    WR.write_sorted(_orders(spark, d).select("sentenceID", "category"), ["category", "sentenceID"], path)
    read = RD.with_file_order(spark.read.option("header", True).csv(path))
    return DS.ordinal(read, ["seq"], "place").select(F.col("sentenceID").cast("bigint").alias("sentenceID"), "category", "place")


@query
def error_file(spark, d):
    path = _folder(spark, "error-file")
    WR.write_errors(_orders(spark, d).filter(F.col("is_valid") == 0).select("sentenceID", "sentence"), path)
    return RD.read_orders(spark, path)


@query
def token_file(spark, d):
    path = _folder(spark, "token-file")
    WR.write_token_examples(_labelled(spark, d).select("tokens", "labels"), path)
    return _rounded(LB.label_stats(RD.read_token_examples(spark, path, json_lines=True)), "share")


@query
def network_snapshot(spark, d):
    path = _folder(spark, "snapshot")
    WR.get_or_build_network(spark, path, lambda: _flat_network(spark, d))
    net = WR.load_network(spark, path)
    return _rounded(GR.degree_stats(net.nodes, net.edges), "avg_degree")


# -------------------------------------------------------------------------- streaming

def _drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything available and read its file sink back."""
    spark = stream.sparkSession
    store = TableStore(spark, label)
    started = (stream.writeStream.format("parquet").option("path", f"{store.path}/out")
               .option("checkpointLocation", f"{store.path}/progress").trigger(availableNow=True).start())
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{store.path}/out")


def _stream_parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stream of orders, city map, and routes of the pairs in demand."""
    orders, _ = TableStore(spark, "stream").write(_orders(spark, d).select("sentenceID", "sentence"), "orders")
    source = spark.readStream.schema(orders.schema).parquet(orders.inputFiles()[0].rsplit("/", 1)[0])
    net = _flat_network(spark, d)
    cities = _city_map(spark, d)
    asked = ST.map_cities(_extracted(spark, d), "origin", cities, "origin_uic")
    asked = ST.map_cities(asked, "destination", cities, "destination_uic")
    pairs = asked.select("origin_uic", "destination_uic").dropna().distinct()
    routes, _ = TableStore(spark, "stream").write(GR.shortest_paths(net.nodes, net.edges, pairs), "routes")
    return source, cities, routes


def _stream_columns(out: DataFrame) -> DataFrame:
    return out.select("sentenceID", "origin", "destination", "origin_uic", "destination_uic", "valid", "method",
                      _joined("path").alias("path"), "total_time", "success")


@query
def stream_resolve(spark, d):
    source, cities, routes = _stream_parts(spark, d)
    return _stream_columns(_drain(SM.resolve_stream(source, _gaz(spark, d), cities, routes), "stream-resolve"))


@query
def stream_resolve_batches(spark, d):
    """With a name for each order line in the dictionary, more than travel with a plan."""
    source, cities, routes = _stream_parts(spark, d)
    path = _folder(spark, "stream-batches")
    names = table(spark, d, "place_names").unionByName(table(spark, d, "line_names"))
    SM.resolve_batches(source, GZ.build_gazetteer(names), cities, routes, SM.batch_tables(f"{path}/out"), f"{path}/progress").awaitTermination()
    return _stream_columns(SM.read_batches(source, f"{path}/out"))


@query
def stream_first_seen(spark, d):
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    first = SM.first_seen(events.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days")
    return _drain(first, "stream-first-seen").select("user_id", "event_type")
