"""Input views that bind the operators to the given tables.

Each view is one SQL text that both engines run. ``{name}`` refers to a given
table or to another view; no view drops rows to become cheaper.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from itinera.plans.session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Tables whose rows feed dear expressions; the others are small or cheap to read.
SPREAD = {"documents", "lineitem", "orders", "pages"}

# The places of the labelled orders, keyed like nations.
PLACES = ["Paris", "Lyon", "Marseille", "Toulouse", "Bordeaux", "Nice", "Nantes",
          "Strasbourg", "Montpellier", "Lille", "Rennes", "Reims", "Le Havre",
          "Saint-Étienne", "Toulon", "Grenoble", "Dijon", "Angers", "Nîmes",
          "Villeurbanne", "Clermont-Ferrand", "Limoges", "Tours", "Amiens", "Metz"]

_PLACE_ROWS = ", ".join(f"({k}, '{name}')" for k, name in enumerate(PLACES))

VIEWS: dict[str, str] = {
    # places and dictionary names
    "places": f"SELECT k, name FROM (VALUES {_PLACE_ROWS}) AS t(k, name)",
    "place_names": "SELECT name, 'city' AS kind, CAST(k AS BIGINT) AS seq FROM {places}",
    # labelled orders
    "orders_text": """
        SELECT id AS sentenceID,
               CASE t WHEN 0 THEN 'Je veux aller de ' || o || ' à ' || d
                      WHEN 1 THEN 'Train pour ' || d || ' depuis ' || o
                      WHEN 2 THEN 'Je voudrais un billet ' || o || ' ' || d
                      WHEN 3 THEN lower('je veux aller de ' || o || ' a ' || d)
                      WHEN 4 THEN 'Je veux aller de ' || substring(o, 1, length(o) - 1) || ' à ' || d
                      WHEN 5 THEN 'Comment me rendre à ' || d || ' depuis ' || o
                      WHEN 6 THEN 'Quel temps fait-il à ' || o || '?'
                      WHEN 7 THEN 'Je pars demain'
                      WHEN 8 THEN 'Je pars de ' || o
                      ELSE 'Je vais de ' || o || ' à ' || o END AS sentence,
               CASE WHEN t < 6 THEN o ELSE '' END AS origin,
               CASE WHEN t < 6 THEN d ELSE '' END AS destination,
               CASE WHEN t < 6 THEN 1 ELSE 0 END AS is_valid,
               CASE WHEN t IN (1, 5, 9) THEN 'medium' WHEN t = 4 THEN 'hard' ELSE 'easy' END AS difficulty,
               CASE t WHEN 0 THEN 'standard' WHEN 1 THEN 'inverted_order' WHEN 2 THEN 'no_markers'
                      WHEN 3 THEN 'no_capitals' WHEN 4 THEN 'misspelling' WHEN 5 THEN 'inverted_order'
                      WHEN 6 THEN 'no_intent' WHEN 7 THEN 'no_intent' WHEN 8 THEN 'incomplete_dest'
                      ELSE 'ambiguous' END AS category,
               '' AS notes
        FROM (SELECT o_orderkey AS id, CAST(o_orderkey % 10 AS INT) AS t, po.name AS o, pd.name AS d
              FROM {orders} JOIN {customer} ON o_custkey = c_custkey
              JOIN {places} po ON po.k = c_nationkey
              JOIN {places} pd ON pd.k = (c_nationkey + 1 + c_custkey % 24) % 25) x""",
    # predictions: valid rows perturbed by a hash of the id
    "preds": """
        SELECT sentenceID,
               CASE WHEN h IN (11, 12) THEN destination WHEN h = 13 THEN 'INVALID' ELSE origin END AS origin,
               CASE WHEN h IN (11, 12) THEN origin WHEN h = 14 THEN origin ELSE destination END AS destination
        FROM (SELECT sentenceID, origin, destination,
                     instr('0123456789abcdef', substring(md5('42|' || CAST(sentenceID AS STRING)), 1, 1)) - 1 AS h
              FROM {orders_text} WHERE is_valid = 1) x
        WHERE h < 15""",
    # timetable
    "stop_times": """
        SELECT CAST(l_orderkey AS STRING) AS trip_id,
               ((CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 10000000 + l_suppkey) * 100
                   + CAST(l_quantity AS BIGINT) AS stop_sequence,
               'StopPoint:OCE-' || CAST(87000000 + l_suppkey AS STRING) AS stop_id,
               lpad(CAST(CAST(floor(dep / 3600) AS INT) AS STRING), 2, '0') || ':' ||
               lpad(CAST(CAST(floor(dep / 60) AS INT) % 60 AS STRING), 2, '0') || ':' ||
               lpad(CAST(dep % 60 AS STRING), 2, '0') AS departure_time
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                     75600 + 1800 * l_linenumber + 60 * CAST(l_quantity AS INT) AS dep FROM {lineitem}) x""",
    "stops": """
        SELECT 'StopPoint:OCE-' || CAST(87000000 + s_suppkey AS STRING) AS stop_id,
               name || CASE CAST(floor(s_suppkey / 25) AS INT) % 5 WHEN 0 THEN '' WHEN 1 THEN ' Gare de Lyon'
                            WHEN 2 THEN ' TGV' WHEN 3 THEN ' Centre' ELSE ' Part Dieu' END AS stop_name,
               41 + CAST(s_suppkey * 37 % 1000 AS DOUBLE) / 100 AS stop_lat,
               -5 + CAST(s_suppkey * 53 % 1500 AS DOUBLE) / 100 AS stop_lon,
               s_suppkey AS seq
        FROM {supplier} JOIN {places} ON k = s_suppkey % 25""",
    "routes": """
        SELECT route_id, route_short_name, route_long_name FROM (VALUES
            ('R0', '001G', 'Paris - Lyon TGV Inoui'), ('R1', 'IC', 'Intercités de nuit'),
            ('R2', 'TER', 'Lyon - Dijon'), ('R3', '', 'TER Nice - Cannes'),
            ('R4', '', 'Nice Ville'), ('R5', '', ''), ('R6', '', 'Materiel'), ('R7', '', ''))
            AS t(route_id, route_short_name, route_long_name)""",
    "trips": """SELECT CAST(o_orderkey AS STRING) AS trip_id,
                       'R' || CAST(o_orderkey % 8 AS STRING) AS route_id FROM {orders}""",
    # city -> station rows; every fifth station belongs to a longer city name
    "city_rows": """
        SELECT translate(lower(name), 'éîè', 'eie')
                   || CASE WHEN s_suppkey % 5 = 4 THEN '-sur-' || CAST(s_suppkey AS STRING) ELSE '' END
                   AS city_name_normalized,
               name AS station_name,
               CAST(87000000 + s_suppkey AS STRING)
                   || CASE WHEN s_suppkey % 7 = 0 THEN ';' || CAST(88000000 + s_suppkey AS STRING) ELSE '' END
                   AS uic_code,
               s_suppkey AS seq
        FROM {supplier} JOIN {places} ON k = s_suppkey % 25""",
    # all supplier-part pairs, one large component, and all customer-order pairs, a component for each customer
    "support_graph": """
        SELECT DISTINCT 's' || CAST(l_suppkey AS STRING) AS src, 'p' || CAST(l_partkey AS STRING) AS dst FROM {lineitem}
        UNION ALL SELECT 'c' || CAST(o_custkey AS STRING) AS src, 'o' || CAST(o_orderkey AS STRING) AS dst FROM {orders}""",
    # near-duplicate names
    "part_names": "SELECT p_name AS name, min(p_partkey) AS seq FROM {part} GROUP BY p_name",
    "typo_names": """
        SELECT DISTINCT CASE WHEN p_partkey % 2 = 0
                   THEN substring(p_name, 1, cut) || substring(p_name, cut + 2)
                   ELSE substring(p_name, 1, cut + 1) || substring(p_name, cut + 1) END AS query
        FROM (SELECT p_name, p_partkey, CAST(p_partkey % length(p_name) AS INT) AS cut FROM {part}) x""",
    # dictionary of both name families, and what people type for them
    "all_names": """
        SELECT name, 'city' AS kind, CAST(k AS BIGINT) AS seq FROM {places}
        UNION ALL SELECT name, 'station' AS kind, 1000 + seq AS seq FROM {part_names}""",
    "typed_names": """
        SELECT query FROM {typo_names}
        UNION SELECT substring(origin, 1, length(origin) - 1) AS query FROM {orders_text} WHERE is_valid = 1
        UNION SELECT origin AS query FROM {orders_text} WHERE is_valid = 1
        UNION SELECT substring(p_name, 1, 4) AS query FROM {part}
        UNION SELECT substring(origin, 1, 5) AS query FROM {orders_text} WHERE is_valid = 1""",
    # sentences with an ambiguous first name in origin position
    "person_orders": """
        SELECT sentenceID,
               'Je pars ' || CASE sentenceID % 3 WHEN 0 THEN 'avec' WHEN 1 THEN 'de' ELSE 'Chez' END || ' '
                   || CASE WHEN sentenceID % 2 = 0 THEN 'Florence' ELSE origin END
                   || ' pour ' || CASE WHEN sentenceID % 5 = 0 THEN 'Nancy' ELSE destination END AS sentence,
               CASE WHEN sentenceID % 2 = 0 THEN 'Florence' ELSE origin END AS origin,
               CASE WHEN sentenceID % 5 = 0 THEN 'Nancy' ELSE destination END AS destination,
               is_valid
        FROM {orders_text} WHERE is_valid = 1""",
    # second model for comparisons: origin and destination always as given, a fifth swapped
    "other_preds": """
        SELECT sentenceID, CASE WHEN sentenceID % 5 = 0 THEN destination ELSE origin END AS origin,
               CASE WHEN sentenceID % 5 = 0 THEN origin ELSE destination END AS destination
        FROM {orders_text} WHERE is_valid = 1""",
    # category targets measured against the valid share of the table itself
    "targets": """
        SELECT category, expected FROM (VALUES ('standard', 1500), ('inverted_order', 3000), ('no_markers', 1500),
            ('misspelling', 1400), ('no_capitals', 1500), ('compound_name', 250), ('no_intent', 3000),
            ('ambiguous', 1000)) AS t(category, expected)""",
    "shares": """SELECT difficulty, CAST(share AS DOUBLE) AS share
                 FROM (VALUES ('easy', 0.30), ('medium', 0.50), ('hard', 0.20)) AS t(difficulty, share)""",
    "templates": """
        SELECT t, template, category, difficulty, lowered AS lower FROM (VALUES
            (0, 'Je veux aller de [origin] à [destination]', 'standard', 'easy', FALSE),
            (1, 'Train pour [destination] depuis [origin]', 'inverted_order', 'medium', FALSE),
            (2, 'Un billet [origin] [destination]', 'no_markers', 'easy', TRUE))
            AS t(t, template, category, difficulty, lowered)""",
    "supplier_places": "SELECT s_suppkey AS k, s_name AS name FROM {supplier}",
    # line end-points for the nearest-station search, one per customer
    "line_ends": """
        SELECT c_custkey AS point_id, 41 + CAST(c_custkey * 61 % 1000 AS DOUBLE) / 100 AS lat,
               -5 + CAST(c_custkey * 97 % 1500 AS DOUBLE) / 100 AS lon FROM {customer}""",
    # points and stations all over the globe, poles and both sides of 180 degrees among them
    "world_points": """
        SELECT c_custkey AS point_id, -90 + CAST(c_custkey * 61 % 1801 AS DOUBLE) / 10 AS lat,
               CASE c_custkey % 4 WHEN 0 THEN 179.95 WHEN 1 THEN -179.9 ELSE -180 + CAST(c_custkey * 97 % 3601 AS DOUBLE) / 10 END AS lon
        FROM {customer}""",
    "world_sites": """
        SELECT CAST(s_suppkey AS STRING) AS uic, -90 + CAST(s_suppkey * 37 % 1801 AS DOUBLE) / 10 AS latitude,
               CASE s_suppkey % 3 WHEN 0 THEN -179.98 WHEN 1 THEN 180.0 ELSE -180 + CAST(s_suppkey * 53 % 3601 AS DOUBLE) / 10 END AS longitude
        FROM {supplier}""",
    # texts of the documents with faulty bytes in some and a genuine replacement mark in others, in files of 100 numbers
    "broken_texts": """
        SELECT doc_id, CAST(floor(doc_id / 100) AS BIGINT) AS part, coalesce(text, '') AS body,
               CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS marked,
               CASE WHEN doc_id * 7919 % 97 = 1 THEN 1 + doc_id % 5 ELSE 0 END AS fault FROM {documents}""",
    # orders with line breaks, commas and quotes inside the sentence
    "broken_lines": """
        SELECT CAST(sentenceID AS STRING) AS sentenceID,
               CASE sentenceID % 4 WHEN 0 THEN sentence || chr(10) || 'le "' || category || '", merci' WHEN 1 THEN chr(10) || sentence || chr(10) || chr(10) || '.'
                                   WHEN 2 THEN '"' || sentence ELSE sentence END AS sentence FROM {orders_text}""",
    # a dictionary name for each order line; no order mentions one
    "line_names": """
        SELECT 'Ligne ' || CAST(l_orderkey AS STRING) || ' ' || CAST(l_linenumber AS STRING) AS name, 'station' AS kind,
               1000 + CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS seq FROM {lineitem}""",
    # dictionary aliases: each supplier's name stands for a place
    "supplier_aliases": "SELECT s_suppkey, s_name AS alias, name AS city FROM {supplier} JOIN {places} ON k = s_suppkey % 25",
    "typed_aliases": """
        SELECT 's' || CAST(s_suppkey AS STRING) AS id, upper(s_name) AS name FROM {supplier}
        UNION ALL SELECT 'c' || CAST(c_custkey AS STRING) AS id, c_name AS name FROM {customer}
        UNION ALL SELECT 'o' || CAST(sentenceID AS STRING) AS id, lower(origin) AS name FROM {orders_text}""",
    # stations whose code lists carry an alternate code
    "packed_stations": """
        SELECT CAST(87000000 + s_suppkey AS STRING)
                   || CASE WHEN s_suppkey % 7 = 0 THEN ';' || CAST(88000000 + s_suppkey AS STRING) ELSE '' END AS uic_code,
               name || ' ' || CAST(s_suppkey AS STRING) AS station_name,
               lower(name) AS station_name_normalized, name AS city_name, lower(name) AS city_name_normalized,
               CASE WHEN s_suppkey % 50 = 49 THEN NULL ELSE 41 + CAST(s_suppkey * 37 % 1000 AS DOUBLE) / 100 END AS latitude,
               CASE WHEN s_suppkey % 50 = 49 THEN NULL ELSE -5 + CAST(s_suppkey * 53 % 1500 AS DOUBLE) / 100 END AS longitude,
               CASE s_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C;A' ELSE NULL END AS segment_drg,
               s_suppkey AS seq
        FROM {supplier} JOIN {places} ON k = s_suppkey % 25""",
    # override edges: each station to another one, one way
    "extra_edges": """
        SELECT CAST(87000000 + s AS STRING) AS origin_uic, CAST(87000000 + t AS STRING) AS destination_uic,
               CAST(5 + s % 40 AS INT) AS duration_minutes, 'TGV' AS line_code, CAST(50 AS BIGINT) AS trip_count
        FROM (SELECT s_suppkey AS s, (s_suppkey * 7 + 1) % (SELECT count(*) FROM {supplier}) AS t FROM {supplier}) x
        WHERE s <> t""",
    # transfer groups: three main stations per city
    "transfer_groups": """
        SELECT name AS city, CAST(87000000 + s AS STRING) AS uic, s AS seq, CAST(15 AS INT) AS minutes
        FROM (SELECT s_suppkey % 25 AS c, min(s_suppkey) AS s FROM {supplier} GROUP BY s_suppkey % 25
              UNION SELECT s_suppkey % 25 AS c, max(s_suppkey) AS s FROM {supplier} GROUP BY s_suppkey % 25
              UNION SELECT s_suppkey % 25 AS c, max(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END) AS s
                    FROM {supplier} GROUP BY s_suppkey % 25) x JOIN {places} ON k = c WHERE s IS NOT NULL""",
}

_REF = re.compile(r"\{(\w+)\}")


def refs(name: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(VIEWS[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view as a DataFrame."""
    if name in VIEWS:
        return spark.sql(VIEWS[name], **{r: table(spark, sf_dir, r) for r in refs(name)})
    given = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(given) if name in SPREAD else given


def with_views(*names: str) -> list[tuple[str, str]]:
    """(name, sql) of the views and everything they need, in dependency order."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in VIEWS and name not in done:
            for r in refs(name):
                visit(r)
            done[name] = _REF.sub(r"\1", VIEWS[name])

    for name in names:
        visit(name)
    return list(done.items())
