"""Check SQL: the results of the registered queries, written independently for a SQL engine."""

from __future__ import annotations

from workload.views import with_views

ORACLES: dict[str, str] = {}

WS = (r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
W = r"[\p{L}\p{N}_]"
PREPOSITIONS = "de|depuis|à|a|pour|vers|du|des|au|aux"
CITIES = ("origin_uic", "destination_uic")


def add(name: str, select: str, views: str = "", ctes: list[tuple[str, str]] | None = None) -> None:
    parts = with_views(*views.split()) + list(ctes or [])
    head = ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in parts)
    ORACLES[name] = (f"WITH RECURSIVE {head} " if head else "") + select


# ------------------------------------------------------------------- text expressions

def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def bare(x: str, cedilla: bool) -> str:
    if not cedilla:
        return f"strip_accents({x})"
    guarded = f"strip_accents(replace(replace({x}, 'ç', chr(1)), 'Ç', chr(2)))"
    return f"replace(replace({guarded}, chr(1), 'ç'), chr(2), 'Ç')"


def marks(x: str) -> str:
    return f"translate(translate({x}, '–—−‐‑', '-----'), '’‘`´', '''''''''')"


def alnum(x: str) -> str:
    return squeeze(f"regexp_replace({x}, '[^a-zA-ZÀ-ÿ0-9{WS}\\-'']', ' ', 'g')")


def norm(x: str) -> str:
    return alnum("lower(" + squeeze(bare(marks(x), True)) + ")")


def fuzzy(x: str) -> str:
    return f"regexp_replace(lower({bare(x, False)}), '[^a-z0-9]', '', 'g')"


def station(x: str) -> str:
    return squeeze(f"regexp_replace(lower({bare(x, False)}), '[^\\p{{L}}\\p{{N}}_{WS}-]', '', 'g')")


def form(x: str) -> str:
    return (f"CASE WHEN coalesce({x}, '') = '' THEN '' WHEN upper({x}) = 'INVALID' THEN 'INVALID' "
            f"ELSE translate(trim(lower({x})), 'àáâäèéêëìíîïòóôöùúûüçñ', 'aaaaeeeeiiiioooouuuucn') END")


def label_tokens(x: str) -> str:
    shape = f"^([\\p{{L}}\\p{{N}}_'']+)([.,!?;:]+)?$"
    return (f"[t for t in flatten([CASE WHEN contains(w, '-') THEN string_split(replace(w, '-', chr(10) || '-' || chr(10)), chr(10)) "
            f"WHEN regexp_matches(w, '{shape}') THEN [regexp_extract(w, '{shape}', 1), regexp_extract(w, '{shape}', 2)] "
            f"ELSE [w] END for w in string_split({squeeze(x)}, ' ')]) if t <> '']")


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def rebuilt(x: str) -> str:
    return f"ltrim(replace(replace(coalesce(array_to_string({x}, ' '), ''), ' -', '-'), '- ', '-'), '-')"


def stripped(x: str) -> str:
    s = squeeze(x)
    return (f"CASE WHEN regexp_matches({s}, '(?i)^(?:(?:{PREPOSITIONS})(?: |$))*$') THEN {x} "
            f"ELSE regexp_replace({s}, '(?i)^(?:(?:{PREPOSITIONS}) )+', '') END")


def ratio(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 6)"


add("normalize_documents", f"""
    SELECT doc_id, md5(lower({squeeze('text')})) AS normalized, md5({bare('text', True)}) AS no_accents,
           md5({marks('text')}) AS marks, md5({alnum('text')}) AS alphanumeric, md5({norm('text')}) AS matching,
           md5({fuzzy('text')}) AS fuzzy, md5({station('text')}) AS station FROM documents""")

_TOK = f"{W}+(?:[-'']{W}+)*|[^\\p{{L}}\\p{{N}}_{WS}]"
add("tokenize_documents", f"""
    SELECT doc_id, len(a) AS n_words, md5({joined('a')}) AS words, len(b) AS n_tokens, md5({joined('b')}) AS tokens,
           len(c) AS n_parts, md5({joined('c')}) AS parts, len(d) AS n_label_tokens, md5({joined('d')}) AS label_tokens
    FROM (SELECT doc_id, regexp_extract_all(text, '{W}+') AS a, regexp_extract_all(text, '{_TOK}') AS b,
                 [p for p in string_split_regex(text, '[-{WS}]+') if p <> ''] AS c, {label_tokens('text')} AS d
          FROM documents)""")
add("quoted_fragments", f"""
    SELECT id, len(f) AS n, md5({joined('f')}) AS fragments
    FROM (SELECT id, list_concat(regexp_extract_all(text, '"([^"]*)"', 1), regexp_extract_all(text, '''([^'']*)''', 1)) AS f
          FROM (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages))""")
add("comparison_forms", f"""
    SELECT CAST(sentenceID AS VARCHAR) AS id, {form('origin')} AS origin_form, {form('destination')} AS destination_form,
           CAST(sentenceID AS VARCHAR) || ',' || coalesce(nullif(origin, ''), 'INVALID') || ','
               || coalesce(nullif(destination, ''), 'INVALID') AS line FROM preds""", "preds")
add("rebuild_names", f"""
    SELECT sentenceID, {rebuilt(label_tokens('sentence'))} AS rebuilt, {stripped("('De  à ' || origin)")} AS stripped
    FROM orders_text""", "orders_text")


# -------------------------------------------------------------------------- gazetteer

def gaz(source: str, name: str = "gaz") -> tuple[str, str]:
    return (name, f"""SELECT norm, arg_max(name, seq) AS canonical, arg_max(kind, seq) AS kind, min(seq) AS seq
                      FROM (SELECT {norm('name')} AS norm, name, kind, seq FROM {source}) GROUP BY norm""")


add("gazetteer_build", "SELECT norm, canonical, kind, seq FROM gaz", "all_names", [
    ("more", """SELECT * FROM all_names UNION ALL
                SELECT 'PARIS gare ' || CAST(s_suppkey % 40 AS VARCHAR), 'station', s_suppkey + 5000 FROM supplier"""),
    gaz("more")])
add("gazetteer_counts", """
    SELECT (SELECT count(DISTINCT name) FROM all_names WHERE kind = 'city') AS cities,
           (SELECT count(DISTINCT name) FROM all_names WHERE kind = 'station') AS stations,
           (SELECT count(*) FROM gaz) AS total_locations,
           35 + (SELECT count(*) FROM typo_names) AS aliases""", "all_names typo_names", [gaz("all_names")])
add("dictionary_lookup", f"""
    SELECT sentenceID, upper(origin) AS name, canonical, canonical IS NOT NULL AS is_member
    FROM preds LEFT JOIN gaz ON gaz.norm = {norm('upper(origin)')}""", "preds place_names", [gaz("place_names")])

add("alias_matches", f"""
    SELECT id, coalesce(gaz.canonical, a.canonical) AS canonical, coalesce(gaz.canonical, a.canonical) IS NOT NULL AS is_member
    FROM typed_aliases LEFT JOIN gaz ON gaz.norm = {norm('typed_aliases.name')}
    LEFT JOIN (SELECT {norm('alias')} AS n, g.canonical FROM supplier_aliases JOIN gaz g ON g.norm = {norm('city')}) a
        ON a.n = {norm('typed_aliases.name')}""", "typed_aliases supplier_aliases place_names", [gaz("place_names")])

MATCH = [
    gaz("place_names"),
    ("t1", f"SELECT *, {norm('sentence')} AS norm FROM orders_text"),
    ("t2", "SELECT *, string_split(norm, ' ') AS words FROM t1"),
    ("grams", """SELECT sentenceID, n, pos, array_to_string(words[pos:pos + n - 1], ' ') AS gram
                 FROM (SELECT sentenceID, words, n, unnest(range(1, len(words) - n + 2)) AS pos
                       FROM t2, (VALUES (1), (2), (3), (4)) v(n))"""),
    ("hits", """SELECT sentenceID, place, canonical, row_number() OVER (PARTITION BY sentenceID ORDER BY place_at) AS rank
                FROM (SELECT sentenceID, gaz.norm AS place, canonical, min(n * 100000 + pos) AS place_at
                      FROM grams JOIN gaz ON gram = gaz.norm WHERE n > 1 OR length(gram) >= 3
                      GROUP BY sentenceID, gaz.norm, canonical)"""),
]
for name in ("dict_ngram_match", "dict_ngram_match_join"):
    add(name, "SELECT sentenceID, rank, place, canonical FROM hits", "orders_text place_names", MATCH)


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_STOP = ["quel temps", "quelle heure est", "comment allez", "bonjour", "bonsoir", "merci", "azerty"]
_KEY = ["de", "depuis", "en partance de", "au depart de", "en partant de", "a partir de", "depart", "a", "vers",
        "pour", "jusqua", "en direction de", "direction", "arrivee", "aller", "partir", "voyager", "rendre",
        "déplacer", "veux", "voudrais", "souhaite", "aimerais", "dois"]
EXTRACT = MATCH + [
    ("listed", """SELECT t2.*, coalesce(p.places, []) AS places, coalesce(p.names, []) AS names FROM t2 LEFT JOIN
                  (SELECT sentenceID, list(place ORDER BY rank) AS places, list(canonical ORDER BY rank) AS names
                   FROM hits GROUP BY sentenceID) p USING (sentenceID)"""),
    ("judged", f"""SELECT *, (NOT {any_of('norm', _STOP)}) AND len(places) >= 1
                   AND ({any_of('norm', _KEY)} OR len(places) >= 2) AS is_order FROM listed"""),
    # every keyword position in turn, as the rule is stated
    ("after", """SELECT sentenceID, i, words[i] AS w, array_to_string(words[i + 1:], ' ') AS rest
                 FROM (SELECT sentenceID, words, unnest(range(1, len(words))) AS i FROM t2)"""),
    ("found", """SELECT sentenceID, CASE WHEN w IN ('de', 'depuis') THEN 'o' ELSE 'd' END AS side,
                        arg_min(canonical, i * 1000 + rank) AS name
                 FROM after JOIN hits USING (sentenceID)
                 WHERE w IN ('de', 'depuis', 'a', 'vers', 'pour') AND contains(rest, place) GROUP BY ALL"""),
    ("kw", """SELECT j.*, o.name AS kw_o, d.name AS kw_d FROM judged j
              LEFT JOIN (SELECT * FROM found WHERE side = 'o') o ON o.sentenceID = j.sentenceID
              LEFT JOIN (SELECT * FROM found WHERE side = 'd') d ON d.sentenceID = j.sentenceID"""),
    ("guess", """SELECT *, len(places) AS n, (contains(norm, 'billet') OR contains(norm, 'ticket')) AND len(places) >= 2 AS direct,
                 contains(norm, 'a ' || places[1]) OR contains(norm, 'vers ' || places[1]) OR contains(norm, 'pour ' || places[1]) AS to1,
                 contains(norm, 'de ' || places[1]) OR contains(norm, 'depuis ' || places[1]) AS from1 FROM kw"""),
    ("extracted", """
        SELECT sentenceID, sentence,
               CASE WHEN NOT is_order THEN 'invalid' WHEN kw_o IS NOT NULL AND kw_d IS NOT NULL THEN 'keywords'
                    WHEN direct THEN 'direct_format' ELSE 'heuristic' END AS method,
               CASE WHEN NOT is_order THEN NULL WHEN kw_o IS NOT NULL AND kw_d IS NOT NULL THEN kw_o WHEN direct THEN names[1]
                    ELSE coalesce(kw_o, CASE WHEN n >= 2 THEN names[1] WHEN NOT to1 AND from1 THEN names[1] END) END AS origin,
               CASE WHEN NOT is_order THEN NULL WHEN kw_o IS NOT NULL AND kw_d IS NOT NULL THEN kw_d WHEN direct THEN names[2]
                    ELSE coalesce(kw_d, CASE WHEN n >= 2 THEN names[n] WHEN to1 OR NOT from1 THEN names[1] END) END AS destination,
               is_order AS valid FROM guess"""),
]
add("order_validity", "SELECT sentenceID, is_order FROM judged", "orders_text place_names", EXTRACT)
add("extract_orders", """SELECT sentenceID, origin, destination, valid, method,
    origin IS NOT NULL AND destination IS NOT NULL AS complete FROM extracted""", "orders_text place_names", EXTRACT)
add("extraction_methods", "SELECT method, count(*) AS n FROM extracted GROUP BY method", "orders_text place_names", EXTRACT)


# ----------------------------------------------------------------------------- labels

def bio(source: str, names: str) -> list[tuple[str, str]]:
    """BIO labels of a labelled order table as rows (sentenceID, i, token, label)."""
    def hits(end: str) -> str:
        e = f"trim({end})"
        return f"""
            SELECT sentenceID, start, size FROM (
                SELECT sentenceID, start, size, [lower(x) for x in win] = [lower(x) for x in parts] AS same,
                       {fuzzy("array_to_string(win, '')")} AS a, {fuzzy('ent')} AS b, known
                FROM (SELECT sentenceID, parts, len(parts) AS size, ent, known, start, toks[start + 1:start + len(parts)] AS win
                      FROM (SELECT sentenceID, toks, parts, ent, known, unnest(range(0, len(toks) - len(parts) + 1)) AS start
                            FROM (SELECT sentenceID, toks, {label_tokens(e)} AS parts, {e} AS ent,
                                         lower({e}) IN (SELECT lower({names}) FROM {source}_names) AS known FROM {source}_tok)
                            WHERE len(parts) > 0)))
            WHERE same OR (known AND levenshtein(a, b) <= 3
                           AND 1.0::DOUBLE - levenshtein(a, b) / greatest(length(a), length(b), 1) > 0.7::DOUBLE)"""
    return [
        (f"{source}_tok", f"SELECT *, {label_tokens('sentence')} AS toks FROM {source}"),
        ("o_hits", hits("origin")), ("d_hits", hits("destination")),
        ("o_first", "SELECT sentenceID, min(start) AS oa, any_value(size) AS ow FROM o_hits GROUP BY 1"),
        ("picked", f"""SELECT t.sentenceID, toks, is_valid, oa, ow,
                       coalesce(min(d.start) FILTER (d.start >= oa + ow), max(d.start)) AS da, any_value(d.size) AS dw
                       FROM {source}_tok t LEFT JOIN o_first o ON o.sentenceID = t.sentenceID
                       LEFT JOIN d_hits d ON d.sentenceID = t.sentenceID GROUP BY ALL"""),
        ("labelled", """SELECT sentenceID, is_valid, i, toks[i + 1] AS token,
                CASE WHEN is_valid = 0 THEN 'O' WHEN i = da THEN 'B-DEST' WHEN i > da AND i < da + dw THEN 'I-DEST'
                     WHEN i = oa THEN 'B-ORIGIN' WHEN i > oa AND i < oa + ow THEN 'I-ORIGIN' ELSE 'O' END AS label
                FROM (SELECT *, unnest(range(0, len(toks))) AS i FROM picked)"""),
    ]


BIO = [gaz("place_names"), ("orders_text_names", "SELECT canonical FROM gaz")] + bio("orders_text", "canonical")
BIO_VIEWS = "orders_text place_names"
add("bio_labels", """SELECT sentenceID, string_agg(token, '|' ORDER BY i) AS tokens, string_agg(label, '|' ORDER BY i) AS labels
                     FROM labelled GROUP BY sentenceID""", BIO_VIEWS, BIO)

NOISY = [("tok", f"SELECT sentenceID, {label_tokens('sentence')} AS toks FROM orders_text"),
         ("labelled", """SELECT sentenceID, i, toks, len(toks) AS n, toks[i + 1] AS token, ['O', 'B-ORIGIN', 'I-ORIGIN', 'B-DEST', 'I-DEST'][
                (instr('0123456789abcdef', md5(CAST(sentenceID AS VARCHAR) || '|' || CAST(i AS VARCHAR))[1]) - 1) % 5 + 1] AS label
                FROM (SELECT *, unnest(range(0, len(toks))) AS i FROM tok)""")]


def spans(kind: str) -> str:
    return f"""
        SELECT sentenceID, toks[b + 1:e] AS ent FROM (
            SELECT l.sentenceID, any_value(toks) AS toks, any_value(e) AS e, max(i) AS b FROM labelled l JOIN (
                SELECT l.sentenceID, p, coalesce(min(i) FILTER (i > p AND label NOT IN ('B-{kind}', 'I-{kind}')), any_value(n)) AS e
                FROM labelled l JOIN (SELECT sentenceID, min(i) AS p FROM labelled WHERE label = 'B-{kind}' GROUP BY 1) f
                     ON f.sentenceID = l.sentenceID GROUP BY l.sentenceID, p) s ON s.sentenceID = l.sentenceID
            WHERE label = 'B-{kind}' AND i >= p AND i < e GROUP BY l.sentenceID)"""


SPANS = [("o_span", spans("ORIGIN")), ("d_span", spans("DEST"))]
_DECODE = f"""SELECT t.sentenceID, CASE WHEN o.ent IS NOT NULL THEN {stripped(rebuilt('o.ent'))} END AS origin,
                     CASE WHEN d.ent IS NOT NULL THEN {stripped(rebuilt('d.ent'))} END AS destination
              FROM (SELECT DISTINCT sentenceID FROM labelled) t LEFT JOIN o_span o ON o.sentenceID = t.sentenceID
              LEFT JOIN d_span d ON d.sentenceID = t.sentenceID"""
add("bio_decode", _DECODE, "orders_text", NOISY + SPANS)
add("bio_all_spans", f"""
    SELECT sentenceID, CAST(min(i) AS INT) AS start, CAST(max(i) + 1 AS INT) AS stop, any_value(kind) AS kind,
           {rebuilt('list(token ORDER BY i)')} AS entity
    FROM (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY sentenceID ORDER BY i) AS island
          FROM (SELECT *, b OR kind <> lag(kind) OVER (PARTITION BY sentenceID, run ORDER BY i) AS opens
                FROM (SELECT *, label[1] = 'B' AS b, label[3:] AS kind,
                             max(CASE WHEN label[1] = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY sentenceID, run ORDER BY i) AS active
                      FROM (SELECT *, i - row_number() OVER (PARTITION BY sentenceID ORDER BY i) AS run
                            FROM labelled WHERE label <> 'O')) WHERE active = 1))
    GROUP BY sentenceID, island""", "orders_text", NOISY)

_PERSON_WORDS = ("'avec','chez','pour','monsieur','madame','mademoiselle','mr','mme','mlle','docteur','dr','professeur',"
                 "'prof','ami','amie','copain','copine','frere','soeur','pere','mere','oncle','tante','cousin','cousine',"
                 "'collegue','mon','ma','notre','votre','son','sa'")
_AMBIGUOUS = ("'florence','albert','lourdes','nancy','leon','victor','eugene','charlotte','alice','rose','marguerite',"
              "'colette','jean','pierre'")
_PERSON = [("person_orders_names", "SELECT DISTINCT origin AS canonical FROM person_orders")] \
    + [(n, q if n != "labelled" else q.replace("SELECT sentenceID, is_valid, i,", "SELECT sentenceID, is_valid, i, toks, len(toks) AS n,"))
       for n, q in bio("person_orders", "canonical")] + SPANS \
    + [("decoded", _DECODE),
       ("before", """SELECT a.sentenceID, a.label, lower(b.token) AS w FROM labelled a JOIN labelled b
                     ON a.sentenceID = b.sentenceID AND b.i = a.i - 1 WHERE a.label IN ('B-ORIGIN', 'B-DEST')""")]
add("person_filter", f"""
    SELECT d.sentenceID, CASE WHEN lower(origin) IN ({_AMBIGUOUS}) AND o.w IN ({_PERSON_WORDS}) THEN NULL ELSE origin END AS origin,
           CASE WHEN lower(destination) IN ({_AMBIGUOUS}) AND e.w IN ({_PERSON_WORDS}) THEN NULL ELSE destination END AS destination
    FROM decoded d LEFT JOIN before o ON o.sentenceID = d.sentenceID AND o.label = 'B-ORIGIN'
    LEFT JOIN before e ON e.sentenceID = d.sentenceID AND e.label = 'B-DEST'""", "person_orders", _PERSON)

SUB = BIO + [("pieces", """SELECT sentenceID AS ex_id, i AS word_id, label, piece,
                    row_number() OVER (PARTITION BY sentenceID ORDER BY i, piece) AS pos
             FROM (SELECT *, unnest(range(0, CAST(ceil(length(token) / 3) AS BIGINT))) AS piece FROM labelled)"""),
             ("subs", """SELECT ex_id, CAST(pos AS INT) AS pos, CAST(word_id AS INT) AS word_id, CASE WHEN piece = 0 THEN
                    CASE label WHEN 'O' THEN 0 WHEN 'B-ORIGIN' THEN 1 WHEN 'I-ORIGIN' THEN 2 WHEN 'B-DEST' THEN 3 ELSE 4 END
                    ELSE -100 END AS label_id FROM pieces
             UNION ALL SELECT DISTINCT ex_id, 0, NULL, -100 FROM pieces
             UNION ALL SELECT ex_id, CAST(max(pos) + 1 AS INT), NULL, -100 FROM pieces GROUP BY ex_id""")]
add("subword_align", "SELECT ex_id, pos, word_id, CAST(label_id AS INT) AS label_id FROM subs", BIO_VIEWS, SUB)
add("subword_stats", """
    SELECT o.difficulty AS split, count(*) AS num_examples, count(*) FILTER (n > 8) AS num_truncated,
           round(avg(w), 6) AS avg_subword_len, max(w) AS max_subword_len
    FROM (SELECT ex_id, count(*) AS w, count(DISTINCT word_id) AS n FROM subs GROUP BY ex_id) s
    JOIN orders_text o ON o.sentenceID = s.ex_id GROUP BY o.difficulty""", BIO_VIEWS, SUB)
add("label_stats", """
    SELECT l.label, count(x.label) AS n, round(CAST(count(x.label) AS DOUBLE) / (SELECT count(*) FROM labelled), 6) AS share
    FROM (VALUES ('O'), ('B-ORIGIN'), ('I-ORIGIN'), ('B-DEST'), ('I-DEST')) l(label)
    LEFT JOIN labelled x ON x.label = l.label GROUP BY l.label""", BIO_VIEWS, BIO)
add("label_example_stats", """
    SELECT count(*) AS examples, count(*) FILTER (v = 1) AS valid, count(*) FILTER (v <> 1) AS invalid, CAST(sum(n) AS BIGINT) AS tokens
    FROM (SELECT sentenceID, any_value(is_valid) AS v, count(*) AS n FROM labelled GROUP BY 1)""", BIO_VIEWS, BIO)
add("label_problems", """
    SELECT sentenceID, CASE WHEN sentenceID % 7 = 0 THEN 'length' ELSE 'label' END AS problem FROM labelled
    GROUP BY sentenceID HAVING sentenceID % 7 = 0 OR (sentenceID % 7 = 1 AND max(CASE WHEN contains(label, 'DEST') THEN 1 END) = 1)""",
    BIO_VIEWS, BIO)


# --------------------------------------------------------------------------- stations

def _city(x: str) -> str:
    out = f"trim({x})"
    for suffix in (r"\s+Gare de .*$", r"\s+Part Dieu$", r"\s+TGV$", r"\s+Centre$", r"\s+Saint[-\s].*$"):
        out = (f"CASE WHEN regexp_matches({x}, '(?i)^\\s*sainte?') THEN {x} ELSE "
               f"regexp_replace({out}, '(?i){suffix}', '') END")
    return out


STATIONS = [("st0", f"SELECT stop_id[-8:] AS uic_code, stop_name, stop_lat, stop_lon, seq, {_city('stop_name')} AS c FROM stops"),
            ("st1", "SELECT *, trim(CASE WHEN contains(c, '-') THEN c ELSE string_split(c, ' ')[1] END) AS city FROM st0 WHERE uic_code[:2] = '87'"),
            ("stations", f"""SELECT uic_code, stop_name AS station_name, {station('stop_name')} AS station_name_normalized, city AS city_name,
                {station('city')} AS city_name_normalized, stop_lat AS latitude, stop_lon AS longitude, seq FROM st1""")]
add("stations_clean", """SELECT uic_code, station_name, station_name_normalized, city_name, city_name_normalized,
                         round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM stations""", "stops", STATIONS)
_PRIO = """CASE WHEN contains(l, 'tgv') OR contains(l, 'gare de lyon') OR contains(l, 'part dieu') OR contains(l, 'saint-charles')
    OR contains(l, 'montparnasse') OR contains(l, 'gare du nord') OR contains(l, 'saint-jean') OR contains(l, 'matabiau') THEN 0
    WHEN drg = 'A' OR contains(l, 'saint-laud') OR contains(l, 'europe') OR contains(l, 'saint-roch') OR contains(l, 'chateaucreux') THEN 1
    WHEN drg = 'B' THEN 2 ELSE 3 END"""
add("station_priority", f"""
    SELECT uic_code, city_name_normalized, priority,
           row_number() OVER (PARTITION BY city_name_normalized ORDER BY priority, l, uic_code) AS city_rank
    FROM (SELECT *, CAST({_PRIO} AS INT) AS priority FROM (
          SELECT s.*, lower(s.station_name) AS l, coalesce(string_split(p.segment_drg, ';')[1], 'C') AS drg
          FROM stations s JOIN packed_stations p ON string_split(p.uic_code, ';')[1] = s.uic_code))""",
    "stops packed_stations", STATIONS)
add("priority_counts", f"""
    SELECT CAST({_PRIO} AS INT) AS priority, count(*) AS n_stations
    FROM (SELECT lower(station_name) AS l, coalesce(string_split(segment_drg, ';')[1], 'C') AS drg FROM packed_stations)
    GROUP BY 1""", "packed_stations")
add("station_stats", """SELECT count(*) AS stations, count(latitude) AS with_coordinates, count(DISTINCT city_name) AS cities
                        FROM packed_stations""", "packed_stations")
add("largest_cities", """SELECT city_name, count(*) AS n_stations FROM stations GROUP BY city_name
                         ORDER BY n_stations DESC, city_name LIMIT 10""", "stops", STATIONS)
CITY_MAP = [("city_map", """SELECT city_name_normalized AS city_norm, arg_min(string_split(uic_code, ';')[1], seq) AS uic, min(seq) AS seq
                            FROM city_rows GROUP BY 1""")]


def mapped(q: str, uic: str = "uic", city_map: str = "city_map") -> str:
    """Exact city, else the first longer city name."""
    return (f"coalesce((SELECT m.{uic} FROM {city_map} m WHERE m.city_norm = {q}), "
            f"(SELECT arg_min(m.{uic}, m.seq) FROM {city_map} m WHERE starts_with(m.city_norm, {q} || '-') OR starts_with(m.city_norm, {q} || ' ')))")


add("city_to_station_exact_prefix", f"""
    SELECT query, {mapped('q')} AS uic, CASE WHEN q IN (SELECT city_norm FROM city_map) THEN 'exact'
           WHEN {mapped('q')} IS NOT NULL THEN 'prefix' END AS match FROM (SELECT query, {norm('query')} AS q FROM typed_names)""",
    "typed_names city_rows", CITY_MAP)
add("city_station_pairs", "SELECT city_norm, uic, seq FROM city_map", "city_rows", CITY_MAP)
add("foreign_flags", f"""
    SELECT query, {norm('query')} IN (SELECT {norm('name')} FROM part_names) AS is_foreign
    FROM (SELECT query FROM typed_names UNION ALL SELECT name FROM part_names)""", "typed_names part_names")
CLASSES = [("route_class", """SELECT route_id, CASE WHEN regexp_matches(n, 'TGV|INOUI|OUIGO|EUROSTAR|THALYS') THEN 'TGV'
                    WHEN regexp_matches(n, '\\bIC\\b|INTERCIT') THEN 'IC' WHEN regexp_matches(n, '\\bTER\\b') THEN 'TER' ELSE 'TRAIN' END AS line_code
                    FROM (SELECT route_id, upper(route_short_name || ' ' || route_long_name) AS n FROM routes)"""),
           ("trip_class", "SELECT trip_id, coalesce(line_code, 'TRAIN') AS line_code FROM trips LEFT JOIN route_class USING (route_id)")]
add("service_class", "SELECT trip_id, line_code FROM trip_class", "trips routes", CLASSES)

# --------------------------------------------------------------------------- matching

NAMES = [gaz("all_names"), ("asked", f"SELECT query, {norm('query')} AS q, {fuzzy('query')} AS f FROM typed_names"),
         ("keys", f"SELECT *, {fuzzy('norm')} AS fk FROM gaz")]
add("edit_distance_best", f"""
    SELECT query, arg_min(name, d * 1000000 + seq) AS match, CAST(min(d) AS INT) AS distance
    FROM (SELECT query, name, seq, levenshtein(q, n) AS d
          FROM (SELECT query, {norm('query')} AS q FROM typed_names), (SELECT name, seq, {norm('name')} AS n FROM all_names))
    WHERE d <= 2 GROUP BY query""", "typed_names all_names")
SIMILAR = NAMES + [("likes", """SELECT query, canonical, seq, CAST(d AS INT) AS distance, 1.0::DOUBLE - d / greatest(length(f), length(fk)) AS similarity
    FROM (SELECT query, canonical, seq, f, fk, levenshtein(f, fk) AS d FROM asked, keys)
    WHERE 10 * d < 3 * greatest(length(f), length(fk))""")]
add("word_corrections", """
    SELECT q AS word, arg_min(c, (d, c)) AS closest, CAST(min(d) AS INT) AS distance, count(*) AS n_near
    FROM (SELECT q, c, levenshtein(q, c) AS d FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS q FROM benchmark)
          JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS c FROM documents) ON abs(length(q) - length(c)) <= 2)
    WHERE d <= 2 GROUP BY q""", "")
add("similarity_topk", "SELECT query, canonical, seq, distance, round(similarity, 6) AS similarity FROM likes",
    "typed_names all_names", SIMILAR)
PREFIX = SIMILAR + [("prefixed", """SELECT query, canonical, seq, CAST(length(norm) - length(q) AS INT) AS gap FROM asked, keys
                                    WHERE length(query) <= 15 AND starts_with(norm, q) AND norm <> q""")]
add("prefix_candidates", "SELECT query, canonical, seq, gap FROM prefixed", "typed_names all_names", PREFIX)
add("resolve_entities", """
    SELECT a.query, CASE WHEN e.canonical IS NOT NULL THEN e.canonical WHEN p.gap <= 2 OR p.n = 1 THEN p.canonical
                         WHEN p.n IS NULL THEN s.canonical END AS canonical,
           CASE WHEN e.canonical IS NOT NULL THEN 'exact' WHEN p.gap <= 2 OR p.n = 1 THEN 'prefix' WHEN p.n > 1 THEN 'ambiguous'
                WHEN s.canonical IS NOT NULL THEN 'similar' ELSE 'unknown' END AS how
    FROM asked a LEFT JOIN gaz e ON e.norm = a.q
    LEFT JOIN (SELECT query, count(*) AS n, min(gap) AS gap, arg_min(canonical, gap * 1000000 + seq) AS canonical FROM prefixed GROUP BY 1) p
         ON p.query = a.query
    LEFT JOIN (SELECT query, arg_min(canonical, distance * 1000000 + seq) AS canonical FROM likes WHERE distance <= 2 GROUP BY 1) s
         ON s.query = a.query""", "typed_names all_names", PREFIX)
SUGGEST = PREFIX + [
    ("saints", """SELECT query, canonical, seq FROM asked, keys WHERE starts_with(q, 'saint') AND length(q) <= 15
                  AND starts_with(regexp_replace(norm, '[ -]', '', 'g'), regexp_replace(q, '[ -]', '', 'g'))"""),
    ("many", "SELECT query FROM saints GROUP BY 1 HAVING count(*) > 1"),
    ("exact", "SELECT query, canonical, seq FROM asked JOIN gaz ON norm = q WHERE query NOT IN (SELECT query FROM many)"),
    ("rest", """SELECT query, canonical, 0 AS stage, 0 AS distance, seq FROM saints
                UNION ALL SELECT query, canonical, 2, distance, seq FROM likes WHERE distance <= 2
                UNION ALL SELECT query, canonical, 3, length(norm) - length(q), seq FROM asked, keys
                          WHERE length(query) <= 10 AND starts_with(norm, q)"""),
    ("suggested", """SELECT query, canonical, 0 AS stage, 0 AS distance, seq FROM saints WHERE query IN (SELECT query FROM many)
                UNION ALL SELECT query, canonical, 1, 0, seq FROM exact
                UNION ALL SELECT query, canonical, b.stage, b.distance, b.seq FROM (
                    SELECT query, canonical, min({'stage': stage, 'distance': distance, 'seq': seq}) AS b FROM rest
                    WHERE query NOT IN (SELECT query FROM many) AND query NOT IN (SELECT query FROM exact) GROUP BY 1, 2)""")]
add("suggestions", """SELECT query, canonical, CAST(stage AS INT) AS stage, CAST(distance AS INT) AS distance, seq FROM suggested""",
    "typed_names all_names", SUGGEST)
add("suggestion_summary", f"""
    SELECT query, count(*) AS n_suggestions, count(u) AS n_with_station, CASE WHEN count(*) = 1 THEN min(canonical) END AS accepted,
           count(*) > 1 AND length(query) <= 10 AS ambiguous
    FROM (SELECT query, canonical, {mapped('n')} AS u FROM (SELECT query, canonical, {norm('canonical')} AS n FROM suggested))
    GROUP BY query""", "typed_names all_names city_rows", SUGGEST + CITY_MAP)


# -------------------------------------------------------------------------- timetable

TIMES = CLASSES + [
    ("calls", """SELECT trip_id, stop_sequence, stop_id[-8:] AS uic,
                 CAST(departure_time[1:2] AS INT) * 3600 + CAST(departure_time[4:5] AS INT) * 60 + CAST(departure_time[7:8] AS INT) AS dep
                 FROM stop_times"""),
    ("steps", """SELECT trip_id, uic AS origin_uic, lead(uic) OVER w AS destination_uic, lead(dep) OVER w - dep AS seconds
                 FROM calls WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)"""),
    ("segments", "SELECT * FROM steps WHERE origin_uic <> destination_uic AND seconds > 0 AND seconds <= 14400"),
    ("timed", """SELECT origin_uic, destination_uic, coalesce(line_code, 'TRAIN') AS line_code,
                 median(CAST(seconds AS DOUBLE)) AS median_seconds, count(*) AS trip_count
                 FROM segments LEFT JOIN trip_class USING (trip_id) GROUP BY 1, 2, 3"""),
    ("best", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin_uic, destination_uic ORDER BY median_seconds, line_code) AS r
                FROM timed) WHERE r = 1 AND trip_count >= 2"""),
    ("conn", """SELECT origin_uic, destination_uic, CAST(round_even(median_seconds / 60, 0) AS INT) AS duration_minutes, line_code, trip_count
                FROM best"""),
    ("sym", """SELECT origin_uic, destination_uic, duration_minutes, line_code, trip_count FROM (
               SELECT *, row_number() OVER (PARTITION BY origin_uic, destination_uic ORDER BY duration_minutes, line_code, trip_count) AS r FROM (
                    SELECT * FROM conn UNION ALL
                    SELECT destination_uic, origin_uic, duration_minutes, line_code, trip_count FROM conn)) WHERE r = 1"""),
]
TIME_VIEWS = "stop_times trips routes"
_EDGE = "origin_uic, destination_uic, duration_minutes, line_code, trip_count"
COST = """CAST({m} * CASE {c} WHEN 'TGV' THEN 1000 WHEN 'IC' THEN 1050 WHEN 'CORRESP' THEN 1000 ELSE 1150 END
          + 1000 * CASE {c} WHEN 'TGV' THEN 5 WHEN 'CORRESP' THEN 15 ELSE 8 END AS BIGINT)"""
add("stop_segments", "SELECT trip_id, origin_uic, destination_uic, CAST(seconds AS INT) AS seconds FROM segments", TIME_VIEWS, TIMES)
add("class_durations", "SELECT origin_uic, destination_uic, line_code, median_seconds, trip_count FROM timed", TIME_VIEWS, TIMES)
add("connections", f"SELECT {_EDGE} FROM conn", TIME_VIEWS, TIMES)
add("symmetric_edges", f"SELECT {_EDGE} FROM sym", TIME_VIEWS, TIMES)
add("named_edges", f"""
    SELECT {_EDGE}, a.stop_name AS origin_name, b.stop_name AS destination_name FROM conn
    LEFT JOIN stops a ON a.stop_id[-8:] = origin_uic LEFT JOIN stops b ON b.stop_id[-8:] = destination_uic""", TIME_VIEWS + " stops", TIMES)
add("edge_costs", f"""
    SELECT origin_uic, destination_uic, line_code, {COST.format(m='duration_minutes', c='line_code')} / 1000::DOUBLE AS cost,
           CASE WHEN duration_minutes >= 60 THEN CAST(duration_minutes // 60 AS VARCHAR) || 'h' || lpad(CAST(duration_minutes % 60 AS VARCHAR), 2, '0')
                ELSE CAST(duration_minutes AS VARCHAR) || ' min' END AS label FROM sym""", TIME_VIEWS, TIMES)
add("duration_summary", """
    SELECT count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, min(duration_minutes) AS min,
           round(quantile_cont(m, 0.25), 6) AS p25, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.75), 6) AS p75,
           max(duration_minutes) AS max FROM (SELECT *, CAST(duration_minutes AS DOUBLE) AS m FROM sym)""", TIME_VIEWS, TIMES)
add("class_counts", "SELECT line_code, count(*) AS n FROM sym GROUP BY 1", TIME_VIEWS, TIMES)
_IN = "(origin_uic, destination_uic) {} (SELECT origin_uic, destination_uic FROM {})"
add("override_merge", f"""SELECT {_EDGE} FROM conn WHERE {_IN.format('NOT IN', 'extra_edges')} UNION ALL SELECT {_EDGE} FROM extra_edges""",
    TIME_VIEWS + " extra_edges", TIMES)
add("insert_missing", f"""SELECT {_EDGE} FROM conn UNION ALL SELECT {_EDGE} FROM extra_edges WHERE {_IN.format('NOT IN', 'conn')}""",
    TIME_VIEWS + " extra_edges", TIMES)
add("new_keys", f"""SELECT DISTINCT origin_uic, destination_uic, CASE WHEN {_IN.format('IN', 'conn')} THEN 'existing' ELSE 'new' END AS state
                    FROM extra_edges""", TIME_VIEWS + " extra_edges", TIMES)
add("set_connections", f"""
    SELECT {_EDGE}, CASE WHEN a.city_name = 'Paris' THEN 'there' ELSE 'back' END AS direction FROM conn
    JOIN stations a ON a.uic_code = origin_uic JOIN stations b ON b.uic_code = destination_uic
    WHERE (a.city_name = 'Paris' AND b.city_name = 'Lyon') OR (a.city_name = 'Lyon' AND b.city_name = 'Paris')""",
    TIME_VIEWS + " stops", TIMES + STATIONS)
add("station_aliases", """SELECT string_split(uic_code, ';')[2] AS alt_uic, string_split(uic_code, ';')[1] AS uic
                          FROM packed_stations WHERE contains(uic_code, ';')""", "packed_stations")
add("subset_stations", """SELECT uic_code, station_name FROM packed_stations
                          WHERE string_split(uic_code, ';')[1] IN (SELECT uic FROM transfer_groups)""", "packed_stations transfer_groups")
# both codes of a station count: the pair table is the symmetric one, seen as unordered pairs
UNDIRECTED = [("pairs", """SELECT least(origin_uic, destination_uic) AS a, greatest(origin_uic, destination_uic) AS b,
                   arg_min(duration_minutes, duration_minutes * 100 + instr('IC   TER  TGV  TRAIN', line_code)) AS m,
                   arg_min(line_code, duration_minutes * 100 + instr('IC   TER  TGV  TRAIN', line_code)) AS line_code FROM sym GROUP BY 1, 2"""),
              ("net", f"""SELECT src, dst, m AS minutes, line_code, {COST.format(m='m', c='line_code')} AS milli FROM (
                  SELECT a AS src, b AS dst, m, line_code FROM pairs UNION ALL SELECT b, a, m, line_code FROM pairs)""")]
add("alias_edges", "SELECT src, dst, minutes, line_code, milli / 1000::DOUBLE AS cost FROM net", TIME_VIEWS, TIMES + UNDIRECTED)
TRANSFERS = [("moves", """SELECT x.uic AS a, y.uic AS b FROM transfer_groups x JOIN transfer_groups y ON x.city = y.city AND x.seq < y.seq
                          WHERE (least(x.uic, y.uic), greatest(x.uic, y.uic)) NOT IN (SELECT a, b FROM pairs)""")]
add("transfer_edges", """SELECT src, dst, CAST(15 AS INT) AS minutes, 30.0::DOUBLE AS cost
                         FROM (SELECT a AS src, b AS dst FROM moves UNION ALL SELECT b, a FROM moves)""",
    TIME_VIEWS + " transfer_groups", TIMES + UNDIRECTED + TRANSFERS)

# ------------------------------------------------------------------------------ graph

NET = TIMES + UNDIRECTED
DEGREES = NET + [("degree", """SELECT 'x' AS k, CAST(87000000 + s_suppkey AS VARCHAR) AS uic, count(src) AS degree
                               FROM supplier LEFT JOIN net ON src = CAST(87000000 + s_suppkey AS VARCHAR) GROUP BY 1, 2""")]
add("degree_stats", """SELECT count(*) AS nodes, CAST(sum(degree) // 2 AS BIGINT) AS edges, round(avg(degree), 6) AS avg_degree,
                       min(degree) AS min_degree, max(degree) AS max_degree, count(*) FILTER (degree = 0) AS orphans FROM degree""", TIME_VIEWS, DEGREES)
add("neighbours", """SELECT src AS uic, dst AS neighbour, stop_name AS station_name, minutes FROM net JOIN stops ON stop_id[-8:] = dst""",
    TIME_VIEWS + " stops", NET)
add("top_connected", """SELECT uic, degree, stop_name AS station_name FROM degree JOIN stops ON stop_id[-8:] = uic
                        ORDER BY degree DESC, uic LIMIT 10""", TIME_VIEWS + " stops", DEGREES)
add("station_lookup", """SELECT DISTINCT destination_uic AS uic, station_name, city_name, round(latitude, 6) AS latitude
                         FROM extra_edges LEFT JOIN stations ON uic_code = destination_uic""", "extra_edges stops", STATIONS)
PARTS = [("links", "SELECT src AS a, dst AS b FROM support_graph UNION SELECT dst, src FROM support_graph"),
         ("low0", "SELECT a AS node, min(least(a, b)) AS low FROM links GROUP BY 1")]
for k in range(1, 9):  # rounds of neighbour minimum, enough to converge here
    PARTS.append((f"low{k}", f"""SELECT node, min(low) AS low FROM (SELECT node, low FROM low{k - 1} UNION ALL
                                  SELECT l.b, r.low FROM low{k - 1} r JOIN links l ON l.a = r.node) GROUP BY 1"""))
PARTS.append(("parts", "SELECT node, low AS component FROM low8"))
add("components", "SELECT node, component FROM parts", "support_graph", PARTS)
add("component_summary", """SELECT CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components, max(n) AS largest, count(*) = 1 AS is_connected
                            FROM (SELECT component, count(*) AS n FROM parts GROUP BY 1)""", "support_graph", PARTS)
add("main_component_members", """
    SELECT u AS uic, coalesce(component = (SELECT component FROM parts GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), FALSE) AS in_main_component
    FROM (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS u FROM supplier) LEFT JOIN parts ON node = u""", "support_graph", PARTS)
HOPS = NET + [("walk", """SELECT DISTINCT src AS source, src AS node, 0 AS hops FROM net
                          UNION SELECT w.source, n.dst, w.hops + 1 FROM walk w JOIN net n ON n.src = w.node WHERE w.hops < 8"""),
              ("dist", "SELECT source, node, min(hops) AS hops FROM walk GROUP BY 1, 2")]
add("hop_diameter", """SELECT full_reach AS is_connected, CASE WHEN full_reach THEN CAST(far AS INT) END AS diameter FROM (
    SELECT count(*) = (SELECT count(DISTINCT src) * count(DISTINCT src) FROM net) AS full_reach, max(hops) AS far FROM dist)""", TIME_VIEWS, HOPS)


def relaxed(sources: str, rounds: int = 8) -> list[tuple[str, str]]:
    """Cheapest labels after so many rounds of relaxation, enough to converge here."""
    out = [("lab0", f"""SELECT source, source AS node, {{'cost': 0::BIGINT, 'hops': 0, 'path': [source], 'minutes': 0::BIGINT}} AS b
                        FROM ({sources})""")]
    for k in range(1, rounds + 1):
        out.append((f"lab{k}", f"""
            SELECT source, node, min(b) AS b FROM (SELECT source, node, b FROM lab{k - 1} UNION ALL
                SELECT l.source, n.dst, {{'cost': l.b.cost + n.milli, 'hops': l.b.hops + 1, 'path': list_append(l.b.path, n.dst),
                                          'minutes': l.b.minutes + n.minutes}}
                FROM lab{k - 1} l JOIN net n ON n.src = l.node WHERE NOT list_contains(l.b.path, n.dst)) GROUP BY 1, 2"""))
    return out + [("final", f"SELECT source, node, b.cost AS milli, b.hops AS hops, b.path AS path, b.minutes AS minutes FROM lab{rounds}")]


OD = NET + [
    ("od", """SELECT DISTINCT CAST(87000000 + po.k + 25 * (sentenceID % 4) AS VARCHAR) AS origin_uic,
                              CAST(87000000 + pd.k + 25 * (sentenceID // 4 % 4) AS VARCHAR) AS destination_uic
              FROM orders_text JOIN places po ON po.name = origin JOIN places pd ON pd.name = destination WHERE is_valid = 1
              UNION SELECT '87000003', CAST(CAST(origin_uic AS BIGINT) + 900000 AS VARCHAR) FROM extra_edges"""),
    ("known", "SELECT stop_id[-8:] AS uic, stop_name AS name, seq FROM stops"),
] + relaxed("SELECT DISTINCT origin_uic AS source FROM od WHERE origin_uic IN (SELECT uic FROM known)") + [
    ("routed", """SELECT origin_uic, destination_uic, path, milli, minutes, hops,
                  CASE WHEN origin_uic NOT IN (SELECT uic FROM known) OR destination_uic NOT IN (SELECT uic FROM known) THEN 'InvalidStationError'
                       WHEN path IS NULL THEN 'NoPathError' END AS error
                  FROM od LEFT JOIN final ON source = origin_uic AND node = destination_uic""")]
OD_VIEWS = TIME_VIEWS + " orders_text extra_edges stops"
add("shortest_paths", """SELECT origin_uic, destination_uic, array_to_string(path, '|') AS path, milli / 1000::DOUBLE AS cost, minutes,
                         CAST(hops AS INT) AS hops, error FROM routed""", OD_VIEWS, OD)
_NAMED = [("named", """SELECT origin_uic, destination_uic, list(k.name ORDER BY i) AS stations FROM (
                          SELECT origin_uic, destination_uic, path, unnest(range(1, len(path) + 1)) AS i FROM routed WHERE path IS NOT NULL)
                       JOIN known k ON k.uic = path[i] GROUP BY 1, 2""")]
add("route_records", """
    SELECT r.origin_uic, r.destination_uic, a.name AS origin_name, b.name AS destination_name, error IS NULL AS success,
           array_to_string(stations, '|') AS stations, coalesce(minutes, 0) AS total_time,
           CAST(coalesce(greatest(len(path) - 2, 0), 0) AS INT) AS num_stops, error IS NOT NULL AS failed
    FROM routed r LEFT JOIN named n ON n.origin_uic = r.origin_uic AND n.destination_uic = r.destination_uic
    LEFT JOIN known a ON a.uic = r.origin_uic LEFT JOIN known b ON b.uic = r.destination_uic""", OD_VIEWS, OD + _NAMED)
_LEGS = [("legs", """SELECT origin_uic, destination_uic, i, path[i + 1] AS f, path[i + 2] AS t FROM (
                     SELECT origin_uic, destination_uic, path, unnest(range(0, len(path) - 1)) AS i FROM routed WHERE len(path) >= 2)""")]
add("route_segments", """
    SELECT origin_uic, destination_uic, CAST(i AS INT) AS seq, f AS from_uic, t AS to_uic, a.name AS from_name, b.name AS to_name,
           n.minutes AS duration, n.line_code FROM legs JOIN net n ON n.src = f AND n.dst = t
    JOIN known a ON a.uic = f JOIN known b ON b.uic = t""", OD_VIEWS, OD + _LEGS)
add("given_route_time", """
    SELECT trip_id, CASE WHEN error IS NULL THEN CAST(total AS INT) END AS total_minutes, error FROM (
        SELECT trip_id, sum(minutes) AS total, CASE WHEN max(n) < 2 THEN 'too_short' WHEN max(bad) = 1 THEN 'unknown_station'
               WHEN count(*) FILTER (nxt IS NOT NULL AND minutes IS NULL) > 0 THEN 'missing_edge' END AS error
        FROM (SELECT w.trip_id, nxt, minutes, count(*) OVER (PARTITION BY w.trip_id) AS n, CASE WHEN w.uic = '99999999' THEN 1 ELSE 0 END AS bad
              FROM (SELECT trip_id, uic, lead(uic) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS nxt
                    FROM (SELECT trip_id, stop_sequence, uic FROM calls UNION ALL
                          SELECT DISTINCT trip_id, 9223372036854775807, '99999999' FROM calls WHERE CAST(trip_id AS BIGINT) % 11 = 0)) w
              LEFT JOIN net ON src = w.uic AND dst = nxt) GROUP BY trip_id)""", TIME_VIEWS, NET)
add("route_coordinates", """
    SELECT origin_uic, destination_uic, CAST(i - 1 AS INT) AS seq, stop, round(coalesce(s.lat, c.lat), 6) AS latitude,
           round(coalesce(s.lon, c.lon), 6) AS longitude
    FROM (SELECT origin_uic, destination_uic, i, CASE WHEN i % 2 = 1 THEN upper(stations[i]) ELSE string_split(stations[i], ' ')[1] END AS stop
          FROM (SELECT *, unnest(range(1, len(stations) + 1)) AS i FROM named)) r
    LEFT JOIN (SELECT lower(station_name) AS n, arg_min(latitude, seq) AS lat, arg_min(longitude, seq) AS lon FROM stations GROUP BY 1) s ON s.n = lower(stop)
    LEFT JOIN (SELECT lower(city_name) AS n, arg_min(latitude, seq) AS lat, arg_min(longitude, seq) AS lon FROM stations GROUP BY 1) c ON c.n = lower(stop)""",
    OD_VIEWS, OD + _NAMED + STATIONS)
KM = """2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, power(sin((radians({b}) - radians({a})) / 2), 2)
        + cos(radians({a})) * cos(radians({b})) * power(sin((radians({d}) - radians({c})) / 2), 2))))"""
add("nearest_station", f"""
    SELECT point_id, arg_min(uic, {{'d': km, 'u': uic}}) AS uic, round(min(km), 6) AS distance_km FROM (
        SELECT point_id, uic_code AS uic, {KM.format(a='lat', b='latitude', c='lon', d='longitude')} AS km FROM line_ends, stations)
    WHERE km <= 20 GROUP BY point_id""", "line_ends stops", STATIONS)
add("nearest_station_world", f"""
    SELECT point_id, arg_min(uic, {{'d': km, 'u': uic}}) AS uic, round(min(km), 6) AS distance_km FROM (
        SELECT point_id, uic, {KM.format(a='lat', b='latitude', c='lon', d='longitude')} AS km FROM world_points, world_sites)
    WHERE km <= 500 GROUP BY point_id""", "world_points world_sites")
_QUALITY = TIMES + UNDIRECTED + TRANSFERS + [
    ("all_edges", """SELECT src, dst, minutes FROM net UNION ALL SELECT a, b, 15 FROM moves UNION ALL SELECT b, a, 15 FROM moves"""),
    ("nodes", "SELECT string_split(uic_code, ';')[1] AS uic, latitude, longitude FROM packed_stations"),
    ("reach", "SELECT uic AS node, uic AS other FROM nodes UNION SELECT r.node, l.dst FROM reach r JOIN all_edges l ON l.src = r.other"),
    ("sizes", "SELECT component, count(*) AS n FROM (SELECT node, min(other) AS component FROM reach GROUP BY 1) GROUP BY 1"),
    ("far", f"""SELECT count(*) AS n FROM all_edges JOIN nodes p ON p.uic = src JOIN nodes q ON q.uic = dst
                WHERE {KM.format(a='p.latitude', b='q.latitude', c='p.longitude', d='q.longitude')} >= 1000""")]
add("network_quality", """
    SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
        SELECT 'stations' AS metric, CAST(count(*) AS DOUBLE) AS value FROM nodes UNION ALL SELECT 'with_coordinates', count(latitude) FROM nodes
        UNION ALL SELECT 'inside_bounds', count(*) FROM nodes WHERE longitude BETWEEN -5.5 AND 10 AND latitude BETWEEN 41 AND 51.5
        UNION ALL SELECT 'directed_edges', count(*) FROM all_edges UNION ALL SELECT 'with_duration', count(minutes) FROM all_edges
        UNION ALL SELECT 'avg_minutes', avg(minutes) FROM all_edges UNION ALL SELECT 'min_minutes', min(minutes) FROM all_edges
        UNION ALL SELECT 'max_minutes', max(minutes) FROM all_edges UNION ALL SELECT 'too_long', n FROM far
        UNION ALL SELECT 'orphans', count(*) FROM nodes WHERE uic NOT IN (SELECT src FROM all_edges)
        UNION ALL SELECT 'one_way_edges', count(*) FROM all_edges e WHERE (dst, src) NOT IN (SELECT src, dst FROM all_edges)
        UNION ALL SELECT 'components', count(*) FROM sizes UNION ALL SELECT 'largest_component', max(n) FROM sizes)""",
    TIME_VIEWS + " packed_stations transfer_groups", _QUALITY)

# ------------------------------------------------------------------------- resolution


def resolution(keep: str) -> list[tuple[str, str]]:
    end = lambda e: f"(SELECT {mapped('q')} FROM (SELECT {norm(e)} AS q))"
    return EXTRACT + NET + [
        ("city_map", f"""SELECT city_name_normalized AS city_norm, arg_min(string_split(uic_code, ';')[1], seq) AS uic, min(seq) AS seq
                         FROM city_rows {keep} GROUP BY 1"""),
        ("town", f"SELECT name, uic FROM (SELECT name, {mapped('q')} AS uic FROM (SELECT name, {norm('name')} AS q FROM places))"),
    ] + relaxed("SELECT DISTINCT uic AS source FROM town WHERE uic IS NOT NULL") + [
        ("known", "SELECT stop_id[-8:] AS uic, stop_name AS name FROM stops"),
        ("ends", """SELECT e.*, o.uic AS ou, d.uic AS du, e.valid AND e.origin IS NOT NULL AND e.destination IS NOT NULL AS complete
                    FROM extracted e LEFT JOIN town o ON o.name = e.origin AND e.destination IS NOT NULL
                    LEFT JOIN town d ON d.name = e.destination AND e.origin IS NOT NULL"""),
        ("resolved", """SELECT e.*, f.path, f.minutes, CASE WHEN NOT complete THEN NULL
                        WHEN ou IS NULL THEN CASE WHEN e.origin IN ('Nice', 'Metz') THEN 'ForeignCityError' ELSE 'CityMappingError' END
                        WHEN du IS NULL THEN CASE WHEN e.destination IN ('Nice', 'Metz') THEN 'ForeignCityError' ELSE 'CityMappingError' END
                        WHEN f.path IS NULL THEN 'NoPathError' END AS error_type
                        FROM ends e LEFT JOIN final f ON f.source = ou AND f.node = du"""),
    ]


RESOLVE = resolution("")
RESOLVE_VIEWS = TIME_VIEWS + " orders_text place_names city_rows stops"
add("route_orders", """
    SELECT sentenceID AS sentence_id, origin, destination, ou AS origin_uic, du AS destination_uic, valid,
           CASE WHEN complete AND ou IS NOT NULL AND du IS NOT NULL THEN origin || '|' || destination ELSE 'INVALID|INVALID' END AS route,
           CASE WHEN complete AND error_type IS NULL THEN array_to_string(path, '|') ELSE '' END AS path,
           CASE WHEN complete AND error_type IS NULL THEN minutes ELSE 0 END AS total_time, complete AND error_type IS NULL AS success, error_type
    FROM resolved""", RESOLVE_VIEWS, RESOLVE)
add("resolution_counters", """
    SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid,
           count(*) FILTER (complete AND error_type IS NULL) AS success, count(error_type) AS errors,
           count(*) FILTER (error_type IS NOT NULL AND NOT valid) AS nlp_errors,
           count(*) FILTER (valid AND error_type = 'CityMappingError') AS mapping_errors,
           count(*) FILTER (valid AND error_type = 'ForeignCityError') AS foreign_errors,
           count(*) FILTER (valid AND error_type NOT IN ('CityMappingError', 'ForeignCityError')) AS pathfinding_errors
    FROM resolved""", RESOLVE_VIEWS, RESOLVE)
add("stream_resolve", """
    SELECT sentenceID, e.origin, e.destination, o.uic AS origin_uic, d.uic AS destination_uic, valid, method,
           array_to_string(f.path, '|') AS path, f.minutes AS total_time, f.path IS NOT NULL AS success
    FROM extracted e LEFT JOIN town o ON o.name = e.origin LEFT JOIN town d ON d.name = e.destination
    LEFT JOIN final f ON f.source = o.uic AND f.node = d.uic""", RESOLVE_VIEWS, resolution(""))
add("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")

# ------------------------------------------------------------------------- evaluation


def compared(preds: str, how: str = "LEFT", name: str = "cmp") -> list[tuple[str, str]]:
    return [(name, f"""
        SELECT *, t_o = p_o AS o_ok, t_d = p_d AS d_ok, t_o = p_o AND t_d = p_d AS ex, is_valid = 1 AS tv,
               p_o NOT IN ('', 'INVALID') AND p_d NOT IN ('', 'INVALID') AS pv
        FROM (SELECT t.*, p.origin AS po, p.destination AS pd, p.sentenceID IS NOT NULL AS hit, {form('t.origin')} AS t_o,
                     {form('t.destination')} AS t_d, {form('p.origin')} AS p_o, {form('p.destination')} AS p_d
              FROM orders_text t {how} JOIN {preds} p ON p.sentenceID = t.sentenceID)""")]


EVAL = "orders_text preds"
_N, _TP = "count(*) FILTER (tv)", "count(*) FILTER (tv AND pv)"
_TN, _FP, _FN = "count(*) FILTER (NOT tv AND NOT pv)", "count(*) FILTER (NOT tv AND pv)", "count(*) FILTER (tv AND NOT pv)"
_ACC = f"""{_N} AS total_valid_orders, count(*) FILTER (tv AND o_ok) AS origin_correct, count(*) FILTER (tv AND d_ok) AS destination_correct,
    count(*) FILTER (tv AND ex) AS exact_match, {ratio('count(*) FILTER (tv AND o_ok)', _N)} AS origin_accuracy,
    {ratio('count(*) FILTER (tv AND d_ok)', _N)} AS destination_accuracy, {ratio('count(*) FILTER (tv AND ex)', _N)} AS exact_match_accuracy"""
_F1 = f"round(coalesce(2.0::DOUBLE * {_TP} / nullif(2 * {_TP} + {_FP} + {_FN}, 0), 0), 6)"
_VAL = f"""{_TP} AS true_positives, {_TN} AS true_negatives, {_FP} AS false_positives, {_FN} AS false_negatives,
    {ratio(f'({_TP} + {_TN})', 'count(*)')} AS validity_accuracy, {ratio(_TP, f'({_TP} + {_FP})')} AS validity_precision,
    {ratio(_TP, f'({_TP} + {_FN})')} AS validity_recall, {_F1} AS validity_f1"""
add("accuracy", f"SELECT {_ACC} FROM cmp", EVAL, compared("preds"))
add("validity_prf", f"SELECT {_VAL} FROM cmp", EVAL, compared("preds"))
add("evaluation_summary", f"SELECT {_ACC}, {_VAL} FROM cmp", EVAL, compared("preds"))
add("confusion", """SELECT 'invalid' AS actual, count(*) FILTER (NOT tv AND NOT pv) AS predicted_invalid, count(*) FILTER (NOT tv AND pv) AS predicted_valid FROM cmp
                    UNION ALL SELECT 'valid', count(*) FILTER (tv AND NOT pv), count(*) FILTER (tv AND pv) FROM cmp""", EVAL, compared("preds"))
add("quality_confusion", """
    SELECT CASE WHEN quality = 1 THEN 'valid' ELSE 'invalid' END AS actual, count(*) FILTER (coalesce(n_chars, 0) < 200) AS predicted_invalid,
           count(*) FILTER (n_chars >= 200) AS predicted_valid FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1""")


def slices(flag: str = "ex", source: str = "cmp") -> str:
    one = lambda kind, col: (f"SELECT '{kind}' AS slice_kind, {col} AS slice, count(*) AS total, count(*) FILTER ({flag}) AS correct, "  # noqa: E731
                             f"{ratio(f'count(*) FILTER ({flag})', 'count(*)')} AS accuracy FROM {source} WHERE tv GROUP BY 1, 2")
    return " UNION ALL ".join([one("category", "category"), one("difficulty", "difficulty"), one("all", "'all'")])


add("robustness", f"""
    SELECT c AS slice, accuracy FROM (VALUES ('no_capitals'), ('misspelling'), ('name_ambiguity'), ('compound_name'), ('complex_question'),
        ('inverted_order')) v(c) LEFT JOIN ({slices()}) s ON s.slice_kind = 'category' AND s.slice = c
    UNION ALL SELECT 'difficulty_' || slice, accuracy FROM ({slices()}) WHERE slice_kind = 'difficulty' AND slice IN ('easy', 'medium', 'hard')""",
    EVAL, compared("preds"))
add("slice_breakdown", slices(), EVAL, compared("preds"))
add("simple_accuracy", f"""
    SELECT count(*) AS total, count(*) FILTER (o AND d) AS correct, {ratio('count(*) FILTER (o AND d)', 'count(*)')} AS accuracy,
           {ratio('count(*) FILTER (o)', 'count(*)')} AS origin_accuracy, {ratio('count(*) FILTER (d)', 'count(*)')} AS destination_accuracy
    FROM (SELECT coalesce(e.origin, '') = t.origin AS o, coalesce(e.destination, '') = t.destination AS d
          FROM extracted e JOIN orders_text t USING (sentenceID))""", "orders_text place_names", EXTRACT)
add("whole_set_eval", f"""
    SELECT count(*) AS total, {_N} AS valid_orders, count(*) FILTER (NOT tv) AS invalid_orders, count(*) FILTER (o AND d) AS correct,
           {ratio('count(*) FILTER (o AND d)', 'count(*)')} AS accuracy, {ratio('count(*) FILTER (tv AND o)', _N)} AS origin_accuracy,
           {ratio('count(*) FILTER (tv AND d)', _N)} AS dest_accuracy, {_TP} AS true_positive, {_TN} AS true_negative,
           {_FP} AS false_positive, {_FN} AS false_negative, {ratio(_TP, f'({_TP} + {_FP})')} AS precision,
           {ratio(_TP, f'({_TP} + {_FN})')} AS recall, {_F1} AS f1_score, count(*) FILTER (NOT o AND NOT d) AS both_wrong,
           count(*) FILTER (NOT o AND d) AS origin_wrong, count(*) FILTER (o AND NOT d) AS dest_wrong
    FROM (SELECT t.is_valid = 1 AS tv, e.origin IS NOT NULL AND e.destination IS NOT NULL AS pv,
                 coalesce(e.origin, '') = t.origin AS o, coalesce(e.destination, '') = t.destination AS d
          FROM extracted e JOIN orders_text t USING (sentenceID))""", "orders_text place_names", EXTRACT)
_BLUR = "CASE WHEN sentenceID % 3 = 0 THEN {0}[1:length({0}) - 1] ELSE {0} END"
_FUZZY = [gaz("place_names"), ("blurred", f"SELECT sentenceID, {_BLUR.format('origin')} AS origin, {_BLUR.format('destination')} AS destination FROM preds"),
          ("near", f"""SELECT q, lower(canonical) AS c FROM (SELECT DISTINCT q, {fuzzy('q')} AS f FROM (SELECT origin AS q FROM blurred UNION SELECT destination FROM blurred)),
                       (SELECT canonical, {fuzzy('norm')} AS k FROM gaz) WHERE levenshtein(f, k) <= 3 AND 10 * levenshtein(f, k) < 3 * greatest(length(f), length(k))""")] \
    + compared("blurred")
_SAME = "(lower(trim(coalesce({0}, ''))) = lower(trim({1})) OR (coalesce({0}, '') <> '' AND {1} <> '' AND ({0}, lower(trim({1}))) IN (SELECT q, c FROM near)))"
add("fuzzy_accuracy", slices("fz", "judged"), EVAL + " place_names",
    _FUZZY + [("judged", f"SELECT *, {_SAME.format('po', 'origin')} AND {_SAME.format('pd', 'destination')} AS fz FROM cmp")])
INNER = compared("preds", "INNER")
add("error_distribution", """SELECT CASE WHEN o_ok AND d_ok THEN 'both_correct' WHEN o_ok THEN 'dest_wrong_only' WHEN d_ok THEN 'origin_wrong_only'
                             ELSE 'both_wrong' END AS outcome, count(*) AS n FROM cmp WHERE tv GROUP BY 1""", EVAL, INNER)
add("error_kinds", """SELECT count(*) AS errors, count(*) FILTER (t_o = p_d AND t_d = p_o) AS swapped, count(*) FILTER (p_o = p_d) AS duplicated,
                      count(*) FILTER (p_o = 'INVALID') AS origin_missing, count(*) FILTER (p_d = 'INVALID') AS dest_missing
                      FROM cmp WHERE tv AND NOT ex""", EVAL, INNER)
add("misidentified_places", f"""
    SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY "end" ORDER BY errors DESC, place) AS r FROM (
        SELECT "end", place, count(*) FILTER (NOT ok) AS errors, count(*) AS occurrences, {ratio('count(*) FILTER (NOT ok)', 'count(*)')} AS error_rate
        FROM (SELECT 'origin' AS "end", origin AS place, o_ok AS ok FROM cmp WHERE tv UNION ALL SELECT 'destination', destination, d_ok FROM cmp WHERE tv)
        GROUP BY 1, 2) WHERE errors > 0) WHERE r <= 10""", EVAL, INNER)
add("slice_ranking", """SELECT category AS slice, count(*) AS total, count(*) FILTER (ex) AS correct, count(*) FILTER (NOT ex) AS errors,
                        round(CAST(count(*) FILTER (ex) AS DOUBLE) / count(*), 4) AS accuracy FROM cmp WHERE tv GROUP BY 1""", EVAL, INNER)
add("difficulty_ranking", """SELECT difficulty AS slice, count(*) AS total, count(*) FILTER (ex) AS correct, count(*) FILTER (NOT ex) AS errors,
                             round(CAST(count(*) FILTER (ex) AS DOUBLE) / count(*), 4) AS accuracy FROM cmp WHERE tv GROUP BY 1""", EVAL, INNER)
add("worst_slices", f"SELECT * FROM ({slices()}) ORDER BY CAST(correct AS DOUBLE) / total, slice LIMIT 3", EVAL, compared("preds"))
_EXAMPLES = """SELECT category, sentenceID, sentence, origin AS expected_origin, destination AS expected_dest, po AS predicted_origin,
    pd AS predicted_dest, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sentenceID) AS rank
    FROM cmp WHERE tv AND NOT ex {0}) WHERE rank <= {1}"""
add("failure_examples", _EXAMPLES.format("", 5), EVAL, INNER)
add("hard_failures", _EXAMPLES.format("AND difficulty = 'hard'", 10), EVAL, compared("preds"))
_SIDES = compared("preds", name="c1") + compared("other_preds", name="c2") + [
    ("s1", slices("ex", "c1")), ("s2", slices("ex", "c2")),
    ("both_sides", """SELECT slice_kind, slice, coalesce(s1.total, 0) AS base_total, coalesce(s2.total, 0) AS other_total,
                      coalesce(CAST(s1.correct AS DOUBLE) / s1.total, 0) AS a, coalesce(CAST(s2.correct AS DOUBLE) / s2.total, 0) AS b
                      FROM s1 FULL JOIN s2 USING (slice_kind, slice)""")]
add("model_comparison", """
    SELECT slice_kind, slice, base_total, other_total, round(a, 6) AS base_accuracy, round(b, 6) AS other_accuracy, round(b - a, 6) AS improvement
    FROM (SELECT * FROM both_sides WHERE slice_kind <> 'category' UNION ALL
          (SELECT * FROM both_sides WHERE slice_kind = 'category' ORDER BY other_total DESC, slice LIMIT 3))""", EVAL + " other_preds", _SIDES)
_METRICS = compared("preds") + [("metrics", f"""
    SELECT 'false_positives' AS metric, CAST({_FP} AS DOUBLE) AS value FROM cmp
    UNION ALL SELECT 'duplicated', count(*) FROM cmp WHERE tv AND hit AND NOT ex AND p_o = p_d
    UNION ALL SELECT 'exact_match_accuracy', CAST(count(*) FILTER (ex) AS DOUBLE) / count(*) FROM cmp WHERE tv
    UNION ALL SELECT 'robustness.' || category, CAST(count(*) FILTER (ex) AS DOUBLE) / count(*) FROM cmp WHERE tv GROUP BY category""")]
add("findings", """
    SELECT priority, issue, r.metric, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold
    FROM (VALUES ('false_positives', 1, 100.0, 'CRITICAL', 'Invalid Order Detection'), ('robustness.misspelling', -1, 0.15, 'CRITICAL', 'Misspelling Handling'),
                 ('robustness.compound_name', -1, 0.5, 'HIGH', 'Compound Name Matching'), ('duplicated', 1, 50.0, 'MEDIUM', 'Duplicated City Predictions'),
                 ('robustness.inverted_order', -1, 0.75, 'MEDIUM', 'Inverted Order Pattern'), ('exact_match_accuracy', -1, 0.75, 'STRATEGIC', 'Baseline Ceiling'))
         r(metric, sign, threshold, priority, issue) JOIN metrics m ON m.metric = r.metric WHERE sign * value > sign * threshold""", EVAL, _METRICS)

# ---------------------------------------------------------------------------- dataset

FIRST = [("firsts", "SELECT * FROM orders_text QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY sentenceID) = 1")]
_ALL = "sentence, origin, destination, is_valid, difficulty, category, notes"
add("dedupe_resequence", f"SELECT row_number() OVER (ORDER BY sentenceID) AS sentenceID, {_ALL} FROM firsts", "orders_text", FIRST)
add("dedupe_documents", """SELECT row_number() OVER (ORDER BY id) AS sentenceID, md5(text) AS sentence_md5, lang
                           FROM (SELECT text, min(doc_id) AS id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text)""")
_SEED = "md5('{0}|' || CAST(sentenceID AS VARCHAR))"
add("trim_exact", f"""SELECT row_number() OVER (ORDER BY sentenceID) AS sentenceID, sentence, category
                      FROM (SELECT * FROM orders_text ORDER BY {_SEED.format(42)}, sentenceID LIMIT 1000)""", "orders_text")
add("shuffle_resequence", f"""SELECT row_number() OVER (ORDER BY {_SEED.format(42)}, sentenceID) AS sentenceID, sentence, category FROM orders_text""", "orders_text")
add("top_up", """
    SELECT n AS sentenceID, sentence, category FROM (SELECT *, row_number() OVER (ORDER BY is_valid, sentenceID) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY is_valid, sentenceID) AS r FROM orders_text) WHERE r = 1) WHERE n <= 2000""", "orders_text")
add("sample_per_category", f"""SELECT sentenceID, sentence, category FROM orders_text
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_SEED.format(42)}, sentenceID) <= 5""", "orders_text")


def split(seed: int, name: str) -> tuple[str, str]:
    return (name, f"""
        SELECT *, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + floor((n - nt) * (0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE))) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, floor(n * 0.15::DOUBLE) AS nt FROM (SELECT *, count(*) OVER (PARTITION BY is_valid) AS n,
              row_number() OVER (PARTITION BY is_valid ORDER BY {_SEED.format(seed)}, sentenceID) AS r FROM orders_text))""")


SPLIT = [split(42, "parts"), split(7, "parts7")]
add("stratified_split", "SELECT sentenceID, is_valid, split FROM parts", "orders_text", SPLIT)
add("split_leakage", """SELECT sentenceID, least(a.split, b.split) AS first_split, greatest(a.split, b.split) AS last_split
                        FROM parts a JOIN parts7 b USING (sentenceID) WHERE a.split <> b.split""", "orders_text", SPLIT)
add("split_overlap", "SELECT sentenceID FROM parts a JOIN parts7 b USING (sentenceID) WHERE a.split = 'test' AND b.split = 'test'", "orders_text", SPLIT)
_S = "count(*) FILTER (split = '{0}')"
add("split_crosstab", f"""SELECT category, {', '.join(f"{_S.format(s)} AS {s}" for s in ('train', 'val', 'test'))}, count(*) AS total,
    {', '.join(f"{ratio(_S.format(s), 'count(*)')} AS {s}_share" for s in ('train', 'val', 'test'))} FROM parts GROUP BY category""", "orders_text", SPLIT)
_WORDS = "len([w for w in string_split(" + squeeze("sentence") + ", ' ') if w <> ''])"
add("split_stats", f"""SELECT split, count(*) AS total, count(*) FILTER (is_valid = 1) AS valid, count(*) FILTER (is_valid = 0) AS invalid,
    round(avg(w) FILTER (is_valid = 1), 6) AS avg_words_valid, round(avg(w) FILTER (is_valid = 0), 6) AS avg_words_invalid
    FROM (SELECT *, {_WORDS} AS w FROM parts) GROUP BY split""", "orders_text", SPLIT)
_D = lambda kind, col: f"SELECT '{kind}' AS slice_kind, {col} AS slice, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders_text), 6) AS percent FROM orders_text GROUP BY 2"
add("dataset_stats", " UNION ALL ".join([_D("all", "'all'"), _D("validity", "CASE WHEN is_valid = 1 THEN 'valid' ELSE 'invalid' END"),
                                         _D("category", "category"), _D("difficulty", "difficulty")]), "orders_text")
_L = lambda name: f"SELECT {name} AS slice, count(*) AS n, CAST(min(w) AS INT) AS min_words, CAST(max(w) AS INT) AS max_words, round(avg(w), 6) AS avg_words FROM sized GROUP BY 1"
add("length_stats", _L("'all'") + " UNION ALL " + _L("CASE WHEN is_valid = 1 THEN 'valid' ELSE 'invalid' END"), "orders_text",
    [("sized", f"SELECT is_valid, {_WORDS} AS w FROM orders_text")])
add("place_usage", """SELECT place, count(*) AS uses FROM (SELECT origin AS place FROM orders_text WHERE is_valid = 1 UNION ALL
                      SELECT destination FROM orders_text WHERE is_valid = 1) WHERE place <> '' GROUP BY 1 ORDER BY uses DESC, place LIMIT 20""", "orders_text")
_SEQ = """SELECT count(*) AS n, count(DISTINCT sentenceID) AS n_distinct, min(sentenceID) AS min_id, max(sentenceID) AS max_id,
          min(sentenceID) = 1 AND max(sentenceID) = count(*) AND count(DISTINCT sentenceID) = count(*) AS is_sequential FROM orders_text"""
add("sequence_check", _SEQ, "orders_text")
add("structure_check", f"""
    SELECT "check", slice, CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual, CASE WHEN expected = actual THEN 'ok' ELSE 'failed' END AS status
    FROM (SELECT 'row_count' AS "check", 'all' AS slice, 15000 AS expected, count(*) AS actual FROM orders_text
          UNION ALL SELECT 'missing_columns', 'none', 0, 0
          UNION ALL SELECT 'duplicate_sentences', 'all', 0, count(*) FROM (SELECT sentence FROM orders_text GROUP BY 1 HAVING count(*) > 1)
          UNION ALL SELECT 'sequential_ids', 'all', 1, CAST(is_sequential AS INT) FROM ({_SEQ}))""", "orders_text")
add("duplicate_sentences", "SELECT sentence, count(*) AS n FROM orders_text GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, sentence LIMIT 20", "orders_text")
add("file_order_check", """SELECT sentenceID, expected FROM (SELECT sentenceID + 1 AS sentenceID, row_number() OVER (
    ORDER BY (sentenceID - 20 * (sentenceID % 9)) * 1000000 + sentenceID + 1) AS expected FROM orders_text) WHERE sentenceID <> expected""", "orders_text")
add("distribution_check", """
    SELECT "check", slice, CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual,
           CASE WHEN actual BETWEEN expected * 0.95::DOUBLE AND expected * 1.05::DOUBLE THEN 'ok' ELSE 'failed' END AS status
    FROM (SELECT 'category' AS "check", t.category AS slice, CAST(expected AS DOUBLE) AS expected, count(o.category) AS actual
          FROM targets t LEFT JOIN orders_text o ON o.category = t.category GROUP BY ALL
          UNION ALL SELECT 'difficulty', s.difficulty, share * (SELECT count(*) FROM orders_text WHERE is_valid = 1), count(o.difficulty)
          FROM shares s LEFT JOIN orders_text o ON o.difficulty = s.difficulty AND o.is_valid = 1 GROUP BY s.difficulty, share
          UNION ALL SELECT 'labels', 'valid_without_origin', 0, count(*) FROM orders_text WHERE is_valid = 1 AND origin = ''
          UNION ALL SELECT 'labels', 'valid_without_destination', 0, count(*) FROM orders_text WHERE is_valid = 1 AND destination = ''
          UNION ALL SELECT 'labels', 'invalid_with_origin', 0, count(*) FROM orders_text WHERE is_valid = 0 AND origin <> ''
          UNION ALL SELECT 'labels', 'invalid_with_destination', 0, count(*) FROM orders_text WHERE is_valid = 0 AND destination <> '')""",
    "orders_text targets shares")
add("expand_templates", """
    SELECT t * n * (n - 1) + o.k * (n - 1) + d.k - CASE WHEN d.k > o.k THEN 1 ELSE 0 END + 1 AS sentenceID,
           CASE WHEN lower THEN lower(s) ELSE s END AS sentence, o.name AS origin, d.name AS destination, difficulty, category
    FROM (SELECT t.*, o.k AS ok, d.k AS dk, replace(replace(template, '[origin]', o.name), '[destination]', d.name) AS s
          FROM templates t, supplier_places o, supplier_places d WHERE o.k <> d.k) x
    JOIN supplier_places o ON o.k = ok JOIN supplier_places d ON d.k = dk, (SELECT count(*) AS n FROM supplier_places) c""", "templates supplier_places")
add("sample_templates", """
    SELECT r.id + 1 AS sentenceID, CASE WHEN lower THEN lower(s) ELSE s END AS sentence, origin, destination, difficulty, category
    FROM (SELECT r.id, t.lower, o.name AS origin, e.name AS destination, difficulty, category,
                 replace(replace(template, '[origin]', o.name), '[destination]', e.name) AS s
          FROM drawn r JOIN templates t ON t.t = r.p // (n * (n - 1))
          JOIN supplier_places o ON o.k = r.p % (n * (n - 1)) // (n - 1)
          JOIN supplier_places e ON e.k = r.p % (n * (n - 1)) % (n - 1)
               + CASE WHEN r.p % (n * (n - 1)) % (n - 1) >= r.p % (n * (n - 1)) // (n - 1) THEN 1 ELSE 0 END) r""",
    "templates supplier_places", [
        ("sizes", "SELECT n, 3 * n * (n - 1) AS total FROM (SELECT count(*) AS n FROM supplier_places)"),
        ("step", """SELECT n, total, min(x) AS step FROM (SELECT n, total, unnest(range(total * 618033989 // 1000000000 + 1,
                    total * 618033989 // 1000000000 + 1000)) AS x FROM sizes) WHERE gcd(x, total) = 1 GROUP BY n, total"""),
        ("drawn", """SELECT id, n, CAST((CAST(id AS HUGEINT) * step + 42 % total) % total AS BIGINT) AS p
                     FROM (SELECT *, unnest(range(least(20 * n, total))) AS id FROM step)""")])
_HEX = " + ".join(f"(instr('0123456789abcdef', h[{i}]) - 1) * {16 ** (6 - i)}" for i in range(1, 7))
add("misspelt_places", f"""
    SELECT name, CASE WHEN name = 'Paris' THEN ['Pari', 'Parris'][v % 2 + 1] WHEN length(name) <= 4 THEN name
        WHEN v % 2 = 0 THEN name[1:length(name) - 1] ELSE name[1:p] || name[p:] END AS misspelt
    FROM (SELECT name, v, v % greatest(length(name) - 2, 1) + 2 AS p FROM (SELECT name, {_HEX} AS v FROM (
          SELECT name, md5('42|' || name) AS h FROM (SELECT name FROM places UNION SELECT p_name FROM part))))""", "places")

_LABELLED = [(n, q if n != "labelled" else q.replace("SELECT sentenceID, is_valid, i,", "SELECT sentenceID, is_valid, i, toks, len(toks) AS n,"))
             for n, q in BIO]
_TYPED = [(n, q.replace("FROM typed_names", "FROM typed_ends")) for n, q in PREFIX if n != "gaz"]
add("resolve_from_labels", f"""
    SELECT d.sentenceID, CASE WHEN lower(o.canonical) IN ({_AMBIGUOUS}) AND bo.w IN ({_PERSON_WORDS}) THEN NULL ELSE o.canonical END AS origin,
           CASE WHEN lower(e.canonical) IN ({_AMBIGUOUS}) AND be.w IN ({_PERSON_WORDS}) THEN NULL ELSE e.canonical END AS destination,
           o.canonical IS NOT NULL AND e.canonical IS NOT NULL AS valid
    FROM decoded d LEFT JOIN settled o ON o.query = d.origin LEFT JOIN settled e ON e.query = d.destination
    LEFT JOIN before bo ON bo.sentenceID = d.sentenceID AND bo.label = 'B-ORIGIN'
    LEFT JOIN before be ON be.sentenceID = d.sentenceID AND be.label = 'B-DEST'""", "orders_text place_names",
    _LABELLED + SPANS + [("decoded", _DECODE), _PERSON[-1],
                         ("typed_ends", "SELECT origin AS query FROM decoded WHERE origin <> '' UNION SELECT destination FROM decoded WHERE destination <> ''")]
    + _TYPED + [("settled", ORACLES["resolve_entities"][ORACLES["resolve_entities"].rindex("SELECT a.query, CASE"):])])

_WIDTH = 4
_STOPS = [("stops_of", """SELECT sentenceID, list(k.name ORDER BY i) AS route FROM (
               SELECT sentenceID, path, unnest(range(1, len(path) + 1)) AS i FROM resolved WHERE complete AND error_type IS NULL)
               JOIN known k ON k.uic = path[i] GROUP BY 1""")]
_NAMES = ["Departure", *[f"Step{i}" for i in range(1, _WIDTH - 1)], "Destination"]
add("wide_route_table", f"""
    SELECT sentenceID, {', '.join(f"coalesce(route[{i}], '') AS {n}" for i, n in enumerate(_NAMES, 1))}
    FROM (SELECT r.sentenceID, coalesce(s.route, ['INVALID', 'INVALID']) AS route FROM resolved r LEFT JOIN stops_of s ON s.sentenceID = r.sentenceID)""",
    RESOLVE_VIEWS, RESOLVE + _STOPS)

# D7 returns the same tables as D6 and D5 from its one comparison
ORACLES["evaluation_slices"] = ORACLES["slice_breakdown"]
ORACLES["evaluation_robustness"] = ORACLES["robustness"]

# files written and read again hold the same rows
add("orders_file", "SELECT CAST(sentenceID AS VARCHAR) AS sentenceID, sentence FROM orders_text", "orders_text")
add("flat_file", "SELECT CAST(sentenceID AS VARCHAR) AS sentenceID, origin AS Departure, destination AS Destination FROM orders_text", "orders_text")
add("gazetteer_file", """SELECT DISTINCT name, kind FROM all_names UNION ALL SELECT upper(name) AS name, 'alias' AS kind FROM place_names""",
    "all_names place_names")
add("sorted_file", """SELECT CAST(sentenceID AS BIGINT) AS sentenceID, category,
                      row_number() OVER (ORDER BY category, sentenceID) AS place FROM orders_text""", "orders_text")
add("error_file", "SELECT CAST(sentenceID AS VARCHAR) AS sentenceID, sentence FROM orders_text WHERE is_valid = 0", "orders_text")
for _file, _same in (("batch_counters", "resolution_counters"), ("timetable_files", "connections"), ("station_file", "stations_clean"),
                     ("token_file", "label_stats"), ("network_snapshot", "degree_stats")):
    ORACLES[_file] = ORACLES[_same]
add("gazetteer_rows", """SELECT name, kind, seq FROM all_names UNION ALL SELECT upper(name) AS name, 'alias' AS kind, NULL AS seq FROM place_names""",
    "all_names place_names")
add("city_map_file", "SELECT city_norm, uic FROM city_map", "city_rows", CITY_MAP)
for _file, _same in (("connection_file", "connections"), ("report_file", "slice_breakdown"), ("batch_route_counters", "resolution_counters")):
    ORACLES[_file] = ORACLES[_same]
add("utf8_files", """
    SELECT part, CAST(sum(size) AS BIGINT) AS length, min(start + good) FILTER (fault > 0) AS first_bad_byte FROM (
        SELECT part, fault, good, size, coalesce(CAST(sum(size) OVER (PARTITION BY part ORDER BY doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
        FROM (SELECT *, strlen(body) + 3 * marked + 1 AS good, strlen(body) + 3 * marked + 5 + [0, 1, 2, 3, 1, 3][fault + 1] AS size FROM broken_texts))
    GROUP BY part HAVING max(fault) > 0""", "broken_texts")
add("orders_file_lines", "SELECT sentenceID, sentence FROM broken_lines", "broken_lines")
ORACLES["stream_resolve_batches"] = ORACLES["stream_resolve"]
