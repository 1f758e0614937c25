"""Dictionary, prefix and edit-distance matching.

The large side of every match is an equi-join on a derived key: n-grams for
mentions, key prefixes for prefix matches, string segments for edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.functions import text as T
from itinera.functions.once import with_computed
from itinera.plans.lookup import sized
from itinera.plans.tables import TableStore

INLINE_KEYS = 20_000
MAX_GRAM = 4


# --------------------------------------------------------------------------- C4

def _grams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    last = F.size(words) - n + 1
    grams = F.transform(F.sequence(F.lit(1), last),
                        lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def dictionary_keys(gazetteer: DataFrame, limit: int) -> list[str] | None:
    """Dictionary keys when there are at most ``limit`` of them, else None."""
    rows = gazetteer.select("norm").limit(limit + 1).collect()
    return None if len(rows) > limit else sorted(r["norm"] for r in rows)


def _gram_sizes(keys: list[str]) -> dict[int, list[str]]:
    sizes: dict[int, list[str]] = {}
    for key in keys:
        sizes.setdefault(len(key.split()), []).append(key)
    return {n: ks for n, ks in sorted(sizes.items()) if n <= MAX_GRAM}


def _known_gram(keys: list[str], min_length: int):
    def known(gram: Column) -> Column:
        hit = gram.isin(keys)
        return hit & (F.length(gram) >= min_length) if min_length else hit

    return known


def _numbered(n: int):
    def numbered(gram: Column, i: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), i.alias("pos"), gram.alias("gram"))

    return numbered


def inline_places(norm: Column, keys: list[str], min_length: int = 3) -> Column:
    """C4 inside the row: matched keys, 1-grams first, then 2- to 4-grams, no repeats.

    The key list becomes a hash-set literal, so matching is a map-only step that
    never shuffles the texts. Gram sizes that no key has are skipped.
    """
    words = F.split(norm, " ")
    parts = []
    for n, same_size in _gram_sizes(keys).items():
        parts.append(F.filter(_grams(words, n), _known_gram(same_size, min_length if n == 1 else 0)))
    if not parts:
        return F.array().cast("array<string>")
    return F.array_distinct(F.concat(*parts))


def _joined_places(df: DataFrame, gazetteer: DataFrame, id_col: str, min_length: int) -> DataFrame:
    """C4 as an n-gram equi-join, for dictionaries too large to travel with the plan.

    Every row gets a key of its own, written with it, so rows with null or
    repeated ids keep their own places. A name mentioned by several of its
    forms counts once, by the first mention. Rows and their hits are both as
    many as the texts, so they meet by shuffle only.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    df, _ = TableStore(df.sparkSession, "places").write(rows, "rows")
    id_col = "_row"
    words = F.split("norm", " ")
    by_size = [F.transform(_grams(words, n), _numbered(n)) for n in range(1, MAX_GRAM + 1)]
    grams = (df.select(id_col, F.explode(F.concat(*by_size)).alias("g")).select(id_col, "g.*")
             .filter((F.col("n") > 1) | (F.length("gram") >= min_length)))
    names = sized(gazetteer.select(F.col("norm").alias("gram"), "canonical"))
    hits = (grams.join(names, "gram")
            .groupBy(id_col, "canonical").agg(F.min(F.struct("n", "pos", "gram")).alias("at"))
            .groupBy(id_col).agg(F.array_sort(F.collect_list("at")).alias("hits"))
            .select(id_col, F.col("hits.gram").alias("places")))
    return (df.join(hits.hint("merge"), id_col, "left").drop(id_col)
            .withColumn("places", F.coalesce("places", F.array().cast("array<string>"))))


def shared_names(gazetteer: DataFrame) -> dict[str, str]:
    """Canonical name of each key that shares it with other keys; as bounded as the dictionary that travels with the plan."""
    several = gazetteer.groupBy("canonical").agg(F.collect_set("norm").alias("keys")).filter(F.size("keys") > 1)
    return {key: row["canonical"] for row in several.collect() for key in row["keys"]}


def _named(shared: dict[str, str], key: Column) -> Column:
    """The canonical name of a key that shares it, else null."""
    return F.create_map(*[F.lit(x) for pair in shared.items() for x in pair])[key]


def find_places(df: DataFrame, gazetteer: DataFrame, text_col: str, id_col: str,
                min_length: int = 3, inline_keys: int = INLINE_KEYS,
                keys: list[str] | None = None) -> DataFrame:
    """C4: add ``norm`` (matching form) and ``places`` (matched keys in mention order).

    A name and its aliases are several keys of one canonical name, which a row
    mentions once. ``keys`` passes the result of ``dictionary_keys`` on, where
    the caller has it.
    """
    df = with_computed(df, norm=T.matching_form(text_col))
    keys = dictionary_keys(gazetteer, inline_keys) if keys is None else keys
    if keys is None:
        return _joined_places(df, gazetteer, id_col, min_length)
    found = with_computed(df, places=inline_places(F.col("norm"), keys, min_length))
    shared = shared_names(gazetteer)
    if not shared:
        return found
    named = with_computed(found, _names=F.transform("places", lambda p: F.coalesce(_named(shared, p), p)))
    first = F.filter("places", lambda p, i: F.array_position("_names", F.get("_names", i)) == i + 1)
    return named.withColumn("places", first).drop("_names")


def place_mentions(df: DataFrame, gazetteer: DataFrame, text_col: str, id_col: str,
                   **options) -> DataFrame:
    """C4 as rows: (id, rank, norm key, canonical)."""
    found = find_places(df, gazetteer, text_col, id_col, **options)
    rows = found.select(id_col, F.posexplode("places").alias("rank", "place"))
    keys = sized(gazetteer.select(F.col("norm").alias("place"), "canonical"))
    return rows.join(keys, "place").select(id_col, (F.col("rank") + 1).alias("rank"),
                                           "place", "canonical")


# ---------------------------------------------------------- C14 / C15: edit distance

class EditBound:
    """Largest allowed edit distance as a function of the two lengths.

    Either a constant ``k`` or a similarity floor: ``1 - d / longest > floor``.
    All bounds are integer arithmetic, usable as Column expressions.
    """

    def __init__(self, k: int | None = None, floor: float | None = None):
        self.k = k
        self.slack = None if floor is None else round((1 - floor) * 1000)

    def pair(self, longest: Column) -> Column:
        if self.k is not None:
            return F.lit(self.k)
        return F.floor((longest * self.slack - 1) / 1000).cast("int")

    def longest_partner(self, length: Column) -> Column:
        if self.k is not None:
            return length + self.k
        return F.floor((length * 1000 - 1) / (1000 - self.slack)).cast("int")

    def shortest_partner(self, length: Column) -> Column:
        return F.greatest(F.lit(0), length - self.pair(length))

    def needed(self, length: Column) -> Column:
        """Segments of a string that suffice to meet all its partners: one more than its largest bound."""
        return self.pair(self.longest_partner(length)) + 1

    def segments(self, length: Column) -> Column:
        """Number of segments a string is cut into: some to spare where they keep three characters or more."""
        return F.greatest(self.needed(length), F.floor(length / 3).cast("int"))


def _segment_start(length: Column, count: Column, i: Column) -> Column:
    """0-based start of segment ``i`` when ``length`` is cut into ``count`` even parts."""
    base = F.floor(length / count).cast("int")
    extra = length % count
    return i * base + F.greatest(F.lit(0), i - (count - extra))


def _dictionary_segments(entries: DataFrame, bound: EditBound) -> DataFrame:
    """The rarest segments of each entry, as many as are needed; the commonest are left out where there are some to spare.

    With n segments and k edits n - k stay whole, so one of any k + 1 does.
    """
    def cut(i: Column) -> Column:
        start = _segment_start(F.col("c_len"), F.col("parts"), i)
        stop = _segment_start(F.col("c_len"), F.col("parts"), i + 1)
        return F.struct(i.alias("part"), F.substring("c_key", start + 1, stop - start).alias("piece"))

    every = (entries.withColumn("parts", bound.segments(F.col("c_len")))
             .withColumn("s", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cut)))
             .select("c_key", "c_len", "s.part", "s.piece"))
    common = every.groupBy("c_len", "part", "piece").agg(F.count(F.lit(1)).alias("uses"))
    ranked = (every.join(common, ["c_len", "part", "piece"]).groupBy("c_key", "c_len")
              .agg(F.array_sort(F.collect_list(F.struct("uses", "part", "piece"))).alias("s")))
    return (ranked.select("c_key", "c_len", F.explode(F.slice("s", F.lit(1), bound.needed(F.col("c_len")))).alias("s"))
            .select("c_key", "c_len", "s.part", "s.piece"))


def _query_pieces(queries: DataFrame, bound: EditBound) -> DataFrame:
    """Substrings of a query that can equal a segment of a partner of each length."""
    probes = (queries
              .withColumn("c_len", F.explode(F.sequence(bound.shortest_partner(F.col("q_len")),
                                                        bound.longest_partner(F.col("q_len")))))
              .withColumn("parts", bound.segments(F.col("c_len")))
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .withColumn("start", _segment_start(F.col("c_len"), F.col("parts"), F.col("part")))
              .withColumn("size", _segment_start(F.col("c_len"), F.col("parts"), F.col("part") + 1)
                          - F.col("start"))
              .withColumn("allowed", bound.pair(F.greatest("q_len", "c_len"))))
    lowest = F.greatest(F.lit(0), F.col("start") - F.col("allowed"))
    highest = F.least(F.col("q_len") - F.col("size"), F.col("start") + F.col("allowed"))
    shift = F.col("at") - F.col("start")
    # edits left of the segment plus edits right of it must fit the bound
    fits = F.abs(shift) + F.abs(shift - (F.col("q_len") - F.col("c_len"))) <= F.col("allowed")
    return (probes.filter(lowest <= highest).withColumn("at", F.explode(F.sequence(lowest, highest)))
            .filter(fits)
            .select("q_key", "q_len", "c_len", "part",
                    F.expr("substring(q_key, at + 1, size)").alias("piece")).distinct())


def edit_pairs(queries: DataFrame, entries: DataFrame, bound: EditBound) -> DataFrame:
    """Exact edit-distance join of distinct strings: (q_key, c_key, distance).

    If two strings are within k edits and one is cut into k + 1 segments, an
    untouched segment occurs in the other at a bounded shift (Li et al.,
    "Pass-Join", 2011). Joining on (length, segment number, segment) therefore
    finds every pair. Longer entries are cut into more segments and indexed by their
    rarest ones, so a segment that a large part of the dictionary shares is not
    looked up. Pairs are made distinct before a distance is worked out, and that stops at the bound. Short strings get empty
    segments, which match by length alone, so no case is left out.
    """
    allowed = bound.pair(F.greatest("q_len", "c_len"))
    distance = F.expr("levenshtein(q_key, c_key, allowed)")
    return (edit_candidates(queries, entries, bound).withColumn("allowed", allowed)
            .withColumn("distance", distance).filter(F.col("distance") >= 0).select("q_key", "c_key", "distance"))


def edit_candidates(queries: DataFrame, entries: DataFrame, bound: EditBound) -> DataFrame:
    """Pairs whose distance ``edit_pairs`` works out, each once: (q_key, c_key, q_len, c_len)."""
    queries = queries.select("q_key").distinct().withColumn("q_len", F.length("q_key"))
    entries = entries.select("c_key").distinct().withColumn("c_len", F.length("c_key"))
    found = _query_pieces(queries, bound).join(_dictionary_segments(entries, bound), ["c_len", "part", "piece"])
    return found.select("q_key", "c_key", "q_len", "c_len").distinct()


def closest_entry(queries: DataFrame, entries: DataFrame, max_distance: int = 2) -> DataFrame:
    """C14: best entry within ``max_distance`` edits, first entry on ties.

    ``queries`` has (query); ``entries`` has (name, seq). Names are compared in
    matching form; queries without a match or without text are left out.
    """
    asked = (queries.filter(F.coalesce("query", F.lit("")) != "").select("query").distinct()
             .withColumn("q_key", T.matching_form("query")))
    known = (entries.withColumn("c_key", T.matching_form("name"))
             .groupBy("c_key").agg(F.min(F.struct("seq", "name")).alias("first")))
    pairs = edit_pairs(asked, known, EditBound(k=max_distance))
    best = (pairs.join(known, "c_key").groupBy("q_key")
            .agg(F.min(F.struct("distance", "first.seq", "first.name")).alias("best")))
    return asked.join(best, "q_key").select("query", F.col("best.name").alias("match"),
                                            F.col("best.distance").alias("distance"))


def similar_entries(queries: DataFrame, gazetteer: DataFrame, floor: float = 0.7,
                    max_distance: int | None = None) -> DataFrame:
    """Every place with similarity above ``floor``: (query, canonical, seq, distance, similarity).

    Similarity is 1 - edits / longer length on fuzzy keys (policy P2).
    """
    asked = queries.select("query").distinct().withColumn("q_key", T.fuzzy_key("query")) \
        .filter(F.col("q_key") != "")
    known = gazetteer.select(T.fuzzy_key("norm").alias("c_key"), "canonical", "seq") \
        .filter(F.col("c_key") != "")
    pairs = edit_pairs(asked, known, EditBound(floor=floor))
    if max_distance is not None:
        pairs = pairs.filter(F.col("distance") <= max_distance)
    longest = F.greatest(F.length("q_key"), F.length("c_key"))
    return (asked.join(pairs, "q_key").join(known, "c_key")
            .select("query", "canonical", "seq", "distance",
                    (F.lit(1.0) - F.col("distance") / longest).alias("similarity")))


# ------------------------------------------------------------------- C16: prefixes

def _prefixes(key: Column, longest: int) -> Column:
    """Proper and full prefixes of a key up to ``longest`` characters."""
    top = F.least(F.length(key), F.lit(longest))
    return F.when(F.length(key) > 0,
                  F.transform(F.sequence(F.lit(1), top), lambda n: F.substring(key, F.lit(1), n)))


def prefix_candidates(queries: DataFrame, gazetteer: DataFrame, max_length: int = 15) -> DataFrame:
    """Keys that properly start with the query: (query, canonical, seq, gap).

    The result lists every candidate, so its size is that of the answer; use
    ``prefix_choice`` where only the decision is needed.
    """
    asked = (queries.select("query").distinct().filter(F.length("query") <= max_length)
             .withColumn("q_key", T.matching_form("query")).filter(F.col("q_key") != ""))
    keys = gazetteer.select("norm", "canonical", "seq",
                            F.explode(_prefixes(F.col("norm"), max_length)).alias("q_key"))
    return (asked.join(keys, "q_key").filter(F.col("norm") != F.col("q_key"))
            .select("query", "canonical", "seq",
                    (F.length("norm") - F.length("q_key")).alias("gap")))


def prefix_choice(gazetteer: DataFrame, max_length: int = 15) -> DataFrame:
    """Per prefix: number of longer keys and the closest one (q_key, n, gap, canonical).

    Aggregated before any join, so a prefix shared by a large part of the
    dictionary costs one row.
    """
    return (gazetteer.select("norm", "canonical", "seq",
                             F.explode(_prefixes(F.col("norm"), max_length)).alias("q_key"))
            .filter(F.col("norm") != F.col("q_key"))
            .withColumn("gap", F.length("norm") - F.length("q_key"))
            .groupBy("q_key")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("gap", "seq", "canonical")).alias("best"))
            .select("q_key", "n", "best.gap", "best.canonical"))


# ------------------------------------------------------------- I7-I10: resolution

def resolve_entities(entities: DataFrame, gazetteer: DataFrame, max_prefix_length: int = 15,
                     close_gap: int = 2, max_distance: int = 2) -> DataFrame:
    """Canonical place per distinct entity (query, canonical, how).

    Exact key, then prefix (close one, single one, else ambiguous), then the most
    similar place. Each later step only sees what the earlier ones left open.
    """
    asked = (entities.select("query").distinct().filter(F.coalesce("query", F.lit("")) != "")
             .withColumn("q_key", T.matching_form("query")))
    exact = gazetteer.select(F.col("norm").alias("q_key"), F.col("canonical").alias("exact"))
    choice = prefix_choice(gazetteer, max_prefix_length)
    step = (asked.join(exact, "q_key", "left")
            .withColumn("p_key", F.when(F.col("exact").isNull()
                                        & (F.length("query") <= max_prefix_length), F.col("q_key")))
            .join(choice.withColumnRenamed("q_key", "p_key"), "p_key", "left"))
    unique_prefix = (F.col("gap") <= close_gap) | (F.col("n") == 1)
    open_rows = step.filter(F.col("exact").isNull() & F.col("n").isNull()).select("query")
    similar = (similar_entries(open_rows, gazetteer, max_distance=max_distance).groupBy("query")
               .agg(F.min(F.struct("distance", "seq", "canonical")).alias("s"))
               .select("query", F.col("s.canonical").alias("similar")))
    joined = step.join(similar, "query", "left")
    how = (F.when(F.col("exact").isNotNull(), "exact")
           .when(unique_prefix, "prefix").when(F.col("n") > 1, "ambiguous")
           .when(F.col("similar").isNotNull(), "similar").otherwise("unknown"))
    canonical = (F.when(F.col("exact").isNotNull(), F.col("exact"))
                 .when(unique_prefix, F.col("canonical"))
                 .when(F.col("n").isNull(), F.col("similar")))
    return joined.select("query", canonical.alias("canonical"), how.alias("how"))


def suggestions(entities: DataFrame, gazetteer: DataFrame, max_saint_length: int = 15,
                max_prefix_length: int = 10, max_distance: int = 2) -> DataFrame:
    """I8: every suggestion as a row (query, canonical, stage, distance, seq).

    Order by (stage, distance, seq) to read a list. Stages: 0 the key starts with
    the ``saint...`` text (spaces and hyphens ignored), 1 exact, 2 similar, 3 prefix.
    Several stage-0 rows, or an exact row, end the search for that entity.
    """
    asked = (entities.select("query").distinct().filter(F.coalesce("query", F.lit("")) != "")
             .withColumn("q_key", T.matching_form("query")))
    bare = lambda c: F.regexp_replace(c, "[ -]", "")
    keys = gazetteer.select("norm", "canonical", "seq")

    saints = (asked.filter(F.col("q_key").startswith("saint")
                           & (F.length("q_key") <= max_saint_length))
              .select("query", bare(F.col("q_key")).alias("prefix"))
              .join(keys.filter(bare(F.col("norm")).startswith("saint"))
                    .select("canonical", "seq",
                            F.explode(_prefixes(bare(F.col("norm")), max_saint_length)).alias("prefix")),
                    "prefix")
              .select("query", "canonical", F.lit(0).alias("stage"), F.lit(0).alias("distance"), "seq"))
    saint_counts = saints.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    settled = saint_counts.filter(F.col("n") > 1).select("query")

    exact = (asked.join(settled, "query", "left_anti")
             .join(keys.withColumnRenamed("norm", "q_key"), "q_key")
             .select("query", "canonical", F.lit(1).alias("stage"), F.lit(0).alias("distance"), "seq"))
    single_saints = saints.join(saint_counts.filter(F.col("n") == 1), "query", "left_semi") \
        .join(exact, "query", "left_anti")
    open_rows = (asked.join(settled, "query", "left_anti").join(exact, "query", "left_anti")
                 .select("query", "q_key"))
    similar = (similar_entries(open_rows, gazetteer, max_distance=max_distance)
               .select("query", "canonical", F.lit(2).alias("stage"), "distance", "seq"))
    prefix = (open_rows.filter(F.length("query") <= max_prefix_length)
              .join(keys.select("norm", "canonical", "seq",
                                F.explode(_prefixes(F.col("norm"), max_prefix_length)).alias("q_key")),
                    "q_key")
              .select("query", "canonical", F.lit(3).alias("stage"),
                      (F.length("norm") - F.length("q_key")).alias("distance"), "seq"))
    rest = (single_saints.unionByName(similar).unionByName(prefix)
            .groupBy("query", "canonical").agg(F.min(F.struct("stage", "distance", "seq")).alias("m"))
            .select("query", "canonical", "m.*"))
    several = saints.join(settled, "query", "left_semi")
    return several.unionByName(exact).unionByName(rest)


def suggestion_summary(found: DataFrame, city_station: DataFrame, max_length: int) -> DataFrame:
    """I9 + I10: per entity the number of suggestions, how many have a station, the
    auto-accepted one (single suggestion) and the ambiguity flag."""
    from itinera.operators.stations import map_cities

    # read twice below, so it is written once
    found, _ = TableStore(found.sparkSession, "suggestions").write(found, "rows")
    names = found.select(F.col("canonical").alias("city")).distinct()
    linked = map_cities(names, "city", city_station).select(
        F.col("city").alias("canonical"), F.col("uic").isNotNull().alias("has_station"))
    return (found.join(linked, "canonical").groupBy("query")
            .agg(F.count(F.lit(1)).alias("n_suggestions"),
                 F.count_if("has_station").alias("n_with_station"),
                 F.min("canonical").alias("first_name"))
            .select("query", "n_suggestions", "n_with_station",
                    F.when(F.col("n_suggestions") == 1, F.col("first_name")).alias("accepted"),
                    ((F.col("n_suggestions") > 1) & (F.length("query") <= max_length))
                    .alias("ambiguous")))
