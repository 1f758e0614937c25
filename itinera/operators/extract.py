"""Rule extraction and span decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera import constants as K
from itinera.functions import text as T
from itinera.functions.once import bind, with_computed
from itinera.operators.matching import INLINE_KEYS, dictionary_keys, find_places
from itinera.plans.lookup import left_lookup, sized


def _any_in(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def _as_words(text: Column, words: list[str]) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" ")).rlike(" (?:" + "|".join(words) + ") ")


def is_order(norm: Column, places: Column, token_match: bool = False) -> Column:
    """B1: travel-order predicate on the matching form and its places.

    Keywords count anywhere in the text; ``token_match=True`` asks for whole words (P3).
    """
    keywords = K.ORIGIN_KEYWORDS + K.DESTINATION_KEYWORDS + K.TRAVEL_VERBS
    mentioned = _as_words(norm, keywords) if token_match else _any_in(norm, keywords)
    return (~_any_in(norm, K.STOP_PHRASES) & (F.size(places) >= 1)
            & (mentioned | (F.size(places) >= 2)))


def is_complete(origin: Column, destination: Column) -> Column:
    """B2: both ends present."""
    present = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return present(origin) & present(destination)


def _after_first(norm: Column, tokens: list[str]) -> Column:
    """Text behind the first of the given words ('' when there is none)."""
    return F.regexp_extract(norm, "(?:^| )(?:" + "|".join(tokens) + ") (.+)$", 1)


def keyword_end(norm: Column, places: Column, tokens: list[str]) -> Column:
    """First place, in mention order, that occurs behind the first keyword.

    The text behind a later keyword is part of the text behind the first one, so
    a place missing there is missing everywhere after it.
    """
    return bind(_after_first(norm, tokens),
                lambda rest: F.get(F.filter(places, lambda p: rest.contains(p)), 0))


def _preceded(norm: Column, place: Column, tokens: list[str]) -> Column:
    out = F.lit(False)
    for token in tokens:
        out = out | norm.contains(F.concat(F.lit(token + " "), place))
    return out


def extract_orders(orders: DataFrame, gazetteer: DataFrame, text_col: str = "sentence",
                   id_col: str = "sentenceID", token_match: bool = False,
                   inline_keys: int = INLINE_KEYS) -> DataFrame:
    """Add (origin, destination, valid, method) to an order table.

    Cascade of B1, I3, I4 and I5; the place list (C4) is computed once per row.
    With one place only, the row is valid with one end missing (P4).
    """
    given = [c for c in orders.columns if c not in ("origin", "destination", "valid", "method")]
    keys = dictionary_keys(gazetteer, inline_keys)
    found = find_places(orders.select(*given), gazetteer, text_col, id_col,
                        inline_keys=0 if keys is None else inline_keys, keys=keys)
    norm, places = F.col("norm"), F.col("places")
    first = F.get(places, 0)
    rows = with_computed(found, _order=is_order(norm, places, token_match),
                         _kw_o=keyword_end(norm, places, K.ORIGIN_TOKENS),
                         _kw_d=keyword_end(norm, places, K.DESTINATION_TOKENS))
    by_keywords = F.col("_kw_o").isNotNull() & F.col("_kw_d").isNotNull()
    direct = _any_in(norm, K.TICKET_WORDS) & (F.size(places) >= 2)
    single = F.size(places) == 1
    leads_away = single & ~_preceded(norm, first, K.DESTINATION_TOKENS) \
        & _preceded(norm, first, K.ORIGIN_TOKENS)
    guess_o = F.when(F.size(places) >= 2, first).when(leads_away, first)
    guess_d = F.when(F.size(places) >= 2, F.element_at(places, -1)).when(single & ~leads_away, first)
    origin = (F.when(by_keywords, F.col("_kw_o")).when(direct, first)
              .otherwise(F.coalesce("_kw_o", guess_o)))
    destination = (F.when(by_keywords, F.col("_kw_d")).when(direct, F.get(places, 1))
                   .otherwise(F.coalesce("_kw_d", guess_d)))
    method = (F.when(~F.col("_order"), "invalid").when(by_keywords, "keywords")
              .when(direct, "direct_format")
              .when(origin.isNotNull() | destination.isNotNull(), "heuristic").otherwise("failed"))
    picked = with_computed(rows, method=method, _o=F.when(F.col("_order"), origin),
                           _d=F.when(F.col("_order"), destination)) \
        .withColumn("valid", ~F.col("method").isin("invalid", "failed"))
    for key, end in (("_o", "origin"), ("_d", "destination")):
        names = gazetteer.select(F.col("norm").alias(key), F.col("canonical").alias(end))
        # the dictionary is known to be small when its keys fit the plan
        picked = left_lookup(picked, F.broadcast(names) if keys is not None else sized(names), [key], id_col)
    return picked.select(*found.columns, "origin", "destination", "valid", "method")


# ------------------------------------------------------------- token labels: E7-E9

def first_span(tokens: Column, labels: Column, kind: str) -> Column:
    """Name of the first span of a kind ('ORIGIN' or 'DEST'), null when absent.

    A B-label directly behind the span starts it over; anything else ends it.
    """
    begin, inside = f"B-{kind}", f"I-{kind}"
    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(0).alias("state"))

    def step(acc: Column, pair: Column) -> Column:
        label, token = pair["labels"], pair["tokens"]
        opened = F.struct(F.array(token).alias("words"), F.lit(1).alias("state"))
        longer = F.struct(F.concat(acc["words"], F.array(token)).alias("words"), F.lit(1).alias("state"))
        closed = F.struct(acc["words"].alias("words"), F.lit(2).alias("state"))
        return (F.when(acc["state"] == 2, acc).when(label == begin, opened)
                .when((label == inside) & (acc["state"] == 1), longer)
                .when(acc["state"] == 1, closed).otherwise(acc))

    pairs = F.arrays_zip(tokens.alias("tokens"), labels.alias("labels"))
    words = F.aggregate(pairs, start, step, lambda acc: acc["words"])
    return F.when(F.size(words) > 0, T.drop_leading_prepositions(T.join_tokens(words)))


def decode_spans(df: DataFrame, tokens: str = "tokens", labels: str = "labels") -> DataFrame:
    """E7 for a table: add ``origin`` and ``destination``; lengths must agree."""
    differs = F.size(tokens) != F.size(labels)
    wrong = F.raise_error(F.lit("tokens and labels differ in length")).cast("string")
    span = lambda kind: F.when(differs, wrong).otherwise(
        first_span(F.col(tokens), F.col(labels), kind))
    return with_computed(df, origin=span("ORIGIN"), destination=span("DEST"))


def all_spans(df: DataFrame, id_col: str, tokens: str = "tokens", labels: str = "labels") -> DataFrame:
    """Every span as a row (id, start, stop, kind, entity); 0-based, stop exclusive.

    An I-label of another kind closes the running span and opens a new one; an
    I-label without a running span is ignored.
    """
    positions = F.arrays_zip(F.col(labels).alias("label"),
                             F.sequence(F.lit(0), F.size(labels) - 1).alias("at"))
    kind_of = lambda label: F.substr(label, F.lit(3))
    span_type = "array<struct<start:int,stop:int,kind:string>>"
    start = F.struct(F.array().cast(span_type).alias("spans"),
                     F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("kind"))

    def flush(acc: Column, at: Column) -> Column:
        closed = F.array(F.struct(acc["start"].alias("start"), at.alias("stop"), acc["kind"].alias("kind")))
        return F.when(acc["kind"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], closed))

    def step(acc: Column, item: Column) -> Column:
        label, at, kind = item["label"], item["at"], kind_of(item["label"])
        inner = label.startswith("I-") & acc["kind"].isNotNull()
        opens = label.startswith("B-") | (inner & (acc["kind"] != kind))
        opened = F.struct(flush(acc, at).alias("spans"), at.alias("start"), kind.alias("kind"))
        ended = F.struct(flush(acc, at).alias("spans"), F.lit(None).cast("int").alias("start"),
                         F.lit(None).cast("string").alias("kind"))
        return F.when(opens, opened).when(inner, acc).otherwise(ended)

    spans = F.aggregate(positions, start, step, lambda acc: flush(acc, F.size(labels)))
    return (df.filter(F.size(labels) > 0).select(id_col, tokens, F.explode(spans).alias("s"))
            .select(id_col, "s.start", "s.stop", "s.kind",
                    T.join_tokens(F.slice(tokens, F.col("s.start") + 1,
                                          F.col("s.stop") - F.col("s.start"))).alias("entity")))


def drop_person_names(df: DataFrame, tokens: str = "tokens", labels: str = "labels") -> DataFrame:
    """Clear an end that is an ambiguous name right behind a person word."""
    def keep(end: str, kind: str) -> Column:
        at = F.array_position(labels, f"B-{kind}")
        before = F.lower(F.get(F.col(tokens), (at - 2).cast("int")))
        person = (F.lower(F.col(end)).isin(K.AMBIGUOUS_NAMES) & (at > 1)
                  & before.isin(K.PERSON_WORDS))
        return F.when(~F.coalesce(person, F.lit(False)), F.col(end))

    return df.withColumns({"origin": keep("origin", "ORIGIN"), "destination": keep("destination", "DEST")})
