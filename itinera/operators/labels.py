"""Token labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera import constants as K
from itinera.functions import text as T
from itinera.functions.once import bind, with_computed
from itinera.plans.lookup import counted

ALL_LABELS = list(K.LABEL_IDS)


def entity_positions(tokens: Column, entity: Column, known: Column, floor: float = 0.7,
                     max_distance: int = 3) -> Column:
    """0-based starts of the windows that are the entity, exactly or by similarity.

    The window is as long as the entity. A similar window counts only when the
    entity is a ``known`` dictionary place.
    """
    forms = F.struct(F.transform(tokens, _lower).alias("lowered"), F.transform(tokens, T.fuzzy_key).alias("keys"))
    return _found_at(forms, entity, T.label_tokens(entity), known, floor, max_distance)


def _token_forms(tokens: Column) -> Column:
    """Lower-case label tokens and their fuzzy keys; such tokens hold no line break, so all keys come from one text."""
    lines = F.regexp_replace(F.lower(T.remove_accents(F.array_join(tokens, "\n"), keep_cedilla=False)), "[^a-z0-9\n]", "")
    return F.struct(F.transform(tokens, _lower).alias("lowered"), F.split(lines, "\n").alias("keys"))


def _lower(token: Column) -> Column:
    return F.trim(F.lower(token))


def _found_at(forms: Column, entity: Column, parts: Column, known: Column, floor: float = 0.7, max_distance: int = 3) -> Column:
    """I11 on ``_token_forms`` of the tokens and the tokens of the entity."""
    def search(e: Column) -> Column:
        last = F.size(e["lowered"]) - e["size"]

        def hit(start: Column) -> Column:
            same = F.slice(e["lowered"], start + 1, e["size"]) == e["parts"]
            window = F.when(e["size"] == 1, F.get(e["keys"], start)).otherwise(F.array_join(F.slice(e["keys"], start + 1, e["size"]), ""))
            return same | (known & bind(window, near))

        def near(window: Column) -> Column:
            edits = F.levenshtein(window, e["key"], max_distance)
            longest = F.greatest(F.length(window), F.length(e["key"]), F.lit(1))
            return (edits >= 0) & (F.lit(1.0) - edits / longest > floor)

        starts = F.filter(F.sequence(F.lit(0), last), hit)
        return F.when((e["size"] > 0) & (last >= 0), starts).otherwise(F.array().cast("array<int>"))

    return bind(F.struct(F.transform(parts, _lower).alias("parts"), forms["lowered"].alias("lowered"), forms["keys"].alias("keys"),
                         F.size(parts).alias("size"), T.fuzzy_key(entity).alias("key")), search)


def bio_labels(orders: DataFrame, gazetteer: DataFrame, text_col: str = "sentence") -> DataFrame:
    """Add ``tokens`` and ``labels`` to labelled orders.

    Origin is its first hit; destination its first hit behind the origin, else its
    last hit. Invalid rows are all 'O'.
    """
    known = gazetteer.select(F.lower(F.trim("canonical")).alias("_p")).distinct()
    places = counted(known, "label-places").withColumn("_m", F.lit(True))
    text = lambda end: F.trim(F.coalesce(end, F.lit("")))
    rows = with_computed(orders, tokens=T.label_tokens(text_col), _op=T.label_tokens(text("origin")), _dp=T.label_tokens(text("destination")))
    rows = with_computed(rows, _forms=_token_forms(F.col("tokens")), _ow=F.size("_op"), _dw=F.size("_dp"))
    for end in ("origin", "destination"):
        rows = (rows.withColumn("_p", F.lower(F.trim(F.coalesce(end, F.lit("")))))
                .join(places.withColumnRenamed("_m", f"_known_{end}"), "_p", "left").drop("_p"))
    found = lambda end, parts: _found_at(F.col("_forms"), text(end), F.col(parts), F.coalesce(f"_known_{end}", F.lit(False)))
    rows = with_computed(rows, _origin=found("origin", "_op"), _destination=found("destination", "_dp"))
    rows = rows.withColumn("_oa", F.get("_origin", 0))
    behind = F.get(F.filter("_destination", lambda s: s >= F.col("_oa") + F.col("_ow")), 0)
    last = F.when(F.size("_destination") > 0, F.element_at("_destination", -1))
    rows = with_computed(rows, _da=F.coalesce(behind, last))

    def label(i: Column) -> Column:
        def inside(at: str, w: str) -> Column:
            return F.coalesce((i > F.col(at)) & (i < F.col(at) + F.col(w)), F.lit(False))

        starts = lambda at: F.coalesce(i == F.col(at), F.lit(False))
        return (F.when(F.col("is_valid") == 0, "O")
                .when(starts("_da"), "B-DEST").when(inside("_da", "_dw"), "I-DEST")
                .when(starts("_oa"), "B-ORIGIN").when(inside("_oa", "_ow"), "I-ORIGIN").otherwise("O"))

    labelled = with_computed(rows, labels=F.transform("tokens", lambda t, i: label(i)))
    return labelled.select(*orders.columns, "tokens", "labels")


def label_problems(df: DataFrame, tokens: str = "tokens", labels: str = "labels") -> DataFrame:
    """A8 row check: rows whose lengths differ or whose labels are outside the label set."""
    domain = F.array(*[F.lit(label) for label in ALL_LABELS])
    unknown = ~F.forall(labels, lambda x: F.array_contains(domain, x))
    differs = F.size(tokens) != F.size(labels)
    return with_computed(df, problem=F.when(differs, "length").when(unknown, "label")) \
        .filter(F.col("problem").isNotNull())


def align_subwords(subwords: DataFrame, word_labels: DataFrame) -> DataFrame:
    """Label id per sub-word.

    ``subwords`` has (ex_id, pos, word_id), ``word_labels`` (ex_id, word_id, label).
    The first sub-word of a word takes its label id; continuations and special
    sub-words (null word_id) take -100. Examples are short by construction.
    """
    previous = F.lag("word_id").over(Window.partitionBy("ex_id").orderBy("pos"))
    marked = subwords.withColumn("_first", F.col("word_id").isNotNull()
                                 & ~F.coalesce(previous == F.col("word_id"), F.lit(False)))
    ids = F.create_map(*[F.lit(x) for kv in K.LABEL_IDS.items() for x in kv])
    known = word_labels.select("ex_id", "word_id", ids[F.col("label")].alias("_id"))
    return (marked.join(known, ["ex_id", "word_id"], "left")
            .select("ex_id", "pos", "word_id",
                    F.when(F.col("_first"), F.col("_id")).otherwise(K.IGNORE_LABEL_ID).alias("label_id")))


def label_stats(examples: DataFrame) -> DataFrame:
    """Tokens per label with share, every label present: (label, n, share)."""
    counts = (examples.select(F.explode("labels").alias("label")).groupBy("label")
              .agg(F.count(F.lit(1)).alias("n")))
    names = examples.sparkSession.createDataFrame([(label,) for label in ALL_LABELS], "label string")
    total = counts.agg(F.sum("n")).scalar()
    return (names.join(counts, "label", "left").withColumn("_t", total)
            .select("label", F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("_t")), F.lit(0.0)).alias("share")))


def example_stats(examples: DataFrame) -> DataFrame:
    """Examples, valid, invalid, tokens (one row)."""
    return examples.agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.col("is_valid") == 1).alias("valid"),
                        F.count_if(F.col("is_valid") != 1).alias("invalid"),
                        F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("bigint").alias("tokens"))


def subword_stats(subwords: DataFrame, examples: DataFrame, max_length: int = 128) -> DataFrame:
    """Per split examples, truncated ones, average and largest sub-word count.

    ``examples`` has (ex_id, split, tokens). An example is truncated when its words
    exceed ``max_length`` minus the two special sub-words.
    """
    sizes = subwords.groupBy("ex_id").agg(F.count(F.lit(1)).alias("w"))
    return (examples.join(sizes, "ex_id", "left").withColumn("w", F.coalesce("w", F.lit(0))).groupBy("split")
            .agg(F.count(F.lit(1)).alias("num_examples"),
                 F.count_if(F.size("tokens") > max_length - 2).alias("num_truncated"),
                 F.avg("w").alias("avg_subword_len"), F.max("w").alias("max_subword_len")))
