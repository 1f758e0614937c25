"""Data-set preparation and checks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera import constants as K
from itinera.functions import text as T
from itinera.plans.ranking import GROUP_LIMIT, first_n, ordinal, rank_in_group, same_keys, top_in_group
from itinera.plans.tables import TableStore

ID = "sentenceID"


# ------------------------------------------------------------- ids, order, samples

def resequence(df: DataFrame, order: Sequence, id_col: str = ID) -> DataFrame:
    """New ids 1..n in ``order``."""
    rest = [c for c in df.columns if c != id_col]
    return ordinal(df, order, "_new").select(F.col("_new").alias(id_col), *rest)


def deduplicate(df: DataFrame, key: str = "sentence", order: Sequence[str] = (ID,)) -> DataFrame:
    """First row per exact key. Partial aggregation keeps one row per key and map task."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
            .select(key, "r.*").select(*df.columns))


def dedupe_resequence(df: DataFrame, key: str = "sentence", order: Sequence[str] = (ID,)) -> DataFrame:
    """G3 + E4."""
    return resequence(deduplicate(df, key, order), order)


def sample_per_category(df: DataFrame, n: int = 5, seed: int = 42, category: str = "category") -> DataFrame:
    """n seeded rows per category."""
    keyed = df.withColumn("_h", T.seeded_hash(seed, ID))
    return top_in_group(keyed, [category], ["_h", ID], n).drop("_h", "rank")


def trim_exact(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n seeded rows in id order, renumbered; the whole table when it is not longer.

    The cut is found by counting the hashes of the ids, so texts are neither
    sorted nor copied before it; ``n`` may be of any size. Null ids come first.
    """
    hashed = F.conv(F.substring(T.seeded_hash(seed, ID), 1, 15), 16, 10).cast("bigint")
    return resequence(first_n(df, F.coalesce(hashed, F.lit(-1)), n, [T.seeded_hash(seed, ID), ID]), [ID])


def shuffle_resequence(df: DataFrame, seed: int = 42) -> DataFrame:
    """seeded order, renumbered."""
    return resequence(df.withColumn("_h", T.seeded_hash(seed, ID)), ["_h", ID]).drop("_h")


def top_up(existing: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """Existing rows, then candidates, without repeated sentences, cut to n and renumbered.

    Repeats are found and the cut is made on (hash of the sentence, source, id);
    the texts are read once more and meet the kept keys only.
    """
    both = (existing.withColumn("_src", F.lit(0))
            .unionByName(candidates.select(*existing.columns).withColumn("_src", F.lit(1)))
            .withColumn("_md5", F.md5("sentence")))
    first = both.groupBy("_md5").agg(F.min(F.struct("_src", ID)).alias("k")).select("_md5", "k.*")
    keys, seen = TableStore(both.sparkSession, "top-up").write(
        first, "keys", old=F.count_if(F.col("_src") == 0), ids=F.count(ID), n=F.count(F.lit(1)))
    whole = dict(keys.dtypes)[ID] in ("tinyint", "smallint", "int", "bigint") and seen["ids"] == seen["n"]

    def cut(part: DataFrame, size: int) -> DataFrame:
        return first_n(part, F.col(ID), size, ["_md5"]) if whole else \
            ordinal(part, [ID, "_md5"], "_pos").filter(F.col("_pos") <= size).drop("_pos")

    old, new = keys.filter(F.col("_src") == 0), keys.filter(F.col("_src") == 1)
    kept = cut(old, n) if seen["old"] >= n else old.unionByName(cut(new, n - seen["old"]))
    rows = deduplicate(same_keys(both, kept, ["_md5", "_src", ID], "left_semi").drop("_md5"), "sentence", ["_src", ID])
    return resequence(rows.withColumn("_old", F.col(ID)), ["_src", "_old"]).drop("_src", "_old")


# --------------------------------------------------------------------- H19: templates

def misspell(city: Column, variants: Column | None = None, seed: int = 42) -> Column:
    """Seeded misspelling: a known variant, else drop the last letter or double an inner one."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), city))
    number = F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint")
    at = (number % F.greatest(F.length(city) - 2, F.lit(1)) + 2).cast("int")
    doubled = F.concat(F.substring(city, F.lit(1), at), F.substring(city, at, F.length(city)))
    dropped = F.substring(city, F.lit(1), F.length(city) - 1)
    generic = F.when(F.length(city) <= 4, city).when(number % 2 == 0, dropped).otherwise(doubled)
    if variants is None:
        return generic
    pick = F.get(variants, (number % F.greatest(F.size(variants), F.lit(1))).cast("int"))
    return F.when(F.coalesce(F.size(variants), F.lit(0)) > 0, pick).otherwise(generic)


def pair_step(total: int) -> int:
    """The step that walks 0..total-1 without a repeat: the first number above 0.618 of it that shares no factor with it."""
    return next(x for x in itertools.count(total * 618_033_989 // 1_000_000_000 + 1) if math.gcd(x, total) == 1)


#: Places in a block; a pair of blocks unfolds to the square of it.
PLACE_BLOCK = 1000


def _every_pair(templates: DataFrame, places: DataFrame, n_templates: int, n_places: int) -> DataFrame:
    """Template columns, origin, destination and row number of the whole product of H19."""
    spark = places.sparkSession
    tasks = 16 * spark.sparkContext.defaultParallelism
    size = max(1, min(PLACE_BLOCK, math.ceil(n_places / math.ceil(math.sqrt(tasks)))))
    block = (places.select(F.col("k").cast("bigint").alias("k"), "name").filter(F.col("k").between(0, n_places - 1))
             .groupBy(F.floor(F.col("k") / size).alias("b")).agg(F.collect_list(F.struct("k", "name")).alias("items")))
    blocks, _ = TableStore(spark, "blocks").write(block, "places")
    side = lambda end: blocks.select(F.col("b").alias(f"{end}b"), F.col("items").alias(f"{end}s"))
    asked = templates.filter(F.col("t").between(0, n_templates - 1))
    unfolded = (side("o").hint("shuffle_replicate_nl").crossJoin(side("d")).crossJoin(F.broadcast(asked))
                .repartition(tasks, "ob", "db", "t")
                .select(*asked.columns, F.explode("os").alias("o"), "ds")
                .select(*asked.columns, "o", F.explode("ds").alias("d")).filter(F.col("o.k") != F.col("d.k")))
    number = (F.col("t") * n_places + F.col("o.k")) * (n_places - 1) + F.col("d.k") - F.when(F.col("d.k") > F.col("o.k"), 1).otherwise(0) + 1
    return unfolded.select(*asked.columns, number.alias(ID), F.col("o.name").alias("origin"), F.col("d.name").alias("destination"))


def expand_templates(templates: DataFrame, places: DataFrame, n_templates: int, n_places: int,
                     marks: tuple[str, str] = ("{origin}", "{destination}"), n: int | None = None, seed: int = 42) -> DataFrame:
    """Every template with every ordered pair of different places, or ``n`` of them without a repeat.

    With ``n`` the row numbers 0..n-1 are mapped into the product by a seeded
    permutation of it, so the other combinations are never made; a larger ``n``
    than the product gives the whole product in that order.

    ``templates`` has (t, template, category, difficulty, lower) and ``places``
    (k, name), both numbered from 0. The whole product is made of pairs of blocks
    of places: only these are shuffled, and a task unfolds them row by row. With
    ``n`` template and places of each row number are looked up.
    """
    filled = F.replace(F.replace("template", F.lit(marks[0]), F.col("origin")),
                       F.lit(marks[1]), F.col("destination"))
    shown = [F.when(F.col("lower"), F.lower(filled)).otherwise(filled).alias("sentence"), "origin", "destination",
             F.lit(1).alias("is_valid"), "difficulty", "category", F.lit("").alias("notes")]
    templates = templates.withColumn("t", F.col("t").cast("bigint"))
    if n is None:
        return _every_pair(templates, places, n_templates, n_places).select(ID, *shown)
    spark = templates.sparkSession
    pairs = n_places * (n_places - 1)
    total = n_templates * pairs
    rows = spark.range(max(0, min(n, total))).withColumn("number", F.col("id") + 1)
    if total:
        wide = lambda c: c.cast("decimal(19,0)")
        rows = rows.withColumn("id", ((wide(F.col("id")) * wide(F.lit(pair_step(total))) + F.lit(seed % total)) % F.lit(total)).cast("bigint"))
    at = F.col("id")
    other = at % (n_places - 1)
    first = F.floor(at % pairs / (n_places - 1)).cast("bigint")
    numbers = rows.select(
        F.col("number").alias(ID), F.floor(at / pairs).cast("bigint").alias("t"), first.alias("o"),
        F.when(other >= first, other + 1).otherwise(other).alias("d"))
    end = lambda k, name: places.select(F.col("k").cast("bigint").alias(k), F.col("name").alias(name))
    return (numbers.join(templates, "t").join(end("o", "origin"), "o").join(end("d", "destination"), "d")
            .select(ID, *shown))


# ------------------------------------------------------------------------- J15: split

def stratified_split(df: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15,
                     strata: Sequence[str] = ("is_valid",), seed: int = 42,
                     group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``split`` with exact sizes per stratum: test int(n x test), then val, rest train."""
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("split ratios must sum to 1")
    strata = list(strata)
    keyed = df.withColumn("_h", T.seeded_hash(seed, ID))
    ranked = rank_in_group(keyed, strata, ["_h", ID], "_pos", group_limit)
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    n_test = F.floor(F.col("_n") * F.lit(test))
    n_val = F.floor((F.col("_n") - n_test) * F.lit(val / (train + val)))
    split = (F.when(F.col("_pos") <= n_test, "test")
             .when(F.col("_pos") <= n_test + n_val, "val").otherwise("train"))
    return same_keys(ranked, sizes, strata).select(*df.columns, split.alias("split"))


def leaked_ids(splits: DataFrame, id_col: str = ID) -> DataFrame:
    """Ids found in more than one split (must be empty)."""
    return (splits.groupBy(id_col).agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
            .filter(F.col("first_split") != F.col("last_split")))


def common_ids(left: DataFrame, right: DataFrame, id_col: str = ID) -> DataFrame:
    """G4, pairwise form."""
    return left.select(id_col).intersect(right.select(id_col))


def split_crosstab(splits: DataFrame) -> DataFrame:
    """Rows per category and split with the share of the category total."""
    names = ["train", "val", "test"]
    counts = splits.groupBy("category").pivot("split", names).agg(F.count(F.lit(1)))
    counts = counts.select("category", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    total = sum((F.col(n) for n in names), F.lit(0))
    return counts.select("category", *names, total.alias("total"),
                         *[(F.col(n) / total).alias(f"{n}_share") for n in names])


def split_stats(splits: DataFrame) -> DataFrame:
    """Per split: rows, valid, invalid, average words per validity."""
    valid = F.col("is_valid") == 1
    words = T.word_count("sentence")
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"),
        F.avg(F.when(valid, words)).alias("avg_words_valid"), F.avg(F.when(~valid, words)).alias("avg_words_invalid"))


# -------------------------------------------------------------------------- statistics

def dataset_stats(df: DataFrame) -> DataFrame:
    """(slice_kind, slice, n, percent) for all, validity, category and difficulty in one pass."""
    cols = ["is_valid", "category", "difficulty"]
    sets = df.groupingSets([[F.col(c)] for c in cols] + [[]], *[F.col(c) for c in cols]) \
        .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("gid") == 3, "validity").when(F.col("gid") == 5, "category") \
        .when(F.col("gid") == 6, "difficulty").otherwise("all")
    name = (F.when(F.col("gid") == 3, F.when(F.col("is_valid") == 1, "valid").otherwise("invalid"))
            .when(F.col("gid") == 5, F.col("category")).when(F.col("gid") == 6, F.col("difficulty"))
            .otherwise("all"))
    rows = sets.select(kind.alias("slice_kind"), name.alias("slice"), "n")
    total = df.agg(F.count(F.lit(1))).scalar()
    return rows.select("slice_kind", "slice", "n", (F.col("n") * 100.0 / total).alias("percent"))


def length_stats(df: DataFrame) -> DataFrame:
    """Least, largest and average words per sentence, overall and per validity."""
    sized = df.select("is_valid", T.word_count("sentence").alias("w"))
    stats = sized.groupingSets([[F.col("is_valid")], []], F.col("is_valid")).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.min("w").alias("min_words"),
        F.max("w").alias("max_words"), F.avg("w").alias("avg_words"))
    name = F.when(F.col("gid") == 1, "all").when(F.col("is_valid") == 1, "valid").otherwise("invalid")
    return stats.select(name.alias("slice"), "n", "min_words", "max_words", "avg_words")


def place_usage(df: DataFrame, k: int | None = None) -> DataFrame:
    """Uses of each place as either end of a valid row; optionally the k most used."""
    ends = df.filter(F.col("is_valid") == 1).select(F.explode(F.array("origin", "destination")).alias("place")) \
        .filter(F.coalesce("place", F.lit("")) != "")
    counts = ends.groupBy("place").agg(F.count(F.lit(1)).alias("uses"))
    return counts if k is None else counts.orderBy(F.desc("uses"), "place").limit(k)


# ------------------------------------------------------------------------------ checks

def _check(name: str, slice_: Column, expected: Column, actual: Column, ok: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), slice_.cast("string").alias("slice"),
                    expected.cast("double").alias("expected"), actual.cast("double").alias("actual"),
                    F.when(ok, "ok").otherwise("failed").alias("status"))


def structure_check(df: DataFrame, expected_rows: int | None = None,
                    required: Sequence[str] = tuple(K.LABELLED_COLUMNS)) -> DataFrame:
    """Row count, required columns, duplicate sentences, sequential ids, as check rows."""
    missing = [c for c in required if c not in df.columns]
    n = F.count(F.lit(1))
    # counted over one row per sentence and one row per id: no distinct set is held in a task
    per_sentence = df.groupBy("sentence").agg(n.alias("c"))
    duplicates = per_sentence.agg(F.count_if(F.col("c") > 1).alias("duplicated"),
                                  F.coalesce(F.sum("c"), F.lit(0)).alias("rows"))
    one = duplicates.withColumn("is_sequential", sequence_check(df).select("is_sequential").scalar())
    wanted = F.lit(expected_rows) if expected_rows is not None else F.col("rows")
    none = F.lit("all")
    checks = F.array(
        _check("row_count", none, wanted, F.col("rows"), F.col("rows") == wanted),
        _check("missing_columns", F.lit(",".join(missing) or "none"), F.lit(0), F.lit(len(missing)), F.lit(not missing)),
        _check("duplicate_sentences", none, F.lit(0), F.col("duplicated"), F.col("duplicated") == 0),
        _check("sequential_ids", none, F.lit(1), F.col("is_sequential").cast("int"), F.col("is_sequential")))
    return one.select(F.explode(checks).alias("c")).select("c.*")


def duplicate_sentences(df: DataFrame, k: int = 20) -> DataFrame:
    """The k most repeated sentences."""
    return (df.groupBy("sentence").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
            .orderBy(F.desc("n"), "sentence").limit(k))


def sequence_check(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Whether the ids are exactly 1..n (one row)."""
    per_id = df.groupBy(F.col(id_col).cast("bigint").alias("i")).agg(F.count(F.lit(1)).alias("c"))
    stats = per_id.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("i").alias("n_distinct"),
                       F.min("i").alias("min_id"), F.max("i").alias("max_id"))
    good = (F.col("n") > 0) & (F.col("min_id") == 1) & (F.col("max_id") == F.col("n")) \
        & (F.col("n_distinct") == F.col("n"))
    return stats.select("n", "n_distinct", "min_id", "max_id", F.coalesce(good, F.lit(False)).alias("is_sequential"))


def in_file_order(df: DataFrame, seq: str, id_col: str = ID) -> DataFrame:
    """E11, order part: rows whose id is not their place in file order (must be empty)."""
    return ordinal(df, [seq], "_pos").filter(F.col("_pos") != F.col(id_col).cast("bigint")) \
        .select(id_col, F.col("_pos").alias("expected"))


def distribution_check(df: DataFrame, targets: DataFrame, difficulty_shares: DataFrame,
                       tolerance: float = 0.05) -> DataFrame:
    """Category targets, difficulty shares and label consistency as check rows.

    ``targets`` has (category, expected), ``difficulty_shares`` (difficulty, share).
    Shares count valid rows and tolerate 5 % of the expected count.
    """
    valid = F.col("is_valid") == 1
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    n = F.count(F.lit(1))

    def within(expected: Column, actual: Column) -> Column:
        return actual.between(expected * F.lit(1 - tolerance), expected * F.lit(1 + tolerance))

    zero = lambda c: F.coalesce(c, F.lit(0))
    category = targets.join(df.groupBy("category").agg(n.alias("_a")), "category", "left") \
        .select(_check("category", F.col("category"), F.col("expected"), zero("_a"),
                       within(F.col("expected"), zero("_a"))).alias("c"))
    total = df.agg(F.count_if(valid)).scalar()
    shares = (difficulty_shares.withColumn("_t", total)
              .join(df.filter(valid).groupBy("difficulty").agg(n.alias("_a")), "difficulty", "left")
              .withColumn("expected", F.col("_t") * F.col("share"))
              .select(_check("difficulty", F.col("difficulty"), F.col("expected"), zero("_a"),
                             within(F.col("expected"), zero("_a"))).alias("c")))
    broken = df.agg(F.count_if(valid & empty("origin")).alias("valid_without_origin"),
                    F.count_if(valid & empty("destination")).alias("valid_without_destination"),
                    F.count_if(~valid & ~empty("origin")).alias("invalid_with_origin"),
                    F.count_if(~valid & ~empty("destination")).alias("invalid_with_destination"))
    labels = broken.select(F.explode(F.array(*[
        _check("labels", F.lit(c), F.lit(0), F.col(c), F.col(c) == 0) for c in broken.columns])).alias("c"))
    return category.unionByName(shares).unionByName(labels).select("c.*")
