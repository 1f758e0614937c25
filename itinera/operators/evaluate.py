"""Prediction quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera import constants as K
from itinera.functions import text as T
from itinera.operators.matching import similar_entries
from itinera.plans.ranking import top_in_group


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def compare(truth: DataFrame, predictions: DataFrame, how: str = "left", id_col: str = "sentenceID",
            legacy_missing: bool = False) -> DataFrame:
    """C1 (left) / C2 (inner): truth next to prediction, with every flag the metrics need.

    A null, empty or INVALID end counts as predicted invalid; ``legacy_missing=True``
    counts only INVALID (P5).
    """
    predicted = predictions.select(id_col, F.col("origin").alias("pred_origin"),
                                   F.col("destination").alias("pred_destination"),
                                   F.lit(True).alias("_found"))
    joined = truth.join(predicted, id_col, how)
    forms = {"t_o": "origin", "t_d": "destination", "p_o": "pred_origin", "p_d": "pred_destination"}
    joined = joined.withColumns({k: T.comparison_form(v) for k, v in forms.items()})
    nothing = ["INVALID"] if legacy_missing else ["INVALID", ""]
    flags = {
        "origin_ok": F.col("t_o") == F.col("p_o"),
        "dest_ok": F.col("t_d") == F.col("p_d"),
        "exact": (F.col("t_o") == F.col("p_o")) & (F.col("t_d") == F.col("p_d")),
        "truth_valid": F.coalesce(F.col("is_valid") == 1, F.lit(False)),
        "pred_valid": ~F.col("p_o").isin(nothing) & ~F.col("p_d").isin(nothing),
        "pred_found": F.coalesce("_found", F.lit(False)),
    }
    return joined.withColumns(flags).drop("_found")


def valid_only(joined: DataFrame, category: str | None = None, difficulty: str | None = None) -> DataFrame:
    """Valid rows, optionally of one category or difficulty."""
    out = joined.filter("truth_valid")
    out = out if category is None else out.filter(F.col("category") == category)
    return out if difficulty is None else out.filter(F.col("difficulty") == difficulty)


def _accuracy_columns() -> list[Column]:
    valid = F.col("truth_valid")
    n = F.count_if(valid)
    o, d, e = (F.count_if(valid & F.col(c)) for c in ("origin_ok", "dest_ok", "exact"))
    return [n.alias("total_valid_orders"), o.alias("origin_correct"), d.alias("destination_correct"),
            e.alias("exact_match"), _ratio(o, n).alias("origin_accuracy"),
            _ratio(d, n).alias("destination_accuracy"), _ratio(e, n).alias("exact_match_accuracy")]


def _validity_columns() -> list[Column]:
    t, p = F.col("truth_valid"), F.col("pred_valid")
    tp, tn = F.count_if(t & p), F.count_if(~t & ~p)
    fp, fn = F.count_if(~t & p), F.count_if(t & ~p)
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))
    return [tp.alias("true_positives"), tn.alias("true_negatives"), fp.alias("false_positives"),
            fn.alias("false_negatives"), _ratio(tp + tn, F.count(F.lit(1))).alias("validity_accuracy"),
            precision.alias("validity_precision"), recall.alias("validity_recall"), f1.alias("validity_f1")]


def accuracy(joined: DataFrame) -> DataFrame:
    """Extraction accuracy over valid rows (one row)."""
    return joined.agg(*_accuracy_columns())


def validity(joined: DataFrame) -> DataFrame:
    """D3: validity precision, recall, F1, accuracy and counts (one row)."""
    return joined.agg(*_validity_columns())


def confusion(joined: DataFrame) -> DataFrame:
    """Two rows (actual), columns predicted_invalid / predicted_valid."""
    counts = joined.groupBy("truth_valid").agg(
        F.count_if(~F.col("pred_valid")).alias("i"), F.count_if("pred_valid").alias("v"))
    rows = joined.sparkSession.createDataFrame([(False, "invalid"), (True, "valid")],
                                               "truth_valid boolean, actual string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.join(counts, "truth_valid", "left").select(
        "actual", zero("i").alias("predicted_invalid"), zero("v").alias("predicted_valid"))


def robustness(joined: DataFrame, categories=tuple(K.ROBUSTNESS_CATEGORIES),
               difficulties=tuple(K.DIFFICULTIES)) -> DataFrame:
    """(slice, accuracy) for named categories (null when absent) and present difficulties."""
    slices = slice_breakdown(joined)
    names = joined.sparkSession.createDataFrame(
        [("category", c, c) for c in categories]
        + [("difficulty", d, f"difficulty_{d}") for d in difficulties],
        "slice_kind string, slice string, name string")
    found = names.join(slices, ["slice_kind", "slice"], "left")
    return found.filter((F.col("slice_kind") == "category") | F.col("accuracy").isNotNull()) \
        .select(F.col("name").alias("slice"), "accuracy")


def slice_breakdown(joined: DataFrame, correct: str = "exact") -> DataFrame:
    """(slice_kind, slice, total, correct, accuracy) by category, difficulty and overall."""
    sets = valid_only(joined).groupingSets(
        [[F.col("category")], [F.col("difficulty")], []], F.col("category"), F.col("difficulty")) \
        .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("total"),
             F.count_if(F.col(correct)).alias("correct"))
    kind = F.when(F.col("gid") == 1, "category").when(F.col("gid") == 2, "difficulty").otherwise("all")
    name = F.when(F.col("gid") == 1, F.col("category")).when(F.col("gid") == 2, F.col("difficulty")).otherwise("all")
    return sets.select(kind.alias("slice_kind"), name.alias("slice"), "total", "correct",
                       _ratio(F.col("correct"), F.col("total")).alias("accuracy"))


def full_evaluation(truth: DataFrame, predictions: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary row, slice table, robustness table) from one comparison.

    The comparison feeds three small aggregates; the caller writes or persists
    its inputs where they are dear to compute.
    """
    joined = compare(truth, predictions, **options).select(
        "category", "difficulty", "truth_valid", "pred_valid", "origin_ok", "dest_ok", "exact")
    summary = joined.agg(*_accuracy_columns(), *_validity_columns())
    return summary, slice_breakdown(joined), robustness(joined)


def simple_accuracy(rows: DataFrame) -> DataFrame:
    """Raw equality of (origin, expected_origin) and (destination, expected_destination).

    A missing end equals the text INVALID.
    """
    shown = lambda c: F.coalesce(c, F.lit("INVALID"))
    o = shown("origin") == shown("expected_origin")
    d = shown("destination") == shown("expected_destination")
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), F.count_if(o & d).alias("correct"),
                    _ratio(F.count_if(o & d), n).alias("accuracy"),
                    _ratio(F.count_if(o), n).alias("origin_accuracy"),
                    _ratio(F.count_if(d), n).alias("destination_accuracy"))


def _plain(col: str) -> Column:
    return F.trim(F.coalesce(col, F.lit("")))


def whole_set(joined: DataFrame) -> DataFrame:
    """Every row counts, empty matching empty (one row).

    End ratios are over valid rows and count hits on valid rows only (P5).
    """
    o = _plain("origin") == _plain("pred_origin")
    d = _plain("destination") == _plain("pred_destination")
    valid = F.col("truth_valid")
    predicted = (_plain("pred_origin") != "") & (_plain("pred_destination") != "")
    n, nv = F.count(F.lit(1)), F.count_if(valid)
    tp, tn = F.count_if(valid & predicted), F.count_if(~valid & ~predicted)
    fp, fn = F.count_if(~valid & predicted), F.count_if(valid & ~predicted)
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))
    return joined.agg(
        n.alias("total"), nv.alias("valid_orders"), (n - nv).alias("invalid_orders"),
        F.count_if(o & d).alias("correct"), _ratio(F.count_if(o & d), n).alias("accuracy"),
        _ratio(F.count_if(valid & o), nv).alias("origin_accuracy"),
        _ratio(F.count_if(valid & d), nv).alias("dest_accuracy"),
        tp.alias("true_positive"), tn.alias("true_negative"), fp.alias("false_positive"),
        fn.alias("false_negative"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1_score"),
        F.count_if(~o & ~d).alias("both_wrong"), F.count_if(~o & d).alias("origin_wrong"),
        F.count_if(o & ~d).alias("dest_wrong"))


def fuzzy_accuracy(joined: DataFrame, gazetteer: DataFrame, max_distance: int = 3) -> DataFrame:
    """Slice accuracy where a misspelt prediction may resolve to the expected place.

    Similar places are looked up once per distinct predicted name.
    """
    plain = lambda c: F.lower(_plain(c))
    predicted = joined.select(F.explode(F.array("pred_origin", "pred_destination")).alias("query")).distinct() \
        .filter(F.coalesce("query", F.lit("")) != "")
    similar = (similar_entries(predicted, gazetteer, max_distance=max_distance)
               .select("query", F.lower(F.trim("canonical")).alias("expected")).distinct()
               .withColumn("near", F.lit(True)))
    out = joined
    for end, name in (("origin", "_o"), ("destination", "_d")):
        pairs = similar.select(F.col("query").alias(f"pred_{end}"), F.col("expected").alias("_e"),
                               F.col("near").alias("_near"))
        both = (F.coalesce(f"pred_{end}", F.lit("")) != "") & (F.coalesce(end, F.lit("")) != "")
        same = plain(f"pred_{end}") == plain(end)
        out = (out.withColumn("_e", plain(end)).join(pairs, [f"pred_{end}", "_e"], "left")
               .withColumn(name, same | (both & F.coalesce("_near", F.lit(False)))).drop("_e", "_near"))
    return slice_breakdown(out.withColumn("fuzzy_exact", F.col("_o") & F.col("_d")), correct="fuzzy_exact")


# --------------------------------------------------------------------- error mining

def error_distribution(joined: DataFrame) -> DataFrame:
    """(outcome, n) over valid rows."""
    outcome = (F.when(F.col("origin_ok") & F.col("dest_ok"), "both_correct")
               .when(F.col("origin_ok"), "dest_wrong_only").when(F.col("dest_ok"), "origin_wrong_only")
               .otherwise("both_wrong"))
    return valid_only(joined).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def error_kinds(joined: DataFrame) -> DataFrame:
    """Overlapping error kinds among wrong rows (one row)."""
    wrong = valid_only(joined).filter(~F.col("exact"))
    return wrong.agg(
        F.count(F.lit(1)).alias("errors"),
        F.count_if((F.col("t_o") == F.col("p_d")) & (F.col("t_d") == F.col("p_o"))).alias("swapped"),
        F.count_if(F.col("p_o") == F.col("p_d")).alias("duplicated"),
        F.count_if(F.col("p_o") == "INVALID").alias("origin_missing"),
        F.count_if(F.col("p_d") == "INVALID").alias("dest_missing"))


def misidentified(joined: DataFrame, k: int | None = None) -> DataFrame:
    """(end, place, errors, occurrences, error_rate); with ``k`` the worst k per end."""
    ends = F.array(F.struct(F.lit("origin").alias("end"), F.col("origin").alias("place"), F.col("origin_ok").alias("ok")),
                   F.struct(F.lit("destination").alias("end"), F.col("destination").alias("place"), F.col("dest_ok").alias("ok")))
    counts = (valid_only(joined).select(F.explode(ends).alias("e")).select("e.*").groupBy("end", "place")
              .agg(F.count_if(~F.col("ok")).alias("errors"), F.count(F.lit(1)).alias("occurrences"))
              .filter(F.col("errors") > 0)
              .withColumn("error_rate", _ratio(F.col("errors"), F.col("occurrences"))))
    return counts if k is None else \
        top_in_group(counts, ["end"], [F.desc("errors"), "place"], k).drop("rank")


def slice_ranking(joined: DataFrame, kind: str = "category") -> DataFrame:
    """Slices of a kind with errors and accuracy rounded to 4 digits; order by accuracy."""
    return (slice_breakdown(joined).filter(F.col("slice_kind") == kind)
            .select("slice", "total", "correct", (F.col("total") - F.col("correct")).alias("errors"),
                    F.round("accuracy", 4).alias("accuracy")))


def worst_slices(slices: DataFrame, k: int = 10) -> DataFrame:
    """the k slices with the lowest accuracy."""
    return slices.orderBy("accuracy", "slice").limit(k)


def failure_examples(joined: DataFrame, n: int = 5, difficulty: str | None = None) -> DataFrame:
    """The first n wrong rows per category, in id order."""
    wrong = valid_only(joined, difficulty=difficulty).filter(~F.col("exact"))
    rows = wrong.select("category", "sentenceID", "sentence",
                        F.coalesce("origin", F.lit("")).alias("expected_origin"),
                        F.coalesce("destination", F.lit("")).alias("expected_dest"),
                        F.col("pred_origin").alias("predicted_origin"),
                        F.col("pred_destination").alias("predicted_dest"))
    return top_in_group(rows, ["category"], ["sentenceID"], n)


def compare_models(base: DataFrame, other: DataFrame, k: int = 5) -> DataFrame:
    """Slice tables side by side; overall, difficulties, and the k largest categories."""
    side = lambda df, p: df.select("slice_kind", "slice", F.col("total").alias(f"{p}_total"),
                                   F.col("accuracy").alias(f"{p}_accuracy"))
    both = side(base, "base").join(side(other, "other"), ["slice_kind", "slice"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    table = both.select("slice_kind", "slice", F.coalesce("base_total", F.lit(0)).alias("base_total"),
                        F.coalesce("other_total", F.lit(0)).alias("other_total"),
                        zero("base_accuracy").alias("base_accuracy"), zero("other_accuracy").alias("other_accuracy"),
                        (zero("other_accuracy") - zero("base_accuracy")).alias("improvement"))
    largest = table.filter(F.col("slice_kind") == "category").orderBy(F.desc("other_total"), "slice").limit(k)
    return table.filter(F.col("slice_kind") != "category").unionByName(largest)


def metric_rows(joined: DataFrame) -> DataFrame:
    """Metrics in long form (metric, value): D2, D3, D12 figures and robustness slices."""
    wrong = F.col("truth_valid") & F.col("pred_found") & ~F.col("exact")
    one = joined.agg(*_accuracy_columns(), *_validity_columns(),
                     F.count_if(wrong & (F.col("p_o") == F.col("p_d"))).alias("duplicated"))
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])
    slices = robustness(joined).filter(F.col("accuracy").isNotNull()) \
        .select(F.concat(F.lit("robustness."), "slice").alias("metric"), F.col("accuracy").alias("value"))
    return one.select(F.explode(pairs).alias("m")).select("m.*").unionByName(slices)


def finding_rules(spark: SparkSession) -> DataFrame:
    """Default rules of D25."""
    return spark.createDataFrame(K.FINDING_RULES,
                                 "metric string, op string, threshold double, priority string, issue string")


def findings(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose metric crosses its threshold."""
    hit = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return rules.join(metrics, "metric").filter(hit).select("priority", "issue", "metric", "value", "threshold")
