"""Personal data: pattern spans, and more found by patterns that the corpus' own contexts teach.

Only built-in expressions run on the rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.llm.common import lookup_join
from itinera.plans.tables import TableStore

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Least distinct instances, seeds or discovered, that a pattern must meet, and the scores that patterns and instances need.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 3, 0.8, 0.75
#: Least share of known instances among all that a pattern meets, times the binary logarithm of one more than the known.
KNOWN_SHARE = 1.0

# A run's start is looked for only where a run can start (\G: right after the span before), and repeats never give
# back, so a match costs one pass; the spans are those of the plain patterns.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BASE = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}

# Shapes of what only a context can tell apart: spelt-out addresses, colon addresses, dotted cards, local numbers.
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_ -][0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+./-])\(?[0-9]{2,5}\)?(?:[ ./-]?[0-9]{2,8}){1,5}(?![0-9A-Za-z/-])",
}
_HINT = {"email": r"\((?:at)\)|\[at\]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]{4}", "phone": "[0-9]{2}"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string,near:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, present: Column) -> Column:
    """Matches with their places: lengths of the parts between matches and of the matches add up to positions.

    ``near`` holds the up to 48 characters before the match.
    """
    none = F.array().cast("array<string>")
    hits = F.when(present, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(none)
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(1))).alias("gap"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        span = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"),
                        p["hit"].alias("value"), F.right(p["gap"], F.lit(48)).alias("near"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.when(F.size(hits) > 0, F.aggregate(pairs, zero, step)["out"]).otherwise(F.array().cast(_SPAN))


def _listed(spans: Column) -> Column:
    """Spans as text: kind:start:end by kind, then start."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def _found(rows: DataFrame, store: TableStore) -> DataFrame:
    """Every row with its base spans and loose candidates; the only pass over the texts."""
    text = F.col("text")
    digits, at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    base = {k: _spans(text, k, p, at if k == "email" else digits) for k, p in _BASE.items()}
    loose = {k: _spans(text, k, p, text.rlike(_HINT[k]) if k == "email" else digits & text.rlike(_HINT[k]))
             for k, p in _LOOSE.items()}
    wide = rows.select("key", "doc_id", *[c.alias(f"b_{k}") for k, c in base.items()],
                       *[c.alias(f"l_{k}") for k, c in loose.items()])
    checked = lambda k: F.filter(f"b_{k}", lambda s: _holds(k, s["value"]))
    enough = F.filter("l_phone", lambda s: F.length(_digits(s["value"])).between(7, 15))
    sure = F.concat(*map(checked, KINDS))
    maybe = F.concat(*[enough if k == "phone" else F.col(f"l_{k}") for k in KINDS])
    free = F.filter("maybe", lambda m: ~F.exists("sure", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    # one written table keeps the spans from being worked out once for each use
    return store.write(wide.select("key", "doc_id", sure.alias("sure"), maybe.alias("maybe"))
                       .withColumn("maybe", F.when(F.size("maybe") > 0, free).otherwise(F.col("maybe"))), "found")[0]


def _patterns(near: Column) -> Column:
    """Lexical patterns of a place: the word before it, and the two words before it."""
    plain = F.trim(F.regexp_replace(F.lower(near), r"[^\p{L}\p{N}:=]+", " "))
    words = F.filter(F.split(plain, " "), lambda w: F.length(w) > 1)
    last = F.when(F.size(words) > 0, F.element_at(words, -1))
    two = F.when(F.size(words) > 1, F.concat_ws(" ", F.slice(words, -2, 2)))
    return F.array_compact(F.array(last, two))


def _learnt(found: DataFrame, store: TableStore) -> DataFrame:
    """Instances that patterns of high confidence discover: (kind, instance).

    A pattern's score is the share of its kind among the known instances that
    it meets: seeds count 1, others their score, and seeds of other kinds
    against it. Instances of which nothing is known only matter where they
    swamp the known ones (``KNOWN_SHARE``). An instance's score is the chance that not
    all of its patterns are wrong; one that is discovered supports further
    patterns as a seed does. Scores only rise from round to round, and rounds end
    when one adds neither a pattern nor an instance.
    """
    each = found.select("key", F.inline(F.concat(F.transform("sure", lambda s: s.withField("seed", F.lit(True))),
                                                 F.transform("maybe", lambda s: s.withField("seed", F.lit(False))))))
    graph = (each.select("kind", "seed", F.xxhash64("value").alias("instance"), F.explode(_patterns(F.col("near"))).alias("pattern"))
             .distinct())
    graph, _ = store.write(graph, "graph")
    seeds, _ = store.write(graph.filter("seed").groupBy("pattern").agg(F.count(F.lit(1)).alias("all_seeds")), "seeds")
    scores, before = None, (0, 0)
    for k in count():
        seen = graph if scores is None else graph.join(scores, ["kind", "instance", "seed"], "left")
        score = F.coalesce("score", F.lit(0.0)) if scores is not None else F.lit(0.0)
        known = F.when(F.col("seed"), 1.0).otherwise(score)
        other = F.col("all_seeds") - F.col("seeds")
        good = (seen.groupBy("kind", "pattern").agg(F.sum(known).alias("known"), F.count(F.lit(1)).alias("met"), F.count_if("seed").alias("seeds"),
                                                    F.count_if(F.col("seed") | (score >= INSTANCE_SCORE)).alias("support"))
                .filter(F.col("support") >= SUPPORT).join(seeds, "pattern", "left").withColumn("all_seeds", F.coalesce("all_seeds", F.lit(0)))
                .withColumn("trust", (F.col("known") + 0.5) / (F.col("known") + other + 1))
                .filter((F.col("trust") >= PATTERN_SCORE) & (F.log2(F.col("known") + 1) * F.col("known") / F.col("met") >= KNOWN_SHARE))
                .select("kind", "pattern", "trust"))
        good, patterns = store.write(good, f"patterns-{k}", n=F.count(F.lit(1)))
        met = graph.filter("not seed").join(good, ["kind", "pattern"])
        scores = met.groupBy("kind", "instance", "seed").agg((1 - F.exp(F.sum(F.log(1 - 0.95 * F.col("trust"))))).alias("score"))
        scores, instances = store.write(scores, f"scores-{k}", n=F.count_if(F.col("score") >= INSTANCE_SCORE))
        if before == (patterns["n"], instances["n"]):
            break
        before = patterns["n"], instances["n"]
    return scores.filter(F.col("score") >= INSTANCE_SCORE).select("kind", "instance")


def find_private(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Personal data in every whole text, seeds and what their contexts discover.

    Seeds are the spans of four strict patterns with checks. The words before
    them are lexical patterns of their kind; a graph of patterns and instances
    (seeds and loosely shaped candidates) is scored in rounds of joins and
    aggregates, and candidates that trusted patterns introduce become spans of
    the pattern's kind. Returns (doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, n_found): counts and digest are of the seeds alone,
    ``spans`` lists all, ``n_found`` counts discovered ones; positions are code
    points. Null and empty texts have none. Rows that repeat are each returned,
    null ids stay, other columns are not looked at. An empty table gives none.
    """
    store = TableStore(docs.sparkSession, "private")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_column), text).alias("key"), F.col(id_column).alias("doc_id"), text.alias("text"))
    found = _found(rows, store)
    learnt = _learnt(found, store)
    loose = found.filter(F.size("maybe") > 0).select("key", F.inline("maybe")).distinct()
    fresh = (loose.withColumn("instance", F.xxhash64("value")).join(learnt, ["kind", "instance"])
             .groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("fresh")))
    fresh, seen = store.write(fresh, "fresh", n=F.count(F.lit(1)))
    sure = F.transform("sure", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    joined = (lookup_join(found, fresh, ["key"], "left", seen["n"])
              .withColumn("base", sure).withColumn("fresh", F.coalesce("fresh", F.array().cast(
                  "array<struct<kind:int,start:bigint,end:bigint>>"))))
    of = lambda i: F.size(F.filter("sure", lambda s: s["kind"] == i)).cast("bigint")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return joined.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                         _listed(F.concat("base", "fresh")).alias("spans"), F.size("fresh").cast("bigint").alias("n_found"))
