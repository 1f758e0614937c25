"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.llm.common import lookup_join, once_per_worker, set_apart, text_or_empty
from itinera.llm.html_text import main_text
from itinera.plans.tables import TableStore

#: Labelled rows of a language that the text model is fitted on, at most about so many; most languages it tells apart.
TRAINING_ROWS, MOST_LANGUAGES = 5_000, 200
#: Slots of the hashed letter triples; triples after which more text adds no evidence (a likelihood's weight, not a cut).
SLOTS, FULL_WEIGHT = 1 << 15, 100.0
#: Strength of the level above in smoothed host priors, pseudo-counts of declared languages and suffixes, least confidence.
HOST_STRENGTH, EVIDENCE_STRENGTH, CONFIDENT = 10.0, 2.0, 0.5

_LETTERS = re.compile(r"[^\W\d_]+")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_ADDRESS = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)"


def triples(text: str) -> np.ndarray:
    """Slots of the byte triples of a text's words, lower case, one space between words; none without letters."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return np.empty(0, dtype=np.int64)
    raw = np.frombuffer((" " + " ".join(words) + " ").encode(), dtype=np.uint8).astype(np.int64)
    x = (raw[:-2] * 0x1003F + raw[1:-1] * 0x10F7 + raw[2:]) * 0x9E3779B1
    return (x >> 12) & (SLOTS - 1)


def _count(batches):
    """(lang, slot, n) of the task's labelled texts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = sums.setdefault(lang, np.zeros(SLOTS, dtype=np.int64))
            counts += np.bincount(triples(text.as_py().decode("utf-8", "replace")), minlength=SLOTS)
    for lang, counts in sums.items():
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot), pa.array(counts[slot])], ["lang", "slot", "n"])


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", most: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of each slot in each, from about ``most`` labelled rows of each, chosen by hash.

    Rows without a label or text teach nothing. The model has
    ``MOST_LANGUAGES`` x ``SLOTS`` numbers at most: those of the languages with most rows,
    the first by name among equals. No labels give no languages.
    """
    rows = labelled.select(F.lower(lang_column).alias("lang"), text_or_empty(text_column).alias("text")).filter("lang is not null and text != ''")
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not known:
        return [], np.empty((0, SLOTS), dtype=np.float32)
    slots = F.create_map(*[F.lit(x) for r in known for x in (r.lang, int(min(1.0, most / r.n) * (1 << 20)) + 1)])
    picked = rows.filter(F.col("lang").isin([r.lang for r in known]) & (F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20)) < slots[F.col("lang")]))
    counted = picked.mapInArrow(_count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for row in counted.toLocalIterator():
        found.setdefault(row.lang, np.zeros(SLOTS))[row.slot] = row.n
    names = sorted(found)
    counts = np.array([found[n] for n in names]).reshape(len(names), SLOTS) + 0.05
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihood(batches, shared, key: str, pages: bool):
    """Log likelihoods of each text, at the weight of at most ``FULL_WEIGHT`` triples, and its declared language."""
    model = once_per_worker(key, lambda: np.ascontiguousarray(shared.value.T))
    names = ["key", "id", "declared", "host", "triples", "evidence"]
    for batch in batches:
        evidence, sizes, declared = [], [], []
        for raw, told in zip(batch.column(4), batch.column(2).to_pylist()):
            text = raw.as_py().decode("utf-8", "replace")
            if pages:
                m = _LANG.search(text)
                told = m[1].lower() if m else None
                text = main_text(text)
            slots = triples(text)
            n = len(slots)
            sums = model[slots].sum(axis=0, dtype=np.float64) if n else np.zeros(model.shape[1])
            evidence.append((sums * (min(n, FULL_WEIGHT) / max(n, 1))).tolist())
            sizes.append(n)
            declared.append(told)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), batch.column(3),
                                          pa.array(sizes, pa.int64()), pa.array(evidence, pa.list_(pa.float64()))], names)


def _softmax(scores: Column) -> Column:
    """Probabilities of an array of log scores."""
    grown = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(grown, lambda x: x / F.aggregate(grown, F.lit(0.0), lambda t, y: t + y))


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Sums of the text's probabilities by language for each key: (keys, seen)."""
    return rows.groupBy(*keys).agg(*[F.sum(F.col("p")[i]).alias(f"_{i}") for i in range(n)]) \
        .select(*keys, F.array(*[F.col(f"_{i}") for i in range(n)]).alias("seen"))


def _blend(seen: Column, above: Column, strength: float) -> Column:
    """A prior from sums of probabilities, drawn to the one above by ``strength`` rows."""
    total = F.aggregate(seen, F.lit(0.0), lambda t, x: t + x) + strength
    return F.zip_with(seen, above, lambda x, a: (x + strength * a) / total)


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, text_column: str, id_column: str, host: Column,
             declared: Column | None, pages: bool = False, confident: float = CONFIDENT) -> DataFrame:
    """Language of every row: (key, id, lang, confidence, text_lang, declared, host, triples, accepted).

    The text's likelihood comes from letter triples of the whole text. What a
    row declares, the last label of its host, and its host are counted against
    the text's probabilities by grouped sums: they give the likelihood of a
    declaration and of a suffix in each language, and host priors smoothed
    towards the domain's, those towards the suffix's, those towards the
    corpus'. Evidences multiply. ``accepted`` is false for a text without
    letters and for a posterior below ``confident``; then ``lang`` is ``und``.

    Null texts are empty; a null declaration or host adds no evidence of its
    own; null and repeated ids stay; other columns are not looked at. No rows
    give no rows. ``key`` is a hash of id and text.
    """
    spark, n = rows.sparkSession, len(languages)
    store = TableStore(spark, "language")
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    text = F.coalesce(F.col(text_column), F.lit(""))
    given = rows.select(F.xxhash64(F.col(id_column), text).alias("key"), F.col(id_column).alias("id"),
                        F.lower(declared if declared is not None else F.lit(None).cast("string")).alias("declared"),
                        F.lower(host).alias("host"), text_or_empty(text_column).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    told = given.mapInArrow(lambda b: _likelihood(b, shared, name, pages), f"key bigint, id {kind}, declared string, host string, "
                                                                         "triples bigint, evidence array<double>")
    names = F.split("host", r"\.")
    told = told.select("*", F.when(F.size(names) > 1, F.element_at(names, -1)).alias("suffix"),
                       F.when(F.size(names) > 1, F.concat_ws(".", F.slice(names, -2, 2))).otherwise(F.col("host")).alias("domain"))
    told, _ = store.write(told, "told")
    sure = told.filter("triples > 0").withColumn("p", _softmax(F.col("evidence")))
    flat = F.array(*[F.lit(1.0 / max(n, 1))] * n)
    hosts, seen = store.write(_sums(sure.filter("host is not null"), ["host", "domain", "suffix"], n), "hosts", n=F.count(F.lit(1)))

    def add(t: DataFrame, keys: list[str]) -> DataFrame:
        sums = t.groupBy(*keys).agg(*[F.sum(F.col("seen")[i]).alias(f"_{i}") for i in range(n)])
        return sums.select(*keys, F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(n)]).alias("seen"))

    every = add(hosts, []).select(_blend(F.col("seen"), flat, HOST_STRENGTH).alias("top"))
    top = store.write(every, "top")[0].first().top  # one row
    base = F.array(*[F.lit(float(x)) for x in top])
    by_suffix = add(hosts, ["suffix"]).select("suffix", _blend(F.col("seen"), base, HOST_STRENGTH).alias("top"))
    by_domain = (add(hosts, ["domain", "suffix"]).withColumn("_s", F.coalesce("suffix", F.lit("")))
                 .join(by_suffix.select(F.coalesce("suffix", F.lit("")).alias("_s"), "top"), "_s")
                 .select("domain", _blend(F.col("seen"), F.col("top"), HOST_STRENGTH).alias("top")))
    priors = hosts.join(by_domain, "domain").select("host", _blend(F.col("seen"), F.col("top"), HOST_STRENGTH).alias("prior"))
    priors, seen = store.write(priors, "priors", n=F.count(F.lit(1)))
    given_language = lambda column: _sums(sure.filter(F.col(column).isNotNull()), [column], n)
    tables = {}
    for column in ("declared", "suffix"):
        counts, held = store.write(given_language(column), column, n=F.count(F.lit(1)),
                                   **{f"s{i}": F.sum(F.col("seen")[i]) for i in range(n)})
        whole = F.array(*[F.lit(float(held[f"s{i}"] or 0.0)) for i in range(n)])
        likely = F.zip_with("seen", whole, lambda x, t: F.log((x + EVIDENCE_STRENGTH / max(held["n"], 1)) / (t + EVIDENCE_STRENGTH)))  # noqa: B023
        tables[column] = (counts.select(column, likely.alias(f"{column}_says")), held["n"])
    out = lookup_join(told, priors, ["host"], "left", seen["n"])
    for column, (table, count) in tables.items():
        out = lookup_join(out, table, [column], "left", count)
    zero = F.array(*[F.lit(0.0)] * n)
    scores = F.transform(F.arrays_zip(F.col("evidence").alias("e"), F.coalesce("prior", base).alias("h"), F.coalesce("declared_says", zero).alias("d"),
                                      F.coalesce("suffix_says", zero).alias("s")), lambda x: x["e"] + F.log(x["h"]) + x["d"] + x["s"])
    out = out.withColumn("scores", scores).withColumn("p", _softmax(F.col("scores"))).withColumn("confidence", F.array_max("p"))
    tags = F.array(*map(F.lit, languages)).cast("array<string>")
    at = lambda c: F.element_at(tags, F.array_position(c, F.array_max(c)).cast("int"))
    accepted = (F.col("triples") > 0) & F.coalesce(F.col("confidence") >= confident, F.lit(False))
    return out.select("key", "id", F.when(accepted, at(F.col("p"))).otherwise("und").alias("lang"),
                      F.round("confidence", 6).alias("confidence"), F.when(F.col("triples") > 0, at(F.col("evidence"))).alias("text_lang"),
                      "declared", "host", "triples", accepted.alias("accepted"))


def identify_pages(pages: DataFrame, labelled: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
                   text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Languages of web pages: main text, ``lang`` of the markup, host of the address; the model learns from ``labelled``.

    Without any label nothing is told apart: every page is ``und`` and not accepted.
    """
    languages, model = train(labelled, text_column, lang_column)
    if not languages:
        languages, model = ["und"], np.zeros((1, SLOTS), dtype=np.float32)
        return identify_pages_by(pages, languages, model, id_column, url_column, html_column).withColumn("accepted", F.lit(False))
    return identify_pages_by(pages, languages, model, id_column, url_column, html_column)


def identify_pages_by(pages: DataFrame, languages: list[str], model: np.ndarray, id_column: str = "page_id", url_column: str = "url",
                      html_column: str = "html") -> DataFrame:
    """``identify_pages`` by a model that is given."""
    host = F.regexp_extract(F.coalesce(F.col(url_column), F.lit("")), _ADDRESS, 1)
    return identify(pages, languages, model, html_column, id_column, F.when(host != "", host), None, pages=True) \
        .withColumnRenamed("id", "page_id").drop("key")


def keep_identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
                    host_column: str = "source", confident: float = CONFIDENT) -> DataFrame:
    """Documents whose language is identified, with their columns; ``lang`` becomes the fused language.

    The documents' own ``lang`` is what they declare and teaches the text
    model, ``source`` is the host. Documents without letters go, and those of
    which no language reaches ``confident``. A document with letters that declares a language the
    model doesn't know (beyond ``MOST_LANGUAGES``) stays as it is, and so does a table without any label.
    Columns may have any names.
    """
    languages, model = train(docs, text_column, lang_column)
    if not languages:
        return docs
    docs, back = set_apart(docs, "_key", "_lang")
    told = identify(docs, languages, model, text_column, id_column, F.col(host_column), F.col(lang_column), confident=confident)
    store = TableStore(docs.sparkSession, "identified")
    unknown = F.col("declared").isNotNull() & ~F.col("declared").isin(languages) & (F.col("triples") > 0)
    changed = told.filter(~unknown & (~F.col("accepted") | ~F.col("lang").eqNullSafe(F.col("declared")))).select(F.col("key").alias("_key"), F.col("lang").alias("_lang"))
    changed, seen = store.write(changed.dropDuplicates(["_key"]), "changed", n=F.count(F.lit(1)))
    keyed = docs.withColumn("_key", F.xxhash64(F.col(id_column), F.coalesce(F.col(text_column), F.lit(""))))
    both = lookup_join(keyed, changed, ["_key"], "left", seen["n"]).filter(F.col("_lang").isNull() | (F.col("_lang") != "und"))
    return both.withColumn(lang_column, F.coalesce("_lang", F.col(lang_column))).select(*docs.columns).withColumnsRenamed(back)
