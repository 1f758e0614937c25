"""Repeated passages: k-mers of words as edges of a De Bruijn graph, nonbranching repeated paths, spans verified at their sources."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itinera.llm.common import _powers, components, mix, shingle_hashes, text_or_empty, word_hashes
from itinera.plans.tables import TableStore

#: Words of an edge (a passage of so many words counts as repeated) and of the minimizers that edges are dealt out by.
WINDOW, MINIMIZER = 20, 5
#: Edges that are cut into pieces at once; a longer text is cut by parts.
PART = 1 << 22

_PLACE = np.uint64((1 << 24) - 1)
_SHA_EMPTY = hashlib.sha256(b"").hexdigest()


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that give the hash of any run of words, and the powers they need."""
    up, down = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix(words) * up[:len(words)], dtype=np.uint64, out=total[1:])
    return total, down


def _runs(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, length) -> np.ndarray:
    """Hashes of the runs of ``length`` words from each start."""
    total, down = sums
    length = np.broadcast_to(np.asarray(length, dtype=np.int64), start.shape)
    return mix((total[start + length] - total[start]) * down[start] + length.astype(np.uint64))


def _least_at(kmers: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbouring k-mers, the last one of equals."""
    ranked = (kmers & ~_PLACE) | (_PLACE - np.arange(len(kmers), dtype=np.uint64))
    out, done = ranked, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:len(out) - step], out[step:])
        done += step
    return (_PLACE - (out & _PLACE)).astype(np.int64)


def pieces(words: np.ndarray, window: int, minimizer: int, part: int = PART) -> tuple[np.ndarray, ...]:
    """A text's edges in pieces: (minimizer's hash, piece's hash, first edge, edges).

    A piece is a run of edges with one minimizer, the least k-mer inside them.
    Equal edges have the same minimizer at the same place, so they are in
    pieces of one minimizer hash; most equal passages have equal pieces.
    """
    found: list[list[np.ndarray]] = []
    sums = _sums(words)
    for low in range(0, max(len(words) - window + 1, 0), part):
        kmers = shingle_hashes(words[low:low + part + window - 1], minimizer)
        at = _least_at(kmers, window - minimizer + 1)
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        n = np.diff(np.append(start, len(at)))
        least = kmers[at[start]]
        content = _runs(sums, start + low, n + window - 1)
        found.append([least, mix(content ^ (least * np.uint64(0x9E3779B97F4A7C15))), start + low, n])
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat).cast(kind))


def _scan(batches, window: int, minimizer: int, mask: int, part: int):
    """(key, doc_id, n_words, digest, pieces) of each text."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            rows = batch.slice(low, 256)
            cut, n_words, digests = [], [], []
            for text in rows.column(2):
                raw = text.as_py()
                least, content, start, n = pieces(word_hashes(raw), window, minimizer, part)
                cut.append((least, content & np.uint64(mask), start, n))
                parts = raw.split()
                n_words.append(len(parts))
                digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(n_words, pa.int64()), pa.array(digests)]
                + [_lists([c[i] for c in cut], kind) for i, kind in enumerate(kinds)], ["key", "doc_id", "n_words", "kept_sha256", "h", "id", "start", "n"])


def _edges(batches, window: int, mask: int):
    """(edge, doc_id, key, at) of the pieces asked for."""
    for batch in batches:
        for key, doc, text, asked in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
            sums = _sums(word_hashes(text.as_py()))
            at = np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in asked.as_py()])
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array((_runs(sums, at, window) & np.uint64(mask)).view(np.int64)), pa.array([doc.as_py()] * n, batch.schema.field(1).type),
                 pa.array([key.as_py()] * n, pa.int64()), pa.array(at)], ["edge", "doc_id", "key", "at"])


def _cleaned(batches, with_text: bool):
    """Texts without their repeats, and a digest of every span, at its source and where it is repeated."""
    names = ["doc_id", "key", "n_words", "n_removed", "kept_sha256", "pid", "digest", "again"] + ["text"] * with_text
    for batch in batches:
        for doc, key, text, asked in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
            words = text.as_py().split()
            keep = np.ones(len(words), dtype=bool)
            pids, digests, again = [], [], []
            for s in asked.as_py():
                low, high = s["start"], s["start"] + s["words"]
                pids.append(s["pid"])
                digests.append(hashlib.blake2b(b" ".join(words[low:high]), digest_size=16).digest())
                again.append(s["again"])
                if s["again"]:
                    keep[low:high] = False
            kept = b" ".join(compress(words, keep))
            out = [[doc.as_py()], [key.as_py()], [len(words)], [int((~keep).sum())], [hashlib.sha256(kept).hexdigest()], [pids], [digests], [again]]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.bool_())]
            if with_text:
                out.append([kept.decode("utf-8", "replace")])
                kinds.append(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)


# ------------------------------------------------------------------------------------------------- graph

def _first(doc: str, at: str):
    return F.min(F.struct(F.col("doc_id"), F.col("key"), F.col(at).alias("at")))


def repeated_paths(hits: DataFrame, classes: DataFrame, window: int, store: TableStore) -> DataFrame:
    """Maximal nonbranching paths of repeated pieces: (head, key, start, words), the coordinates of the first occurrence.

    Two pieces are joined where every occurrence of the one is followed by the
    other and every occurrence of the other follows the one: the node between
    them does not branch. Chains of joined pieces are contracted in rounds of
    joins. All occurrences of a path hold all of it, so its source is one run of words and
    ``head``, its first piece, stands for it.
    """
    again = classes.filter("occurrences > 1")
    own = hits.join(again.select("id", "occurrences"), "id").select("id", "key", "start", "n", "occurrences")
    ahead = own.select("key", F.col("start").alias("behind"), F.col("id").alias("next"), F.col("occurrences").alias("theirs"))
    links = (own.withColumn("behind", F.col("start") + F.col("n")).join(ahead, ["key", "behind"])
             .groupBy("id", "next").agg(F.count(F.lit(1)).alias("m"), F.first("occurrences").alias("ours"), F.first("theirs").alias("theirs"))
             .filter((F.col("m") == F.col("ours")) & (F.col("m") == F.col("theirs"))))
    links, seen = store.write(links.select(F.col("id").alias("a"), F.col("next").alias("b")), "links", n=F.count(F.lit(1)))
    path = F.col("id")
    if seen["n"]:
        again = again.join(components(links, store, "paths").withColumnRenamed("node", "id"), "id", "left")
        path = F.coalesce("component", "id")
    found = again.select(path.alias("path"), "id", "first.key", F.col("first.at").alias("at"), "n").groupBy("path").agg(
        F.min_by("id", "at").alias("head"), F.min("key").alias("key"), F.min("at").alias("start"),
        (F.max(F.col("at") + F.col("n")) - F.min("at") + F.lit(window - 1)).cast("int").alias("words"))
    return store.write(found.drop("path"), "repeated-paths")[0]


def _branch_spans(docs: DataFrame, classes: DataFrame, window: int, mask: int, store: TableStore) -> DataFrame:
    """Repeats inside pieces that differ: (key, start, words, source, source_start).

    Where a minimizer has several distinct pieces, their edges are compared
    one by one, each piece at its first occurrence only: edges that are found
    earlier elsewhere, in runs along one source.
    """
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    asked = (classes.join(several, "h", "left_semi").groupBy("first.key")
             .agg(F.collect_list(F.struct(F.col("first.at").alias("start"), "n")).alias("asked")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.join(asked, "key").select("key", "doc_id", "text", "asked")
    edges, _ = store.write(texts.mapInArrow(lambda b: _edges(b, window, mask), f"edge bigint, doc_id {kind}, key bigint, at bigint")
                           .dropDuplicates(["key", "at"]), "edges")
    first = edges.groupBy("edge").agg(_first("doc_id", "at").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    later = (edges.join(first, "edge").filter((F.col("key") != F.col("first.key")) | (F.col("at") != F.col("first.at")))
             .select("key", "at", F.col("first.key").alias("source"), (F.col("first.at") - F.col("at")).alias("shift")))
    along = Window.partitionBy("key", "source", "shift").orderBy("at")
    run = later.withColumn("run", F.col("at") - F.row_number().over(along))
    spans = run.groupBy("key", "source", "shift", "run").agg(F.min("at").alias("start"), (F.max("at") - F.min("at") + window).cast("int").alias("words"))
    return store.write(spans.select("key", "start", "words", "source", (F.col("start") + F.col("shift")).alias("source_start")), "branches")[0]


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER, id_column: str = "doc_id", text_column: str = "text",
                   with_text: bool = True, part: int = PART, bits: int = 64) -> DataFrame:
    """Texts without passages that stand earlier: (doc_id, n_words, n_removed, kept_sha256, text), a row for each row.

    A word goes if a run of ``window`` words around it also starts earlier: in a
    document with a smaller id, or earlier in the same. Runs are judged on
    the input. ``text`` is the words that stay, joined by one space (left out
    without ``with_text``).

    Every run of ``window`` words is an edge of a De Bruijn graph. A text's
    edges are kept in pieces that share a minimizer, so that a seventh or less of
    them is shuffled; pieces whose minimizer occurs once cannot repeat and are
    left behind. Repeated pieces are compacted to nonbranching paths, whose
    occurrences but the first go; where pieces of one minimizer differ their
    edges are compared. In the end the words of every span are digested at the
    source and where they repeat, and a span whose digest is not its source's
    stays, so no hash (of ``bits`` bits) removes what is not a repeat.

    Null texts are empty. Texts of one id are in the order of their hashes, and rows alike in
    id and text are one document, each of them returned; a null id comes before
    all others. Other columns are not looked at; no rows give no rows.
    """
    store, mask = TableStore(docs.sparkSession, "repeats"), (1 << bits) - 1
    text = F.coalesce(F.col(text_column), F.lit(""))
    keyed = docs.select(F.xxhash64(F.col(id_column), text).alias("key"), F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    scan, _ = store.write(keyed.mapInArrow(lambda b: _scan(b, window, minimizer, mask, part), f"key bigint, doc_id {kind}, n_words bigint, kept_sha256 string, "
                                           "h array<bigint>, id array<bigint>, start array<int>, n array<int>"), "scan")
    each = scan.select("key", "doc_id", F.inline(F.arrays_zip("h", "id", "start", "n")))
    shared = scan.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    shared, _ = store.write(shared, "shared")
    hits, _ = store.write(each.join(shared, "h", "left_semi").dropDuplicates(["key", "start"]), "hits")
    store.drop("shared")
    classes = hits.groupBy("id").agg(F.min("h").alias("h"), F.min("n").alias("n"), F.count(F.lit(1)).alias("occurrences"), _first("doc_id", "start").alias("first"))
    classes, _ = store.write(classes, "classes")
    paths = repeated_paths(hits, classes, window, store)
    heads = paths.select(F.col("head").alias("id"), F.col("key").alias("source"), F.col("start").alias("source_start"), "words")
    copies = (hits.select("id", "key", "start").join(heads, "id")
              .filter((F.col("key") != F.col("source")) | (F.col("start") != F.col("source_start"))))
    spans = copies.select("key", "start", "words", "source", "source_start").unionByName(_branch_spans(keyed, classes, window, mask, store))
    spans, _ = store.write(spans.withColumn("pid", F.xxhash64("source", "source_start", "words")), "spans")
    store.drop("hits")
    both = spans.select("key", F.struct(F.col("start").cast("int").alias("start"), "words", "pid", F.lit(True).alias("again")).alias("s")).unionByName(
        spans.select(F.col("source").alias("key"), F.struct(F.col("source_start").cast("int").alias("start"), "words", "pid",
                                                            F.lit(False).alias("again")).alias("s")).distinct())
    asked, _ = store.write(both.groupBy("key").agg(F.collect_list("s").alias("asked")), "asked")
    schema = (f"doc_id {kind}, key bigint, n_words bigint, n_removed bigint, kept_sha256 string, pid array<bigint>, digest array<binary>, "
              "again array<boolean>" + ", text string" * with_text)
    clean = lambda a, name: store.write(keyed.join(a, "key").select("doc_id", "key", "text", "asked")
                                        .mapInArrow(lambda b: _cleaned(b, with_text), schema), name)[0]
    cleaned = clean(asked, "cleaned")
    told = cleaned.select("key", F.inline(F.arrays_zip("pid", "digest", "again")))
    unlike = told.groupBy("pid").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x != y").select("pid")
    unlike, wrong = store.write(unlike, "unlike", n=F.count(F.lit(1)))
    if wrong["n"]:  # spans that only their hashes hold for repeats
        source = told.join(unlike, "pid", "left_semi").filter("not again").groupBy("pid").agg(F.min("digest").alias("right"))
        false = told.filter("again").join(source, "pid").filter("digest != right").select("key", "pid").distinct()
        false = false.groupBy("key").agg(F.collect_set("pid").alias("false"))
        right = asked.join(false, "key").select("key", F.filter("asked", lambda s: ~(s["again"] & F.array_contains("false", s["pid"]))).alias("asked"))
        right, _ = store.write(right, "right")
        cleaned = cleaned.join(right.select("key"), "key", "left_anti").unionByName(clean(right, "cleaned-again"))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
    untouched = scan.select("key", "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256").join(asked.select("key"), "key", "left_anti")
    if with_text:
        plain = F.trim(F.regexp_replace(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", " "))
        untouched = untouched.dropDuplicates(["key"]).drop("doc_id").join(keyed.select("key", "doc_id", plain.alias("text")), "key")
    return untouched.select(*columns).unionByName(cleaned.select(*columns))
