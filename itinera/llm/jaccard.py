"""N-gram Jaccard join by adaptive multi-match prefixes."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera.llm.common import components, lookup_join, once_per_worker, set_apart, shingle_hashes, text_or_empty, word_hashes
from itinera.plans.tables import TableStore

#: Words of a shingle and least similarity in hundredths.
WIDTH, PERCENT = 4, 85
#: Counters of the frequency sketch, and how many of them travel in one row.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: Most shared prefix tokens that a document may ask for (a choice of plan: any value gives the same links).
MOST_SHARED = 8
#: Tokens before a posting that are compared so that a pair is not met again at each token it shares (a choice of plan as well).
BEFORE = 16
#: Postings before one that it is compared with by bitmap in a round of contraction, most of a token that one task deals in,
#: pairs of a class that a round checks, share of its classes that a round must link for another, most rounds (choices of plan, too).
AHEAD, HELD, CLOSEST, WORTH, ROUNDS = 64, 4096, 3, 0.01, 4


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z read as a-z."""
    return np.unique(shingle_hashes(word_hashes(text.lower()), width))


def _class(shingles: np.ndarray) -> int | None:
    """Hash of a whole set: sums of its mixed members; texts of one set are one class."""
    if not len(shingles):
        return None
    x = shingles * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = int((x * np.uint64(0xBF58476D1CE4E5B9)).sum(dtype=np.uint64)) * 0x94D049BB133111EB + len(shingles)
    x = (x ^ (x >> 31)) & 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >= 1 << 63 else x


#: 64-bit words of a set's parity bitmap.
WORDS = 8
_BITS = [f"b{i}" for i in range(WORDS)]
_PROFILE = ["doc_id", "key", "n_shingles", "cls", *_BITS, "chunk", "counts"]


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * ``WORDS`` slots: whether an odd number of members fall there.

    The bits in which two sets differ are at most the members that only one of them has.
    """
    slots = np.bincount((shingles >> np.uint64(40)).astype(np.int64) & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(slots.astype(np.uint8)).view(np.int64)


def _profile(batches, width: int):
    """Size and class of every row, then this task's shingle counts by hash, cut in chunks."""
    counts, kind = np.zeros(COUNTERS, dtype=np.int64), None
    for batch in batches:
        kind = batch.schema.field(0).type
        sets = [shingle_set(t.as_py(), width) for t in batch.column(2)]
        n = len(sets)
        if n:
            every = np.concatenate(sets)
            counts += np.bincount((every & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()),
             pa.array(list(map(_class, sets)), pa.int64()), *map(pa.array, np.array(list(map(parity, sets)), dtype=np.int64).reshape(n, WORDS).T.copy()),
             pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], _PROFILE)
    if kind is not None:
        n = COUNTERS // CHUNK
        cut = [counts[i * CHUNK:(i + 1) * CHUNK].tobytes() for i in range(n)]
        yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), *[pa.nulls(n, pa.int64())] * (3 + WORDS), pa.array(range(n), pa.int32()), pa.array(cut, pa.binary())], _PROFILE)


def _add_counts(batches):
    """Sums of the chunks that reach a task, streamed; a task holds one array for each of its chunks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(counts.as_py(), dtype=np.int64)
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                     ["chunk", "counts"])


def _levels(sketch: DataFrame) -> tuple[np.ndarray, float]:
    """A byte for each counter, four steps to a doubling, and the mean count: one megabyte whatever the corpus."""
    once = sketch.repartition(16, "chunk").mapInArrow(_add_counts, "chunk int, counts binary")
    level, total = np.zeros(COUNTERS, dtype=np.uint8), 0
    for row in once.groupBy("chunk").agg(F.collect_list("counts").alias("parts")).toLocalIterator():
        counts = sum(np.frombuffer(p, dtype=np.int64) for p in row.parts)
        total += int(counts.sum())
        level[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.floor(4 * np.log2(np.maximum(counts, 1)))
    return level, total / COUNTERS


def prefix(shingles: np.ndarray, level: np.ndarray, mean: float, percent: int) -> tuple[np.ndarray, int]:
    """Tokens of a set's prefix, rarest first by the sketch, and how many of them a partner must share.

    Two sets that are similar share at least ``o`` tokens, so the first tokens
    up to all but ``o - k`` of both hold ``k`` shared ones. ``k`` grows as long
    as the estimated cost falls: postings read plus candidates to verify, which
    are at most the postings over ``k``.
    """
    n = len(shingles)
    overlap = -(-percent * n // 100)
    most = min(MOST_SHARED, overlap)
    key = (level[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8))
    longest = n - overlap + most
    if longest < n:
        key.partition(longest - 1)
        key = key[:longest]
    key.sort()
    others = np.maximum(2.0 ** ((key >> np.uint64(56)).astype(np.float64) / 4) - mean - 1, 0)
    read = np.cumsum(others)[n - overlap:]
    shared = np.arange(1, most + 1)
    k = int(np.argmin(read * (1 + n / 16 / shared))) + 1
    return key[:n - overlap + k].view(np.int64), k


def _prefixes(batches, shared, key: str, width: int, percent: int):
    level, mean = once_per_worker(key, lambda: shared.value)
    done: set[int] = set()
    for batch in batches:
        tokens, classes, sizes, asked = [], [], [], []
        for text in batch.column(0):
            s = shingle_set(text.as_py(), width)
            c = _class(s)
            if c is None or c in done:
                continue
            done.add(c)
            t, k = prefix(s, level, mean, percent)
            tokens.append(t)
            classes.append(np.full(len(t), c, dtype=np.int64))
            sizes.append(np.full(len(t), len(s), dtype=np.int32))
            asked.append(np.full(len(t), k, dtype=np.int32))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, classes, sizes, asked)],
                                             ["token", "cls", "n", "k"])


def _shared_tokens(batches):
    """Of rows sorted by token and class: those of tokens that two classes share, with the token's first class.

    One row is held back from batch to batch, whatever the length of a token's run.
    """
    names = ["token", "cls", "n", "k", "leader", "leader_n", "leader_k"]
    held, opens, before = None, True, (0, 0, 0)
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        token, cls = cols[0], cols[1]
        if not len(token):
            continue
        fresh = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))
        cols = [c[fresh] for c in cols]
        token = cols[0]
        first = np.append(opens, token[1:] != token[:-1])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(token)), -1))
        lead = [np.where(begin >= 0, c[np.maximum(begin, 0)], old).astype(c.dtype) for c, old in zip(cols[1:], before)]
        keep = np.flatnonzero(~first[:-1] | (token[1:] == token[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in cols + lead], names)
        held, opens, before = [c[-1:] for c in cols], bool(first[-1]), tuple(int(x[-1]) for x in lead)
    if held is not None and not opens:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held]
                                         + [pa.array(np.array([x], dtype=c.dtype)) for x, c in zip(before, held[1:])], names)


def _verify(batches, width: int, percent: int):
    sets: OrderedDict[int, np.ndarray] = OrderedDict()

    def of(c: int, text) -> np.ndarray:
        if c not in sets:
            sets[c] = shingle_set(text.as_py(), width)
            if len(sets) > 32:
                sets.popitem(last=False)
        sets.move_to_end(c)
        return sets[c]

    for batch in batches:
        good = []
        for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            one, two = of(a, x), of(b, y)
            both = len(one) + len(two)
            shared = both - len(np.union1d(one, two))
            good.append(100 * shared >= percent * (both - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_())), batch.column(1).filter(pa.array(good, pa.bool_()))],
                                         ["a", "b"])


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether sizes and parity bitmaps let two classes be similar: members of one side only are few enough."""
    apart = sum((F.bit_count(F.col(f"{w}_{a}").bitwiseXOR(F.col(f"{w}_{b}"))) for w in _BITS), F.lit(0))
    x, y = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (x * percent <= y * 100) & (y * percent <= x * 100) & (apart * (100 + percent) <= (x + y) * (100 - percent))


def _enough(n: Column, k: Column, m: Column, j: Column, percent: int) -> Column:
    """Least shared prefix tokens of two sets of ``n`` and ``m`` members that asked for ``k`` and ``j``.

    Behind the prefix that ends first nothing is known of the rest: the sets
    share at most what the prefixes share and the longer of the two rests.
    """
    up = lambda c, d: F.ceil(c / d)
    whole = up((n + m) * percent, F.lit(100 + percent))
    return whole - F.greatest(up(n * percent, F.lit(100)) - k, up(m * percent, F.lit(100)) - j)


class _Verifier:
    """Checks pairs of classes on their whole texts."""

    def __init__(self, texts: DataFrame, reps: DataFrame, store: TableStore, width: int, percent: int):
        self.texts, self.reps, self.store, self.width, self.percent = texts, reps, store, width, percent

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) that are similar; a class's text is read once for all its pairs."""
        pairs, _ = self.store.write(pairs, f"{name}-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(self.reps.select("cls", "key"), "cls")
        wanted, counted = self.store.write(wanted, f"{name}-wanted", n=F.count(F.lit(1)))
        held = lookup_join(self.texts, wanted, ["key"], "inner", counted["n"]).dropDuplicates(["cls"]).select("cls", "text")
        held, _ = self.store.write(held, f"{name}-texts")
        side = lambda c: held.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
        width, percent = self.width, self.percent
        links, _ = self.store.write(both.mapInArrow(lambda x: _verify(x, width, percent), "a bigint, b bigint"), f"{name}-links")
        for table in ("pairs", "wanted", "texts"):
            self.store.drop(f"{name}-{table}")
        return links


def _across(parts: DataFrame, store: TableStore, name: str) -> DataFrame:
    """Of postings (token, cls, n, k, part) those of tokens that several components share; ``main`` has most of a token's ``total``."""
    parts, _ = store.write(parts, f"{name}-parts")
    size = parts.groupBy("token", "part").agg(F.count(F.lit(1)).alias("size"))
    mixed = size.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "part")).alias("m"), F.sum("size").alias("total")) \
        .filter("parts > 1").select("token", F.col("m.part").alias("main"), "total")
    across, _ = store.write(parts.join(mixed, "token"), name)
    store.drop(f"{name}-parts")
    return across


def _closest(batches, percent: int):
    """Of rows sorted by token: each row's closest one by bitmap of those ``AHEAD`` before it that is of another component and fits.

    That many rows are held back from batch to batch.
    """
    held, names = None, ["a", "b", "apart"]
    for batch in batches:
        cols, old = [c.to_numpy(zero_copy_only=False) for c in batch.columns], 0
        if held is not None:
            old = len(held[0])
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        (token, salt, cls, part, n), bits = cols[:5], np.column_stack(cols[5:]).view(np.uint64)
        best, at = np.full(len(token), 64 * WORDS + 1), np.arange(len(token))
        for k in range(1, min(AHEAD, len(token) - 1) + 1):
            i = np.arange(max(old, k), len(token))
            i = i[(token[i] == token[i - k]) & (salt[i] == salt[i - k])]
            if not len(i):
                break
            i = i[part[i] != part[i - k]]
            x, y = n[i].astype(np.int64), n[i - k].astype(np.int64)
            apart = np.bitwise_count(bits[i] ^ bits[i - k]).sum(axis=1, dtype=np.int64)
            good = (x * percent <= y * 100) & (y * percent <= x * 100) & (apart * (100 + percent) <= (x + y) * (100 - percent)) & (apart < best[i])
            best[i[good]], at[i[good]] = apart[good], i[good] - k
        found = np.flatnonzero(at != np.arange(len(at)))
        yield pa.RecordBatch.from_arrays([pa.array(cls[found]), pa.array(cls[at[found]]), pa.array(best[found].astype(np.int32))], names)
        held = [c[-AHEAD:] for c in cols]


def _agreeing(pairs: DataFrame, split: DataFrame, store: TableStore, percent: int, name: str) -> DataFrame:
    """Of pairs (a, b, ...) of classes of different components those that share enough prefix tokens."""
    tokens, _ = store.write(split.groupBy("cls").agg(F.collect_list("token").alias("tokens"), F.first("n").alias("n"), F.first("k").alias("k")), name)
    held = lambda c: tokens.select(*[F.col(x).alias(c if x == "cls" else f"{x}_{c}") for x in tokens.columns])
    votes = F.size(F.array_intersect("tokens_a", "tokens_b"))
    need = _enough(F.col("n_a"), F.col("k_a"), F.col("n_b"), F.col("k_b"), percent)
    return pairs.join(held("a"), "a").join(held("b"), "b").filter(votes >= need).select(*pairs.columns)


def _candidates(split: DataFrame, k: int, store: TableStore, percent: int) -> DataFrame:
    """A few pairs (a, b) for each class, close by bitmap and of different components; round ``k`` looks at others than the last."""
    salt = F.pmod(F.xxhash64("cls", F.lit(k)), F.ceil(F.col("total") / HELD)).cast("int").alias("salt")
    rows = split.select("token", salt, "cls", "part", "n", *_BITS, F.xxhash64("cls", "token", F.lit(k)).alias("o"))
    found = (rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "o").drop("o")
             .mapInArrow(lambda b: _closest(b, percent), "a bigint, b bigint, apart int"))
    found, _ = store.write(found.distinct(), f"found-{k}")
    rank = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    few = _agreeing(found, split, store, percent, f"tokens-{k}").withColumn("_r", rank).filter(F.col("_r") <= CLOSEST)
    return few.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _contracted(split: DataFrame, verifier: _Verifier, store: TableStore, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Postings whose components are linked as far as a few close pairs of each class do, and those links.

    Where a token's first class is an outlying copy, the others of its group are
    still apart; met by their tokens they would make all pairs of the group.
    Later rounds go on with the classes that had such pairs.
    """
    found, steps, work = [], [], split
    for k in range(ROUNDS):
        close, _ = store.write(_candidates(work, k, store, percent), f"close-{k}")
        links = verifier.links(close, f"round-{k}")
        size = links.count()
        if not size:
            break
        named, seen = store.write(work.select("cls", "part").distinct(), f"parts-{k}", n=F.count(F.lit(1)))
        side = lambda c: named.select(F.col("cls").alias(c), F.col("part").alias(f"part_{c}"))  # noqa: B023, E731
        edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
        found.append(links)
        steps.append(components(edges, store, f"round-{k}"))
        if size <= WORTH * seen["n"]:
            break
        alive = close.select(F.col("a").alias("cls")).union(close.select("b")).distinct()
        work = work.drop("main", "total").join(alive, "cls", "left_semi").join(steps[-1].withColumnRenamed("node", "part"), "part", "left")
        work = _across(work.withColumn("part", F.coalesce("component", "part")).drop("component"), store, f"alive-{k + 1}")
    if not steps:
        return split, found
    moved = split.select("part", F.col("part").alias("node")).distinct()
    for step in steps:
        moved = moved.join(step, "node", "left").select("part", F.coalesce("component", "node").alias("node"))
    moved, _ = store.write(moved.filter("part != node"), "moved")
    split = split.drop("main", "total").join(moved, "part", "left").withColumn("part", F.coalesce("node", "part")).drop("node")
    split = _across(split, store, "contracted")
    return split, found


def _placed(split: DataFrame) -> DataFrame:
    """Postings with the tokens ``before`` them in their class, ``BEFORE`` at the most."""
    order = Window.partitionBy("cls").orderBy("token").rowsBetween(-BEFORE, -1)
    return split.withColumn("before", F.collect_list("token").over(order))


def _met(split: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a token and fit, of placed postings with bitmaps.

    A pair meets at the first token it shares, and at others only where none of
    the last ones before is shared, so that pairs do not multiply by their tokens.
    """
    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("cls", "n", "part", "before", *_BITS)]
    one = split.filter("part != main").select("token", *side("a"))
    two = split.select("token", *side("b"), (F.col("part") != F.col("main")).alias("minor"))
    met = one.join(two, "token").filter((F.col("part_a") != F.col("part_b")) & (~F.col("minor") | (F.col("cls_a") < F.col("cls_b")))
                                        & _fits("a", "b", percent) & ~F.arrays_overlap("before_a", "before_b"))
    return met.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"))


def _linked(docs: DataFrame, store: TableStore, id_column: str, text_column: str, width: int, percent: int) -> DataFrame:
    """Every row's text hash, shingles and group of classes: (doc_id, key, n_shingles, component)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("key"), text_or_empty(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    profile, _ = store.write(rows.mapInArrow(lambda b: _profile(b, width), f"doc_id {kind}, key bigint, n_shingles bigint, cls bigint, "
                                               + "".join(f"{w} bigint, " for w in _BITS) + "chunk int, counts binary"), "profile")
    shared = spark.sparkContext.broadcast(_levels(profile.filter("chunk is not null").select("chunk", "counts")))
    name = uuid.uuid4().hex
    sized = profile.filter("chunk is null").select("doc_id", "key", "n_shingles", "cls")
    reps = (profile.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("key", "n_shingles", *_BITS)).alias("m"))
            .select("cls", "m.key", F.col("m.n_shingles").alias("n"), *[f"m.{w}" for w in _BITS]))
    reps, _ = store.write(reps, "classes")
    marks = lambda c: reps.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), *[F.col(w).alias(f"{w}_{c}") for w in _BITS])
    postings = (rows.select("text").mapInArrow(lambda b: _prefixes(b, shared, name, width, percent), "token bigint, cls bigint, n int, k int")
                .repartition("token").sortWithinPartitions("token", "cls")
                .mapInArrow(_shared_tokens, "token bigint, cls bigint, n int, k int, leader bigint, leader_n int, leader_k int"))
    postings, _ = store.write(postings, "postings")
    verifier = _Verifier(rows.select("key", "text"), reps, store, width, percent)

    need = _enough(F.col("n"), F.col("k"), F.col("leader_n"), F.col("leader_k"), percent)
    votes = (postings.filter("cls != leader").groupBy("cls", "leader", "n", "k", "leader_n", "leader_k").agg(F.count(F.lit(1)).alias("votes"))
             .filter(2 * F.col("votes") >= need).groupBy("cls").agg(F.max(F.struct("votes", "leader")).alias("m"))
             .select(F.col("cls").alias("a"), F.col("m.leader").alias("b")))
    votes = votes.join(marks("a"), "a").join(marks("b"), "b").filter(_fits("a", "b", percent)).select("a", "b")
    near = verifier.links(votes, "leaders")
    joined = components(near, store, "leaders").withColumnRenamed("node", "cls")
    parts = postings.join(joined, "cls", "left").select("token", "cls", "n", "k", F.coalesce("component", "cls").alias("part"))
    split = _across(parts, store, "shared")
    split, _ = store.write(split.join(reps.drop("key", "n"), "cls"), "across-0")
    split, linked = _contracted(split, verifier, store, percent)

    split, _ = store.write(_placed(split), "mixed")
    pairs, _ = store.write(_met(split, percent).distinct(), "met")
    far = verifier.links(_agreeing(pairs, split, store, percent, "tokens"), "others")

    whole = components(reduce(DataFrame.unionByName, [near, *linked, far]), store, "all").select(F.col("node").alias("cls"), "component")
    named = sized.join(whole, "cls", "left").select("doc_id", "key", "n_shingles", F.coalesce("component", "cls").alias("component"))
    named, _ = store.write(named, "named")
    return named


def jaccard_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH,
                   percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of word shingles: (doc_id, key, n_shingles, component_id).

    Two documents link when 100 * shared >= ``percent`` * union. Texts of one
    shingle set are one class. Shingles are ordered by a frequency sketch over
    the whole corpus; each class keeps a prefix whose length follows its
    estimated candidate cost, and a longer prefix asks for more shared tokens.
    First every class is checked against one leader, the first class of the
    tokens it shares most, then in rounds against a few of its closest by
    bitmap; linked classes then count as one, and each pair of
    classes of different components is checked if it shares enough prefix
    tokens and if sizes and parity bitmaps, which never differ more than the
    sets, allow the similarity. So a large group of near copies costs about one check for each
    copy, and no link that could join two components is left out.

    ``component_id`` is the smallest id reachable by links, a row's own if it
    has none. Null and empty texts have no shingles and link with nothing; null
    ids stay and are the component only of groups without another id. Repeated
    rows are each returned (``key`` is a hash of the text). Other columns are
    not looked at. No rows give no rows. Class hashes have 64 bits.
    """
    named = _linked(docs, TableStore(docs.sparkSession, "jaccard"), id_column, text_column, width, percent)
    least = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    alone = named.filter("component is null").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"))
    return (named.filter("component is not null").join(least, "component")
            .select("doc_id", "key", "n_shingles", F.col("least").alias("component_id")).unionByName(alone))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each linked group left, that of the smallest id (nulls last), with their columns.

    Rows without shingles stay. Of rows alike in id and text one stays. Columns may have any names.
    """
    docs, back = set_apart(docs, "_row", "_twice")
    store, work = TableStore(docs.sparkSession, "keep-one"), TableStore(docs.sparkSession, "keep-one-compared")
    named = _linked(docs, work, id_column, text_column, width, percent).filter("component is not null")
    row = F.xxhash64("doc_id", "key").alias("_row")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", row)).alias("m"), F.count(F.lit(1)).alias("n"))
    crowd, _ = store.write(named.join(first.filter("n > 1").select("component", F.col("m._row").alias("_kept")), "component")
                           .select(row, "_kept"), "crowd")
    gone, seen = store.write(crowd.filter("_row != _kept").select("_row").distinct(), "gone", n=F.count(F.lit(1)))
    again, found = store.write(crowd.filter("_row = _kept").groupBy("_row").count().filter("count > 1").select("_row", F.lit(True).alias("_twice")),
                               "again", n=F.count(F.lit(1)))
    work.clear()
    key = F.xxhash64(F.col(id_column), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))
    left = lookup_join(docs.withColumn("_row", key), gone, ["_row"], "left_anti", seen["n"])
    if not found["n"]:
        return left.select(*docs.columns).withColumnsRenamed(back)
    marked = lookup_join(left, again, ["_row"], "left", found["n"])
    once = marked.filter("_twice").dropDuplicates(["_row"])
    return marked.filter("_twice is null").unionByName(once).select(*docs.columns).withColumnsRenamed(back)
