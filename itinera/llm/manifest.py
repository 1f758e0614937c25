"""Merkle manifest of a table: bitmap ranks give leaf coordinates, slot arrays reduce the levels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera.llm.common import lookup_join
from itinera.plans.ranking import ordinal
from itinera.plans.tables import TableStore

#: Slots that one array reduces at once (a power of two).
SLOTS = 1024
#: Bits of an id inside a bitmap word, and of a block's place among its parent's blocks in the rank directory.
WORD_BITS, FAN_BITS = 6, 10
_BIT = f"int(id & {(1 << WORD_BITS) - 1})"
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(*parts: bytes) -> bytes:
    """H of digests: they enter as hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: ``-`` for each null, else the UTF-8 byte count, ``:`` and the value."""
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


# ------------------------------------------------------------------------------------------------ ranks

def _unsigned(c: Column) -> Column:
    """A long whose unsigned order is the order of the longs."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def rank_directory(ids: DataFrame, store: TableStore) -> DataFrame:
    """Bitmap words with the ranks before them, of rows (grp, id): (grp, word, bits, n, before).

    A word is the bitmap of 64 neighbouring ids of a group; only words that hold
    an id exist, which compresses sparse groups, and they are combined before the
    shuffle. ``n`` counts a word's rows (more than its bits where ids repeat),
    ``before`` the rows of the group in earlier words. The counts pass through a
    directory whose blocks have at most 2**10 parts each, so that no running sum
    sees more than one block, whatever the number of rows and however ids lie.
    """
    u = _unsigned(F.col("id"))
    words = (ids.groupBy("grp", F.shiftrightunsigned(u, WORD_BITS).alias("word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, {_BIT})")).alias("bits"),
                  F.count(F.lit(1)).alias("n")))
    levels = [store.write(words.select("grp", F.col("word").alias("at"), "n", "bits"), "words")[0]]
    while True:
        up = levels[-1].groupBy("grp", F.shiftrightunsigned("at", FAN_BITS).alias("at")).agg(F.sum("n").alias("n"))
        up, seen = store.write(up, f"directory-{len(levels)}", n=F.count(F.lit(1)), zeros=F.count_if(F.col("at") == 0))
        levels.append(up)
        if seen["n"] == seen["zeros"]:  # one block a group
            break
    known = levels.pop().select("grp", F.col("at").alias("block"), F.lit(0).cast("bigint").alias("base"))
    inside = Window.partitionBy("grp", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    while levels:
        parts = levels.pop().withColumn("block", F.shiftrightunsigned("at", FAN_BITS))
        parts = parts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        placed = parts.join(known, ["grp", "block"]).withColumn("base", F.col("base") + F.col("inside"))
        known = placed.select("grp", F.col("at").alias("block"), "base", *([] if levels else ["bits", "n"]))
        known, _ = store.write(known, f"before-{len(levels)}")
    return known.select("grp", F.col("block").alias("word"), "bits", "n", F.col("base").alias("before"))


def coordinates(rows: DataFrame, store: TableStore) -> DataFrame:
    """Each row (grp, id, leaf, …) with its ``slot``: its place, from 0, among the group's rows by id.

    The place is a rank query: rows in earlier words plus the bits below the
    row's own. Rows without an id come before all others, and rows of one id
    lie together in the order of their leaves; only those rows, if there are
    any, are numbered in a sort (spread over tasks).
    """
    directory = rank_directory(rows.filter("id is not null").select("grp", "id"), store)
    bit, below = F.expr(_BIT), F.expr(f"bits & ~shiftleft(-1L, {_BIT})")
    twice = directory.filter(F.bit_count("bits") < F.col("n")).select("grp", "word")
    told = rows.withColumn("word", F.shiftrightunsigned(_unsigned(F.col("id")), WORD_BITS))
    repeats = (told.join(twice, ["grp", "word"], "left_semi").groupBy("grp", "word", "id").agg((F.count(F.lit(1)) - 1).alias("more"))
               .filter("more > 0").withColumn("bit", bit))
    repeats, seen = store.write(repeats, "repeats", n=F.count(F.lit(1)))
    nulls, none = store.write(rows.filter("id is null").groupBy("grp").agg(F.count(F.lit(1)).alias("nulls")), "nulls", n=F.count(F.lit(1)))
    found = told.filter("id is not null").join(directory, ["grp", "word"]).withColumn("slot", F.col("before") + F.bit_count(below))
    if seen["n"]:  # what repeated ids of the same word add, one array of at most 64 for each such word
        extra = repeats.groupBy("grp", "word").agg(F.collect_list(F.struct("bit", "more")).alias("extra"))
        found = found.join(extra, ["grp", "word"], "left")
        found = found.withColumn("slot", F.col("slot") + F.coalesce(F.aggregate(
            F.filter("extra", lambda e: e["bit"] < bit), F.lit(0).cast("bigint"), lambda t, e: t + e["more"]), F.lit(0)))
    found = found.select(*rows.columns, "slot")
    if none["n"]:
        found = found.unionByName(rows.filter("id is null").withColumn("slot", F.lit(0).cast("bigint")))
        shift = F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("nulls", F.lit(0)))
        found = lookup_join(found, nulls, ["grp"], "left", none["n"]).withColumn("slot", F.col("slot") + shift).drop("nulls")
    if seen["n"] or none["n"]:
        found, _ = store.write(found.withColumn("own", F.monotonically_increasing_id()), "ranked")
        shared = repeats.select("grp", "id")
        alike = found.filter("id is not null").join(shared, ["grp", "id"], "left_semi").unionByName(found.filter("id is null"))
        numbered = ordinal(alike, ["leaf", "own"], "place", ["grp", "id"])
        numbered, _ = store.write(numbered.select("own", (F.col("slot") + F.col("place") - 1).alias("apart")), "apart")
        found = found.join(numbered, "own", "left").select(*rows.columns, F.coalesce("apart", "slot").alias("slot"))
    return found


# ----------------------------------------------------------------------------------------------- levels

def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole slot arrays of rows sorted by (grp, chunk); none has more than the slots of a chunk and one row."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        grp, chunk = table.column("grp").to_numpy(), table.column("chunk").to_numpy()
        cuts = np.append(0, np.flatnonzero((grp[1:] != grp[:-1]) | (chunk[1:] != chunk[:-1])) + 1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def _levels(leaves: list[bytes], chunk: int, slots: int) -> list[list[bytes]]:
    """Nodes of every level of a slot array, lowest first.

    An array that is its group's only one is reduced to one node; of several
    arrays each is reduced by the levels of a full one.
    """
    alone = chunk == 0 and len(leaves) < slots
    levels, steps = [leaves], slots.bit_length() - 1
    while len(levels[-1]) > 1 if alone else len(levels) <= steps:
        now = levels[-1]
        levels.append([_digest(*now[i:i + 2]) for i in range(0, len(now), 2)])
    return levels


def _sides(levels: list[list[bytes]], at: int) -> bytes:
    """Siblings on a slot's way up: a byte (0 none, 1 left, 2 right), then the sibling's digest if there is one."""
    way = []
    for nodes in levels[:-1]:
        other = at ^ 1
        way.append(b"\0" if other >= len(nodes) else (b"\1" if other < at else b"\2") + nodes[other])
        at >>= 1
    return b"".join(way)


def _siblings(way: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(way):
        side = way[at]
        yield side, way[at + 1:at + 33] if side else b""
        at += 33 if side else 1


def fold(leaf: bytes, way: bytes) -> bytes:
    """The digest that a leaf and the siblings on its way give."""
    for side, other in _siblings(way):
        leaf = _digest(leaf) if not side else _digest(other, leaf) if side == 1 else _digest(leaf, other)
    return leaf


def _tops(batches, slots: int):
    for table in _arrays(batches):
        order = np.argsort(table.column("slot").to_numpy(), kind="stable")
        leaves = table.column("digest").take(pa.array(order)).to_pylist()
        chunk = table.column("chunk")[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array([table.column("grp")[0].as_py()], pa.int64()), pa.array([chunk], pa.int64()),
             pa.array([_levels(leaves, chunk, slots)[-1][0]], pa.binary())], ["grp", "slot", "digest"])


def _descend(batches, slots: int):
    """Ways of an array's nodes up to the root: inside the array, then the array's own way (in the row without a digest)."""
    for table in _arrays(batches):
        order = np.argsort(table.column("slot").to_numpy(), kind="stable")  # the array's way has slot -1
        slot, nodes = table.column("slot").to_numpy()[order], table.column("digest").take(pa.array(order)).to_pylist()
        above = table.column("way")[int(order[0])].as_py()
        chunk = table.column("chunk")[0].as_py()
        levels = _levels(nodes[1:], chunk, slots)
        ways = [_sides(levels, i) + above for i in range(len(nodes) - 1)]
        n = len(ways)
        yield pa.RecordBatch.from_arrays([pa.array([table.column("grp")[0].as_py()] * n, pa.int64()), pa.array(slot[1:]),
                                          pa.array(ways, pa.binary())], ["grp", "slot", "way"])


def _prove(batches, slots: int, root: bytes):
    """Proofs of an array's leaves, each folded anew from the leaf that is claimed."""
    for table in _arrays(batches):
        order = np.argsort(table.column("slot").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        above, subroot = table.column("way")[0].as_py(), table.column("claim")[0].as_py()
        nodes, claims = table.column("digest").to_pylist()[1:], table.column("claim").to_pylist()[1:]
        levels = _levels(nodes, table.column("chunk")[0].as_py(), slots)
        proofs, folded = [], []
        for i, (leaf, claim) in enumerate(zip(nodes, claims)):
            way = _sides(levels, i) + above
            proofs.append(_digest(*[other for side, other in _siblings(way) if side]).hex())
            folded.append(fold(leaf if claim is None else claim, way).hex())
        n, text = len(nodes), pa.string()
        yield pa.RecordBatch.from_arrays(
            [table.column("id").combine_chunks()[1:], pa.array([x.hex() for x in nodes], text), pa.array([subroot.hex()] * n, text),
             pa.array([root.hex()] * n, text), pa.array(proofs, text), pa.array(folded, text), pa.array([f == root.hex() for f in folded])],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _in_arrays(nodes: DataFrame, slots: int) -> DataFrame:
    """Nodes dealt out so that each slot array is one run of rows of a task."""
    return nodes.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk")


def _chunk(slots: int) -> Column:
    return F.shiftright("slot", slots.bit_length() - 1)


def reduce_levels(nodes: DataFrame, store: TableStore, name: str, slots: int = SLOTS) -> list[DataFrame]:
    """(grp, slot, digest) of the nodes at every array level, the last with one node a group."""
    levels = [nodes.select("grp", "slot", "digest")]
    while True:
        arrays = _in_arrays(levels[-1].withColumn("chunk", _chunk(slots)), slots)
        tops, seen = store.write(arrays.mapInArrow(lambda b: _tops(b, slots), "grp bigint, slot bigint, digest binary"),
                                 f"{name}-{len(levels)}", most=F.max("slot"))
        levels.append(tops)
        if not seen["most"]:
            return levels


def _ways(levels: list[DataFrame], above: DataFrame, store: TableStore, name: str, slots: int) -> DataFrame:
    """The way to the root of every node of the second level, from the ways (grp, slot, way) of the top nodes."""
    for k in range(len(levels) - 2, 0, -1):
        heads = above.select("grp", F.col("slot").alias("chunk"), F.lit(-1).cast("bigint").alias("slot"),
                             F.lit(None).cast("binary").alias("digest"), "way")
        nodes = levels[k].select("grp", _chunk(slots).alias("chunk"), "slot", "digest", F.lit(None).cast("binary").alias("way"))
        above, _ = store.write(_in_arrays(nodes.unionByName(heads), slots)
                               .mapInArrow(lambda b: _descend(b, slots), "grp bigint, slot bigint, way binary"), f"{name}-{k}")
    return above


def manifest(docs: DataFrame, id_column: str = "doc_id", group_column: str = "lang", fields: tuple[str, ...] = FIELDS,
             count_column: str = "n_chars", tampered: Column | None = None, slots: int = SLOTS) -> DataFrame:
    """Merkle tree of a table and a proof for each row.

    Returns (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified),
    a row for each row. A leaf is the digest of the row's ``fields``. The leaves
    of a group (null is one, and the first) are in the order of their ids and
    are reduced in pairs, a last single node by itself, to the subroot; the
    subroots in the order of their groups in turn to the root. A proof is the
    digest of the siblings on the leaf's way. ``tampered`` tells which rows
    claim a leaf with one more in ``count_column``; the root is folded from the
    claimed leaf and the true siblings, and verified if it is the root.

    A leaf's coordinate is a rank query on the group's bitmap, so no group is
    sorted; then keyed arrays of ``slots`` neighbouring nodes are reduced, each
    in one task: a group of any size is many arrays. Rows with a null id come
    first in their group; rows of one id are in the order of their leaves, and
    rows alike in all fields take neighbouring places. Ids are integers. Other columns are not
    looked at; no rows give no rows. Only the root comes to the driver.
    """
    spark = docs.sparkSession
    store = TableStore(spark, "manifest")
    cells = [F.col(c) for c in fields]
    claim = [(F.col(c).cast("decimal(20,0)") + 1).cast("string") if c == count_column else F.col(c) for c in fields]
    if tampered is None:
        tampered = F.coalesce(F.crc32(F.col(id_column).cast("string")) % 7 == 0, F.lit(False))
    kind = docs.schema[id_column].dataType.simpleString()
    named = F.coalesce(F.concat(F.lit("1"), F.col(group_column).cast("string")), F.lit("0"))
    rows = docs.select(named.alias("name"), F.col(id_column).cast("bigint").alias("id"), leaf_digest(*cells).alias("leaf"),
                       F.when(tampered, leaf_digest(*claim)).alias("claim"))
    rows, _ = store.write(rows, "leaves")
    # groups by number, in their order
    groups = ordinal(rows.select("name").distinct(), ["name"], "grp").select("name", (F.col("grp") - 1).alias("grp"))
    groups, seen = store.write(groups, "groups", n=F.count(F.lit(1)))
    if not seen["n"]:
        return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                                         "folded_root string, verified boolean")
    rows = lookup_join(rows, groups, ["name"], "inner", seen["n"]).select("grp", "id", "leaf", "claim")
    placed, _ = store.write(coordinates(rows, store).withColumnRenamed("leaf", "digest"), "placed")
    levels = reduce_levels(placed, store, "level", slots)
    subroots = levels[-1].select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("slot"), "digest")
    top = reduce_levels(subroots, store, "top", slots)
    root = bytes(top[-1].first().digest)
    start = top[-1].select("grp", "slot", F.lit(b"").alias("way"))
    ways = _ways([subroots] + top, start, store, "top-way", slots)  # of each subroot: the list's second level is the first here
    ways = ways.select(F.col("slot").alias("grp"), F.lit(0).cast("bigint").alias("slot"), "way")
    ways = _ways(levels, ways, store, "way", slots)
    heads = (lookup_join(ways, levels[-1].select("grp", F.col("digest").alias("claim")), ["grp"], "inner", seen["n"])
             .select("grp", F.col("slot").alias("chunk"), F.lit(-1).cast("bigint").alias("slot"), F.lit(None).cast("bigint").alias("id"),
                     F.lit(None).cast("binary").alias("digest"), "claim", "way"))
    leaves = placed.select("grp", _chunk(slots).alias("chunk"), "slot", "id", "digest", "claim", F.lit(None).cast("binary").alias("way"))
    proofs = _in_arrays(leaves.unionByName(heads), slots).mapInArrow(
        lambda b: _prove(b, slots, root), "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
                                          "folded_root string, verified boolean")
    return proofs.withColumn("doc_id", F.col("doc_id").cast(kind))
