"""Helpers shared by the training-data operators: text columns, word hashes, components, sized lookups."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.plans.tables import TableStore

#: Most rows of a lookup side that is broadcast; it is counted first, and a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C15  # odd, so powers of it have inverses modulo 2**64
_BYTE = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)


_MADE: dict[str, object] = {}


def once_per_worker(key: str, make):
    """What ``make`` gives, made once in a Python worker for each key; of older keys only a few are kept."""
    if key not in _MADE:
        for old in list(_MADE)[:-2]:
            del _MADE[old]
        _MADE[key] = make()
    return _MADE[key]


def text_or_empty(column: str) -> Column:
    """A text column as bytes for Arrow, null read as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def set_apart(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """A table whose own columns of these names have others, and the way back for ``withColumnsRenamed``."""
    taken = {n.lower() for n in names}
    away = {c: f"{c}-{uuid.uuid4().hex}" for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(away), {b: a for a, b in away.items()}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, at least ``n`` of each."""
    size = max(1 << 16, 1 << max(n - 1, 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        back = pow(_STEP, -1, 2**64)
        both = []
        for step in (_STEP, back):
            p = np.full(size, step, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def words_at(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash, the start and the end of each word ``[^\\x20\\x09-\\x0D]+`` of a text of bytes."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    inside = np.empty(len(raw) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[raw]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word of a text."""
    return words_at(text)[0]


_TURNS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out += words[k:k + n] * _TURNS[k % len(_TURNS)]
        out ^= out >> np.uint64(31)
    return mix(out)


def lookup_join(df: DataFrame, table: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join to a table of ``rows`` counted rows: broadcast up to ``BROADCAST_ROWS``, else by shuffle."""
    return df.join(F.broadcast(table) if rows <= BROADCAST_ROWS else table, on, how)


def components(edges: DataFrame, store: TableStore, name: str) -> DataFrame:
    """Connected components of edges (a, b) of longs: (node, component), the smallest node naming each.

    Every round each node moves to the neighbour (itself included) that comes
    first in an order drawn anew for the round, and edges are rewritten between
    the nodes moved to, which at least about halves the nodes that have edges.
    Rounds are tables in the shared folder. Aggregates combine before they
    shuffle and joins can be split, so a node with very many edges is no
    single task's work. No edges give no rows.
    """
    first, _ = store.write(edges.filter("a != b").select("a", "b").distinct(), f"{name}-edges")
    left, steps = first, []
    while True:
        k = len(steps)
        order = lambda c: F.xxhash64(F.col(c), F.lit(k))  # noqa: B023, E731
        pair = lambda n, to: F.struct(F.col(n).alias("node"), order(to).alias("o"), F.col(to).alias("to"))  # noqa: B023, E731
        near = left.select(F.inline(F.array(pair("a", "b"), pair("b", "a"), pair("a", "a"), pair("b", "b"))))
        moved = near.groupBy("node").agg(F.min(F.struct("o", "to")).alias("m")).select("node", F.col("m.to").alias("to"))
        moved, _ = store.write(moved, f"{name}-moved-{k}")
        steps.append(moved)
        ends = (left.join(moved.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
                .join(moved.select(F.col("node").alias("b"), F.col("to").alias("y")), "b"))
        left, seen = store.write(ends.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                                 .distinct(), f"{name}-edges-{k}", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
    ends = steps.pop()
    while steps:
        later = ends.select(F.col("node").alias("to"), F.col("to").alias("last"))
        ends = steps.pop().join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    ends, _ = store.write(ends, f"{name}-ends")
    least = ends.groupBy("to").agg(F.min("node").alias("component"))
    return store.write(ends.join(least, "to").select("node", "component"), f"{name}-components")[0]
