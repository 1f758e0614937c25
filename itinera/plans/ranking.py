"""Row numbers and neighbours that stay distributed whatever the group sizes.

A plain window sends a whole group to one task. That is the right plan while
groups are small and the wrong one for a group that holds a large part of the
table, so the helpers here look for heavy groups first (one frequency sketch)
and send only groups above ``group_limit`` down a range-partitioned path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera.plans.tables import TableStore

GROUP_LIMIT = 5_000_000
_HOT_GROUPS, _SKETCH_ITEMS = 1000, 16384
_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def _columns(items: Sequence) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal, as they are to a window; the right keys go."""
    theirs = {k: f"_their_{k}" for k in keys}
    on = [left[k].eqNullSafe(F.col(t)) for k, t in theirs.items()]
    return left.join(right.withColumnsRenamed(theirs), on, how).drop(*theirs.values())


def hot_groups(df: DataFrame, keys: Sequence[str], group_limit: int) -> Column | None:
    """Condition that selects the rows of hot groups, or None when there are none.

    One frequency sketch per map task finds the groups, so the check costs a scan
    of the key columns and no shuffle of keys. The sketch only decides which of
    two exact plans a row takes; a wrong guess never changes a result.
    """
    group = F.xxhash64(*keys)
    sketch = F.expr(f"approx_top_k(xxhash64({', '.join(f'`{k}`' for k in keys)}), "
                    f"{_HOT_GROUPS}, {_SKETCH_ITEMS})")
    found = df.agg(F.filter(sketch, lambda i: i["count"] > group_limit)["item"].alias("h")).first()
    return group.isin([int(h) for h in found["h"]]) if found["h"] else None


def ordinal(df: DataFrame, order: Sequence, name: str = "ordinal",
            partition: Sequence[str] = ()) -> DataFrame:
    """1..n in ``order``, per ``partition`` if given, without a single-task window.

    Range partitioning sorts the table across tasks; the rows get their index
    inside the task, the table is written once, and the start of each task
    comes from a running sum over one row per (task, group). ``order`` should be
    unique so that no range is larger than one task can sort.
    """
    store = TableStore(df.sparkSession, "ordinal")
    keys = [F.col(p) for p in partition] + _columns(order)
    placed = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_row", F.monotonically_increasing_id())
              .withColumn("_task", F.shiftright("_row", _ROW_BITS)))
    placed, _ = store.write(placed, "placed")
    running = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    starts = (placed.groupBy("_task", *partition)
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
              .withColumn("_start", F.sum("_n").over(
                  running.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)))
              .select("_task", *partition, "_first", F.coalesce("_start", F.lit(0)).alias("_start")))
    joined = same_keys(placed, starts, ["_task", *partition])
    number = (F.col("_start") + F.col("_row") - F.col("_first") + 1).cast("bigint")
    return joined.select(*[F.col(c) for c in df.columns], number.alias(name))


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rank",
                  group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``row_number`` per group: a window for normal groups, ``ordinal`` for hot ones."""
    window = Window.partitionBy(*keys).orderBy(*_columns(order))

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumn(name, F.row_number().over(window).cast("bigint"))

    hot = hot_groups(df, keys, group_limit)
    if hot is None:
        return plain(df)
    return plain(df.filter(~hot)).unionByName(ordinal(df.filter(hot), order, name, keys))


def next_in_group(df: DataFrame, keys: Sequence[str], order: Sequence, columns: Sequence[str],
                  prefix: str = "next_", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Values of the following row of the group (null on the last row).

    Normal groups use ``lead``; the rows of hot groups are numbered and meet
    their successor in an equi-join on (group, number), which spreads one group
    over all tasks.
    """
    window = Window.partitionBy(*keys).orderBy(*_columns(order))
    hot = hot_groups(df, keys, group_limit)

    def plain(part: DataFrame) -> DataFrame:
        return part.select("*", *[F.lead(c).over(window).alias(prefix + c) for c in columns])

    if hot is None:
        return plain(df)
    numbered, _ = TableStore(df.sparkSession, "next").write(
        ordinal(df.filter(hot), order, "_pos", keys), "numbered")
    following = numbered.select(*keys, (F.col("_pos") - 1).alias("_pos"),
                                *[F.col(c).alias(prefix + c) for c in columns])
    paired = same_keys(numbered, following, [*keys, "_pos"], "left").drop("_pos")
    cold = plain(df.filter(~hot))
    return cold.unionByName(paired.select(*cold.columns))


def first_in_group(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per group in ``order`` (E3), with map-side partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*_columns(order)))
    return (df.groupBy(*keys).agg(best.alias("_row"))
            .select(*keys, "_row.*").select(*df.columns))


def top_in_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
                 name: str = "rank") -> DataFrame:
    """First ``n`` rows per group.

    ``row_number() <= n`` lets Spark keep at most ``n`` rows per group and map
    task before the shuffle (WindowGroupLimit), so a hot group stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


_BINS = 4096


def nth_smallest(keys: DataFrame, column: str, n: int) -> tuple[int, int, int] | None:
    """(value, rows below it, rows equal to it) for the ``n``-th smallest integer; None with fewer than ``n`` rows.

    A histogram of 4096 counters narrows the range to one value: one scan of the
    key column, then scans of the rows of one bin, which are written. Nothing is
    sorted or shuffled but the counters. Nulls are not counted.
    """
    store = TableStore(keys.sparkSession, "nth")
    value = F.col("v")
    keys = keys.select(F.col(column).cast("bigint").alias("v")).filter(value.isNotNull())
    low, high, equal = keys.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
    if n < 1 or equal < n:
        return None
    below, rounds = 0, 0
    while low < high:
        width = (high - low) // _BINS + 1
        bins = keys.groupBy(F.expr(f"CAST((v - {low}L) DIV {width}L AS INT)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        for place, equal in sorted((r["bin"], r["n"]) for r in bins.collect()):  # at most 4096 counters
            if below + equal >= n:
                break
            below += equal
        low, high = low + place * width, min(high, low + (place + 1) * width - 1)
        keys, _ = store.write(keys.filter(value.between(low, high)), f"bin-{rounds}")
        rounds += 1
    store.clear()
    return low, below, equal


def first_n(df: DataFrame, key: Column, n: int, ties: Sequence) -> DataFrame:
    """The ``n`` rows with the smallest integer ``key``, in no order; all rows when there are no more.

    The cut is found on the keys alone, so the rows themselves are only filtered.
    Rows that share the key of the cut are numbered in the order ``ties``.
    """
    if n < 1:
        return df.limit(0)
    keyed = df.withColumn("_key", key)
    cut = nth_smallest(keyed, "_key", n)
    if cut is None:
        return df
    value, below, equal = cut
    at_most = keyed.filter(F.col("_key") <= value).drop("_key")
    if below + equal == n:
        return at_most
    tied = ordinal(keyed.filter(F.col("_key") == value), ties, "_pos").filter(F.col("_pos") <= n - below)
    return keyed.filter(F.col("_key") < value).drop("_key").unionByName(tied.select(*df.columns))
