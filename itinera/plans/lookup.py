"""Left joins to lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itinera.plans.tables import TableStore

_SPREAD = 4096

#: Most rows of a lookup side that is broadcast; it is counted first, and a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def sized(lookup: DataFrame) -> DataFrame:
    """A lookup side whose join is chosen by its counted rows.

    Spark guesses the size of derived columns from compressed files and may
    broadcast millions of rows; the hint for a larger side keeps it from that.
    """
    few = lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(lookup) if few else lookup.hint("merge")


def counted(lookup: DataFrame, label: str) -> DataFrame:
    """``sized`` for a lookup side that is dear to derive: written once, counted as it is written."""
    table, seen = TableStore(lookup.sparkSession, label).write(lookup, "rows", n=F.count(F.lit(1)))
    return F.broadcast(table) if seen["n"] <= BROADCAST_ROWS else table.hint("merge")


def left_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Left join on text keys where rows without a key do not gather in one task.

    A null key never matches, yet a shuffle join sends all of them to the same
    task. They get one of many stand-in keys that no lookup row has.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    stand_in = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(row_id), F.lit(_SPREAD)).cast("string"))
    left = df.withColumns({n: F.when(missing, stand_in).otherwise(F.col(k)) for n, k in zip(names, keys)})
    right = lookup.withColumnsRenamed(dict(zip(keys, names)))
    return left.join(right, names, "left").drop(*names)
