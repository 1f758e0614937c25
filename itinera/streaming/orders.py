"""Streaming operators (K1, K2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from itinera.operators.extract import extract_orders
from itinera.operators.matching import INLINE_KEYS
from itinera.operators.stations import map_cities
from itinera.plans.tables import TableStore


def resolve_stream(orders: DataFrame, gazetteer: DataFrame, city_station: DataFrame,
                   routes: DataFrame, inline_keys: int = INLINE_KEYS) -> DataFrame:
    """K1: resolve a stream of (sentenceID, sentence) against static tables.

    Matching happens inside the row and everything else is a stream-static join,
    so the query holds no state. ``routes`` is a ready table of routes (J9 rows).
    A streaming plan can't join n-grams back to their row without state, so a
    dictionary of more than ``inline_keys`` keys goes through ``resolve_batches``.
    """
    if orders.isStreaming and gazetteer.limit(inline_keys + 1).count() > inline_keys:
        raise ValueError(f"more than {inline_keys} keys: use resolve_batches, which takes a dictionary of any size")
    extracted = extract_orders(orders, gazetteer, inline_keys=inline_keys)
    mapped = map_cities(extracted, "origin", city_station, "origin_uic")
    mapped = map_cities(mapped, "destination", city_station, "destination_uic")
    known = routes.filter(F.col("error").isNull()).select("origin_uic", "destination_uic", "path", "minutes")
    return (mapped.join(known, ["origin_uic", "destination_uic"], "left")
            .select("sentenceID", "sentence", "origin", "destination", "origin_uic", "destination_uic",
                    "valid", "method", "path", F.col("minutes").alias("total_time"),
                    F.col("path").isNotNull().alias("success")))


def resolve_batches(orders: DataFrame, gazetteer: DataFrame, city_station: DataFrame, routes: DataFrame,
                    sink: Callable[[DataFrame, int], None], checkpoint: str, inline_keys: int = INLINE_KEYS) -> StreamingQuery:
    """K1 for dictionaries of any size: each micro-batch is resolved as a table and handed to ``sink(rows, batch)``.

    A large dictionary is an n-gram join inside the batch; nothing is kept
    between batches but the stream's own progress in ``checkpoint``. The
    dictionary is written once, not derived again by each of its joins.
    """
    gazetteer, _ = TableStore(gazetteer.sparkSession, "stream-names").write(gazetteer, "gazetteer")

    def resolve(batch: DataFrame, number: int) -> None:
        sink(resolve_stream(batch, gazetteer, city_station, routes, inline_keys), number)

    return (orders.writeStream.foreachBatch(resolve).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def batch_tables(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``resolve_batches``: a Parquet folder for each batch number, written whole or again.

    A stream hands a batch to its sink once more if it stopped before noting it;
    the number stays, so the rows take the place of the earlier ones. Read the
    folder as one table with ``read_batches``.
    """
    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_batches(orders: DataFrame, path: str) -> DataFrame:
    """All batches that ``batch_tables`` wrote, without their numbers."""
    return orders.sparkSession.read.parquet(path).drop("batch")


def first_seen(events: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """K2: pass each key once; state is dropped ``delay`` behind the newest event."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return timed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
