"""Vector columns: which take part, as arrays inside tasks, and centres fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most vectors that centres are fitted on.
SAMPLE = 20_000


def takes_part(vector: str) -> Column:
    """Whether a vector is there, has no null or non-finite component and is not zero."""
    v = F.col(vector)
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long vectors as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch's rows apart by the length of their vectors."""
    lengths = pc.list_value_length(batch.column(column))
    for n in pc.unique(lengths):
        yield batch.filter(pc.equal(lengths, n))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow on the way."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def sample_rows(vectors: DataFrame, vector: str, rows: int, most: int = SAMPLE) -> np.ndarray:
    """About ``most`` vectors of ``rows`` at the most, chosen by hash."""
    share = min(1.0, most / max(rows, 1))
    picked = vectors.filter(F.pmod(F.xxhash64(vector, F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(vector)
    found = [r[0] for r in picked.limit(2 * most).toLocalIterator()]
    return np.array(found, dtype=np.float64).reshape(len(found), -1)


def spherical_centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means on a sample: unit vectors, each the direction of its members' sum."""
    points = unit(sample)
    k = max(1, min(k, len(points)))
    centres = points[np.random.default_rng(11).permutation(len(points))[:k]]
    for _ in range(rounds):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres
