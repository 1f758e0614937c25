"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept for each group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itinera.llm.common import components
from itinera.llm.vectors import by_length, matrix, sample_rows, spherical_centres, takes_part, unit
from itinera.plans.tables import TableStore

#: Least cosine, rows of one label for each cell aimed at, most cells, rows of a block.
COSINE, CELL_ROWS, MOST_CELLS, BLOCK = 0.93, 4096, 4096, 1024


def _assign(batches, centres: np.ndarray, reach: float):
    """Each vector at home in its nearest cell, and a guest in every cell whose members it could link with."""
    for batch in (part for whole in batches for part in by_length(whole, 2)):
        n = batch.num_rows
        points = unit(matrix(batch.column(2)))
        if points.shape[1] == centres.shape[1]:
            near = points @ centres.T
            home = near.argmax(axis=1)
            apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
            margin = near[np.arange(n), home][:, None] - near
            row, cell = np.nonzero(margin <= reach * apart[home] + 1e-9)
            row, cell = np.concatenate([row, np.arange(n)]), np.concatenate([cell, home])
            first = np.unique(row * np.int64(len(centres)) + cell)
            row, cell = first // len(centres), first % len(centres)
        else:
            row, cell, home = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.astype(np.int32)), pa.array(home[row] == cell),
             batch.column(3).take(at), batch.column(2).take(at)], ["cls", "label", "cell", "home", "copies", "v"])


def _block(table: pa.Table, cosine: float) -> pa.Table:
    """Links between two parts of a cell, or inside one: counts for home vectors, and a forest of the links."""
    table = table.combine_chunks()
    cls, home, copies, own = (table.column(c).to_numpy() for c in ("cls", "home", "copies", "own"))
    points = unit(matrix(table.column("v").chunk(0)))
    low = own == own.min()
    a = np.flatnonzero(low)
    b = np.flatnonzero(~low) if table.column("i")[0].as_py() != table.column("j")[0].as_py() else a
    linked = points[a] @ points[b].T >= cosine
    linked &= cls[a][:, None] != cls[b][None, :]
    links = np.zeros(len(cls), dtype=np.int64)
    links[a] += linked @ copies[b]
    if b is not a:
        links[b] += copies[a] @ linked
    names, place = np.unique(cls, return_inverse=True)
    root = np.arange(len(names))
    x, y = np.nonzero(linked)
    x, y = place[a][x], place[b][y]
    while True:  # smallest neighbour's root, then the root's root, till nothing moves
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(names)))
    at = np.flatnonzero(home & (links > 0))
    out_cls = np.concatenate([cls[at], names[moved]])
    return pa.Table.from_arrays(
        [pa.array(out_cls), pa.array(np.concatenate([links[at], np.zeros(len(moved), dtype=np.int64)])),
         pa.array(np.concatenate([cls[at], names[root[moved]]]))], ["cls", "links", "root"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding",
                    label_column: str = "label", cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """Vectors of one label linked by cosine: (vec_id, n_links, component_id, kept), a row for each vector.

    Equal vectors of a label are one class and are not compared with each
    other. Centres are fitted on at most about ``SAMPLE`` vectors; every vector
    is then at home in its nearest cell and a guest in each cell that lies
    within the chord of the least cosine behind the border, so every linked
    pair meets where one of them is at home and no link is lost. Cells are cut
    in blocks and each pair of blocks is one matrix product in double
    precision: a cell of any size is spread over many tasks of bounded memory.
    Products give a count for each home vector and a forest of the links, never
    all pairs.

    Vectors that are null, empty, zero or hold null or non-finite components
    and those without a label link with nothing: no links, themselves the
    component, kept. Vectors of different lengths never link. Repeated rows are vectors that
    link with each other. A null id names a component only if it has no other.
    Other columns are not looked at; no rows give no rows.
    """
    store = TableStore(vectors.sparkSession, "cosine")
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v"), F.col(label_column).alias("label"))
    good = takes_part("v") & F.col("label").isNotNull()
    rows = rows.withColumn("cls", F.when(good, F.xxhash64("label", "v")))
    named, _ = store.write(rows.select("vec_id", "cls"), "rows")
    classes = rows.filter(good).groupBy("cls", "label", "v").agg(F.count(F.lit(1)).alias("copies")).select("cls", "label", "v", "copies")
    classes, seen = store.write(classes, "classes", n=F.count(F.lit(1)))
    usual = classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return named.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = sample_rows(classes.filter(F.size("v") == usual.d), "v", seen["n"])
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    centres = spherical_centres(sample, min(MOST_CELLS, largest // cell_rows)) if len(sample) else np.zeros((1, usual.d))
    reach = float(np.sqrt(2 - 2 * cosine))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("label", "v")}
    placed = classes.mapInArrow(lambda b: _assign(b, centres, reach), f"cls bigint, label {kinds['label']}, cell int, home boolean, "
                                                                      f"copies bigint, v {kinds['v']}")
    placed, _ = store.write(placed.withColumn("d", F.size("v")), "placed")
    sizes = placed.groupBy("label", "d", "cell").agg(F.count(F.lit(1)).alias("n")) \
        .select("label", "d", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cut = placed.join(sizes, ["label", "d", "cell"]).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), "blocks").cast("int"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(
        F.least("own", q).alias("i"), F.greatest("own", q).alias("j"))))
    met = (cut.withColumn("m", meet).select("label", "d", "cell", "m.i", "m.j", "own", "cls", "home", "copies", "v")
           .groupBy("label", "d", "cell", "i", "j").applyInArrow(lambda t: _block(t, cosine), "cls bigint, links bigint, root bigint"))
    met, _ = store.write(met, "met")
    joined = components(met.filter("cls != root").select(F.col("cls").alias("a"), F.col("root").alias("b")), store, "groups")
    links = met.groupBy("cls").agg(F.sum("links").alias("links"))
    group = F.coalesce("component", "cls").alias("component")
    of = (classes.select("cls", "copies").join(links, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
          .select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), group))
    of, _ = store.write(of, "of")
    full, _ = store.write(named.join(of, "cls", "left"), "full")
    least = full.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    some = full.filter("component is not null").join(least, "component").select("vec_id", F.col("links").alias("n_links"), F.col("least").alias("component_id"))
    none = full.filter("component is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
