"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profusion.session import dropped, shuffle_partitions, written

#: Edges that a task holds at a time.
CHUNK = 1 << 20
EDGES = "v long, u long"


def trees(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of the edges with the smallest id it is connected with, but for these smallest themselves."""
    ids, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    a, b = at[: len(v)], at[len(v) :]
    top = np.arange(len(ids))
    while True:
        low = np.minimum(top[a], top[b])
        np.minimum.at(top, top[a], low)
        np.minimum.at(top, top[b], low)
        while True:  # point at the top itself
            over = top[top]
            if np.array_equal(over, top):
                break
            top = over
        open_ = top[a] != top[b]
        if not open_.any():
            break
        a, b = a[open_], b[open_]
    rest = np.flatnonzero(top != np.arange(len(ids)))
    return ids[rest], ids[top[rest]]


def _trees(edges: DataFrame) -> DataFrame:
    """Fewer edges (v, u) that connect the same: within a task, or a chunk of it, one for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            v, u = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("v", "u"))
            held.clear()
            return pa.RecordBatch.from_arrays(list(map(pa.array, trees(v, u))), ["v", "u"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield flush()
        if held:
            yield flush()

    return edges.mapInArrow(run, EDGES)


def components(edges: DataFrame) -> DataFrame:
    """Columns id, class: for each id of ``edges`` (a, b), the smallest id it is connected with.

    Each round deals the edges out by their larger id, after each task has cut its edges to a forest, so
    that an id has few rows however many edges it has; the tasks that gather them join the trees that
    meet. Then each smaller id is replaced by its own smallest one. Both tables of that join are written ones,
    so that Spark splits the rows of a hub. It ends when every id has one smaller id that has none itself.
    """
    n = shuffle_partitions(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").cast("long").alias("v"), F.least("a", "b").cast("long").alias("u")).filter("u < v")
    before: tuple[DataFrame, ...] = ()
    while True:
        forest = written(_trees(_trees(now).repartition(n, "v")), "forest")
        parents = written(forest.groupBy("v").agg(F.min("u").alias("m"), F.max("u").alias("last")), "parents")
        dropped(*before)
        before = forest, parents
        if parents.filter("m < last").isEmpty() and forest.join(parents.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return parents.select(F.col("v").alias("id"), F.col("m").alias("class"))
        now = forest.join(parents.select(F.col("v").alias("u"), "m"), "u", "left").select("v", F.coalesce("m", "u").alias("u"))
