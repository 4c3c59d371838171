"""Connected components of an edge table, without collecting any of it.

Edges are first thinned to a spanning star per partition and component. Then
large-star and small-star steps alternate until nothing changes, each written to
the shared folder. A step takes the minimum over a node's neighbours as a partial
aggregate and joins it back under a salt, so a node with very many neighbours is
spread over tasks, not gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.joins import lookup_join
from quarryline.llm.common import discard, free_shuffles, stage

ROUNDS = 60


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the smallest node reachable over the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        keep = ra != rb
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all other nodes of the edges."""
    nodes, number = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = local_roots(number[: len(u)], number[len(u) :], len(nodes))
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _thin(edges: DataFrame) -> DataFrame:
    """Per partition a star for each component; holds the partition's edges, a few bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            u, v = spanning_stars(np.concatenate((u, np.asarray(batch.column(0)))), np.concatenate((v, np.asarray(batch.column(1)))))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return lookup_join(both.filter("v > u"), low, ["u"], "v", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = lookup_join(e, low, ["u"], "v", "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes with an edge other than the roots; ``edges`` has two long columns.

    The root is the smallest node reachable. No edges give no rows. The result is staged.
    """
    e = edges.toDF("u", "v").filter("u <> v")
    e = stage(_thin(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    mark = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    before = e.agg(*mark).first()
    for _ in range(ROUNDS):
        if not before.n:
            break
        older, e = e, stage(_small_star(_large_star(e)))
        discard(older)
        free_shuffles(edges.sparkSession)
        now = e.agg(*mark).first()
        if now == before:
            return e.toDF("node", "root")
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.toDF("node", "root")
