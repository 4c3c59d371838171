"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on random orthonormal directions. Two vectors collide
in a projection if one lies in the window centred on the other. Window width and
the number of collisions to ask for are calibrated by simulation on pairs exactly
at the threshold, so that at least ``RECALL`` of them pass; closer pairs pass more
often. Passing pairs are verified by their cosine in double precision, so no pair
below the threshold is linked.

Equal vectors form one class first. Classes are sorted by their most spread
projection and cut into blocks of about ``BLOCK`` at quantiles; each pair of blocks
that some window spans is one task, so a dense region makes more tasks, not larger
ones. In a task the second and further projections are counted over tiles of
pairs, and a pair is dropped once it can't reach the count. A task returns how many
links each vector gets and spanning stars of the links, never the pairs.

A vector that is null, all zero, or holds a null or non-finite component links
with nothing. Vectors of different length never link. Repeated rows are vectors
of their own that link with each other. A null id takes part but names no
component. Further columns are kept by ``keep_one`` and passed over otherwise.
The number of block pairs grows with the square of the number of classes, scaled
by the share of pairs within one window; the README has figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import free_shuffles, stage
from quarryline.llm.graph import components, local_roots

COSINE, RECALL = 0.95, 0.995
#: Projections, the share of threshold pairs that one window holds, rows of a block, and of a tile.
PROJECTIONS, HIT, BLOCK, TILE = 20, 0.93, 4096, 512
#: Share of threshold pairs that the window of the dealing projection holds.
DEALT = 0.999
SEED = 17


def directions(dim: int, k: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """min(k, dim) orthonormal directions as columns."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q[:, : min(k, dim)]


def calibrate(dim: int, cosine: float = COSINE, k: int = PROJECTIONS, recall: float = RECALL, hit: float = HIT) -> tuple[float, int, float]:
    """(half width of a window, collisions to ask for, half width that vectors are dealt
    within), from differences of pairs at the threshold. Pairs are dealt by one projection,
    so its window there is wide enough to lose next to none."""
    k = min(k, dim)
    d = np.random.default_rng(SEED + 1).standard_normal((20_000, dim))
    d = np.abs(d / np.linalg.norm(d, axis=1, keepdims=True) * np.sqrt(max(0.0, 2 - 2 * cosine)))[:, :k]
    width = float(np.quantile(d, hit)) + 1e-6
    return width, int(np.quantile((d <= width).sum(axis=1), 1 - recall, method="lower")), float(np.quantile(d, DEALT)) + 1e-6


def _classes(vectors: DataFrame) -> DataFrame:
    """(node, h, embedding, size, first, dim): one row per distinct valid vector."""
    keys = F.xxhash64("embedding").alias("node"), F.xxhash64(F.lit(SEED), "embedding").alias("h")
    rows = vectors.select("vec_id", F.col("embedding"), *keys)
    return rows.groupBy("node", "h").agg(
        F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first"), F.size(F.first("embedding")).alias("dim")
    )


def valid(column: str = "embedding"):
    """Whether a vector can link: there, finite, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(column).isNotNull() & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the square
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _projected(classes: DataFrame, dim: int) -> DataFrame:
    basis = directions(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = (_unit(_matrix(batch.column(1), dim)) @ basis).astype(np.float32) if batch.num_rows else np.zeros((0, basis.shape[1]), np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), basis.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), batch.column(2), lists], ["node", "embedding", "size", "p"])

    return classes.select("node", F.col("embedding").cast("array<double>"), "size").mapInArrow(run, "node long, embedding array<double>, size long, p array<float>")


def linked_pairs(x: np.ndarray, p: np.ndarray, y: np.ndarray, r: np.ndarray, same: bool, calibrated: tuple[float, int, float], cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into x, into y) whose cosine reaches the threshold, per tile. ``p`` and ``r``
    are the projections, both sides ascending in the first; ``same``: both sides are one block."""
    k = p.shape[1]
    width, count, reach = calibrated
    for a in range(0, len(x), TILE):
        pa_ = p[a : a + TILE]
        lo = np.searchsorted(r[:, 0], pa_[0, 0] - reach)
        hi = np.searchsorted(r[:, 0], pa_[-1, 0] + reach, "right")
        for b in range(max(int(lo), a if same else 0), int(hi), TILE):
            rb = r[b : min(b + TILE, hi)]
            missed = np.zeros((len(pa_), len(rb)), np.int8)
            pairs = None
            for i in range(k):
                if pairs is None:
                    missed += np.abs(pa_[:, i, None] - rb[None, :, i]) > width
                    if i >= k - count and (i % 3 == 2 or i == k - 1):
                        left = missed <= k - count
                        if np.count_nonzero(left) < 0.1 * left.size:
                            pairs = np.nonzero(left)
                            lost = missed[pairs]
                else:
                    lost = lost + (np.abs(pa_[pairs[0], i] - rb[pairs[1], i]) > width)
                    on = lost <= k - count
                    pairs, lost = (pairs[0][on], pairs[1][on]), lost[on]
            if pairs is None:  # dense: all cosines of the tile at once
                near = (x[a : a + TILE] @ y[b : b + len(rb)].T >= cosine) & (missed <= k - count)
                u, v = np.nonzero(near)
            else:
                u, v = pairs
                near = np.einsum("ij,ij->i", x[a + u], y[b + v]) >= cosine
                u, v = u[near], v[near]
            u, v = u + a, v + b
            if same:
                u, v = u[u < v], v[u < v]
            if len(u):
                yield u, v


def _search(rows: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(node, other, links): partial link counts (other null) and star edges (links null)."""
    spark = rows.sparkSession
    calibrated = calibrate(dim, cosine)
    reach = np.float32(calibrated[2])
    k = directions(dim).shape[1]
    spread = rows.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(F.get("p", F.lit(i))).alias(f"v{i}") for i in range(k)]).first()
    lead = max(range(k), key=lambda i: spread[f"v{i}"] or 0.0)
    blocks = max(1, -(-spread.n // BLOCK))
    cuts = []
    if blocks > 1:
        wanted = [b / blocks for b in range(1, blocks)]
        cuts = rows.agg(F.percentile_approx(F.get("p", F.lit(lead)), F.array(*[F.lit(q) for q in wanted]), F.lit(max(10_000, 20 * blocks)))).first()[0]
    edges = np.array([-np.inf, *cuts, np.inf], np.float32)
    # Block b holds values in [edges[b], edges[b + 1]); the tasks of a block are the pairs it belongs to.
    first = np.searchsorted(edges[1:-1], edges[:-1] - reach, "right").tolist()
    last = np.searchsorted(edges[1:-1], edges[1:] + reach, "right").tolist()
    shared = spark.sparkContext.broadcast((edges[1:-1], list(zip(first, last, strict=True))))

    @F.pandas_udf("array<long>")
    def tasks(values):
        import pandas as pd

        inner, near = shared.value
        home = np.searchsorted(inner, values.to_numpy(np.float32), "right").tolist()
        return pd.Series([[min(b, c) << 32 | max(b, c) for c in range(near[b][0], near[b][1] + 1)] for b in home])

    sent = rows.select("node", "embedding", "size", "p", F.explode(tasks(F.get("p", F.lit(lead)))).alias("task"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[0].as_py() >> 32, key[0].as_py() & 0xFFFFFFFF
        node, size = table.column("node").to_numpy(), table.column("size").to_numpy()
        p = np.asarray(table.column("p").combine_chunks().flatten(), np.float32).reshape(-1, k)
        p = p[:, [lead, *(c for c in range(k) if c != lead)]]
        x = _unit(_matrix(table.column("embedding"), dim))
        home = np.searchsorted(edges[1:-1], p[:, 0], "right")
        sides = []
        for b in (i, j):
            own = np.flatnonzero(home == b)
            sides.append(own[np.argsort(p[own, 0], kind="stable")])
        left, right = sides
        links = np.zeros(len(node), np.int64)
        root = np.arange(len(node))
        for u, v in linked_pairs(x[left], p[left], x[right], p[right], i == j, calibrated, cosine):
            u, v = left[u], right[v]
            np.add.at(links, u, size[v])
            np.add.at(links, v, size[u])
            own = np.flatnonzero(root != np.arange(len(root)))
            root = local_roots(np.concatenate((own, u)), np.concatenate((root[own], v)), len(root))
        some, other = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        return pa.table(
            {
                "node": pa.array(np.concatenate((node[some], node[other])), pa.int64()),
                "other": pa.array([None] * len(some) + node[root[other]].tolist(), pa.int64()),
                "links": pa.array(links[some].tolist() + [None] * len(other), pa.int64()),
            }
        )

    return sent.groupBy("task").applyInArrow(run, "node long, other long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", valid().alias("ok"))
    good = rows.filter("ok").select("vec_id", "embedding")
    classes = stage(_classes(good))
    found = None
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():
        projected = stage(_projected(classes.filter(F.col("dim") == dim), dim))
        part = _search(projected, dim, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found)
    roots = components(found.filter("other is not null").select("node", "other"))
    counts = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.select("node", "h", "size", "first").join(roots, "node", "left").join(counts, "node", "left")
    placed = placed.select("node", "h", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = stage(placed.join(named, "root").select("node", "h", "n_links", "component_id"))
    free_shuffles(vectors.sparkSession)
    keyed = rows.select("vec_id", "ok", F.when(F.col("ok"), F.xxhash64("embedding")).alias("node"), F.when(F.col("ok"), F.xxhash64(F.lit(SEED), "embedding")).alias("h"))
    out = keyed.join(by_class, ["node", "h"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, ~F.col("ok")).alias("kept"),
    )


def keep_one(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows whose id names their component, columns unchanged."""
    kept = near_duplicates(vectors, cosine).filter("kept").select(F.col("vec_id").alias("_kept_id")).distinct()
    return vectors.join(kept, F.col("vec_id").cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")


SQL = f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings),
n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as s from v),
pairs as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id < b.vec_id where list_dot_product(a.e, b.e) / (a.s * b.s) >= {COSINE}),
links as (select a, b from pairs union all select b, a from pairs),
reach as (select vec_id as a, vec_id as b from v union select reach.a, links.b from reach join links on reach.b = links.a),
comp as (select a as vec_id, min(b) as component_id from reach group by 1),
deg as (select a as vec_id, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from comp left join deg using (vec_id)"""
