"""Exact top-k search by inner product: tiled matrix products, selection per tile, tree merging of the lists.

Items and queries are dealt to tiles of bounded size by a hash of their id. Each pair of an item tile and a query tile
is one group in one task: a matrix product, from which only the k best items of each query go on. The lists of a query
are merged ``FAN_IN`` at a time until one is left, so no task ever holds more than ``FAN_IN * k`` entries of a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

ITEM_TILE = 32_768
QUERY_TILE = 16_384
FAN_IN = 16
_BLOCK_CELLS = 4_000_000
_LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Vectors that are not null and hold only finite components."""
    sound = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  false for NaN and null
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(sound(x), F.lit(False)) & ~F.isnan(x.cast("double")))


def _matrix(table: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors, each component floor(scale * x) with x as a double."""
    ids = table.column("id").to_numpy()
    lists = table.column("vector").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.floor(scale * flat.reshape(len(ids), -1))[order]


def _products(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in the narrowest type that can't round, else with Python's integers."""
    top = lambda a: float(np.abs(a).max(initial=0))
    bound = top(queries) * top(items) * max(1, queries.shape[1])
    if bound < 2**24:
        return (queries.astype(np.float32) @ items.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (queries @ items.T).astype(np.int64)
    as_integers = np.vectorize(int, otypes=[object])
    exact = as_integers(queries).dot(as_integers(items).T) if queries.shape[1] else np.zeros((len(queries), len(items)))
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the lower column, in order."""
    width = scores.shape[1]
    k = min(k, width)
    if np.abs(scores).max(initial=0) < 2**62 // max(1, width):
        ranked = scores * width - np.arange(width)  # one distinct number a column, so partial selection is exact
        if k < width:
            some = np.argpartition(ranked, width - k, axis=1)[:, width - k:]
        else:
            some = np.broadcast_to(np.arange(width), scores.shape)
        inner = np.argsort(-np.take_along_axis(ranked, some, axis=1), axis=1)
        return np.take_along_axis(some, inner, axis=1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _tile_top(k: int, scale: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "node", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        query_ids, queries = _matrix(left, scale)
        item_ids, items = _matrix(right, scale)
        rows = max(1, _BLOCK_CELLS // len(item_ids))
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(query_ids), rows):
            own = query_ids[at:at + rows]
            scores = _products(queries[at:at + rows], items)
            # As many more than k as there may be rows of the query's own id among them.
            alike = np.searchsorted(item_ids, own, "right") - np.searchsorted(item_ids, own)
            best = _best(scores, k + int(alike.max()))
            found, values = item_ids[best], np.take_along_axis(scores, best, axis=1)
            other = found != own[:, None]
            other &= np.cumsum(other, axis=1) <= k
            which = np.nonzero(other)
            for part, column in zip(out, (own[which[0]], found[which], values[which])):
                part.append(column)
        query, item, score = (np.concatenate(part) for part in out)
        return pa.table([pa.array(query), pa.array(np.full(len(query), right.column("tile")[0].as_py())),
                         pa.array(item), pa.array(score)], names)

    return run


def top_k(queries: DataFrame, items: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding",
          scale: float = 256, item_tile: int = ITEM_TILE, query_tile: int = QUERY_TILE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k items with the highest inner product of floor(scale * vector).

    ``queries`` and ``items`` have a BIGINT ``id`` and an array ``vector``. An item is never a result for a query with
    its id. Ties go to the smaller id; with fewer than k others, all are returned. Null vectors, vectors with null or
    non-finite components and rows with a null id take no part. Only vectors of equal length are compared. Rows that
    share an id are items of their own, so an id can be in a list more than once; queries that share an id have one
    list, the best of all their pairs. Scores beyond 64 bits are held at the limits. Empty tables give an empty result,
    other columns are ignored.
    """
    def sound(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("vector")).filter(
            F.col("id").isNotNull() & usable(F.col("vector")))
        # Of equal rows, no more than k can be in a list, so more need not travel.
        copies = F.sequence(F.lit(1), F.least(F.count("*"), F.lit(k)).cast("int"))
        return rows.groupBy("id", "vector").agg(copies.alias("copies")).select("id", "vector", F.explode("copies")).drop("col")

    queries, items = sound(queries), sound(items)
    cores = items.sparkSession.sparkContext.defaultParallelism
    n_items, n_queries = items.count(), queries.count()
    # More tiles than needed for memory, if there are idle cores and a tile is still worth a task.
    item_tiles = max(1, math.ceil(n_items / item_tile), min(2 * cores, n_items // 2048))
    query_tiles = max(1, math.ceil(n_queries / query_tile))
    key = lambda n, salt: F.pmod(F.xxhash64("id", "vector", F.lit(salt)), F.lit(n)).cast("bigint")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    keys = ["tile", "query_tile", "size"]
    left = queries.select("*", key(query_tiles, 1).alias("query_tile"), F.size("vector").alias("size")).select(
        "*", every(item_tiles).alias("tile"))
    right = items.select("*", key(item_tiles, 2).alias("tile"), F.size("vector").alias("size")).select(
        "*", every(query_tiles).alias("query_tile"))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "node", "vec_id", "score")])
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile_top(k, scale), schema)
    # Sorted ascending by the complement of the score, which unlike its negative can't overflow.
    entry = F.struct(F.bitwise_not("score").alias("c"), F.col("vec_id").alias("v"))
    best = lambda entries: F.slice(F.sort_array(entries), 1, k).alias("best")
    merged = found.groupBy("query_id", F.expr(f"node div {FAN_IN}").alias("node")).agg(best(F.collect_list(entry)))
    nodes = math.ceil(item_tiles / FAN_IN)
    while nodes > 1:
        nodes = math.ceil(nodes / FAN_IN)
        merged = merged.groupBy("query_id", F.expr(f"node div {FAN_IN}").alias("node")).agg(
            best(F.flatten(F.collect_list("best"))))
    return merged.select("query_id", F.posexplode("best")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("col.v").alias("vec_id"),
        F.bitwise_not("col.c").alias("score"))
