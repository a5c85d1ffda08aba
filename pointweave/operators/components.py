"""Connected components of a distributed graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Smallest id of the component of every vertex in ``edges (src, dst)``: ``id, label``.

    Each round hooks every vertex to its smallest neighbour, shortens the chains to their roots and contracts the
    graph, which at least halves the vertices left in a component. Long-label joins are split by adaptive execution.
    """
    graph = cut(_simple(edges))
    mapping = None
    for _ in range(max_rounds):
        if graph.isEmpty():
            break
        both = graph.unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("nearest")).select(
            "id", F.least("id", "nearest").alias("parent"))
        hooks = _shortened(cut(hooks))
        if mapping is None:
            mapping = hooks.select("id", F.col("parent").alias("label"))
        else:
            mapping = mapping.join(hooks.select(F.col("id").alias("label"), "parent"), "label", "left").select(
                "id", F.coalesce("parent", "label").alias("label"))
        mapping = cut(mapping)
        graph = cut(_simple(
            graph.join(hooks.select(F.col("id").alias("src"), F.col("parent").alias("a")), "src")
            .join(hooks.select(F.col("id").alias("dst"), F.col("parent").alias("b")), "dst")
            .select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    else:
        raise RuntimeError("components did not settle")
    if mapping is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("label")).limit(0)
    return mapping


def _simple(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, larger end first, without loops."""
    return edges.filter(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def _shortened(hooks: DataFrame) -> DataFrame:
    """Follow parents of parents until every vertex points at a root."""
    while True:
        above = hooks.select(F.col("id").alias("parent"), F.col("parent").alias("grandparent"))
        jumped = cut(hooks.join(above, "parent").select("id", F.col("grandparent").alias("parent"),
                                                        (F.col("grandparent") != F.col("parent")).alias("moved")))
        hooks = jumped.select("id", "parent")
        if jumped.filter("moved").isEmpty():
            return hooks


TILE_BITS = 3


def _contracted(vertex: T.DataType):
    """Labels of the vertices of one tile: the smallest vertex that its edges lead to."""
    schema = T.StructType([T.StructField("tx", T.LongType()), T.StructField("ty", T.LongType()),
                           T.StructField("id", vertex), T.StructField("label", vertex)])

    def contract(tile: pd.DataFrame) -> pd.DataFrame:
        ids, codes = np.unique(np.concatenate([tile["src"], tile["dst"]]), return_inverse=True)
        a, b = codes[:len(tile)], codes[len(tile):]
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                return pd.DataFrame({"tx": tile["tx"].iloc[0], "ty": tile["ty"].iloc[0], "id": ids, "label": ids[label]})
            label = new

    return contract, schema


def tiled_components(edges: DataFrame) -> DataFrame:
    """Components of ``edges (src, dst, src_tx, src_ty, dst_tx, dst_ty)``: ``id, label``, the smallest id of the component.

    A vertex lies in one tile of a plane, which holds a bounded number of them, and edges join near vertices. Each tile is
    contracted in one task. What is left are the edges between tiles, with the tiles' labels as ends; they are contracted in
    tiles of 8 x 8 tiles, and so on, one written table a level, until no edge leaves its tile. A tile of any level so
    has work in proportion to the borders inside it. The labels then come back down. All joins are within a tile, so a
    component of half of all vertices is no key of any of them.
    """
    contract, schema = _contracted(edges.schema["src"].dataType)
    tiles = [f"{end}_{c}" for end in ("src", "dst") for c in ("tx", "ty")]
    state = cut(edges.select("src", "dst", *tiles))
    first = state.agg(*[F.least(F.min(f"src_{c}"), F.min(f"dst_{c}")).alias(c) for c in ("tx", "ty")]).first()
    if first["tx"] is None:
        return state.select(F.col("src").alias("id"), F.col("src").alias("label"))
    state = state.select("src", "dst", *[(F.col(t) - first[t[-2:]]).cast("bigint").alias(t) for t in tiles])
    within = (F.col("src_tx") == F.col("dst_tx")) & (F.col("src_ty") == F.col("dst_ty"))
    maps: list[DataFrame] = []
    while True:
        ends = [state.filter(~within).select(F.col(end).alias("src"), F.col(end).alias("dst"), F.col(f"{end}_tx").alias("tx"),
                                             F.col(f"{end}_ty").alias("ty")) for end in ("src", "dst")]
        work = state.filter(within).select("src", "dst", F.col("src_tx").alias("tx"), F.col("src_ty").alias("ty"))
        work = work.unionByName(ends[0].unionByName(ends[1]).distinct())
        maps.append(cut(work.groupBy("tx", "ty").applyInPandas(contract, schema)))
        outer = state.filter(~within)
        if outer.isEmpty():
            break
        for end in ("src", "dst"):
            named = maps[-1].select(F.col("tx").alias(f"{end}_tx"), F.col("ty").alias(f"{end}_ty"), F.col("id").alias(end),
                                    F.col("label").alias(f"{end}_label"))
            outer = outer.join(named, [f"{end}_tx", f"{end}_ty", end])
        state = cut(outer.select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst"),
                                 *[F.shiftright(t, TILE_BITS).alias(t) for t in tiles]).distinct())
    result = maps[-1]
    for below in reversed(maps[:-1]):
        above = result.select(F.col("tx").alias("up_tx"), F.col("ty").alias("up_ty"), F.col("id").alias("up"), F.col("label").alias("top"))
        up = below.withColumns({"up_tx": F.shiftright("tx", TILE_BITS), "up_ty": F.shiftright("ty", TILE_BITS), "up": F.col("label")})
        # Labels whose tile no edge leaves are not taken up.
        result = up.join(above, ["up_tx", "up_ty", "up"], "left").select("tx", "ty", "id", F.coalesce("top", "label").alias("label"))
    return result.select("id", "label")
