"""Spanning trees and components, over edges (src, dst, weight) in the total order (weight, src, dst)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegraph.plans.tables import settled

EDGE = "src long, dst long, weight double"


class DisconnectedGraphError(ValueError):
    """A spanning tree was asked for of a graph that isn't connected."""


def forest(edges: pd.DataFrame) -> pd.DataFrame:
    """The minimum spanning forest of edges held in memory."""
    if edges.empty:
        return edges
    e = edges.sort_values(["weight", "src", "dst"], kind="stable")
    ids, ends = np.unique(e[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept, left = [], len(ids) - 1
    for i, (a, b) in enumerate(ends.reshape(-1, 2).tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(i)
            left -= 1
            if not left:
                break
    return e.iloc[kept]


def _forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's forest: what is dropped closes a cycle of lighter edges, so it is in no tree.

    Edges are gathered until they are as many as the forest so far, so its repeated building costs about as much as building it once.
    """
    kept, waiting, rows = None, [], 0
    for f in frames:
        waiting.append(f)
        rows += len(f)
        if rows >= max(100_000, 0 if kept is None else len(kept)):
            kept, waiting, rows = forest(pd.concat([kept, *waiting] if kept is not None else waiting)), [], 0
    if waiting or kept is not None:
        yield forest(pd.concat([kept, *waiting] if kept is not None else waiting))


def simple(edges: DataFrame) -> DataFrame:
    """One direction of each edge, the lightest of repeated ones, no loops."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").cast("double").alias("weight")).where("src < dst")


def kruskal(edges: DataFrame, *, nodes: int | None = None, partitions: int = 16) -> DataFrame:
    """The minimum spanning tree by forests of ever fewer partitions; raises if ``nodes`` are given and not all joined.

    For node sets that one task holds; boruvka() has no such bound.
    """
    out = simple(edges)
    while partitions > 1:
        out = out.repartition(partitions).mapInPandas(_forests, EDGE)
        partitions //= 4
    return validated(settled(out.coalesce(1).mapInPandas(_forests, EDGE)), nodes)


def boruvka(edges: DataFrame, *, nodes: int | None = None) -> DataFrame:
    """The minimum spanning tree in rounds of joins: each component takes its lightest edge and components are contracted.

    Nothing is gathered in one task, whatever the size.
    """
    left = settled(simple(edges).withColumns({"a": F.col("src"), "b": F.col("dst")}))
    picked = []
    while not left.isEmpty():
        both = left.unionByName(left.withColumns({"a": F.col("b"), "b": F.col("a")}))
        best = both.groupBy("a").agg(F.min(F.struct("weight", "src", "dst", "b")).alias("m"))
        best = settled(best.select("a", F.col("m.b").alias("to"), F.col("m.weight").alias("weight"), F.col("m.src").alias("src"), F.col("m.dst").alias("dst")))
        picked.append(best.select("src", "dst", "weight"))
        # Chosen edges form trees with one mutual pair each, whose lesser end is the root; pointers are doubled up to it.
        back = best.select(F.col("a").alias("to"), F.col("to").alias("again"))
        hop = best.join(back, "to", "left")
        up = settled(hop.select("a", F.when((F.col("again") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to")).alias("p")))
        while True:
            far = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            new = settled(up.join(far, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            done = new.where("moved").isEmpty()
            up = new.drop("moved")
            if done:
                break
        x, y = up.select("a", F.col("p").alias("pa")), up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = left.join(x, "a").join(y, "b").where("pa <> pb")
        left = settled(moved.select("src", "dst", "weight", F.col("pa").alias("a"), F.col("pb").alias("b")))
    spark = edges.sparkSession
    out = picked[0] if picked else spark.createDataFrame([], EDGE)
    for p in picked[1:]:
        out = out.unionByName(p)
    return validated(settled(out.distinct()), nodes)


def validated(tree: DataFrame, nodes: int | None) -> DataFrame:
    if nodes is not None and (n := tree.count()) != nodes - 1:
        raise DisconnectedGraphError(f"{n} edges join {nodes} nodes; a tree has {nodes - 1}")
    return tree


def ordered(tree: DataFrame) -> DataFrame:
    return tree.orderBy("weight", "src", "dst")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): each node (those of ``nodes`` with no edge too) with the least id that it reaches."""
    e = settled(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct())
    every = e.select(F.col("a").alias("id")).union(e.select("b")).distinct() if nodes is None else nodes.select("id")
    names = settled(every.withColumn("component", F.col("id")))
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        names = settled(names.join(least, names["component"] == least["a"], "left").select("id", F.coalesce("m", "component").alias("component")))
        x, y = least.select("a", F.col("m").alias("u")), least.select(F.col("a").alias("b"), F.col("m").alias("v"))
        e = settled(e.join(x, "a").join(y, "b").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct())
    return names


def at_threshold(tree: DataFrame, weight: float, nodes: DataFrame | None = None) -> DataFrame:
    """Components of the edges up to a weight."""
    return components(tree.where(F.col("weight") <= weight), nodes)
