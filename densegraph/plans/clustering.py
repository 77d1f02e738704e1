"""From vectors to a compact graph and to flat labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegraph.operators import graph, hierarchy, knn, mst
from densegraph.plans.tables import settled


@dataclass
class Clustering:
    """knn: the neighbour graph; core_sg: edges enough for any smaller mpts; tree: the spanning tree or forest; labels: (id, label), -1 for noise."""

    knn: DataFrame
    core_sg: DataFrame
    tree: DataFrame
    labels: DataFrame


def core_graph(vectors: DataFrame, *, k: int, mpts: int, exact: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The neighbour graph of ``(vec_id, embedding)``, the spanning tree of its enhanced graph and the compact graph of both.

    Neighbours come from descent, or from exact search if asked for, which compares all pairs of vectors.
    """
    near = settled((knn.exact_knn if exact else knn.nndescent)(vectors, k))
    enhanced = settled(graph.enhanced_graph(vectors, near, mpts))
    tree = mst.boruvka(enhanced.select("src", "dst", "weight"))
    return near, tree, settled(graph.core_sg(near, tree, vectors, mpts))


def connected(tree: DataFrame, n: int) -> DataFrame:
    """The tree; a forest's parts joined by edges of infinite weight from the least id of all to the least id of each part."""
    if tree.count() >= n - 1:
        return tree
    heads = settled(mst.components(tree.select("src", "dst"), tree.sparkSession.range(n).toDF("id")).select("component").distinct())
    first = heads.agg(F.min("component")).first()[0]
    return tree.unionByName(heads.where(F.col("component") != first).select(F.lit(first).alias("src"), F.col("component").alias("dst"), F.lit(float("inf")).alias("weight")))


def labels_of(tree: DataFrame, n: int, min_cluster_size: int) -> DataFrame:
    """Flat labels of a spanning tree or forest over the ids 0 to n - 1."""
    condensed = settled(hierarchy.condensed_tree(hierarchy.single_linkage(connected(tree, n)), min_cluster_size))
    return settled(hierarchy.flat_labels(condensed, hierarchy.selected(condensed, settled(hierarchy.stability(condensed)))))


def cluster(vectors: DataFrame, *, k: int = 32, mpts: int = 32, min_cluster_size: int | None = None, exact: bool = False) -> Clustering:
    """Density-based clusters of ``(vec_id, embedding)`` with ids from 0 to n - 1."""
    near, tree, compact = core_graph(vectors, k=k, mpts=mpts, exact=exact)
    return Clustering(near, compact, tree, labels_of(tree, vectors.count(), min_cluster_size or mpts))


def reweighted_labels(found: Clustering, mpts: int, *, min_cluster_size: int | None = None) -> DataFrame:
    """Labels for another, smaller mpts from the compact graph alone, without new distances."""
    edges = graph.reweighted(found.core_sg, found.knn, mpts).select("src", "dst", "weight")
    return labels_of(mst.boruvka(edges), found.labels.count(), min_cluster_size or mpts)
