"""Graph statistics and graph building over (q, nbr, dist, rank) tables and undirected edges (src < dst)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densegraph.functions.vectors import l2, quantised
from densegraph.plans.tables import settled

#: The most vectors that are broadcast, 100 MB of 128 doubles each.
BROADCAST_VECTORS = 100_000


def in_degree(knn: DataFrame) -> DataFrame:
    """(id, in_degree) of every point that has a list; points in no list have 0."""
    counts = knn.groupBy(F.col("nbr").alias("id")).count()
    return knn.select(F.col("q").alias("id")).distinct().join(counts, "id", "left").select("id", F.coalesce("count", F.lit(0)).cast("long").alias("in_degree"))


def tie_score(knn: DataFrame, degree: DataFrame) -> DataFrame:
    """(id, score): the sum of the in-degrees of a point's neighbours."""
    return knn.join(degree.select(F.col("id").alias("nbr"), "in_degree"), "nbr").groupBy(F.col("q").alias("id")).agg(F.sum("in_degree").alias("score"))


def antihub_count(n: int) -> int:
    return int(n**0.5)


def antihubs(knn: DataFrame, m: int | None = None) -> DataFrame:
    """(id, in_degree, score) of the m points of least in-degree, ties by score, then id; m is the square root of the number of points if not given."""
    degree = in_degree(knn)
    m = antihub_count(degree.count()) if m is None else m
    return degree.join(tie_score(knn, degree), "id").orderBy("in_degree", "score", "id").limit(m)


def largest_list(knn: DataFrame) -> DataFrame:
    """(size): of the longest list of a graph; 0 for none."""
    return knn.groupBy("q").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("size"))


def boundary_ties(degree: DataFrame, m: int) -> DataFrame:
    """(id, in_degree) of the points whose in-degree is that of the m-th lowest."""
    w = Window.orderBy("in_degree")
    at = degree.groupBy("in_degree").count().withColumn("upto", F.sum("count").over(w)).where(F.col("upto") >= m).agg(F.min("in_degree").alias("in_degree"))  # a row for each in-degree
    return degree.join(F.broadcast(at), "in_degree").select("id", "in_degree")


def core_distance(knn: DataFrame, mpts: int, *, include_self: bool = False) -> DataFrame:
    """(id, core): the distance of the mpts-th neighbour (the point itself first if ``include_self``); raises if a list is shorter."""
    rank = mpts - 1 if include_self else mpts
    if rank == 0:
        return knn.select(F.col("q").alias("id")).distinct().withColumn("core", F.lit(0.0))
    r = knn.groupBy("q").agg(F.max("rank").alias("k")).agg(F.min("k").alias("k")).first()
    if r["k"] is not None and r["k"] < rank:
        raise ValueError(f"a list of {r['k']} neighbours has no core distance for mpts = {mpts}")
    return knn.where(F.col("rank") == rank).select(F.col("q").alias("id"), F.col("dist").alias("core"))


def mutual_flags(knn: DataFrame) -> DataFrame:
    """(q, nbr, mutual): how often q stands in the list of nbr."""
    back = knn.select(F.col("nbr").alias("q"), F.col("q").alias("nbr")).groupBy("q", "nbr").count()
    return knn.select("q", "nbr").join(back, ["q", "nbr"], "left").select("q", "nbr", F.coalesce("count", F.lit(0)).cast("int").alias("mutual"))


def symmetrised(knn: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, dist) of a graph."""
    return knn.groupBy(F.least("q", "nbr").alias("src"), F.greatest("q", "nbr").alias("dst")).agg(F.min("dist").alias("dist"))


def directed(knn: DataFrame) -> DataFrame:
    """Each list with the reverse of every edge that isn't mutual: (src, dst, dist), both directions."""
    lonely = knn.join(mutual_flags(knn).where("mutual = 0"), ["q", "nbr"])
    return knn.select(F.col("q").alias("src"), F.col("nbr").alias("dst"), "dist").union(lonely.select("nbr", "q", "dist"))


def clique(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """All pairs (src, dst, dist) of the given points, which are about as many as the square root of all.

    They are written first and counted; one side is broadcast up to BROADCAST_VECTORS, the other spread over all tasks.
    """
    v = settled(vectors.join(ids.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"))
    a = v.select(F.col("vec_id").alias("src"), F.col("embedding").alias("x")).repartition("src")
    b = v.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("y"))
    return a.join(F.broadcast(b) if v.count() <= BROADCAST_VECTORS else b, F.col("src") < F.col("dst")).select("src", "dst", l2("x", "y").alias("dist"))


def mutual_reachability(edges: DataFrame, core: DataFrame) -> DataFrame:
    """Edges with ``weight``: the greatest of the distance and both core distances."""
    a, b = core.select(F.col("id").alias("src"), F.col("core").alias("_a")), core.select(F.col("id").alias("dst"), F.col("core").alias("_b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "dist", F.greatest("dist", "_a", "_b").alias("weight"))


def enhanced_graph(vectors: DataFrame, knn: DataFrame, mpts: int) -> DataFrame:
    """The undirected graph of neighbours and of pairs of antihubs, weighted by mutual reachability."""
    pairs = symmetrised(knn).unionByName(clique(antihubs(knn), vectors)).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return mutual_reachability(pairs, core_distance(knn, mpts))


def core_sg(knn: DataFrame, mst: DataFrame, vectors: DataFrame, mpts: int) -> DataFrame:
    """Neighbour edges and spanning tree edges with distance and weight: enough to reweight for any smaller mpts."""
    x, y = vectors.select(F.col("vec_id").alias("src"), F.col("embedding").alias("x")), vectors.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("y"))
    tree = mst.select("src", "dst").join(x, "src").join(y, "dst").select("src", "dst", l2("x", "y").alias("dist"))
    pairs = symmetrised(knn).unionByName(tree).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return mutual_reachability(pairs, core_distance(knn, mpts))


def reweighted(graph: DataFrame, knn: DataFrame, mpts: int) -> DataFrame:
    """A graph's edges weighted for another mpts."""
    return mutual_reachability(graph.select("src", "dst", "dist"), core_distance(knn, mpts))


def csr_offsets(edges: DataFrame) -> DataFrame:
    """(id, degree, start): where each point's entries begin if both directions of all edges are listed by point.

    The running sum is taken within ranges of ids, then over the ranges, so no task sees all rows.
    """
    both = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    degree = both.groupBy("id").agg(F.count("*").alias("degree")).withColumn("_range", F.floor(F.col("id") / 65536))
    sums = degree.groupBy("_range").agg(F.sum("degree").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")  # a row for each 65536 points
    own = F.coalesce(F.sum("degree").over(Window.partitionBy("_range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return degree.withColumn("start", own).join(before, "_range").select("id", "degree", (F.col("start") + F.col("_before")).alias("start"))


def min_positive_nearest(knn: DataFrame) -> DataFrame:
    """(min_dist): the least positive distance of a first neighbour."""
    return knn.where("rank = 1 AND dist > 0").agg(F.min("dist").alias("min_dist"))


def weight_digits(knn: DataFrame) -> int:
    """Decimal digits that keep the least distance apart from 0."""
    least = min_positive_nearest(knn).first()["min_dist"]
    return 2 if least is None else int(-(-(-math.log10(least)) // 1)) + 2


def quantised_graph(edges: DataFrame, digits: int) -> DataFrame:
    return edges.withColumn("weight_q", quantised("weight", digits))
