"""Single linkage, condensed tree, stability, selection and flat labels.

What is sequential over N - 1 rows runs in one task; what is one row a cluster runs on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegraph.functions.vectors import INFINITE_LAMBDA

LINKAGE = "node long, left long, right long, weight double, size long"
CONDENSED = "parent long, child long, lambda double, child_size long"


def _linkage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    e = pd.concat(parts).sort_values(["weight", "src", "dst"], kind="stable")
    n = len(e) + 1
    group, size = list(range(2 * n - 1)), [1] * (2 * n - 1)

    def top(x: int) -> int:
        end = x
        while group[end] != end:
            end = group[end]
        while group[x] != end:
            group[x], x = end, group[x]
        return end

    rows = []
    for i, (a, b, w) in enumerate(zip(e["src"].tolist(), e["dst"].tolist(), e["weight"].tolist(), strict=True)):
        a, b, new = top(a), top(b), n + i
        group[a] = group[b] = new
        size[new] = size[a] + size[b]
        rows.append((new, a, b, w, size[new]))
    yield pd.DataFrame(rows, columns=["node", "left", "right", "weight", "size"])


def single_linkage(tree: DataFrame) -> DataFrame:
    """(node, left, right, weight, size): node N + i joins the groups of the i-th edge of a spanning tree over ids 0..N-1."""
    return tree.select("src", "dst", "weight").coalesce(1).mapInPandas(_linkage, LINKAGE)


def condensed_tree(linkage: DataFrame, min_cluster_size: int) -> DataFrame:
    """(parent, child, lambda, child_size) of the tree without splits that only shed fewer than ``min_cluster_size`` points."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        t = pd.concat(parts).sort_values("node")
        n = len(t) + 1
        left, right, weight, size = (t[c].tolist() for c in ("left", "right", "weight", "size"))
        count = lambda x: 1 if x < n else size[x - n]
        rows: list[tuple] = []
        level, fresh = [(2 * n - 2, n)], n + 1

        def shed(x: int, label: int, lam: float) -> None:
            stack = [x]
            while stack:
                y = stack.pop()
                if y < n:
                    rows.append((label, y, lam, 1))
                else:
                    stack += [right[y - n], left[y - n]]

        while level:  # breadth first: clusters are numbered level by level
            below = []
            for x, label in level:
                if x < n:
                    continue
                kids, w = (left[x - n], right[x - n]), weight[x - n]
                lam = 1 / w if w > 0 else INFINITE_LAMBDA
                large = [count(y) >= min_cluster_size for y in kids]
                for y, big in zip(kids, large, strict=True):
                    if not big:
                        shed(y, label, lam)
                    elif all(large):
                        rows.append((label, fresh, lam, count(y)))
                        below.append((y, fresh))
                        fresh += 1
                    else:
                        below.append((y, label))
            level = below
        yield pd.DataFrame(rows, columns=["parent", "child", "lambda", "child_size"])

    return linkage.coalesce(1).mapInPandas(run, CONDENSED)


def stability(condensed: DataFrame) -> DataFrame:
    """(cluster, stability): the sum over a cluster's rows of (lambda - lambda of its birth) * size; the root is born at 0."""
    born = condensed.groupBy(F.col("child").alias("parent")).agg(F.min("lambda").alias("birth"))
    each = condensed.join(born, "parent", "left").withColumn("birth", F.coalesce("birth", F.lit(0.0)))
    return each.groupBy(F.col("parent").alias("cluster")).agg(F.sum((F.col("lambda") - F.col("birth")) * F.col("child_size")).alias("stability"))


def tree_extrema(condensed: DataFrame) -> DataFrame:
    return condensed.agg(F.max("child").alias("max_child"), F.max("parent").alias("max_parent"), F.min("parent").alias("min_parent"), F.max("lambda").alias("max_lambda"))


def selected(condensed: DataFrame, stabilities: DataFrame, *, most_size: int | None = None) -> list[int]:
    """Clusters by excess of mass, ascending; the root is never one. Works on one row a cluster."""
    own = {r["cluster"]: r["stability"] for r in stabilities.collect()}
    edges = [(r["parent"], r["child"], r["child_size"]) for r in condensed.where("child_size > 1").collect()]
    kids: dict[int, list[int]] = {}
    size = {}
    for p, c, s in edges:
        kids.setdefault(p, []).append(c)
        size[c] = s
    root = min(own, default=None)
    best, chosen = dict(own), {c: True for c in own if c != root}
    for c in sorted(chosen, reverse=True):
        below = sum(best.get(k, 0.0) for k in kids.get(c, []))
        if below > own[c] or most_size is not None and size.get(c, 0) > most_size:
            chosen[c], best[c] = False, below
        else:
            stack = [*kids.get(c, [])]
            while stack:
                k = stack.pop()
                chosen[k] = False
                stack += kids.get(k, [])
    return sorted(c for c, yes in chosen.items() if yes)


def flat_labels(condensed: DataFrame, clusters: list[int], *, strict: bool = True) -> DataFrame:
    """(id, label): labels 0.. by ascending cluster, -1 for noise.

    ``strict``: a point of a selected cluster must leave it at a greater lambda than the one at which the
    cluster was born.
    """
    spark = condensed.sparkSession
    up = {r["child"]: (r["parent"], r["lambda"]) for r in condensed.where("child_size > 1").collect()}
    number = {c: i for i, c in enumerate(clusters)}
    rows = []
    for c in {*up, *(p for p, _ in up.values())} | set(clusters):
        x = c
        while x not in number and x in up:
            x = up[x][0]
        if x in number:
            rows.append((c, number[x], up[x][1] if x in up else 0.0))
    names = spark.createDataFrame(rows, "parent long, label int, birth double")  # one row a cluster
    keep = F.col("lambda") > F.col("birth") if strict else F.lit(True)
    points = condensed.where("child_size = 1").join(F.broadcast(names), "parent", "left")
    return points.select(F.col("child").alias("id"), F.when(F.col("label").isNotNull() & keep, F.col("label")).otherwise(-1).alias("label"))
