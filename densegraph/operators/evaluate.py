"""Recall of neighbour graphs and agreement of labellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall): the share of true neighbours that are listed, over the first k of each list."""
    a, b = found.where(F.col("rank") <= k).select("q", "nbr", F.lit(1).alias("hit")), truth.where(F.col("rank") <= k).select("q", "nbr")
    return b.join(a, ["q", "nbr"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))


def positional_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall): the share of places that hold the very neighbour of the true list."""
    a, b = found.select("q", "rank", F.col("nbr").alias("x")), truth.where(F.col("rank") <= k).select("q", "rank", "nbr")
    return b.join(a, ["q", "rank"], "left").agg(F.avg(F.when(F.col("x") == F.col("nbr"), 1.0).otherwise(0.0)).alias("recall"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(ari) of two label columns; 1 if both are trivial."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n").alias(name)) for c, name in ((a, "ra"), (b, "rb")))
    total = cells.agg(pairs("n").alias("both"), F.sum("n").alias("n"))
    t = total.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.col("ra") * F.col("rb") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("ra") + F.col("rb")) / 2
    return t.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def averaged(runs: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    """Mean run time by configuration."""
    return runs.groupBy(*by).agg(F.avg(seconds).alias("mean_seconds"), F.count("*").alias("runs"))
