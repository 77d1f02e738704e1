"""Scalar functions over vectors and weights, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What 1/weight becomes for weight 0.
INFINITE_LAMBDA = 2147483647.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def l2_sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance, in double."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_sq(a, b))


def norm_sq(v: Column | str) -> Column:
    return F.aggregate(F.transform(doubles(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_by_dot(a: Column | str, b: Column | str) -> Column:
    """Distance from norms and a dot product; loses digits for near vectors."""
    return F.sqrt(F.greatest(norm_sq(a) + norm_sq(b) - 2 * dot(a, b), F.lit(0.0)))


def lambda_of(weight: Column | str) -> Column:
    w = _col(weight)
    return F.when(w > 0, 1 / w).otherwise(INFINITE_LAMBDA)


def shard_of(vec_id: Column | str, n: int, shards: int) -> Column:
    """Equal ranges of ids 0..n-1, the last takes the rest."""
    return F.least(F.floor(_col(vec_id) / max(1, n // shards)), F.lit(shards - 1)).cast("int")


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards] * (shards - 1) + [n - n // shards * (shards - 1)]


def shards_for(n: int, least: int, most_rows: int) -> int:
    """``least`` shards while they hold the rows, else as many as needed."""
    return least if n < most_rows * least else -(-n // most_rows)


def shards_for_memory(n: int, gigabytes: float, step: int, bytes_each: int = 12, copies: int = 4) -> int:
    """The fewest shards, in steps, whose working set fits."""
    shards = step
    while copies * bytes_each * n / 1e9 / shards > gigabytes:
        shards += step
    return shards


def quantised(weight: Column | str, digits: int) -> Column:
    """A weight as a whole number of 10 ** -digits."""
    return F.floor(_col(weight) * F.pow(F.lit(10.0), F.lit(digits))).cast("long")


def dequantised(weight: Column | str, digits: int) -> Column:
    return _col(weight) / F.pow(F.lit(10.0), F.lit(digits))


def validated(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding); raises for null ids or vectors, repeated ids or differing lengths."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    r = v.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id").isNull() | F.col("embedding").isNull()).alias("nulls"), F.countDistinct("vec_id").alias("ids"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if r["nulls"] or r["ids"] != r["n"] or r["lo"] != r["hi"]:
        raise ValueError(f"vectors need distinct ids and one length: {r.asDict()}")
    return v


def register(spark: SparkSession) -> None:
    """SQL functions ``l2`` and ``l2_sq`` over double arrays."""
    body = "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_sq(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt({body})")
