"""Readers and writers of vector and graph files, and a generator of clustered vectors.

read_fvecs(), read_ivecs(), read_kgraph() and read_distances() read any path that Spark can; each file is loaded whole by one task, so it must fit
there (2 GB at most). Files on a file system that is mounted on all machines under one path have the ``*_slice`` readers and the
writers instead: every task reads or writes its own row ranges at their places in the file, whatever the file's size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) of a text file with a header ``N dim`` and a line of numbers for each vector; ids follow the lines of one file."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("x"))
    rows = lines.select(F.posexplode(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0)))))
    numbers = F.split(F.btrim("col", F.lit(" \t\r")), r"[ \t\r]+")
    return rows.where(F.btrim("col", F.lit(" \t\r")) != "").select(F.col("pos").cast("long").alias("vec_id"), numbers.cast("array<float>").alias("embedding"))


def write_text_vectors(vectors: DataFrame, path: str) -> None:
    """One file in the format of read_text_vectors, in order of ids."""
    n, dim = vectors.count(), vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    head = vectors.sparkSession.createDataFrame([(-1, f"{n} {dim}")], "vec_id long, value string")
    body = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.concat_ws("\t", F.col("embedding").cast("array<string>")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("vec_id").select("value").write.mode("overwrite").text(path)


def _binary(spark: SparkSession, path: str, item: np.dtype, schema: str, make) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                k = int(np.frombuffer(content, np.int32, 1)[0]) if len(content) >= 4 else 0
                row = np.dtype([("k", np.int32), ("x", item, (k,))])
                rows = np.frombuffer(content, row, len(content) // row.itemsize) if k else np.empty(0, row)
                for lo in range(0, len(rows), 8192):
                    yield make(lo, rows[lo : lo + 8192])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) of a file of rows ``int32 dim, float32[dim]``."""
    return _binary(spark, path, np.dtype(np.float32), "vec_id long, embedding array<float>", lambda lo, r: pd.DataFrame({"vec_id": np.arange(lo, lo + len(r)), "embedding": list(r["x"])}))


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, ids) of a file of rows ``int32 k, int32[k]``."""
    return _binary(spark, path, np.dtype(np.int32), "vec_id long, ids array<int>", lambda lo, r: pd.DataFrame({"vec_id": np.arange(lo, lo + len(r)), "ids": list(r["x"])}))


def read_kgraph(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(q, nbr, dist, rank) of a file of rows ``int32 k, k x (float32 dist, int32 id)``; ``n`` cuts rows allotted beyond the points."""

    def make(lo: int, r: np.ndarray) -> pd.DataFrame:
        k = r["x"].shape[1]
        q = np.repeat(np.arange(lo, lo + len(r)), k)
        return pd.DataFrame({"q": q, "nbr": r["x"]["nbr"].ravel().astype(np.int64), "dist": r["x"]["dist"].ravel().astype(np.float64), "rank": np.tile(np.arange(1, k + 1, dtype=np.int32), len(r))})

    out = _binary(spark, path, np.dtype([("dist", np.float32), ("nbr", np.int32)]), "q long, nbr long, dist double, rank int", make)
    return out if n is None else out.where(F.col("q") < n)


def fvecs_bytes(vectors: np.ndarray) -> bytes:
    """Rows of numbers as .fvecs (float32) or .ivecs (int32) bytes."""
    x = np.asarray(vectors)
    x = x.astype(np.int32 if x.dtype.kind in "iu" else np.float32)
    rows = np.zeros(len(x), np.dtype([("k", np.int32), ("x", x.dtype, (x.shape[1],))]))
    rows["k"], rows["x"] = x.shape[1], x
    return rows.tobytes()


def kgraph_bytes(dist: np.ndarray, nbr: np.ndarray) -> bytes:
    rows = np.zeros(len(dist), np.dtype([("k", np.int32), ("x", [("dist", np.float32), ("nbr", np.int32)], (dist.shape[1],))]))
    rows["k"], rows["x"]["dist"], rows["x"]["nbr"] = dist.shape[1], dist, nbr
    return rows.tobytes()


def distances_bytes(dist: np.ndarray) -> bytes:
    return np.int64(len(dist)).tobytes() + np.asarray(dist, np.float32).tobytes()


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """(place, dist) of a file ``int64 n, float32[n]``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                d = np.frombuffer(content, np.float32, int(np.frombuffer(content, np.int64, 1)[0]), offset=8)
                yield pd.DataFrame({"place": np.arange(len(d)), "dist": d.astype(np.float64)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "place long, dist double")


#: Rows that a task reads or writes at once.
BLOCK_ROWS = 65536


def _row(kind: str, k: int) -> np.dtype:
    item = {"fvecs": np.dtype(np.float32), "ivecs": np.dtype(np.int32), "kgraph": np.dtype([("dist", np.float32), ("nbr", np.int32)])}[kind]
    return np.dtype([("k", np.int32), ("x", item, (k,))])


def rows_in(path: str, kind: str) -> tuple[int, int]:
    """Rows and row length of a mounted fvecs, ivecs or kgraph file, from its size and first number; none if it is empty."""
    with open(path, "rb") as f:
        head = f.read(4)
    if len(head) < 4:
        return 0, 0
    k = int(np.frombuffer(head, np.int32)[0])
    return os.path.getsize(path) // _row(kind, k).itemsize, k


def _slice(spark: SparkSession, path: str, kind: str, begin: int, end: int | None, schema: str, make) -> DataFrame:
    n, k = rows_in(path, kind)
    end, row = n if end is None else min(n, end), _row(kind, k)
    blocks = max(0, -(-(end - begin) // BLOCK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                for i in b.column(0).to_pylist():
                    lo = begin + i * BLOCK_ROWS
                    size = min(BLOCK_ROWS, end - lo)
                    yield make(lo, np.frombuffer(os.pread(f.fileno(), size * row.itemsize, lo * row.itemsize), row))

    return spark.range(0, blocks, 1, max(1, min(blocks, 4096))).mapInArrow(run, schema)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def read_fvecs_slice(spark: SparkSession, path: str, begin: int = 0, end: int | None = None) -> DataFrame:
    """(vec_id, embedding) of the rows from ``begin`` to before ``end`` of a mounted file; ids are places in the file."""
    return _slice(spark, path, "fvecs", begin, end, "vec_id long, embedding array<float>", lambda lo, r: pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(r))), _lists(r["x"])], ["vec_id", "embedding"]))


def read_kgraph_slice(spark: SparkSession, path: str, begin: int = 0, end: int | None = None) -> DataFrame:
    """(q, nbr, dist, rank) of the lists from ``begin`` to before ``end`` of a mounted file."""

    def make(lo: int, r: np.ndarray) -> pa.RecordBatch:
        k = r["x"].shape[1]
        columns = [np.repeat(np.arange(lo, lo + len(r)), k), r["x"]["nbr"].ravel().astype(np.int64), r["x"]["dist"].ravel().astype(np.float64), np.tile(np.arange(1, k + 1, dtype=np.int32), len(r))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "nbr", "dist", "rank"])

    return _slice(spark, path, "kgraph", begin, end, "q long, nbr long, dist double, rank int", make)


def _write(rows: DataFrame, path: str, item: np.dtype, lists: list[str], place: str, first: int) -> int:
    """Rows of lists written at their places, ``place`` + ``first`` rows from the beginning; the number of rows written."""
    k = rows.agg(F.max(F.size(lists[0])), F.min(F.size(lists[0]))).first()
    if k[0] is None:
        return 0
    if k[0] != k[1]:
        raise ValueError(f"rows of {k[1]} to {k[0]} entries have no common length")
    row = np.dtype([("k", np.int32), ("x", item, (k[0],))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fd = os.open(path, os.O_CREAT | os.O_WRONLY, 0o644)
        n = 0
        for b in batches:
            out = np.zeros(b.num_rows, row)
            out["k"] = k[0]
            values = [b.column(1 + j).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for j in range(len(lists))]
            for name, v in zip(item.names or [None], values, strict=True):
                (out["x"][name] if name else out["x"])[...] = v
            at = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(at) != 1) + 1
            for ids, part in zip(np.split(at, cuts), np.split(out, cuts), strict=True):
                if len(ids):
                    os.pwrite(fd, part.tobytes(), (first + int(ids[0])) * row.itemsize)
            n += b.num_rows
        os.close(fd)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    ordered = rows.select(F.col(place).cast("long"), *lists).repartitionByRange(F.col(place)).sortWithinPartitions(place)
    return ordered.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]  # what a task that is run again writes is the same


def write_fvecs(vectors: DataFrame, path: str, *, first: int = 0) -> int:
    """Vectors as rows of a mounted fvecs file, that of id 0 at row ``first``; what else the file holds stays."""
    return _write(vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), path, np.dtype(np.float32), ["embedding"], "vec_id", first)


def write_kgraph(knn: DataFrame, path: str, *, first: int = 0) -> int:
    """A graph's lists, all of one length, as rows of a mounted kgraph file."""
    lists = knn.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("dist").cast("float").alias("dist"), F.col("nbr").cast("int").alias("nbr")))).alias("x"))
    return _write(lists.select("q", F.col("x.dist").alias("dist"), F.col("x.nbr").alias("nbr")), path, np.dtype([("dist", np.float32), ("nbr", np.int32)]), ["dist", "nbr"], "q", first)


def write_mutual(knn: DataFrame, flags: DataFrame, path: str) -> int:
    """Flags (q, nbr, mutual) in the order of the lists as rows of a mounted ivecs file."""
    lists = knn.join(flags, ["q", "nbr"]).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("mutual").cast("int").alias("mutual")))).alias("x"))
    return _write(lists.select("q", F.col("x.mutual").alias("mutual")), path, np.dtype(np.int32), ["mutual"], "q", 0)


def prepare(spark: SparkSession, text_path: str, path: str) -> int:
    """A text file of vectors as a mounted fvecs file."""
    return write_fvecs(read_text_vectors(spark, text_path), path)


def graph_text(knn: DataFrame) -> DataFrame:
    """(q, line): each list as ``k, then distance and id of each neighbour``, tab-separated, distances to 6 decimals."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "dist", "nbr"))), lambda x: F.concat_ws("\t", F.format_string("%.6f", x["dist"]), x["nbr"].cast("string")))
    return knn.groupBy("q").agg(F.concat_ws("\t", F.count("*").cast("string"), F.concat_ws("\t", items)).alias("line"))


def without_marks(lines: DataFrame) -> DataFrame:
    """Graph lines without their second and last field."""
    x = F.split("line", "\t")
    return lines.withColumn("line", F.concat_ws("\t", F.concat(F.slice(x, 1, 1), F.slice(x, F.lit(3), F.greatest(F.size(x) - 3, F.lit(0))))))


def write_labels(labels: DataFrame, path: str) -> None:
    """One label a line, in order of ids."""
    labels.coalesce(1).sortWithinPartitions("id").select(F.col("label").cast("string")).write.mode("overwrite").text(path)


def generated(spark: SparkSession, n: int, dim: int = 12, seed: int = 0) -> DataFrame:
    """(vec_id, embedding, truth): half the rows in two noisy blocks of coordinates, half in five Gaussian blobs of deviation 0.6."""
    r = spark.range(n).withColumn("truth", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)).cast("int"))
    r = r.withColumn("truth", F.when(F.col("id") < n // 2, F.col("truth")).otherwise(2 + F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(5)).cast("int")))
    rng = np.random.default_rng(seed)
    centres = [*(np.where((np.arange(dim) < dim // 2) == bool(c), rng.uniform(-12, 10, dim), rng.uniform(-12, 10)) for c in (0, 1)), *rng.uniform(-10, 10, (5, dim))]
    table = F.array(*(F.array(*map(F.lit, map(float, c))) for c in centres))
    noise = F.when(F.col("truth") < 2, 0.4).otherwise(0.6)
    values = [F.get(F.get(table, F.col("truth")), F.lit(j)) + noise * F.randn(seed * 1000 + j) for j in range(dim)]
    return r.select(F.col("id").alias("vec_id"), F.array(*values).cast("array<float>").alias("embedding"), "truth")
