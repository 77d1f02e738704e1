"""Substring deduplication with a log-structured index of window fingerprints.

A batch of documents is turned into sorted immutable runs: for each chunk of documents and
each range of hash values, the distinct 64-bit window hashes in order. Runs of one range, those
of the batch and those kept from earlier batches, are merged; equal hashes meet
there and every holder but the first is told the first one. Neighbouring windows that a document is told to share with one
holder make a claim, and a claim is verified: the holder's text is looked up and SHA-256 digests of all words of both
passages are compared. What fails as a passage is verified window by window. Windows of earlier batches, whose texts are no longer there,
carry an independent 64-bit check, 128 bits in all. Runs of earlier batches are compacted when they are many.

A chunk sends one entry for each distinct window, so a passage that a third of all
documents share costs one entry a chunk and no task gathers its holders; their claims on it are answered once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densegraph.llm.common import HashCache, chosen, save, window_hashes

#: Windows, and documents, after which a chunk is closed; windows of a range of the index from which it gets more ranges.
CHUNK_WINDOWS, CHUNK_DOCS, PART_WINDOWS = 4_000_000, 60_000, 8_000_000
#: Run rows: kind 0 a sorted run of the batch, 1 windows already known to be repeated, 2 a run of an earlier batch.
RUN = "part int, kind int, chunk long, hashes binary, holders binary, ids binary, owners binary, checks binary"
RUN_NAMES = [x.split()[0] for x in RUN.split(", ")]
FOUND = "chunk long, hashes binary, holders binary, ids binary, owners binary, checks binary"
#: What a document was told: hashes in order of owners, the distinct owners and how many hashes each has; checks of those of earlier batches.
TOLD = "doc_id long, hashes binary, owners binary, counts binary, checks binary"
#: The owner of windows of earlier batches; no document takes part that has it as its id.
EARLIER = np.iinfo(np.int64).min
CLAIM = "doc_id long, owner long, first long, length int, digest binary"


def packed(ordered: np.ndarray) -> bytes:
    """Sorted 64-bit values: the first, then differences of 5 to 7 bytes if they all fit, else of 8."""
    steps = np.diff(ordered)
    most = int(steps.max()) if len(steps) else 0
    n = next((k for k in (5, 6, 7) if most < 1 << 8 * k), 8)
    return bytes([n]) + ordered[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = data[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, n)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :n] = raw
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, offset=1), steps.view(np.uint64).ravel()]), dtype=np.uint64)


def dictionary(values: np.ndarray) -> bytes:
    """64-bit values as the distinct ones and the place of each among them."""
    distinct, at = np.unique(values, return_inverse=True)
    return np.int64(len(distinct)).tobytes() + distinct.astype(np.int64).tobytes() + at.astype(np.uint32).tobytes()


def undictionary(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.int64, n, offset=8)[np.frombuffer(data, np.uint32, offset=8 + 8 * n)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def windows(words: list[bytes], width: int, cache: HashCache) -> np.ndarray:
    """The hash of each window."""
    return window_hashes(cache.of(words), width, 21)


def checks_of(words: list[bytes], width: int, cache: HashCache) -> np.ndarray:
    return window_hashes(cache.of(words), width, 22)


def parts_for(docs: DataFrame) -> int:
    """Hash ranges: a power of two that grows with the input, so that a range's runs fit a task."""
    return 1 << max(5, (2 * docs.rdd.getNumPartitions() - 1).bit_length())


def edges_of(h: np.ndarray, parts: int, first: int = 0, n: int | None = None) -> np.ndarray:
    """Where sorted hashes of ``n`` of ``parts`` ranges from ``first`` on go over to the next range."""
    shift = np.uint64(64 - (parts.bit_length() - 1))
    return np.searchsorted(h, np.arange(first + 1, first + (parts if n is None else n), dtype=np.uint64) << shift)


def table_of(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def runs(docs: DataFrame, width: int, parts: int, *, checked: bool = False) -> DataFrame:
    """Sorted runs of (doc_id, text) rows, with checks if the index keeps them. Rows without an id take no part."""

    def close(chunk: int, ids: list[int], hashes: list[np.ndarray], checks: list[np.ndarray]) -> Iterator[dict]:
        h = np.concatenate(hashes)
        owners = np.array(ids, np.int64)
        holder = np.repeat(np.arange(len(ids), dtype=np.uint16), [len(x) for x in hashes])
        order = np.lexsort((owners[holder], h))
        h, holder = h[order], holder[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        first = owners[holder[fresh]][np.cumsum(fresh) - 1]  # the least id that holds the entry's window here
        later = owners[holder] > first
        table = np.diff(owners, prepend=0).tobytes()  # neighbours differ by little, which shuffle files compress
        c = np.concatenate(checks)[order][~later] if checked else None
        edges = edges_of(h[~later], parts)
        for p, (hs, os, cs) in enumerate(zip(np.split(h[~later], edges), np.split(holder[~later], edges), np.split(c, edges) if checked else [None] * parts, strict=True)):
            if len(hs):
                yield {"part": p, "kind": 0, "chunk": chunk, "hashes": packed(hs), "holders": os.tobytes(), "ids": table, "checks": cs.tobytes() if checked else None}
        if later.any():
            yield {"part": chunk % parts, "kind": 1, "chunk": chunk, "hashes": packed(h[later]), "holders": holder[later].tobytes(), "ids": table, "owners": dictionary(first[later])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        chunk, size = TaskContext.get().partitionId() << 24, 0
        ids, hashes, checks = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if size:
                for row in close(chunk, ids, hashes, checks):
                    yield pa.RecordBatch.from_pylist([row], RUN_SCHEMA)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                if key is None or key == EARLIER or len(words) < width:
                    continue
                h, at = np.unique(windows(words, width, cache), return_index=True)
                ids.append(key)
                hashes.append(h)
                if checked:
                    checks.append(checks_of(words, width, cache)[at])
                size += len(h)
                if size >= CHUNK_WINDOWS or len(ids) >= CHUNK_DOCS:
                    yield from flush()
                    chunk, size, ids, hashes, checks = chunk + 1, 0, [], [], []
        yield from flush()

    return docs.mapInArrow(run, RUN)


RUN_SCHEMA, FOUND_SCHEMA, TOLD_SCHEMA, CLAIM_SCHEMA = map(schema_of, (RUN, FOUND, TOLD, CLAIM))


def merge(table: pa.Table) -> pa.Table:
    """For each chunk of the batch, its entries whose window an earlier document or batch holds too, and the first holder."""
    every = table.to_pylist()
    out = [{k: r[k] for k in FOUND_SCHEMA.names} for r in every if r["kind"] == 1]
    past = [r for r in every if r["kind"] == 2]
    rows = [r for r in every if r["kind"] == 0]
    if rows:
        sides = [unpacked(r["hashes"]) for r in rows]
        owner = np.concatenate([np.cumsum(np.frombuffer(r["ids"], np.int64))[np.frombuffer(r["holders"], np.uint16)] for r in rows])
        source = np.repeat(np.arange(len(rows)), [len(x) for x in sides])
        h = np.concatenate(sides)
        entry = np.concatenate([np.arange(len(x)) for x in sides])  # each entry's place in its own run
        order = np.lexsort((owner, h))
        h, owner, source, entry = h[order], owner[order], source[order], entry[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        first = owner[fresh][np.cumsum(fresh) - 1]
        later, check = owner > first, np.zeros(len(h), np.uint64)
        for r in past:  # one run after the other, each in order
            old = unpacked(r["hashes"])
            at = np.minimum(np.searchsorted(old, h), len(old) - 1)
            met = (old[at] == h) & (first != EARLIER)
            check[met] = np.frombuffer(r["checks"], np.uint64)[at[met]]
            first, later = np.where(met, EARLIER, first), later | met
        for i in np.unique(source[later]):
            mine = later & (source == i) if len(rows) < 4 else np.flatnonzero(later)[source[later] == i]
            holders = np.frombuffer(rows[i]["holders"], np.uint16)[entry[mine]]
            out.append({"chunk": rows[i]["chunk"], "hashes": packed(h[mine]), "holders": holders.tobytes(), "ids": rows[i]["ids"], "owners": dictionary(first[mine]), "checks": check[mine].tobytes() if past else None})
    return table_of(out, FOUND_SCHEMA)


def by_document(table: pa.Table) -> pa.Table:
    """What one chunk was told, as a row for each document."""
    rows = table.to_pylist()
    ids = np.cumsum(np.frombuffer(rows[0]["ids"], np.int64))
    holders = np.concatenate([np.frombuffer(r["holders"], np.uint16) for r in rows])
    hashes, owners = np.concatenate([unpacked(r["hashes"]) for r in rows]), np.concatenate([undictionary(r["owners"]) for r in rows])
    checks = np.concatenate([np.frombuffer(r["checks"], np.uint64) if r["checks"] else np.zeros(len(r["holders"]) // 2, np.uint64) for r in rows])
    order = np.lexsort((hashes, owners, holders))
    holders, hashes, owners, checks = holders[order], hashes[order], owners[order], checks[order]
    own, at = np.unique(holders, return_index=True)
    out = []
    for key, h, o, c in zip(ids[own].tolist(), np.split(hashes, at[1:]), np.split(owners, at[1:]), np.split(checks, at[1:]), strict=True):
        distinct, counts = np.unique(o, return_counts=True)
        out.append({"doc_id": key, "hashes": h.tobytes(), "owners": distinct.tobytes(), "counts": counts.astype(np.int32).tobytes(), "checks": c.tobytes() if EARLIER in distinct else None})
    return table_of(out, TOLD_SCHEMA)


class Text:
    """A document's words with their window hashes."""

    def __init__(self, text: str | None, width: int, cache: HashCache):
        self.words, self.width = words_of(text), width
        self.h = windows(self.words, width, cache) if len(self.words) >= width else np.empty(0, np.uint64)
        self.cache = cache

    def owners(self, told: list[dict]) -> np.ndarray:
        """For each window the owner that the document was told, itself masked where there is none; windows of earlier batches must agree in their checks."""
        owner = np.ma.masked_all(len(self.h), np.int64)
        for t in told:
            h = np.frombuffer(t["hashes"], np.uint64)
            of = np.repeat(np.frombuffer(t["owners"], np.int64), np.frombuffer(t["counts"], np.int32))
            order = np.argsort(h, kind="stable")
            at = np.minimum(np.searchsorted(h[order], self.h), len(h) - 1)
            hit, of = h[order][at] == self.h, of[order][at]
            if t["checks"]:
                c = np.frombuffer(t["checks"], np.uint64)[order][at]
                hit &= (of != EARLIER) | (c == checks_of(self.words, self.width, self.cache))
            owner[hit] = of[hit]
        return owner

    def digest(self, at: int, length: int) -> bytes:
        """Of all words of ``length`` windows in a row."""
        return hashlib.sha256(b" ".join(self.words[at : at + length + self.width - 1])).digest()

    def claims(self, told: list[dict], single: bool) -> Iterator[tuple[int, int, int, bytes]]:
        """(owner, hash of the first window, windows, digest) of each stretch of windows with one owner, or of each window."""
        owner = self.owners(told)
        of, known = owner.filled(EARLIER), ~np.ma.getmaskarray(owner)
        known &= of != EARLIER
        if single:
            at = np.flatnonzero(known)
            at = at[np.unique(self.h[at], return_index=True)[1]]
            ends = at + 1
        else:
            new = known.copy()
            new[1:] &= ~known[:-1] | (of[1:] != of[:-1])
            last = known.copy()
            last[:-1] &= ~known[1:] | (of[1:] != of[:-1])
            at, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
        for i, j in zip(at.tolist(), ends.tolist(), strict=True):
            yield int(of[i]), int(self.h[i : i + 1].view(np.int64)[0]), j - i, self.digest(i, j - i)

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """The words outside of windows that are gone or start earlier in the same text."""
        if not len(self.h):
            return self.words
        gone = gone.copy()
        if len(self.h) > 1:
            _, first, inverse = np.unique(self.h, return_index=True, return_inverse=True)
            later = np.flatnonzero(first[inverse] != np.arange(len(self.h)))
            if len(later):  # compared word by word
                ids: dict[bytes, int] = {}
                x = np.lib.stride_tricks.sliding_window_view(np.array([ids.setdefault(w, len(ids)) for w in self.words]), self.width)
                gone[later[(x[later] == x[first[inverse[later]]]).all(1)]] = True
        if not gone.any():
            return self.words
        cover = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(gone), 1)
        np.add.at(cover, np.flatnonzero(gone) + self.width, -1)
        return [w for w, n in zip(self.words, np.cumsum(cover).tolist(), strict=False) if not n]


def claims(held: DataFrame, width: int, *, single: bool) -> DataFrame:
    """The claims of (doc_id, text, told) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for b in batches:
            for key, text, told in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("told"), strict=True):
                rows = [dict(zip(CLAIM_SCHEMA.names, (key, *c), strict=True)) for c in Text(text.as_py(), width, cache).claims(told.as_py(), single)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, CLAIM_SCHEMA)

    return held.mapInArrow(run, CLAIM)


def verified(made: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The claims with ``true``: whether the owner has the same words where it first has the first window."""
    wants = made.select("owner", "first", "length").distinct().groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list(F.struct("first", "length")).alias("wants"))
    wants = save(wants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for b in batches:
            for key, text, asked in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("wants"), strict=True):
                t, rows = Text(text.as_py(), width, cache), []
                h, place = np.unique(t.h, return_index=True)
                asked = asked.as_py()
                first = np.array([a["first"] for a in asked], np.int64).view(np.uint64)
                at = np.minimum(np.searchsorted(h, first), max(len(h) - 1, 0))
                for k, (a, i) in enumerate(zip(asked, at.tolist(), strict=True)):
                    if len(h) and h[i] == first[k] and place[i] + a["length"] <= len(t.h):
                        rows.append({"doc_id": None, "owner": key, **a, "digest": t.digest(int(place[i]), a["length"])})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, CLAIM_SCHEMA)

    asked = chosen(docs, wants.select("doc_id")).join(wants, "doc_id")
    answers = asked.mapInArrow(run, CLAIM).select("owner", "first", "length", "digest").distinct().withColumn("true", F.lit(True))
    both = made.join(answers, ["owner", "first", "length", "digest"], "left")  # claims on one passage may be many, its answers are few
    return both.select("doc_id", "owner", "first", "length", F.coalesce("true", F.lit(False)).alias("true"))


class FingerprintIndex:
    """Window fingerprints of the batches seen so far, as immutable sorted runs in a folder.

    ``folder`` None keeps nothing: the index serves one batch. Otherwise a manifest there tells the runs, so an index can be opened
    again, by another process too. ``most_runs`` is how many runs are read beside a batch before they are compacted into one; ranges are split
    when they hold more than PART_WINDOWS windows on average, so what a task reads of the history stays bounded.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, *, width: int = 20, parts: int = 64, most_runs: int = 8):
        self.spark, self.folder, self.width, self.parts, self.most_runs = spark, folder, width, parts, most_runs
        self.paths: list[str] = []
        self.sequence = self.windows = 0
        if folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest-*/_SUCCESS")
            found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
            if found:
                last = max(str(x.getPath().getParent()) for x in found)
                row = spark.read.parquet(last).first()
                if row["width"] != width:
                    raise ValueError(f"the index in {folder} has windows of {row['width']} words")
                self.paths, self.parts, self.sequence, self.windows = list(row["runs"]), row["parts"], row["sequence"], row["windows"]

    def history(self) -> DataFrame | None:
        return self.spark.read.schema(RUN).parquet(*self.paths) if self.paths else None

    def _write(self, source: DataFrame, parts: int) -> str:
        """Runs of the index's ranges merged into one run of ``parts`` ranges, as many or a multiple of them."""
        self.sequence += 1
        path, each = f"{self.folder}/run-{self.sequence:09d}", parts // self.parts

        def one(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            h = np.concatenate([unpacked(r["hashes"]) for r in rows])
            c = np.concatenate([np.frombuffer(r["checks"], np.uint64) for r in rows])
            h, at = np.unique(h, return_index=True)
            first = rows[0]["part"] * each
            edges = edges_of(h, parts, first, each)
            split = zip(np.split(h, edges), np.split(c[at], edges), strict=True)
            return table_of([{"part": first + k, "kind": 2, "chunk": -1, "hashes": packed(hs), "checks": cs.tobytes()} for k, (hs, cs) in enumerate(split) if len(hs)], RUN_SCHEMA)

        source.groupBy("part").applyInArrow(one, RUN).write.mode("overwrite").parquet(path)  # what a broken attempt left isn't in the manifest
        return path

    def _add(self, batch: DataFrame) -> None:
        paths = [*self.paths, self._write(batch, self.parts)]
        self.paths = paths
        size = F.length("checks") / 8
        self.windows += int(self.spark.read.schema(RUN).parquet(paths[-1]).agg(F.coalesce(F.sum(size), F.lit(0.0))).first()[0])
        if len(paths) > self.most_runs:
            parts = self.parts
            while self.windows > PART_WINDOWS * parts:
                parts *= 2
            self.paths, self.parts = [self._write(self.history(), parts)], parts
            self.windows = int(self.history().agg(F.coalesce(F.sum(size), F.lit(0.0))).first()[0])
        row = [(self.paths, self.parts, self.sequence, self.windows, self.width)]
        self.spark.createDataFrame(row, "runs array<string>, parts int, sequence long, windows long, width int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest-{self.sequence:09d}")

    def told(self, docs: DataFrame) -> DataFrame:
        """(doc_id, told): for documents with windows held earlier, those windows and their first holders; then the batch joins the index."""
        batch = runs(docs, self.width, self.parts, checked=bool(self.folder))
        if self.folder:
            batch = save(batch)
        past = self.history()
        found = (batch.unionByName(past) if past is not None else batch).groupBy("part").applyInArrow(merge, FOUND)
        out = save(found.groupBy("chunk").applyInArrow(by_document, TOLD).groupBy("doc_id").agg(F.collect_list(F.struct("hashes", "owners", "counts", "checks")).alias("told")))
        if self.folder:
            self._add(batch.where("kind = 0"))
        return out


def substring_dedup(docs: DataFrame, *, width: int = 20, index: FingerprintIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every input row.

    A word goes if a window of ``width`` words covers it that also starts earlier: in a document
    with a smaller id, in the same text at an earlier word, or in an earlier batch of the
    index. Windows are judged on the input. Null or empty texts have no words. Rows with one id do
    not shadow each other; rows with a null id lose only what repeats within them. An empty table
    gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = index or FingerprintIndex(docs.sparkSession, width=width, parts=parts_for(docs))
    told = index.told(docs)
    held = save(chosen(docs, told.select("doc_id")).join(told, "doc_id"))
    first = save(verified(save(claims(held, width, single=False)), docs, width))
    doubted = save(first.where(~F.col("true")).select("doc_id").distinct())
    again = chosen(held, doubted)
    alone = verified(save(claims(again, width, single=True)), docs, width).where("true").groupBy("doc_id").agg(F.collect_list("first").alias("sure"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for b in batches:
            counts, removed, texts = [], [], []
            for text, told, doubted, sure in zip(b.column("text"), b.column("told"), b.column("doubted").to_pylist(), b.column("sure"), strict=True):
                t = Text(text.as_py(), width, cache)
                owner = t.owners(told.as_py() or [])
                gone = ~np.ma.getmaskarray(owner)
                if doubted:  # only what was verified window by window, and windows of earlier batches
                    gone &= (owner.filled(0) == EARLIER) | np.isin(t.h, np.array(sure.as_py() or [], np.int64).view(np.uint64))
                kept = t.kept(gone)
                counts.append(len(t.words))
                removed.append(len(t.words) - len(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    told_type, no = held.schema["told"].dataType, F.lit(False).alias("doubted")
    free = chosen(docs, told.select("doc_id"), "left_anti").select("doc_id", "text", none(told_type, "told"), no, none("array<long>", "sure"))
    clear = chosen(held, doubted, "left_anti").select("doc_id", "text", "told", no, none("array<long>", "sure"))
    unsure = again.join(alone, "doc_id", "left").select("doc_id", "text", "told", F.lit(True).alias("doubted"), "sure")
    return free.unionByName(clear).unionByName(unsure).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
