"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

Documents with the same shingle set form a class at once. Classes meet in buckets of
equal MinHash bands; each is first paired with its bucket's hub only, so a group of n
copies costs n pairs. An odd sketch, the MinHash samples folded into a parity bitmap,
estimates a pair's similarity from the population count of the XOR of two bitmaps; pairs
that it doesn't rule out are confirmed on whole shingle sets. Buckets that still hold
more than one component are then searched for pairs across components, so no link
between components is left out for the sake of the hubs. Near copies that are only almost
similar enough meet there in numbers, so the documents left by then get finer sketches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegraph.llm import common
from densegraph.llm.common import HashCache, chosen, mix, multipliers, save, window_hashes

#: A pair at similarity 0.8 shares none of 36 bands of 5 samples with a chance of 6e-7.
BANDS, ROWS = 36, 5
SAMPLES = BANDS * ROWS
#: Longs of a sketch, and how far below the threshold an estimate may be before a pair is ruled out. A pair that a hub loses by it meets the last search.
SKETCH_LONGS, SLACK = 8, 0.12
SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]
#: The same of the sketches for the last search, where a pair that is ruled out is lost: 5 standard deviations of samples and parities together.
FINE_SAMPLES, FINE_LONGS, FINE_SLACK = 2048, 32, 0.07
FINE = [f"f{i}" for i in range(FINE_LONGS)]
#: Rows of a block of a band in the last search.
CELL_ROWS = 512


def shingle_set(text: str | None, width: int, cache: HashCache) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles, letters A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = cache.of(words)
    return np.unique(window_hashes(hashes, min(width, len(words)), 11 + min(width, len(words))))


def samples(shingles: np.ndarray, n: int = SAMPLES, block: int = 2048) -> np.ndarray:
    """MinHash samples: for each of ``n`` hash functions the least value over the set."""
    a, b = multipliers(n, 1), multipliers(n, 2)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    block = max(1, block * SAMPLES // n)
    for i in range(0, len(shingles), block):
        np.minimum(least, (a[:, None] * shingles[None, i : i + block] + b[:, None]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS) * multipliers(ROWS, 3)
    return mix(rows.sum(axis=1, dtype=np.uint64) + multipliers(BANDS, 4)).view(np.int64)


def odd_sketch(least: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """Each sample flips one bit of the bitmap."""
    at = (mix(least + multipliers(len(least), 5)) >> np.uint64(32)) % np.uint64(64 * longs)
    odd = np.bincount(at.astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_limit(similarity: float, n: int = SAMPLES, longs: int = SKETCH_LONGS) -> int:
    """The most differing bits of two sketches of ``n`` samples whose estimated similarity is at least ``similarity``."""
    size = 64 * longs
    return int(size / 2 * (1 - (1 - 2 / size) ** (2 * n * (1 - similarity))))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bands and sketch of every row of (doc_id, text)."""
    names = ["doc_id", "n_shingles", "digest", "bands", *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for b in batches:
            sizes, digests, lists, sketches = [], [], [], np.zeros((b.num_rows, SKETCH_LONGS), np.int64)
            for i, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                s = shingle_set(text.as_py(), width, cache)
                sizes.append(len(s))
                if len(s) and key is not None:
                    least = samples(s)
                    lists.append(bands(least))
                    sketches[i] = odd_sketch(least)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                else:  # linked with nothing: a class of its own
                    lists.append(np.empty(0, np.int64))
                    digests.append(xxhash.xxh3_128_digest(f"{key}:{i}".encode()))
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(values)), *(pa.array(np.ascontiguousarray(x)) for x in sketches.T)], names
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH))


def fine_sketches(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and its fine sketch, for the given nodes among the rows of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for b in batches:
            bits = np.zeros((b.num_rows, FINE_LONGS), np.int64)
            for i, text in enumerate(b.column(1)):
                if len(s := shingle_set(text.as_py(), width, cache)):
                    bits[i] = odd_sketch(samples(s, FINE_SAMPLES), FINE_LONGS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(x)) for x in bits.T)], ["node", *FINE])

    return chosen(docs, nodes).mapInArrow(run, "node long, " + ", ".join(f"{s} long" for s in FINE)).distinct()


def alike(a: str, b: str, similarity: float, sketch: list[str], limit: int) -> Column:
    """Whether sizes and sketches of two sides leave the pair possible."""
    bits = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in sketch))
    m, n = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(m, n) >= similarity * F.greatest(m, n)) & (bits <= limit)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (hub, node) whose whole shingle sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for b in batches:
            sets = [shingle_set(t.as_py(), width, cache).view(np.int64) for t in b.column(1)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], ["id", "shingles"])

    wanted = pairs.select("hub").union(pairs.select("node"))
    sets = save(chosen(docs, wanted).mapInArrow(run, "id long, shingles array<long>").distinct())
    own = pairs.join(sets.select(F.col("id").alias("node"), F.col("shingles").alias("y")).hint("merge"), "node")
    both = own.join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("x")).hint("merge"), "hub")  # a hub's set is read once, not sent with each pair
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("hub", "node")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node, the component named by its least node.

    Each round maps every node to its least neighbour and contracts the links, so the number
    of rounds grows with the logarithm of the longest path; nothing goes to the driver.
    """
    edges = save(links.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).where("a < b").distinct())
    names = save(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        new = names.join(least, names["component"] == least["a"], "left")
        names = save(new.select("node", F.coalesce("m", "component").alias("component")))
        first, second = least.select("a", F.col("m").alias("u")), least.select(F.col("a").alias("b"), F.col("m").alias("v"))
        moved = edges.join(first, "a").join(second, "b")
        edges = save(moved.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct())
    return names


def of_one_id(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (hub, node) between the classes of texts (doc_id, digest) that one id bears."""
    at = texts.distinct().join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    return at.join(at.groupBy("doc_id").agg(F.min("node").alias("hub")), "doc_id").where("hub < node").select("hub", "node").distinct()


def looked_up(rows: DataFrame, bands: DataFrame, how: str) -> DataFrame:
    """Rows joined to a table of one row a band, which is broadcast up to a bound, so that rows of a frequent band stay where they are."""
    bands = save(bands)
    return rows.join(F.broadcast(bands) if bands.count() <= common.BROADCAST_IDS else bands, "band", how)


def cell(a: Column, b: Column) -> Column:
    """The number of an unordered pair of blocks."""
    return F.greatest(a, b) * (F.greatest(a, b) + 1) / 2 + F.least(a, b)


def in_cells(rows: DataFrame) -> DataFrame:
    """The rows of each band in blocks of about CELL_ROWS, each row once for every block that its own is paired with: band, block, cell and the rest.

    Every pair of rows of a band meets in the one cell of their blocks, so a band that many rows share is work for many tasks.
    """
    sizes = rows.groupBy("band").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = looked_up(rows, sizes, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("cell", cell(F.col("block"), F.col("with"))).drop("blocks", "with")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every input row.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``width``-word
    shingles (letters A-Z in lower case; a shorter text is one shingle). ``component_id`` is
    the least id reachable over links; ``kept`` marks the document that bears it. Null or empty
    texts have no shingles and are linked with nothing. Rows with one id are one document: all of them get one
    component, and what one of them links is linked. Rows with a null id are linked with nothing, get a null
    component and are kept. An empty table gives no rows.
    """
    similarity = percent / 100
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = save(signatures(docs, width))
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "bands", *SKETCH)]
    classes = save(sig.where("size(bands) > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), *firsts))
    figures = classes.select("node", "n_shingles", *SKETCH)

    def candidates(stars: DataFrame) -> DataFrame:
        x = stars.distinct().join(figures.alias("p"), F.col("p.node") == stars["node"]).join(figures.alias("q"), F.col("q.node") == stars["hub"])
        return x.where(alike("p", "q", similarity, SKETCH, sketch_limit(similarity - SLACK))).select(stars["hub"], stars["node"])

    def still_open(rest: DataFrame, named: DataFrame) -> DataFrame:
        at = rest.join(named, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        several = at.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
        return save(looked_up(at, several, "left_semi"))

    # Each bucket's least node is its first hub. A bucket of one class or one component is settled for good.
    members = classes.select("node", F.explode("bands").alias("band"))
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("hi")).where("hub < hi").select("band", "hub")
    shared = save(members.join(hubs.hint("merge"), "band").select("band", "node", "hub"))
    near = save(chosen(docs, shared.select("node")))  # what follows reads these texts only
    pairs = save(candidates(shared.where("hub < node").select("hub", "node")))
    several = save(sig.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id"))
    repeated = not several.isEmpty()  # ids that bear several texts
    links = confirmed(pairs, near, width, percent)
    if repeated:
        links = links.unionByName(of_one_id(chosen(sig.select("doc_id", "digest"), several), classes))
    links = save(links)
    named = components(links)
    rest = still_open(shared.select("band", "node"), named)

    # Other hubs, of each bucket's own choice, for the buckets that still hold several components.
    for rank in (F.xxhash64("node", "band"), F.xxhash64("band", "node")):
        hubs = rest.groupBy("band").agg(F.max_by("node", rank).alias("hub"), F.max_by("component", rank).alias("of"))
        stars = looked_up(rest, hubs, "inner").where("component <> of").select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node"))
        new = save(candidates(stars).join(pairs, ["hub", "node"], "left_anti"))
        found = save(confirmed(new, near, width, percent))
        pairs, links = pairs.unionByName(new), links.unionByName(found)
        named = components(links)
        rest = still_open(rest.select("band", "node"), named)

    # Pairs across components that share a bucket: what the hubs may have missed. A pair is
    # made in the first of its shared buckets only, which is open too.
    before = F.slice("bands", F.lit(1), (F.array_position("bands", F.col("band")) - 1).cast("int"))
    fine = save(fine_sketches(near, rest.select("node"), width))
    rest = save(rest.join(classes.select("node", "n_shingles", "bands"), "node").withColumn("before", before).drop("bands").join(fine, "node"))
    possible = alike("p", "q", similarity, FINE, sketch_limit(similarity - FINE_SLACK, FINE_SAMPLES, FINE_LONGS))
    dealt = save(in_cells(rest))
    p, q = dealt.alias("p"), dealt.alias("q")
    met = (F.col("p.band") == F.col("q.band")) & (F.col("p.cell") == F.col("q.cell")) & (F.col("p.cell") == cell(F.col("p.block"), F.col("q.block")))
    across = p.join(q, met & (F.col("p.component") < F.col("q.component")) & possible & ~F.arrays_overlap("p.before", "q.before"))
    found = across.select(F.least("p.node", "q.node").alias("hub"), F.greatest("p.node", "q.node").alias("node")).distinct()
    more = save(found.join(pairs, ["hub", "node"], "left_anti"))
    if not more.isEmpty():
        named = components(links.unionByName(confirmed(more, near, width, percent)))

    of_class = classes.select("digest", "node").join(named, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    own = F.coalesce("component_id", "doc_id")
    if repeated:  # a text without shingles takes the component of the others of its id
        least = chosen(out, several).groupBy("doc_id").agg(F.min(own).alias("least"))
        out = out.join(least, "doc_id", "left")
        own = F.least(own, "least")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
