"""Quality by co-training of a text-content and a page-metadata classifier.

The text view sees a document's words, hashed, and cells of figures of its style; the metadata view sees source, language
and length. Each has a weight for each slot, the smoothed log-odds of the label given the slot, from counts of
documents. Over rounds each view scores all unlabelled documents, and the other one counts those that it is sure of as labelled. Counts
are sums over all documents, so nothing is sampled there. Each view is calibrated on labelled rows
that neither learned from, and the log-odds of both views, less the base rate that both contain,
are added up to score all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegraph.llm.common import chosen, let, save, words_of
from densegraph.llm.quality_rules import statistics
from densegraph.llm.toxicity import held_out, known_labels, logistic

#: Slots: buckets of words; figures of style and levels of each; one-hot buckets of source, language, decimal logarithm of the length in halves.
WORDS = 1 << 14
FIGURES, LEVELS = 12, 24
SOURCES, LANGS, LENGTHS = 64, 16, 12
SIZES = {"words": WORDS, "cells": FIGURES * LEVELS, "meta": SOURCES + LANGS + LENGTHS}
#: The views and their slots, and how many documents the smoothing of a slot is worth.
VIEWS = (("words", "cells"), ("meta",))
SMOOTHING = 3.0


def text_features(docs: DataFrame) -> DataFrame:
    """The input with ``words``, the buckets of its distinct words in lower case, and ``cells``, the levels of figures of its style."""
    n = F.greatest(F.col("_dg_w.n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("_dg_w.word_chars"), F.lit(1)).cast("double")
    cap = lambda x: F.least(x, F.lit(1.0))
    figures = (
        F.array(
            cap(F.log1p(n) / 10), cap(F.col("_dg_c.n_symbols") / n), cap(F.col("_dg_c.n_symbols") / n * 10), cap(F.col("_dg_c.upper") / chars), cap(F.col("_dg_c.marks") / n), cap(F.col("_dg_c.stops") / n * 2),
            cap(F.col("_dg_w.n_repeat_words") / n), cap(F.col("_dg_l.n_dup_lines") / F.greatest(F.col("_dg_l.lines"), F.lit(1))), cap(F.col("_dg_w.function_words") / 10.0), (F.col("_dg_w.function_words") >= 2).cast("double"),
            cap(chars / n / 20), (n < 20).cast("double"),
        )
    )
    level = lambda v, j: (j * LEVELS + F.ceil(F.greatest(v, F.lit(0.0)) * (LEVELS - 1))).cast("int")
    buckets = let(words_of(F.lower(F.col("text"))), lambda w: F.array_distinct(F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(WORDS)).cast("int"))))
    return docs.withColumns({"words": buckets, "cells": F.transform(figures, level)})


def meta_slots(docs: DataFrame) -> DataFrame:
    """The input with ``meta``: the one-hot places of source, language and length."""
    bucket = lambda c, k: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(k)).cast("int")
    size = F.least(F.floor(2 * F.log10(1 + F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)).cast("double"))), F.lit(LENGTHS - 1)).cast("int")
    return docs.withColumn("meta", F.array(bucket("source", SOURCES), SOURCES + bucket("lang", LANGS), SOURCES + LANGS + size))


Slots = dict[str, tuple[np.ndarray, np.ndarray]]  # by kind: slots of all rows one after the other, and of which row each is


def slots_of(b: pa.RecordBatch) -> Slots:
    out = {}
    for kind in SIZES:
        x = b.column(b.schema.get_field_index(kind))
        out[kind] = x.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(b.num_rows), x.value_lengths().to_numpy(zero_copy_only=False))
    return out


def weights(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """From documents of label 0 and 1 with each slot, and in all."""
    share = (totals[1] + 0.5) / (totals.sum() + 1)
    return np.log((counts[:, 1] + SMOOTHING * share) / (counts[:, 0] + SMOOTHING * (1 - share))) - np.log(share / (1 - share))


@dataclass
class View:
    """Weights by kind of slot; slope of the mean over each kind's slots of a row; bias."""

    weights: dict[str, np.ndarray]
    slopes: np.ndarray
    bias: float

    def means(self, slots: Slots, n: int) -> np.ndarray:
        out = []
        for kind, w in self.weights.items():
            slot, row = slots[kind]
            out.append(np.bincount(row, w[slot], n) / np.maximum(np.bincount(row, minlength=n), 1))
        return np.stack(out, 1)

    def odds(self, slots: Slots, n: int) -> np.ndarray:
        return self.means(slots, n) @ self.slopes + self.bias


class Counts:
    """Documents of each label with each slot, by kind, and documents of each label for each view."""

    def __init__(self):
        self.by = {k: np.zeros((n, 2)) for k, n in SIZES.items()}
        self.totals = [np.zeros(2) for _ in VIEWS]

    def add(self, view: int, slots: Slots, label: np.ndarray) -> None:
        """Rows with labels 0 and 1; others have -1."""
        self.totals[view] += [(label == 0).sum(), (label == 1).sum()]
        for kind in VIEWS[view]:
            slot, row = slots[kind]
            for v in (0, 1):
                self.by[kind][:, v] += np.bincount(slot[label[row] == v], minlength=SIZES[kind])

    def plus(self, other: Counts) -> Counts:
        out = Counts()
        out.by = {k: x + other.by[k] for k, x in self.by.items()}
        out.totals = [x + y for x, y in zip(self.totals, other.totals, strict=True)]
        return out


def fit_linear(x: np.ndarray, y: np.ndarray, base: float, steps: int = 800, hold: float = 1e-3) -> tuple[np.ndarray, float]:
    """Slopes and bias by logistic regression in Nesterov steps. With one label or no rows it says the base rate."""
    start = float(np.log(base / (1 - base)))
    w, b = np.zeros(x.shape[1]), start
    if not len(y) or y.min() == y.max():
        return w, b
    v, u = w.copy(), b
    step = 4 / (1 + float((x * x).sum(1).max()))
    for k in range(steps):
        e = logistic(x @ v + u) - y
        w2, b2 = v - step * (x.T @ e / len(y) + hold * v), u - step * float(e.mean())
        m = k / (k + 3)
        v, u = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, b


def calibrated(counts: Counts, spare: Slots, y: np.ndarray, base: float) -> list[View]:
    """Both views from their counts, with slopes and biases from rows that the counts don't contain."""
    out = []
    for kinds, totals in zip(VIEWS, counts.totals, strict=True):
        view = View({k: weights(counts.by[k], totals) for k in kinds}, np.ones(len(kinds)), 0.0)
        x = view.means(spare, len(y))
        scale, mean = np.maximum(x.std(0), 1e-6) if len(y) else np.ones(len(kinds)), x.mean(0) if len(y) else np.zeros(len(kinds))
        slopes, bias = fit_linear((x - mean) / scale, y, base)
        out.append(View(view.weights, slopes / scale, float(bias - (slopes / scale) @ mean)))
    return out


def sure_of(odds: np.ndarray, base: float, least: float) -> np.ndarray:
    """1 or 0 where the chance of that label is at least ``least`` and leaves at most a fourth of the base rate's doubt, else -1."""
    p = logistic(odds)
    label = np.full(len(p), -1)
    label[p >= max(least, 1 - (1 - base) / 4)] = 1
    label[1 - p >= max(least, 1 - base / 4)] = 0
    return label


def exchanged(pool: DataFrame, views: list[View], base: float, least: float) -> Counts:
    """What each view learns from the other one's sure labels over all rows of the pool; at most two sums for each slot come back."""
    shared = pool.sparkSession.sparkContext.broadcast((views, base))  # a weight for each slot, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, base = shared.value
        counts = Counts()
        for b in batches:
            slots = slots_of(b)
            for me, other in ((0, 1), (1, 0)):
                counts.add(other, slots, sure_of(views[me].odds(slots, b.num_rows), base, least))
        rows = [(k, i, v, x[i, v]) for k, x in counts.by.items() for i, v in np.argwhere(x).tolist()] + [("totals", i, v, t[v]) for i, t in enumerate(counts.totals) for v in (0, 1)]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "slot", "label", "n"), r, strict=True)) for r in rows], pa.schema([("kind", pa.string()), ("slot", pa.int32()), ("label", pa.int32()), ("n", pa.float64())]))

    out = Counts()
    for r in pool.select(*SIZES).mapInArrow(run, "kind string, slot int, label int, n double").groupBy("kind", "slot", "label").agg(F.sum("n").alias("n")).collect():
        if r["kind"] == "totals":
            out.totals[r["slot"]][r["label"]] = r["n"]
        else:
            out.by[r["kind"]][r["slot"], r["label"]] = r["n"]
    return out


def co_train(labelled: pa.Table, pool: DataFrame, *, rounds: int = 3, least: float = 0.9) -> tuple[list[View], float]:
    """Both views and the base rate, from labelled rows (slots and ``label``), of which a fourth calibrates, and all unlabelled ones."""
    y = labelled["label"].to_numpy().astype(float)
    base = float((y.sum() + 0.5) / (len(y) + 1))
    spare = np.arange(len(y)) % 4 == 3
    part = lambda keep: slots_of(pa.RecordBatch.from_pylist(labelled.filter(pa.array(keep)).to_pylist(), labelled.schema))
    own = Counts()
    for view in (0, 1):
        own.add(view, part(~spare), y[~spare])
    held, counts = part(spare), own
    for _ in range(rounds if len(y) and y.min() != y.max() else 0):
        counts = own.plus(exchanged(pool, calibrated(counts, held, y[spare], base), base, least))
    return calibrated(counts, held, y[spare], base), base


def quality(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 8000, rounds: int = 3, least_score: float = 0.5) -> DataFrame:
    """``doc_id, held_out, text_score, meta_score, score, kept`` for every input row; scores are chances of quality 1.

    Documents have ``doc_id, text`` and the metadata ``lang, source, n_chars``. At most ``most_labelled`` labelled
    ids are fitted on (those with the least hash of the id; of an id's rows one), and all unlabelled rows; every row is scored on its whole
    text. Null or empty texts have no words; null
    metadata count as empty; rows without an id are scored but not learned from; repeated rows score alike; an
    empty table gives no rows; with no labels of both kinds all rows score the base rate. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source", "n_chars")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    features = save(meta_slots(text_features(statistics(docs))).select("doc_id", *SIZES))
    known = known_labels(labels, "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    one = features.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", *SIZES)).alias("x"))  # at most most_labelled ids
    lists = {k: pa.list_(pa.int32()) for k in SIZES}
    labelled = pa.Table.from_pylist([r["x"].asDict() for r in one.orderBy("doc_id").collect()], pa.schema([("label", pa.int32()), *lists.items()]))
    pool = chosen(features.where("doc_id is not null"), labels.select("doc_id"), "left_anti")
    views, base = co_train(labelled, pool, rounds=rounds)
    shared = docs.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = slots_of(b)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v.odds(slots, b.num_rows)) for v in shared.value)], ["doc_id", "text_odds", "meta_odds"])

    odds = features.mapInArrow(run, "doc_id long, text_odds double, meta_odds double")
    chance = lambda o: 1 / (1 + F.exp(-F.greatest(F.least(o, F.lit(40.0)), F.lit(-40.0))))
    both = F.col("text_odds") + F.col("meta_odds") - float(np.log(base / (1 - base)))
    out = odds.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), chance(F.col("text_odds")).alias("text_score"), chance(F.col("meta_odds")).alias("meta_score"), chance(both).alias("score"))
    return out.withColumn("kept", F.col("score") >= least_score)
