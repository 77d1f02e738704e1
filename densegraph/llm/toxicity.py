"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its bag: the word itself and its character
n-grams, bounds included, so a misspelling that was never seen shares most of its vector
with the word. A linear softmax classifies the vectors; embeddings and softmax are trained
together in numpy. A document is as toxic as its few most toxic words on average, which is what
training, calibration and scoring all look at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS, SIZE = 18, 4
BUCKETS = 1 << BUCKET_BITS
#: Lengths of n-grams in code points; how many of a document's words make its score; least documents that hold an n-gram that is learnt.
SHORTEST, LONGEST, TOP, LEAST_DOCS = 3, 6, 3, 10
#: ASCII as the n-grams see it: letters and digits stay, marks and controls become the space that bounds words.
PLAIN = np.array([b if chr(b).isalnum() else 32 for b in range(128)], np.uint32)
#: The base of the rolling hash and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def plain(text: str | None) -> np.ndarray:
    """Code points of a text in lower case between two spaces."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = codes < 128
    codes[low] = PLAIN[codes[low]]
    return codes


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def subwords(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and word number of each word and of each n-gram within a word (its bounding spaces included); the number of words."""
    space = codes == 32
    begin, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(codes)), out=total[1:], dtype=np.uint64)
    down = powers(BACK, len(codes))
    buckets, owners = [bucket((total[end] - total[begin]) * down[begin])], [np.arange(len(begin))]
    word, spaces = np.cumsum(np.bincount(begin, minlength=len(codes))) - 1, np.cumsum(space)
    for n in range(SHORTEST, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        at = np.flatnonzero(spaces[n - 2 : n - 2 + m] == spaces[:m])  # no space inside
        buckets.append(bucket((total[at + n] - total[at]) * down[at] + np.uint64(n)))
        owners.append(word[at + 1])
    return np.concatenate(buckets), np.concatenate(owners), len(begin)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """weights: what each bucket adds to a word's log-odds; bias; slope and shift of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, text: str | None) -> float:
        """The mean over the most toxic words; that of a word that says nothing if there are no words."""
        at, owner, n = subwords(plain(text))
        if not n:
            return self.bias
        values = np.bincount(owner, self.weights[at], n) / np.bincount(owner, minlength=n)
        return float((np.partition(values, n - TOP)[n - TOP :] if n > TOP else values).mean()) + self.bias

    def score(self, text: str | None) -> float:
        return float(logistic(np.float64(self.slope * self.log_odds(text) + self.shift)))


def documents_holding(ids: list[np.ndarray], gram: np.ndarray, owner: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """How many documents of each label hold each of ``n`` n-grams; ``ids`` are the words of each document."""
    order = np.argsort(owner, kind="stable")
    of_word, starts = gram[order], np.searchsorted(owner[order], np.arange(owner.max(initial=-1) + 2))
    out = np.zeros((n, 2), np.float32)
    for x, label in zip(ids, y.astype(int).tolist(), strict=True):
        own = np.unique(x)
        sizes = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) + np.arange(sizes.sum()) if len(own) else own
        out[np.unique(of_word[at]), label] += 1
    return out


def train(texts: list[str], labels: list[int], *, base: float | None = None, epochs: int = 60, rate: float = 0.05, seed: int = 7) -> Model:
    """Fit by full-batch steps of Adam; of every fifth epoch the one that does best on an eighth of the rows, kept apart, which calibrates it too.

    The first coordinate of the embeddings starts from smoothed log-odds of the label given the
    n-gram. With one label only the model scores the base rate. ``base`` is the share of label 1 among
    all labelled rows, if the texts are not a plain sample of them.
    """
    y = np.array(labels, np.float64)
    base = float((y.sum() + 0.5) / (len(y) + 1)) if base is None else base
    flat = Model(np.zeros(BUCKETS), float(np.log(base / (1 - base))))
    if not len(y) or y.min() == y.max():
        return flat
    apart = np.zeros(len(y), bool)
    for label in (0, 1):
        apart[np.flatnonzero(y == label)[7::8]] = True
    if min(y[apart].sum(), (1 - y[apart]).sum()) < 5:
        apart[:] = False  # too few to spare
    held = [(t, v) for t, v, a in zip(texts, y, apart | ~apart.any(), strict=True) if a]
    known: dict[str, int] = {}
    split = lambda t: plain(t).tobytes().decode("utf-32-le", "surrogatepass").split(" ")
    rows = [(np.array([known.setdefault(w, len(known)) for w in split(t) if w], np.int64), v) for t, v, a in zip(texts, y, apart, strict=True) if not a]
    rows = [r for r in rows if len(r[0])]
    if not rows:
        return flat
    ids, y = [r[0] for r in rows], np.array([r[1] for r in rows])
    gram, owner, n_words = subwords(np.frombuffer((" " + " ".join(known) + " ").encode("utf-32-le", "surrogatepass"), np.uint32))
    sizes = np.bincount(owner, minlength=n_words).astype(np.float64)
    used, gram = np.unique(gram, return_inverse=True)
    counts = documents_holding(ids, gram, owner, y, len(used))
    alive = counts.sum(1) >= min(LEAST_DOCS, len(y) / 8)
    share = float(y.mean())
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (len(used), SIZE))
    emb[:, 0] = np.log((counts[:, 1] + 10 * share) / (counts[:, 0] + 10 * (1 - share))) - np.log(share / (1 - share))
    emb[~alive] = 0
    gram, owner = gram[alive[gram]], owner[alive[gram]]
    soft, bias = rng.normal(0, 0.1, (SIZE, 2)), np.array([2.0, -2.0])
    soft[0] = -4, 4
    word, lengths = np.concatenate(ids), np.array([len(x) for x in ids])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    doc, place, top = np.repeat(np.arange(len(ids)), lengths), np.arange(len(word)), np.minimum(lengths, TOP)
    weight = np.where(y == 1, 1 / max(y.sum(), 1), 1 / max((1 - y).sum(), 1))
    state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (emb, soft, bias)]
    best, least = flat, np.inf
    for epoch in range(epochs + 1):
        side = soft[:, 1] - soft[:, 0]
        if epoch % 5 == 0:
            weights = np.zeros(BUCKETS)
            weights[used] = emb @ side
            model, loss = calibrated(Model(weights, float(bias[1] - bias[0])), held, base)
            if loss < least:
                best, least = model, loss
        # the mean of a word's n-gram vectors and of a document's top words, seen along the softmax's two classes
        odds = np.bincount(owner, (emb @ side)[gram], n_words) / sizes
        order = np.argsort(doc - logistic(odds[word]))  # by document, the most toxic words first
        chosen = order[place - first[doc] < top[doc]]
        of, w = doc[chosen], word[chosen]
        z = np.bincount(of, odds[w], len(ids)) / top + bias[1] - bias[0]
        err = (logistic(z) - y) * weight
        to_gram = np.bincount(gram, (np.bincount(w, (err / top)[of], n_words) / sizes)[owner], len(used))
        along = emb.T @ to_gram
        for (x, m, v), g in zip(state, (to_gram[:, None] * side, np.stack([-along, along], 1), np.array([-err.sum(), err.sum()])), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    return best


def calibrated(model: Model, held: list[tuple[str, float]], base: float) -> tuple[Model, float]:
    """Slope and shift by logistic regression of the label on a document's log-odds, moved to the base rate; and the log loss before the move."""
    x, y = np.array([model.log_odds(t) for t, _ in held]), np.array([v for _, v in held])
    scale, mean = float(np.std(x)) or 1.0, float(x.mean())
    z = np.stack([(x - mean) / scale, np.ones(len(x))], 1)
    c, hold = np.zeros(2), np.diag([1e-3, 0.0])
    for _ in range(30):  # Newton steps, with a little weight decay for labels that one threshold parts
        p = logistic(z @ c)
        c = c - np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) / len(y) + hold, z.T @ (p - y) / len(y) + hold @ c)
    p = np.clip(logistic(z @ c), 1e-9, 1 - 1e-9)
    share = float(y.mean())
    move = np.log(base / (1 - base)) - np.log(share / (1 - share))
    return Model(model.weights, model.bias, c[0] / scale, c[1] - c[0] * mean / scale + float(move)), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; rows without an id are held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) to learn from: rows that aren't held out and have a label; of several labels of an id the largest."""
    return labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def training_rows(docs: DataFrame, known: DataFrame, most: int) -> tuple[DataFrame, float | None]:
    """At most ``most`` labelled rows, half of each label if there are enough: those with the least hash of the id. And the share of label 1 among all."""
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = None if not counts else (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    each = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for v in (0, 1)]
    ids = each[0].unionByName(each[1])
    return docs.join(F.broadcast(ids), "doc_id"), share  # at most ``most`` ids


def toxicity(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 3000, least_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every input row.

    Trained on at most ``most_labelled`` labelled ids, a bound on what the driver holds; every
    row is scored on its whole text. A null or empty text scores as one without toxic
    words; rows without an id are scored, never learned from; repeated rows score alike; an empty table
    gives no rows, and with no labels of both kinds every text scores the base rate.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = known_labels(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), "toxic")
    sample, share = training_rows(docs, known, most_labelled)
    rows = sample.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("label").alias("label")).orderBy("doc_id").collect()
    model = train([r["text"] or "" for r in rows], [r["label"] for r in rows], base=share)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least_score).cast("int").alias("predicted"))
