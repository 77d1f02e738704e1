"""Benchmark decontamination with a BM25 inverted index of test items and block-max WAND.

The index holds the test items; every passage of every document is a query. A term's weight
in an item is its BM25 weight over the sum of the item's weights, so a passage that holds
all of an item scores 1 and one threshold serves items of any length. Passages overlap by half
and are twice as long as the longest item, so each copy of an item lies whole in one of them.
Upper bounds over all passages of a batch at once, from enough of each item's rarest terms that the
rest can't reach the threshold, leave few to search; those go through block-max WAND, and each item that is retrieved is verified: the words of its question part and
of its answer part must be covered by word shingles shared with the passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegraph.llm.common import chosen

#: BM25's constants, postings in a block, and the most items in one index; more items are searched in several indexes.
K1, B, BLOCK, MOST_ITEMS = 1.2, 0.75, 64, 20_000
MARKS = ".,;:!?\"'()[]{}<>«»„“”"


def terms(text: str | None) -> list[str]:
    return [x for w in (text or "").lower().split() if (x := w.strip(MARKS))]


@dataclass
class Postings:
    """Items (ascending) and weights of one term, the greatest weight overall and in each block with the block's last item."""

    items: np.ndarray
    weights: np.ndarray
    most: float
    ends: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    block_most: np.ndarray = field(default_factory=lambda: np.empty(0))


@dataclass
class Keys:
    """For each term the items (equal ones once) that it is a key of and its weights there, the greatest of these, and each item's weight without keys."""

    items: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    most: np.ndarray
    rest: np.ndarray


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def slices(sizes: np.ndarray, groups: np.ndarray, most: int = 2_000_000) -> Iterator[slice]:
    """Runs of about ``most`` in size; equal neighbours in ``groups`` stay together."""
    if len(sizes):
        ends = np.append(np.flatnonzero(np.diff(groups)) + 1, len(sizes))
        last = np.append(np.flatnonzero(np.diff(np.cumsum(sizes)[ends - 1] // most)), len(ends) - 1)
        yield from (slice(lo, hi) for lo, hi in zip([0, *ends[last][:-1].tolist()], ends[last].tolist(), strict=True))


class Index:
    """BM25 index of test items ``(id, text)``; items without terms are left out."""

    def __init__(self, items: list[tuple[int, str | None]]):
        split = [(i, t) for i, x in items if (t := terms(x))]
        self.ids = [i for i, _ in split]
        self.words = [t for _, t in split]
        n = len(split)
        mean = sum(map(len, self.words)) / max(1, n)
        held: dict[str, dict[int, float]] = {}
        for k, words in enumerate(self.words):
            for w in set(words):
                tf = words.count(w)
                held.setdefault(w, {})[k] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
        sums = np.zeros(n)
        for got in held.values():
            idf = np.log(1 + (n - len(got) + 0.5) / (len(got) + 0.5))
            for k in got:
                got[k] *= idf
                sums[k] += got[k]
        self.term = {w: j for j, w in enumerate(held)}
        self.postings = []
        for got in held.values():
            at = np.array(sorted(got), np.int64)
            weights = np.array([got[k] / sums[k] for k in at.tolist()])
            cuts = np.arange(0, len(at), BLOCK)
            self.postings.append(Postings(at, weights, float(weights.max()), at[np.append(cuts[1:], len(at)) - 1], np.maximum.reduceat(weights, cuts)))
        self.longest = max(map(len, self.words), default=0)
        self.stride = max(32, self.longest)
        # For bounds over many passages, each item's terms, those of the fewest items first, and its first equal item.
        counts = np.array([len(p.items) for p in self.postings] or [0])
        self.rare = counts <= max(2, n // 20)
        term = np.repeat(np.arange(len(counts)), counts)
        item = np.concatenate([p.items for p in self.postings] or [np.empty(0, np.int64)])
        order = np.lexsort((term, counts[term], item))
        self.item_terms, self.item_weights = term[order], np.concatenate([p.weights for p in self.postings] or [np.empty(0)])[order]
        self.item_starts = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=n))])
        firsts: dict[tuple, int] = {}
        self.first = [firsts.setdefault(tuple(t), k) for k, t in enumerate(self.words)]
        self.keys: dict[float, Keys] = {}

    def key_terms(self, least: float) -> Keys:
        """Terms of which a passage must hold one for an item to reach ``least``: the rare ones, and then the next rarest until the rest can't reach it."""
        if least not in self.keys:
            rest, terms, items, weights = np.zeros(len(self.ids)), [], [], []
            for k in range(len(self.ids)):
                if self.first[k] != k:  # as the item that it equals
                    continue
                own = slice(self.item_starts[k], self.item_starts[k + 1])
                w = self.item_weights[own]
                after = np.append(np.cumsum(w[::-1])[::-1], 0.0)
                n = max(int(self.rare[self.item_terms[own]].sum()), int(np.argmax(after < least - 1e-6)) if least > 1e-6 else len(w))
                rest[k] = after[n]
                terms.append(self.item_terms[own][:n])
                items.append(np.full(n, k))
                weights.append(w[:n])
            term, item, weight = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (terms, items, weights))
            order = np.argsort(term, kind="stable")
            sizes = np.bincount(term, minlength=len(self.postings))
            most = np.zeros(len(self.postings))
            np.maximum.at(most, term, weight)
            self.keys[least] = Keys(item[order], weight[order], np.concatenate([[0], np.cumsum(sizes)]), most, rest)
        return self.keys[least]

    def wand(self, query: list[int], least: float) -> list[tuple[int, float]]:
        """Items whose score for the distinct terms is at least ``least``, by block-max WAND."""
        lists = [self.postings[t] for t in query]
        at = [0] * len(lists)
        out = []
        live = list(range(len(lists)))
        while live:
            live.sort(key=lambda j: lists[j].items[at[j]])
            bound, pivot = 0.0, -1
            for k, j in enumerate(live):
                bound += lists[j].most
                if bound >= least - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            upto = live[: pivot + 1]
            blocks = {j: int(np.searchsorted(lists[j].ends, item)) for j in upto}
            if sum(lists[j].block_most[b] for j, b in blocks.items() if b < len(lists[j].ends)) < least - 1e-9:
                # no item up to the end of the nearest block can do it
                stop = min([lists[j].ends[b] for j, b in blocks.items() if b < len(lists[j].ends)] or [item]) + 1
                if pivot + 1 < len(live):
                    stop = min(stop, lists[live[pivot + 1]].items[at[live[pivot + 1]]])
                target = max(stop, item + 1)
            elif lists[live[0]].items[at[live[0]]] == item:
                score = sum(float(lists[j].weights[at[j]]) for j in upto)
                if score >= least - 1e-9:
                    out.append((int(item), score))
                target = item + 1
            else:
                target = item
            for j in upto:
                at[j] += int(np.searchsorted(lists[j].items[at[j] :], target))
            live = [j for j in live if at[j] < len(lists[j].items)]
        return out

    def possible(self, ids: np.ndarray, passages: np.ndarray, least: float) -> np.ndarray:
        """Passages that some item may reach ``least`` in, from (passage, term) occurrences (both passages of a word given)."""
        key, n_terms, n = self.key_terms(least), max(1, len(self.postings)), max(1, len(self.ids))
        known = ids >= 0
        held = np.unique(passages[known] * n_terms + ids[known])
        passage, term = held // n_terms, held % n_terms
        own = key.starts[term + 1] > key.starts[term]
        passage, term = passage[own], term[own]
        if not len(passage):
            return passage
        _, inverse = np.unique(passage, return_inverse=True)
        hopeful = (np.bincount(inverse, key.most[term]) >= least - key.rest.max() - 2e-9)[inverse]
        passage, term = passage[hopeful], term[hopeful]
        sizes = key.starts[term + 1] - key.starts[term]
        out = [np.empty(0, np.int64)]
        for part in slices(sizes, passage):
            pairs, inverse = np.unique(np.repeat(passage[part], sizes[part]) * n + key.items[(at := ranges(key.starts[term[part]], sizes[part]))], return_inverse=True)
            pairs = pairs[np.bincount(inverse, key.weights[at]) + key.rest[pairs % n] >= least - 2e-9]
            # what the bound leaves is scored on all terms of the item
            item = pairs % n
            lengths = self.item_starts[item + 1] - self.item_starts[item]
            for some in slices(lengths, np.arange(len(pairs))):
                at, of = ranges(self.item_starts[item[some]], lengths[some]), np.repeat(np.arange(len(item[some])), lengths[some])
                wanted = np.repeat(pairs[some] // n, lengths[some]) * n_terms + self.item_terms[at]
                place = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                score = np.bincount(of, self.item_weights[at] * (held[place] == wanted), minlength=len(item[some]))
                out.append(pairs[some][score >= least - 2e-9] // n)
        return np.unique(np.concatenate(out))

    def verified(self, item: int, passage: list[str], width: int, question: float, answer: float) -> bool:
        """Whether enough words of the item's question and of its answer (the last third) lie in shingles that the passage shares."""
        words = self.words[item]
        width = min(width, len(words))
        shared = {tuple(passage[i : i + width]) for i in range(len(passage) - width + 1)}
        covered = [False] * len(words)
        for i in range(len(words) - width + 1):
            if tuple(words[i : i + width]) in shared:
                covered[i : i + width] = [True] * width
        cut = len(words) - max(1, len(words) // 3)
        return sum(covered[:cut]) >= question * cut and sum(covered[cut:]) >= answer * (len(words) - cut)


class TermIds(dict):
    """Index term number of each raw word, -1 if the index lacks it."""

    def __init__(self, index: Index):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        bare = word.strip(MARKS)
        value = self[word] = self.index.term.get(bare, -1) if bare else -2
        return value


def matches(index: Index, ids: TermIds, texts: list[str | None], least: float, width: int, question: float, answer: float) -> list[list[tuple[int, float]]]:
    """For each text its verified items with their best scores."""
    stride, out = index.stride, [[] for _ in texts]
    words = [(t or "").lower().split() for t in texts]
    flat, doc_of, at = [], [], []
    for d, w in enumerate(words):
        x = np.fromiter(map(ids.__getitem__, w), np.int64, len(w))
        real = np.flatnonzero(x != -2)  # words of marks only don't count
        flat.append(x[real])
        at.append(real)
        doc_of.append(len(real))
    term, sizes = np.concatenate(flat), np.array(doc_of)
    blocks = sizes // stride + 2  # numbers of passages, with one spare for each text
    first = np.concatenate([[0], np.cumsum(blocks)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(term)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    block = first[owner] + place // stride + 1  # passage b covers the words of blocks b and b - 1
    for p in index.possible(np.concatenate([term, term]), np.concatenate([block, block - 1]), least).tolist():
        d = int(np.searchsorted(first, p, "right")) - 1
        k = p - int(first[d])
        lo, hi = max(0, (k - 1) * stride), min(int(sizes[d]), (k + 1) * stride)
        part = flat[d][lo:hi]
        got = index.wand(np.unique(part[part >= 0]).tolist(), least)
        if got:
            text = [words[d][i].strip(MARKS) for i in at[d][lo:hi].tolist()]
            out[d] += [(index.ids[i], s) for i, s in got if index.verified(i, text, width, question, answer)]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.6, width: int = 5, question: float = 0.8, answer: float = 0.5, most_items: int = MOST_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, score`` for every document row and benchmark item found in it, the best score of its passages.

    Every passage is searched; ``least`` is the share of an item's BM25 weight that a passage must
    reach, ``question`` and ``answer`` are the shares of words that must be covered. The index is broadcast: at most
    ``most_items`` items in one, further items in further searches. Null or empty texts and items match nothing;
    repeated rows match alike; ids may be null; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    searches = max(1, -(-items.count() // most_items))
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(searches))
    out = []
    for k in range(searches):
        rows = items.where(share == k).orderBy("item_id", "text").collect()  # about most_items rows
        index = Index([(r["item_id"], r["text"]) for r in rows])
        index.key_terms(least)  # once, for all tasks
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            ids = TermIds(index)
            for b in batches:
                keys, found = b.column(0), []
                for lo in range(0, b.num_rows if index.ids else 0, 256):
                    texts = [x.as_py() for x in b.column(1)[lo : lo + 256]]
                    for i, hits in enumerate(matches(index, ids, texts, least, width, question, answer)):
                        best: dict[int, float] = {}
                        for item, s in hits:
                            best[item] = max(s, best.get(item, 0.0))
                        found += [(keys[lo + i].as_py(), item, s) for item, s in sorted(best.items(), key=str)]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "score"])

        out.append(docs.mapInArrow(run, "doc_id long, item_id long, score double"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those in which an item is found, with all their columns.

    Rows with a null id and null or empty texts are kept, as are repeated rows of a clean id; of an id whose texts differ all rows
    go if one holds an item. An empty table gives no rows, an empty benchmark all.
    """
    return chosen(docs, contaminated(docs, benchmark, **options).select("doc_id"), "left_anti").select(*docs.columns)
