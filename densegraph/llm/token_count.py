"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word form a doubly linked list; a heap gives the adjacent pair of
the lowest rank, again and again. The count is the number of initial symbols minus
the number of merges, so no identifiers are made. White space never joins a token,
so counts are remembered by white-space-delimited chunk.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks remembered by each Python worker, and the longest one worth remembering.
MOST_CHUNKS, LONGEST_CHUNK = 500_000, 200


def byte_letters() -> list[str]:
    """The printable letter for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class PairMerger:
    """Counts tokens as the tokenizer file at ``path`` defines them (BPE with an end-of-word mark, lower-casing)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.known: dict[str, int] = {}

    def merges(self, symbols: list[str]) -> int:
        """How many merges the symbols allow."""
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # the pair is gone since it was put there
            done += 1
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return done

    def word(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        return len(symbols) - self.merges(symbols)

    def chunk(self, chunk: str) -> int:
        """Tokens of a lower-cased text without white space."""
        n = self.known.get(chunk)
        if n is None:
            n = sum(map(self.word, self.pattern.findall(chunk)))
            if len(chunk) <= LONGEST_CHUNK:
                if len(self.known) >= MOST_CHUNKS:
                    self.known.clear()
                self.known[chunk] = n
        return n

    def piece(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lower-cases letter by letter
        chunks = text.lower().split()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes them for white space, the pattern does not
            chunks = regex.split(r"\s+", text.lower())
        return sum(map(self.chunk, chunks))

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self.piece(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.piece, pieces))


@lru_cache(1)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def token_counts(docs: DataFrame, *, vocabulary: str, most_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of each whole text.

    One row per input row with ``doc_id, n_bytes, n_tokens, over_limit``. A null or
    empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give
    repeated rows; an empty table gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for b in batches:
            sizes, counts = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                sizes.append(len(t.encode()))
                counts.append(m.count(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > most_tokens)
