"""Helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegraph.plans.tables import settled, shared_folder

#: Writes a table to the shared folder and reads it again, which cuts the lineage.
save = settled
__all__ = ["BROADCAST_IDS", "SPACES", "HashCache", "chosen", "let", "mix", "multipliers", "save", "shared_folder", "window_hashes", "words_of"]

#: The class of white space of every word pattern here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


#: The most ids that are broadcast to choose rows, 16 MB of longs; for more, ids and rows are shuffled.
BROADCAST_IDS = 2_000_000


def chosen(docs: DataFrame, ids: DataFrame, how: str = "left_semi", *, most: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in the one column of ``ids`` (``left_anti``: is not, nulls included)."""
    ids = save(ids.toDF("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= (BROADCAST_IDS if most is None else most) else ids, "doc_id", how)


def let(value: Column, body) -> Column:
    """``body`` of a lambda variable bound to ``value``, which is so computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


class HashCache(dict):
    """64-bit hash of a word (bytes), remembered for up to ``most`` words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, m in enumerate(multipliers(width, seed)):
        out += hashes[j : j + n] * m
    return mix(out)
