"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The lattice of a text has a node for each (place, piece that ends there); an edge leads from
piece to piece. For BPE vocabularies an edge weighs 0 if the two pieces stay as they
are when their joined text is encoded alone, else minus infinity: a path is of weight 0 just
when it is the encoding, and no text has two. A text is cut into chunks of so many letters, wherever that
falls. Each chunk has a max-plus transfer matrix from the states in which its left boundary can be
crossed, which are the pieces over it, to those of its right boundary; the matrices of a text are combined by
an associative prefix scan, which tells the state at every boundary, and then each chunk is traced
back on its own. Chunks of giant documents are rows: matrices and traces are worked out wherever
the rows are. Within a chunk, a word that begins after a space has one state on either side, so its matrix
is one number and its one path is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegraph.llm.common import save

SPACE = "▁"
#: Letters of a chunk, words remembered by a worker and the longest one remembered.
CHUNK, MOST_WORDS, LONGEST_WORD = 32768, 800_000, 64
#: A state at a boundary: the place where the piece over it begins, seen from the boundary, and the piece. This one where no piece crosses.
START = (0, "")
MAYBE = 2
State = tuple[int, str]
Matrix = dict[State, set[State]]


class Pieces:
    """A SentencePiece BPE model with byte fallback and identity normalisation, read from ``path``."""

    def __init__(self, path: str):
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(p.vocab_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i):
                self.bytes_of.append(b"" if p.is_control(i) else " ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.rank = {piece: -p.get_score(i) for piece, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        #: Of beginnings of pieces whether they are pieces that merging can make: False, True, or MAYBE before it is looked into.
        self.begins = dict.fromkeys((x[:n] for x in self.ids for n in range(1, len(x))), False) | dict.fromkeys(self.ids, MAYBE)
        # a space within a piece only follows spaces, so chunks that begin after the last space of a run keep to themselves
        self.word_bound = all(SPACE not in x.lstrip(SPACE) for x in self.ids)
        self.pair: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by merging the best pair, the leftmost of equals, while there is one."""
        parts = list(text)
        while len(parts) > 1:
            rank, i = min((self.rank.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1))
            if rank == np.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def allowed(self, a: str, b: str) -> bool:
        """Whether the edge from piece a to piece b weighs 0."""
        key = (a, b)
        ok = self.pair.get(key)
        if ok is None:
            if len(self.pair) > 1_000_000:
                self.pair.clear()
            ok = self.pair[key] = self.merged(a + b) == [a, b]
        return ok

    def starting(self, text: str, i: int) -> list[str]:
        """Pieces that begin at a place: the single letter, known or not, and every longer piece of the vocabulary that merging can make."""
        out, known = [text[i]], self.begins.get
        for n in range(i + 2, min(i + self.longest, len(text)) + 1):
            x = text[i:n]
            piece = known(x)
            if piece is None:
                break
            if piece and (piece is True or self.valid(x)):
                out.append(x)
        return out

    def short(self, text: str) -> list[str]:
        """The one path of weight 0 of a text of one chunk, longest pieces tried first.

        Every place is reached by one such path at most, so a place that led nowhere is not tried again.
        """
        end, dead, known = len(text), set(), self.pair.get
        stack = [(0, "", self.starting(text, 0))]
        while True:
            i, before, options = stack[-1]
            while options:
                x = options.pop()
                j = i + len(x)
                if j in dead:
                    continue
                ok = known((before, x)) if before else True
                if ok or ok is None and self.allowed(before, x):
                    if j == end:
                        return [s[1] for s in stack[1:]] + [x]
                    stack.append((j, x, self.starting(text, j)))
                    break
            else:
                dead.add(i)
                stack.pop()

    def valid(self, piece: str) -> bool:
        """Whether merging can make the piece at all."""
        ok = self.begins[piece] = self.merged(piece) == [piece]
        return ok

    def crossing(self, text: str, at: int) -> list[State]:
        """The states in which a boundary can be met: pieces that begin before it and reach it or lie over it."""
        if self.sure(text, at):
            return [START]
        return [(i - at, x) for i in range(max(0, at - self.longest), at) for x in self.starting(text, i) if i + len(x) >= at]

    def sure(self, text: str, at: int) -> bool:
        """Whether no piece can reach over the place, whatever stands before or behind what is seen of the text."""
        return at == 0 or at == len(text) or self.word_bound and text[at] == SPACE != text[at - 1]

    def paths(self, text: str, begin: int, end: int, states: list[State]) -> dict[int, list[Node]]:
        """From states at ``begin`` all pieces by the place where they end, up to those that reach ``end`` or over it.

        A piece is one node, however many states lead to it; bit k of its mask tells that states[k] does.
        """
        reach: dict[int, list[Node]] = {}
        for k, (d, x) in enumerate(states):
            reach.setdefault(begin + d + len(x), []).append(Node(begin + d, x, 1 << k, ()))
        for i in range(begin, end):
            nodes = reach.get(i)
            for x in self.starting(text, i) if nodes else ():
                before = [n for n in nodes if not n.piece or self.allowed(n.piece, x)]
                if before:
                    mask = 0
                    for n in before:
                        mask |= n.mask
                    reach.setdefault(i + len(x), []).append(Node(i, x, mask, before))
        return reach

    def ends(self, text: str, begin: int, end: int, states: list[State]) -> list[tuple[State, Node]]:
        """The states at ``end`` that can be reached, with their nodes."""
        reach = self.paths(text, begin, end, states)
        if self.sure(text, end):
            return [(START, n) for n in reach.get(end, ())]
        return [((n.at - end, n.piece), n) for place, nodes in reach.items() if place >= end for n in nodes]

    def inner(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and last place from ``begin`` to ``end`` that no piece reaches over."""
        if self.sure(text, begin) and self.sure(text, end):
            return begin, end
        at = [i for i in (begin, *self.word_starts(text, begin, end), end) if self.sure(text, i)]
        return (at[0], at[-1]) if at else None

    def word_starts(self, text: str, begin: int, end: int) -> list[int]:
        return [m.start() + 1 for m in WORD_START.finditer(text, begin, min(end + 1, len(text)))] if self.word_bound else []

    def transfer(self, text: str, begin: int, end: int) -> Matrix:
        """The chunk's max-plus matrix as its entries of weight 0: from each state at ``begin`` the states at ``end``."""
        states, inner = self.crossing(text, begin), self.inner(text, begin, end)
        if inner is None:
            out: Matrix = {s: set() for s in states}
            for t, n in self.ends(text, begin, end, states):
                for k, s in enumerate(states):
                    if n.mask >> k & 1:
                        out[s].add(t)
            return out
        # the product of the first word's matrix, those of whole words, which are one number, and the last word's
        first, last = inner
        into = {START} if first == begin else {states[k] for _, n in self.ends(text, begin, first, states) for k in range(len(states)) if n.mask >> k & 1}
        onto = {START} if last == end else {t for t, _ in self.ends(text, last, end, [START])}
        return {s: set(onto) if s in into else set() for s in states}

    def between(self, text: str, begin: int, end: int, s: State, t: State) -> bytes:
        """Identifiers of the pieces after state ``s`` at ``begin`` up to state ``t`` at ``end``, traced back."""
        node = next((n for state, n in self.ends(text, begin, end, [s]) if state == t), None)
        out: list[str] = []
        while node is not None and node.before:
            out.append(node.piece)
            node = next(iter(node.before))
        return self.numbers(out[::-1])

    def trace(self, text: str, begin: int, end: int, s: State, t: State) -> bytes:
        """Identifiers of a chunk between two known states."""
        inner = self.inner(text, begin, end)
        if inner is None:
            return self.between(text, begin, end, s, t)
        first, last = inner
        out = [self.between(text, begin, first, s, START)] if first > begin else []
        out += map(self.word, WORDS.findall(text, first, last) if self.word_bound else [text[first:last]] * (last > first))
        out += [self.between(text, last, end, START, t)] if last < end else []
        return b"".join(out)

    def numbers(self, parts: list[str]) -> bytes:
        """Identifiers of pieces as 32-bit integers; letters that the vocabulary lacks as bytes."""
        ids: list[int] = []
        for x in parts:
            i = self.ids.get(x)
            ids += [i] if i is not None else [self.byte_ids[b] for b in x.encode()]
        return np.array(ids, np.int32).tobytes()

    def word(self, text: str) -> bytes:
        """Identifiers of a text that no piece reaches into or out of."""
        got = self.known.get(text)
        if got is None:
            got = self.numbers(self.short(text))
            if len(text) <= LONGEST_WORD:
                if len(self.known) >= MOST_WORDS:
                    self.known.clear()
                self.known[text] = got
        return got

    def encode(self, text: str, chunk: int = CHUNK) -> np.ndarray:
        """Identifiers of a text in one place: the scan over its chunks, of which most texts have one."""
        if not text:
            return np.empty(0, np.int32)
        text = normal(text)
        bounds = [*range(0, len(text), chunk), len(text)]
        spans = list(zip(bounds, bounds[1:], strict=False))
        states = at_boundaries([self.transfer(text, *b) for b in spans])
        return np.frombuffer(b"".join(self.trace(text, *b, s, t) for b, s, t in zip(spans, states, states[1:], strict=False)), np.int32)

    def text_of(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode(errors="replace")

    def decode(self, ids: np.ndarray) -> str:
        return self.text_of(ids).removeprefix(" ")


#: A run of spaces and what follows up to the next space; the place before a run of spaces.
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
WORD_START = re.compile(f"[^{SPACE}](?={SPACE})")


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product of two matrices of weights 0 and minus infinity."""
    return {s: set().union(*(b.get(t, ()) for t in got)) for s, got in a.items()}


def prefixes(matrices: list[Matrix]) -> list[Matrix]:
    """The products of the first 1, 2, ... matrices, by an associative scan: neighbours are paired, the pairs scanned, the gaps filled."""
    if len(matrices) < 2:
        return list(matrices)
    pairs = prefixes([product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], matrices[i]))
    return out


def at_boundaries(matrices: list[Matrix]) -> list[State]:
    """The state at every boundary of a text, both ends included."""
    reached = prefixes(matrices)
    states = [START]
    for k in range(len(matrices) - 1, -1, -1):
        before = reached[k - 1][START] if k else {START}
        states.append(next(s for s, got in matrices[k].items() if s in before and states[-1] in got))
    return states[::-1]


class Node:
    """A piece of the lattice: where it begins, its text, the states that lead to it and the nodes before it."""

    __slots__ = ("at", "before", "mask", "piece")

    def __init__(self, at: int, piece: str, mask: int, before):
        self.at, self.piece, self.mask, self.before = at, piece, mask, before


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


ROWS = "doc_id long, n_tokens long, ids array<int>, ids_hash string, round_trip boolean"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
#: A chunk: the text that it needs, its own part of it and whether the document has the vocabulary's space sign.
CHUNKS = "key long, k int, doc_id long, text string, begin int, end int, marked boolean"
CHUNK_FIELDS = [("key", pa.int64()), ("k", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("marked", pa.bool_())]
MATRIX = "key long, k int, si array<int>, sx array<string>, ti array<int>, tx array<string>"
STATES = "key long, k int, si int, sx string, ti int, tx string"


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32)))


def encode_giants(docs: DataFrame, model: str, chunk: int) -> DataFrame:
    """encode_decode for documents of many chunks, each chunk a row of its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = pieces(model).longest + 1
        key = TaskContext.get().partitionId() << 32
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                marked, text = SPACE in text, normal(text)
                for k, lo in enumerate(range(0, len(text), chunk)):
                    # with the first and last place of the text in sight only where they are its ends
                    left, right = max(0, lo - reach), min(len(text), lo + chunk + reach)
                    row = (key, k, doc_id, text[left:right], lo - left, min(len(text), lo + chunk) - left, marked)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, CHUNK_FIELDS, strict=True)], [n for n, _ in CHUNK_FIELDS])
                key += 1

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            entries = []
            for text, begin, end in zip(b.column("text"), b.column("begin").to_pylist(), b.column("end").to_pylist(), strict=True):
                entries.append([(*s, *t) for s, got in p.transfer(text.as_py(), begin, end).items() for t in got])
            columns = [pa.array([[e[j] for e in row] for row in entries], pa.list_(pa.string() if j % 2 else pa.int32())) for j in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), *columns], [x.split()[0] for x in MATRIX.split(", ")])

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        matrices: list[Matrix] = []
        for r in rows:
            m: Matrix = {}
            for si, sx, ti, tx in zip(r["si"], r["sx"], r["ti"], r["tx"], strict=True):
                m.setdefault((si, sx), set()).add((ti, tx))
            matrices.append(m)
        states = at_boundaries(matrices)
        return pa.table({"key": table["key"], "k": pa.array([r["k"] for r in rows], pa.int32()), **{f"{a}{b}": pa.array([x[j] for x in part], pa.string() if j else pa.int32()) for a, part in (("s", states[:-1]), ("t", states[1:])) for j, b in enumerate("ix")}})

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            lists, trips = [], []
            for r in b.to_pylist():
                s, t = (r["si"], r["sx"]), (r["ti"], r["tx"])
                ids = np.frombuffer(p.trace(r["text"], r["begin"], r["end"], s, t), np.int32)
                lists.append(ids)
                own = r["text"][r["begin"] + s[0] + len(s[1]) : r["end"] + t[0] + len(t[1])]
                trips.append(not r["marked"] and p.text_of(ids) == own.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), b.column("doc_id"), lists_of(lists), pa.array(trips, pa.bool_())], ["key", "k", "doc_id", "ids", "round_trip"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        ids = np.concatenate([x.values.to_numpy() for x in table["ids"]])
        row = (table["doc_id"][0].as_py(), len(ids), ids, xxhash.xxh3_64_hexdigest(ids.tobytes()), all(table["round_trip"].to_pylist()))
        return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.bool_()), strict=True)], NAMES)

    chunks = save(docs.mapInArrow(cut, CHUNKS).repartition("key", "k"))
    states = save(chunks.mapInArrow(transfers, MATRIX).groupBy("key").applyInArrow(combine, STATES))
    traced = chunks.join(states, ["key", "k"]).mapInArrow(traces, "key long, k int, doc_id long, ids array<int>, round_trip boolean")
    return traced.groupBy("key").applyInArrow(joined, ROWS)


def encode_decode(docs: DataFrame, *, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_hash, round_trip`` for every input row.

    ``ids`` are the identifiers of the whole text, without begin or end marks; ``ids_hash`` is a hash
    of them; ``round_trip`` tells whether decoding them gives the text again, which only a text with the
    vocabulary's own space sign U+2581 fails. Texts of more than ``chunk`` code points are worked on as rows of chunks,
    the rest as one chunk. A null or empty text has no tokens. Null ids stay, repeated
    rows give repeated rows, an empty table gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                lists, hashes, trips = [], [], []
                for t in part.column(1):
                    text = t.as_py() or ""
                    ids = p.encode(text, chunk + 1)
                    lists.append(ids)
                    hashes.append(xxhash.xxh3_64_hexdigest(ids.tobytes()))
                    trips.append(p.decode(ids) == text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in lists], pa.int64()), lists_of(lists), pa.array(hashes), pa.array(trips)], NAMES)

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    return kept.where(~giant).mapInArrow(run, ROWS).unionByName(encode_giants(kept.where(giant), model, chunk))
