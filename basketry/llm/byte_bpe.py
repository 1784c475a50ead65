"""Byte-level BPE encoding by padded matrices, and decoding.

Distinct pieces of a slice of texts are dealt to matrices by length. In every round each row of a
matrix merges its leftmost pair of least rank; pairs are looked up in a hash table, finished rows
leave and the columns close up. Rank files are read where the task runs and never trained or copied.
"""

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_rows, per_worker

NONE = np.int32(2**31 - 1)
#: Pieces kept between slices: at most so many, and none longer than LONG bytes.
KNOWN_PIECES, LONG = 400_000, 256


class PairTable:
    """(left id, right id) -> rank of the joined bytes, by open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 1
        while len(todo):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]] = keys[todo[put]]
            self.ranks[slot[put]] = rank[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys ^ (keys >> np.uint64(29))
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair has none or a side is padding (-1)."""
        real = (left >= 0) & (right >= 0)
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero(real)
        keys = (left.ravel()[at].astype(np.uint64) << np.uint64(32)) | right.ravel()[at].astype(np.uint64)
        slot, flat = self._slot(keys), out.ravel()
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == keys
            flat[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (held != np.uint64(2**64 - 1))
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
            if not len(at):
                break
        return flat.reshape(left.shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("every byte needs a rank")
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t))
                 if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*pairs))) if pairs else PairTable(*[np.zeros(0, np.int64)] * 3)
        by_rank = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            by_rank[r] = t
        self.by_rank = by_rank
        self.vocabulary = np.frombuffer(b"".join(by_rank), np.uint8)
        self.sizes = np.array([len(t) for t in by_rank], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known: dict[str, bytes] = {}

    def _merge_matrix(self, ids: np.ndarray) -> list[bytes]:
        """Rows of ids padded with -1 at the right; every row merges its leftmost least pair each round."""
        out: list = [None] * len(ids)
        row = np.arange(len(ids))
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
            done = least == NONE
            data, width = ids[done].tobytes(), 4 * ids.shape[1]
            for k, (r, n) in enumerate(zip(row[done].tolist(), (ids[done] >= 0).sum(axis=1).tolist())):
                out[r] = data[k * width:k * width + 4 * n]
            go = ~done
            if not go.any():
                break
            row, ids, ranks, at, least = row[go], ids[go], ranks[go], at[go], least[go]
            each, width = np.arange(len(row)), ids.shape[1]
            ids[each, at] = least
            ids = ids[np.arange(width) != (at + 1)[:, None]].reshape(len(row), width - 1)
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(len(row), width - 2)
            if width > 2:  # the new id meets a new neighbour on either side
                right = at < width - 2
                ranks[each[right], at[right]] = self.pairs(ids[each[right], at[right]], ids[each[right], at[right] + 1])
                left = at > 0
                ranks[each[left], at[left] - 1] = self.pairs(ids[each[left], at[left] - 1], ids[each[left], at[left]])
                used = int((ids >= 0).sum(axis=1).max())
                ids, ranks = ids[:, :used], ranks[:, :max(used - 1, 0)]
        return out

    def _merge_long(self, ids: np.ndarray) -> bytes:
        """One long row: the leftmost least pair from a heap each time, so only the pairs beside it are looked up anew."""
        at, n, token, rank = ids.tolist(), len(ids), self.by_rank, self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pairs(ids[:-1], ids[1:]).tolist() + [NONE]
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapify(heap)
        while heap:
            least, i = heappop(heap)
            if ranks[i] != least:
                continue  # a neighbour was merged since
            j = after[i]
            at[i], ranks[j], after[i] = least, NONE, after[j]
            if after[i] < n:
                before[after[i]] = i
            at[j] = -1
            for left in (before[i], i):
                if left >= 0:
                    right = after[left]
                    ranks[left] = rank(token[at[left]] + token[at[right]], NONE) if right < n else NONE
                    if ranks[left] != NONE:
                        heappush(heap, (ranks[left], left))
        merged = np.array(at, np.int32)
        return merged[merged >= 0].tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces, as packed 32-bit numbers."""
        out, by_length = {}, {}
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            if data in self.ranks:
                out[piece] = self.ranks[data].to_bytes(4, "little")
            elif len(data) > LONG:
                out[piece] = self._merge_long(self.single[np.frombuffer(data, np.uint8)])
            else:
                by_length.setdefault(-(-len(data) // 4) * 4, []).append((piece, data))
        for width, rows in by_length.items():
            for start in range(0, len(rows), 20_000):
                part = rows[start:start + 20_000]
                codes = np.frombuffer(b"".join(d.ljust(width, b"\0") for _, d in part), np.uint8).reshape(len(part), width)
                real = np.arange(width) < np.array([len(d) for _, d in part])[:, None]
                ids = np.where(real, self.single[codes], np.int32(-1))
                out.update(zip((p for p, _ in part), self._merge_matrix(ids)))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text, as packed 32-bit numbers."""
        pieces = [self.pattern.findall(t) if t else [] for t in texts]
        new = set().union(*pieces).difference(self.known)
        if len(self.known) + len(new) > KNOWN_PIECES:
            self.known, new = {}, set().union(*pieces)
        self.known.update(self.encode_pieces(list(new)))
        out = [b"".join(map(self.known.__getitem__, x)) for x in pieces]
        for piece in new:
            if len(piece) > LONG // 4:
                del self.known[piece]
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; null lists give null."""
        flat = np.asarray(ids.flatten(), np.int64)
        counts = np.fromiter((0 if n is None else n for n in ids.value_lengths().to_pylist()), np.int64, len(ids))
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        data = self.vocabulary[np.repeat(self.starts[flat] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        edges = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        real, data = ids.is_valid().to_pylist(), data.tobytes()
        return pa.array([data[a:b] if r else None for a, b, r in zip(edges, edges[1:], real)], pa.binary())


def _lists(packed: list[bytes]) -> pa.ListArray:
    edges = np.append(0, np.cumsum([len(x) // 4 for x in packed])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _load(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as file:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, file))}, pattern)


def bpe(path: str, pattern: str) -> ByteBpe:
    return per_worker(("bpe", path, pattern), lambda: _load(path, pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>) for every row of `docs`; null and empty texts have no ids.

    `ranks` is the path of a rank file that every executor has, `pattern` what splits a text into pieces.
    Repeated rows are encoded each, other columns are ignored.
    """
    def work(columns):
        return [columns[0], _lists(bpe(ranks, pattern).encode(columns[1].to_pylist()))]

    kind = docs.schema[id].dataType.simpleString()
    named = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(named, ["doc_id", "text"], f"doc_id {kind}, ids array<int>", work, 1_000_000, raw=True)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """`encoded` (doc_id, ids) with the column `decoded` (binary): the bytes of the ids."""
    def work(columns):
        return [*columns, bpe(ranks, pattern).decode(columns[1])]

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_rows(encoded, ["doc_id", "ids"], f"doc_id {kind}, ids array<int>, decoded binary", work, 1_000_000, raw=True)
