"""Language-model scores of documents: a word unigram base, and context-tree weighting over bytes.

Context trees: every byte is coded as eight binary decisions. Each decision has a tree over the DEPTH
bytes before it, with a Krichevsky-Trofimov estimate at every node and the usual mixture of a node
with its children. All contexts of the documents are nodes. Counts come from the training documents: tasks count
(context, byte) codes, Spark adds them up. Codes met only in documents left out are rows with a count of
zero, which weigh nothing in the mixture and get the probability of a context that was never learnt.

Codes are numbers with the nearest byte first, so that a node is a range of them. Ranges of about PART codes are
mixed by one task each; only nodes cut by a bound between two ranges, DEPTH per bound, are added up
over ranges and closed on the driver. The outcome is a table of codes and their probabilities that grows with
the corpus. The most frequent codes are looked up in the task, all others are joined.

Unigrams: counts are a table; the most frequent words (a fixed number) are looked up in the task, which
also takes the hot keys away, all others are joined by hash.
"""

from math import log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_rows
from basketry.session import staged

DEPTH, CLASS_BITS = 5, 8
END = 3  # the byte that ends a text
FREQUENT = 1 << 15
#: Codes mixed by one task at a time, and codes looked up in the task instead of joined. Neither changes a result.
PART, CACHED = 1 << 19, 1 << 20
SAMPLED = 64  # codes of the sample per range, from which bounds are taken
SMALL = 1 << 12


def training(id: str = "doc_id") -> Column:
    """True for documents the model learns from; the tenth left out is told by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 10 != 0, F.lit(False))


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context-and-byte codes of texts, each with its end, and the number of each text's codes."""
    lead = bytes([10] * DEPTH)
    data = np.frombuffer(b"".join(lead + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    wide, code = data.astype(np.int64), np.zeros(len(data), np.int64)
    for back in range(DEPTH, 0, -1):  # the byte before in the lowest bits
        code[DEPTH:] = (code[DEPTH:] << CLASS_BITS) | wide[DEPTH - back:len(data) - back]
    code = (code << 8) | data
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    real = np.ones(len(data), bool)
    for k in range(DEPTH):
        real[starts + k] = False
    return code[real], sizes


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def _ranked(codes: np.ndarray) -> np.ndarray:
    """Codes with the nearest byte of the context in the highest bits instead of the lowest; the byte coded stays last."""
    order = [0, *range(DEPTH, 0, -1), *range(DEPTH + 1, 8)]
    return np.ascontiguousarray(np.ascontiguousarray(codes, "<i8").view(np.uint8).reshape(-1, 8)[:, order]).view("<i8").ravel()


def context_counts(docs: DataFrame, text: str = "text", trained: str = "trained") -> DataFrame:
    """Rows (code, n, uses): how often a byte follows a context in the training texts, and in all. Null texts are empty."""
    def work(columns):
        out = [[], [], []]
        for learnt in (True, False):
            texts = [_lower(t) for t, x in zip(*columns) if x == learnt]
            found, counts = np.unique(_codes(texts)[0], return_counts=True) if texts else [np.zeros(0, np.int64)] * 2
            for column, values in zip(out, (_ranked(found), counts * learnt, counts)):
                column.append(values)
        return [pa.array(np.concatenate(column), pa.int64()) for column in out]

    return map_rows(docs.select(F.col(text).alias("text"), F.col(trained).alias("trained")), ["text", "trained"],
                    "code long, n long, uses long", work, 8_000_000).groupBy("code").agg(
        F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    low = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - 1.1447298858494002


def _small_log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The same for counts that are mostly small, from a table."""
    total = zeros + ones
    steps = np.arange(SMALL, dtype=np.float64)
    half, whole = _log_gamma(steps + 0.5), _log_gamma(steps + 1)
    at = np.minimum(total, SMALL - 1)
    out = half[np.minimum(zeros, at)] + half[np.minimum(ones, at)] - whole[at] - 1.1447298858494002
    big = np.flatnonzero(total >= SMALL)
    out[big] = _log_kt(zeros[big].astype(np.float64), ones[big].astype(np.float64))
    return out


def _within(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `values` in the sorted `ids`, and whether they are there."""
    if not len(ids):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
    return at, ids[at] == values


def _weigh(log_kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's mixture with its children, and the share of the node's own estimate in it."""
    return np.logaddexp(log_kt, children) - np.log(2), 1 / (1 + np.exp(np.clip(children - log_kt, -700, 700)))


def mix(codes: np.ndarray, n: np.ndarray, cut: list[np.ndarray], known: list | None = None):
    """The trees over one range of sorted codes, contexts whole. `cut` are, by depth, the contexts that reach beyond it.

    Without `known`, arrays (depth, decision, zeros, ones, children) of the cut nodes: what this range adds to their
    counts and to the sum over their uncut children. With `known` (by depth: decisions, shares, estimates of cut
    nodes), the log10 probability of every code.
    """
    levels, ups = [(codes, n)], [None]
    for _ in range(DEPTH):
        below, counts = levels[0]
        shorter, up = np.unique((below >> 16 << 8) | (below & 255), return_inverse=True)
        levels.insert(0, (shorter, np.bincount(up, weights=counts).astype(np.int64)))
        ups.insert(1, up)
    logs, found = np.zeros(len(codes)), []
    for bit in range(8):
        ids, pairs, places, parents = [], [], [], []
        for d, (code, counts) in enumerate(levels):
            prefix = code >> (8 - bit)
            starts = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            first, place = np.flatnonzero(starts), np.cumsum(starts) - 1
            ones = np.add.reduceat(counts * (code >> (7 - bit) & 1), first)
            ids.append((code[first] >> 8 << 8) | (1 << bit) | ((code[first] & 255) >> (8 - bit)))
            pairs.append((np.add.reduceat(counts, first) - ones, ones))
            parents.append(places[-1][ups[d][first]] if d else None)
            places.append(place)
        shares, estimates, weighted = [None] * DEPTH + [1.0], [], None
        for d in range(DEPTH, -1, -1):
            zeros, ones = pairs[d]
            log_kt = _small_log_kt(zeros, ones)
            estimates.insert(0, (ones + 0.5) / (zeros + ones + 1))
            if d == DEPTH:
                weighted = log_kt
                continue
            children = np.bincount(parents[d + 1], weights=weighted, minlength=len(ids[d]))
            weighted, shares[d] = _weigh(log_kt, children)
            at, open_ = _within(cut[d], ids[d] >> 8)
            open_ = np.flatnonzero(open_)
            weighted[open_] = 0  # added to its parent once all ranges have been seen
            if known is None:
                found.append((np.full(len(open_), d), ids[d][open_], zeros[open_], ones[open_], children[open_]))
            elif len(open_):
                at = np.searchsorted(known[d][0], ids[d][open_])
                shares[d][open_], estimates[0][open_] = known[d][1][at], known[d][2][at]
        if known is None:
            continue
        one, reach = shares[0] * estimates[0], 1 - shares[0]
        for d in range(1, DEPTH + 1):
            one, reach = one[parents[d]], reach[parents[d]]
            one, reach = one + reach * shares[d] * estimates[d], reach * (1 - shares[d])
        one = np.clip(one, 1e-12, 1 - 1e-12)[places[DEPTH]]
        logs += np.log10(np.where(codes >> (7 - bit) & 1, one, 1 - one))
    return logs if known is not None else [np.concatenate(x) for x in zip(*found)]


def close(parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By depth the sorted decisions of cut nodes with their shares and estimates, from what all ranges add to them."""
    depth, ids, zeros, ones, children = parts
    out, below = [], None
    for d in range(DEPTH - 1, -1, -1):
        rows = np.flatnonzero(depth == d)
        node, at = np.unique(ids[rows], return_inverse=True)
        z, o, inner = (np.bincount(at, weights=x[rows], minlength=len(node)) for x in (zeros, ones, children))
        if below is not None and len(below[0]):
            np.add.at(inner, np.searchsorted(node, (below[0] >> 16 << 8) | (below[0] & 255)), below[1])
        weighted, share = _weigh(_log_kt(z, o), inner)
        below = node, weighted
        out.insert(0, (node, share, (o + 0.5) / (z + o + 1)))
    return out


def code_scores(counts: DataFrame, part: int | None = None) -> DataFrame:
    """Rows (code, uses, value) of `counts` (code, n, uses): the log10 probability of the byte after its context."""
    spark = counts.sparkSession
    ranges = max(1, -(-counts.count() // (part or PART)))
    every = max(1, (part or PART) // SAMPLED)
    sample = np.sort(np.asarray(counts.where(F.pmod(F.xxhash64("code"), F.lit(every)) == 0).select(
        F.shiftright("code", 8).alias("context")).toArrow().column("context")))
    bounds = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges]) if len(sample) else sample
    cut = [np.unique(bounds >> 8 * (DEPTH - d)) for d in range(DEPTH)]

    def place(columns):
        code = columns[0].to_numpy(zero_copy_only=False)
        return [pa.array(np.searchsorted(bounds, code >> 8, side="right"), pa.int32()), *columns]

    def arrays(rows: pa.Table) -> list[np.ndarray]:
        code, n, uses = (rows.column(c).to_numpy() for c in ("code", "n", "uses"))
        order = np.argsort(code)
        return [code[order], n[order], uses[order]]

    def add(rows: pa.Table) -> pa.Table:
        code, n, _ = arrays(rows)
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x.astype(k.to_pandas_dtype())) for x, k in zip(mix(code, n, cut), kinds)],
                        ["depth", "decision", "zeros", "ones", "children"])

    placed = map_rows(counts, ["code", "n", "uses"], "part int, code long, n long, uses long", place, 1_000_000, raw=True).groupBy("part")
    known = spark.sparkContext.broadcast([])
    if len(bounds):
        sums = placed.applyInArrow(add, "depth int, decision long, zeros double, ones double, children double").toArrow()
        known = spark.sparkContext.broadcast(close([sums.column(c).to_numpy() for c in sums.column_names]))

    def finish(rows: pa.Table) -> pa.Table:
        code, n, uses = arrays(rows)
        return pa.table([code, uses, mix(code, n, cut, known.value)], ["code", "uses", "value"])

    return placed.applyInArrow(finish, "code long, uses long, value double")


class Tree:
    """The same trees held in memory whole, for a small corpus: log10 P(byte | deepest node) by node, and the nodes by depth."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        firsts = np.cumsum([0] + [len(x) for x, _ in levels])
        self.table = np.zeros((firsts[-1], 256), np.float32)
        parents = [None] + [np.searchsorted(levels[d - 1][0], levels[d][0] & ((1 << CLASS_BITS * (d - 1)) - 1))
                            for d in range(1, len(levels))]
        for bit in range(8):
            for low in range(0, 1 << bit, 16):  # decisions do not depend on each other
                self._decide(levels, parents, firsts, bit, slice(low, min(low + 16, 1 << bit)))
        self.firsts, self.nodes = firsts, [x for x, _ in levels]

    def _decide(self, levels, parents, firsts, bit: int, some: slice) -> None:
        """Adds the log-probabilities of some of the decisions at a bit to every node's row."""
        shape = (-1, 1 << bit, 2, 1 << (7 - bit))
        splits = [dense.reshape(shape)[:, some].sum(axis=-1, dtype=np.float64) for _, dense in levels]
        stops, estimates, rests = [None] * len(levels), [None] * len(levels), [None] * len(levels)
        below = None
        for d in range(len(levels) - 1, -1, -1):
            zeros, ones = splits[d][..., 0], splits[d][..., 1]
            log_kt = _log_kt(zeros, ones)
            estimates[d] = (ones + 0.5) / (zeros + ones + 1)
            weighted = log_kt
            if d + 1 < len(levels):
                zeros_left, ones_left, children = zeros.copy(), ones.copy(), np.zeros_like(log_kt)
                inner = np.zeros(len(zeros), bool)
                inner[parents[d + 1]] = True
                np.subtract.at(zeros_left, parents[d + 1], splits[d + 1][..., 0])
                np.subtract.at(ones_left, parents[d + 1], splits[d + 1][..., 1])
                np.add.at(children, parents[d + 1], below)
                children += _log_kt(zeros_left, ones_left)
                stops[d] = np.where(inner[:, None], 1 / (1 + np.exp(np.clip(children - log_kt, -700, 700))), 1)
                rests[d] = (ones_left + 0.5) / (zeros_left + ones_left + 1)
                weighted = np.where(inner[:, None], np.logaddexp(log_kt, children) - np.log(2), log_kt)
            below = weighted
        one, reach = 0.0, 1.0
        for d in range(len(levels)):
            if d:
                one, reach = one[parents[d]], reach[parents[d]]
            stop = 1.0 if stops[d] is None else stops[d]
            one = one + reach * stop * estimates[d]
            reach = reach * (1 - stop) if stops[d] is not None else np.zeros_like(one)
            final = np.clip(one + (reach * rests[d] if rests[d] is not None else 0), 1e-12, 1 - 1e-12)
            bits = np.stack([np.log10(1 - final), np.log10(final)], axis=-1).astype(np.float32)
            self.table[firsts[d]:firsts[d + 1]].reshape(shape)[:, some] += bits[..., None]

    def parts(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        return self.table, self.firsts, self.nodes


def log10_of(codes: np.ndarray, table: np.ndarray, firsts: np.ndarray, nodes: list[np.ndarray]) -> np.ndarray:
    """The log-probabilities of (context, byte) codes, nearest byte lowest, from the parts of a tree."""
    node = np.zeros(codes.shape, np.int64)
    for d, at_depth in enumerate(nodes):
        at, there = _within(at_depth, (codes >> 8).ravel() & ((1 << CLASS_BITS * d) - 1))
        node = np.where(there.reshape(codes.shape), firsts[d] + at.reshape(codes.shape), node)
    return table[node, codes & 255]


def _hashes(words: list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in words]


END_WORD = xxhash.xxh3_64_intdigest(b" ") - (1 << 63)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (word, n): 64-bit hashes of lower-cased words of `docs` and their counts; each text has one end."""
    def work(columns):
        counts: dict[bytes, int] = {}
        for t in columns[0]:
            for w in _lower(t).split():
                counts[w] = counts.get(w, 0) + 1
        return [_hashes(list(counts)) + [END_WORD], [*counts.values(), len(columns[0])]]

    return map_rows(docs.select(F.col(text).alias("text")), ["text"], "word long, n long", work, 16_000_000).groupBy(
        "word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows whose `training` is true are learnt from, all are scored. Null texts are empty: one end token.
    A null id is held out. Rows that repeat an id are learnt from and scored one by one. Without training
    documents every word is unknown and bytes are uniform. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), training(id).alias("trained"))
    learnt = named.where("trained")
    counts = staged(word_counts(learnt), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    frequent = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist()))
    values = staged(code_scores(staged(context_counts(named), "context-counts")), "code-scores")
    often = values.groupBy("uses").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("uses")).toArrow()
    fit = np.flatnonzero(np.cumsum(np.asarray(often.column("n"))) <= CACHED)
    least = int(np.asarray(often.column("uses"))[fit[-1]]) if len(fit) else 1 << 62
    cached = values.where(F.col("uses") >= least).select("code", "value").toArrow()
    order = np.argsort(np.asarray(cached.column("code")))
    held = [np.asarray(cached.column(c))[order] for c in ("code", "value")]
    shared = spark.sparkContext.broadcast((frequent, *held))
    scale = float(np.log10(total + 0.1 * (distinct + 1)))
    unknown = float(np.log10(0.1))

    def work(columns):
        known, cached_codes, cached_values = shared.value
        texts = list(map(_lower, columns[1]))
        codes, sizes = _codes(texts)
        codes, where = np.unique(codes, return_inverse=True)
        codes = _ranked(codes)
        at, there = _within(cached_codes, codes)
        found = np.where(there, cached_values[at], 0.0) if len(cached_codes) else np.zeros(len(codes))
        starts, missed = np.cumsum(sizes) - sizes, ~there[where]
        byte_score = np.add.reduceat(found[where], starts)
        ends = np.cumsum(np.add.reduceat(missed.astype(np.int64), starts))
        deep = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(codes[where[missed]], pa.int64()))
        rows = []
        for key, t, size, value in zip(columns[0], texts, sizes.tolist(), byte_score.tolist()):
            words: dict[bytes, int] = {}
            for w in t.split():
                words[w] = words.get(w, 0) + 1
            hashes, times = _hashes(list(words)) + [END_WORD], [*words.values(), 1]
            seen = [known.get(h, 0) for h in hashes]
            base = sum(k * log10(c + 0.1) for c, k in zip(seen, times) if c)
            rows.append((key, sum(times), sum(k for c, k in zip(seen, times) if c), base + 0.0, value, size,
                         [h for h, c in zip(hashes, seen) if not c], [k for k, c in zip(times, seen) if not c]))
        return [*map(list, zip(*rows)), deep]

    kind = docs.schema[id].dataType.simpleString()
    scored = staged(map_rows(
        named, ["doc_id", "text"],
        f"doc_id {kind}, n_tokens long, n_frequent long, base double, score double, n_bytes long, "
        "rare array<long>, times array<long>, deep array<long>", work, 1_000_000).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare"),
        F.sum(F.col("times") * F.coalesce(F.log10(F.col("n") + 0.1), F.lit(unknown))).alias("rare_score"))
    deeper = scored.select("row", F.explode("deep").alias("code")).join(values.select("code", "value"), "code").groupBy("row").agg(
        F.sum("value").alias("deep_score"))
    return scored.join(found, "row", "left").join(deeper, "row", "left").select(
        "doc_id", (~training("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_score", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("score") + F.coalesce("deep_score", F.lit(0.0))).alias("score"), "n_bytes").withColumn(
        "bits_per_byte", -F.col("score") / F.col("n_bytes") * float(np.log2(10)))
