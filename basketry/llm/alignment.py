"""Aligns the tokens of two tokenisers by bytes and scores links by how many documents hold them.

Tokens of A (byte-level BPE) and of B (pieces with byte fallback) are cut into groups where both end at
the same byte. Within a group every token of A is linked with every token of B.

Pairs of ids live in an inverted index: one compressed bitmap of documents per pair and block of
documents, and planes with the binary digits of (multiplicity - 1) beside it. Parts of a bitmap are merged
by OR and counted: the presence bitmaps give documents per pair, the planes links per pair. The
same postings then carry the counts back, and every document sums what its links score.

Texts are tokenised once: no token of either side reaches from a character that is no white space over a
following space, so a text is the sequence of its stretches between such places, and a slice of texts
aligns its distinct stretches only.
"""

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import per_worker
from basketry.session import staged

#: Documents of a block, whose numbers fit 16 bits, and postings after which a block or a part of it ends.
BLOCK, BLOCK_POSTINGS, PART_POSTINGS = 1 << 16, 16_000_000, 2_000_000
#: From so many documents on a bitmap is BLOCK plain bits instead of sorted 16-bit numbers.
DENSE = BLOCK // 16
SLICE = 3_000_000
_CUT = re.compile(r"(?<=\S)(?= )")
_GLUED = re.compile(r"\s ")


def _byte_of() -> dict[str, int]:
    """The bytes that the usual printable stand-ins of byte-level vocabularies mean."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class _TokensA:
    """Ids and bytes of a byte-level BPE file; ids in the order of the merges are ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(model["vocab"]) - len(merges)
        if any(model["vocab"][a + b] != first + i for i, (a, b) in enumerate(merges)):
            raise ValueError("ids of the first vocabulary are not in the order of its merges")
        of = _byte_of()
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items()}
        self.bytes = {i: token for token, i in ranks.items()}
        self.encode = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _TokensB:
    """Ids and bytes of a piece model that adds a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model, self.bytes = model, {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        #: No piece reaches over a space that follows something else.
        self.by_words = not any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.vocab_size()))

    def encode(self, stretches: list[str]) -> list[list[int]]:
        """Ids of " " + stretch; a lone space needs a letter before it, as an empty text has no tokens."""
        ids = self.model.encode(stretches, num_threads=1)
        if "" in stretches:
            lone = self.model.encode("x ")[len(self.model.encode("x")):]
            ids = [lone if s == "" else i for s, i in zip(stretches, ids)]
        return ids


def _crossed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and numbers of the links of one long group, by the counts of its ids."""
    (ids_a, n_a), (ids_b, n_b) = (np.unique(x, return_counts=True) for x in (a, b))
    return (ids_a[:, None] << 32 | ids_b[None, :]).ravel(), (n_a[:, None] * n_b[None, :]).ravel()


class Linked:
    """Alignments of several stretches: facts (n_a, n_b, n_groups, n_links) and groups of each, and their pairs in turn."""

    def __init__(self, facts, named, codes, counts, sizes):
        self.facts, self.named, self.codes, self.counts, self.sizes = facts, named, codes, counts, sizes


def _parts(flat: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per place the `n` items of `flat` from `before` on, in turn."""
    ends = np.cumsum(n)
    return flat[np.repeat(before - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)]


class Aligner:
    """Aligns texts; distinct stretches of a slice are encoded once, all in one string per tokeniser."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.a, self.b = _TokensA(path_a, pattern), _TokensB(path_b)
        self.length_a, self.length_b = (np.zeros(max(t.bytes) + 1, np.int64) for t in (self.a, self.b))
        for lengths, tokens in ((self.length_a, self.a), (self.length_b, self.b)):
            for i, data in tokens.bytes.items():
                lengths[i] = len(data)
        self.size = max(len(self.length_a), len(self.length_b))
        self.names = pa.array([str(i).encode() + end for end in (b",", b"|", b";", b"") for i in range(self.size)], pa.large_binary())

    def stretches(self, text: str) -> list[str]:
        """The parts of " " + text, each without the space it starts with."""
        if not self.b.by_words:
            return [text]
        if text.startswith(" ") or _GLUED.search(text):
            return [part[1:] for part in _CUT.split(" " + text)]
        return text.split(" ")

    def tokens(self, stretches: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of A and B of each " " + stretch, encoded alone; None where either does not spell it."""
        out = []
        for stretch, b in zip(stretches, self.b.encode(stretches)):
            whole, a = (" " + stretch).encode("utf-8", "surrogatepass"), self.a.encode(" " + stretch)
            spelt = all(b"".join([t.bytes[i] for i in ids]) == whole for t, ids in ((self.a, a), (self.b, b)))
            out.append((a, b) if spelt else None)
        return out

    def joint(self, stretches: list[str]) -> tuple[list[int], list[int]] | None:
        """Ids of all stretches, each with its space, in turn; None where they do not spell them or do not end with them."""
        if not self.b.by_words or any(not s or s[-1].isspace() for s in stretches):
            return None
        whole = " ".join(stretches)
        a, b = self.a.encode(" " + whole), self.b.model.encode(whole, num_threads=1)
        data = (" " + whole).encode("utf-8", "surrogatepass")
        return (a, b) if all(b"".join([t.bytes[i] for i in ids]) == data for t, ids in ((self.a, a), (self.b, b))) else None

    def linked(self, a: list[int], b: list[int], ends: np.ndarray) -> Linked:
        """Alignment of the tokens of stretches that end at the bytes `ends`."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        before_a, before_b = np.concatenate(([0], last_a[:-1] + 1)), np.concatenate(([0], last_b[:-1] + 1))
        n_a, n_b = last_a + 1 - before_a, last_b + 1 - before_b
        of_a, of_b = np.repeat(np.arange(len(cuts)), n_a), np.repeat(np.arange(len(cuts)), n_b)
        links = n_a * n_b
        stop = np.searchsorted(cuts, ends) + 1  # groups up to the end of each stretch
        start = np.concatenate(([0], stop[:-1]))
        long = links > 64
        reach = np.where(long, 0, n_b)[of_a]
        codes = np.repeat(a, reach) << 32 | _parts(b, before_b[of_a], reach)
        counts = np.ones(len(codes), np.int64)
        groups, sizes = np.repeat(of_a, reach), None
        if long.any():
            more = [_crossed(a[before_a[g]:last_a[g] + 1], b[before_b[g]:last_b[g] + 1]) for g in np.flatnonzero(long)]
            groups = np.concatenate([groups, np.repeat(np.flatnonzero(long), [len(m[0]) for m in more])])
            codes, counts = (np.concatenate([x, *(m[k] for m in more)]) for k, x in enumerate((codes, counts)))
            order = np.argsort(groups, kind="stable")
            codes, counts, groups = codes[order], counts[order], groups[order]
        sizes = np.searchsorted(groups, stop) - np.searchsorted(groups, start)
        # names: the tokens of a group of A, then of B, each with what separates it from the next
        name = np.empty(len(a) + len(b), np.int64)
        name[np.arange(len(a)) + before_b[of_a]] = a
        name[np.arange(len(b)) + last_a[of_b] + 1] = b
        name[last_a + before_b] += self.size
        name[last_a + last_b + 1] += 2 * self.size
        final = (last_a + last_b + 1)[stop - 1]
        name[final] += self.size
        written = self.names.take(pa.array(name))
        offsets = np.frombuffer(written.buffers()[1], np.int64)[:len(name) + 1]
        data = written.buffers()[2].to_pybytes()
        to = offsets[final + 1].tolist()
        named = [data[x:y] for x, y in zip([0] + to[:-1], to)]
        total = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(np.stack([n_a, n_b, links], 1), 0)))
        sums = total[stop] - total[start]
        return Linked(np.stack([sums[:, 0], sums[:, 1], stop - start, sums[:, 2]], 1), named, codes, counts, sizes)

    def alignments(self, stretches: list[str]) -> tuple[np.ndarray, Linked]:
        """Which stretches tokens spell, and their alignment; the others have nothing."""
        sizes = np.array([len(s.encode("utf-8", "surrogatepass")) + 1 for s in stretches], np.int64)
        both = self.joint(stretches)
        spelt = np.ones(len(stretches), bool)
        if both is None:
            alone = self.tokens(stretches)
            spelt = np.array([x is not None for x in alone], bool)
            both = [i for x in alone if x for i in x[0]], [i for x in alone if x for i in x[1]]
        if not spelt.any():
            return spelt, Linked(np.zeros((len(stretches), 4), np.int64), [b""] * len(stretches), np.zeros(0, np.int64),
                                 np.zeros(0, np.int64), np.zeros(len(stretches), np.int64))
        made = self.linked(*both, np.cumsum(sizes[spelt]))
        if not spelt.all():
            facts, n, names = np.zeros((len(stretches), 4), np.int64), np.zeros(len(stretches), np.int64), iter(made.named)
            facts[spelt], n[spelt] = made.facts, made.sizes
            made = Linked(facts, [next(names) if s else b"" for s in spelt], made.codes, made.counts, n)
        return spelt, made

    def slice(self, texts: list[str | None]) -> tuple:
        """Per text [n_a, n_b, n_groups, n_links] and groups (b"" without tokens), then (text, code, count) of its linked pairs."""
        parts = [self.stretches(t) if t else [] for t in texts]
        distinct = set().union(*parts)
        # those that may end a text in white space go alone
        plain = [s for s in distinct if s and not s[-1].isspace()]
        other = [s for s in distinct if not s or s[-1].isspace()]
        (ok_1, one), (ok_2, two) = self.alignments(plain), self.alignments(other)
        spelt, named = np.concatenate([ok_1, ok_2]), one.named + two.named
        facts, codes, counts, sizes = (np.concatenate([getattr(one, k), getattr(two, k)]) for k in ("facts", "codes", "counts", "sizes"))
        place = dict(zip(plain + other, range(len(named)))).__getitem__
        at = np.array([place(s) for p in parts for s in p], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        bad = np.zeros(len(texts), bool)
        bad[row[~spelt[at]]] = True
        strings = [b"" if b or not p else b";".join([named[place(s)] for s in p]) for p, b in zip(parts, bad)]
        good = ~bad[row]
        at, row = at[good], row[good]
        total = np.zeros((len(texts), 4), np.int64)
        np.add.at(total, row, facts[at])
        width = max(1, len(named))
        once, times = np.unique(row * width + at, return_counts=True)
        row, at = once // width, once % width
        before = np.concatenate(([0], np.cumsum(sizes)))[at]
        n = sizes[at]
        return total, strings, np.repeat(row, n), _parts(codes, before, n), _parts(counts, before, n) * np.repeat(times, n)


# bitmaps -----------------------------------------------------------------------------------------

def bitmap(numbers: np.ndarray) -> bytes:
    """Sorted distinct numbers below BLOCK as a compressed bitmap."""
    if len(numbers) < DENSE:
        return numbers.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[numbers] = 1
    return np.packbits(bits).tobytes()


def members(data: bytes) -> np.ndarray:
    """The sorted numbers of a bitmap."""
    if len(data) < 2 * DENSE:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def merged(parts: list[bytes]) -> bytes:
    """The OR of bitmaps."""
    if sum(map(len, parts)) < 2 * DENSE:
        return bitmap(np.unique(np.concatenate([members(p) for p in parts])))
    bits = np.zeros(BLOCK // 8, np.uint8)
    for part in parts:
        if len(part) == 2 * DENSE:
            bits |= np.frombuffer(part, np.uint8)
        else:
            spread = np.zeros(BLOCK, np.uint8)
            spread[members(part)] = 1
            bits |= np.packbits(spread)
    return bitmap(np.flatnonzero(np.unpackbits(bits)))


def popcount(data: bytes) -> int:
    if len(data) < 2 * DENSE:
        return len(data) // 2
    return int(np.bitwise_count(np.frombuffer(data, np.uint64)).sum())


def _bitmaps(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Per distinct code the bitmap of its rows; input is sorted by both."""
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(codes))
    data = rows.astype("<u2").tobytes()
    return codes[starts], [data[2 * s:2 * e] if e - s < DENSE else bitmap(rows[s:e])
                           for s, e in zip(starts.tolist(), ends.tolist())]


def planes_of(codes: np.ndarray, rows: np.ndarray, counts: np.ndarray):
    """Yields (plane, codes, bitmaps): 0 holds all rows of a code, k those with digit k - 1 of (count - 1) set."""
    order = np.lexsort((rows, codes))
    codes, rows, counts = codes[order], rows[order], counts[order]
    if not len(codes):
        return
    first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1]))))
    counts = np.add.reduceat(counts, first)
    codes, rows = codes[first], rows[first]
    yield 0, *_bitmaps(codes, rows)
    for k in range(int(counts.max() - 1).bit_length()):
        has = (counts - 1 >> k & 1).astype(bool)
        yield k + 1, *_bitmaps(codes[has], rows[has])


# operators ---------------------------------------------------------------------------------------

def _aligner(paths: tuple) -> Aligner:
    return per_worker(("aligner", *paths), lambda: Aligner(*paths))


def _slices(batch: pa.RecordBatch):
    """(ids, texts) of up to SLICE characters, or of one longer text."""
    keys, texts = batch.column(0), batch.column(1).to_pylist()
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE or i == len(texts) - 1:
            yield keys.slice(start, i + 1 - start), texts[start:i + 1]
            start, size = i + 1, 0


def align(docs: DataFrame, vocabulary_a: str, pattern: str, model_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, groups) of all rows of `docs`, without scores.

    `groups` reads `a1,a2|b1;a3|b2,b3`: ids of A and B per group. Null and empty texts, and those whose
    tokens do not spell space + text, have no tokens: zeros and an empty string. Rows are taken as they
    are, null and repeated ids too.
    """
    from basketry.llm.common import map_rows

    def work(columns):
        counts, strings, *_ = _aligner((vocabulary_a, pattern, model_b)).slice(columns[1])
        return [columns[0], *counts.T.tolist(), [s.decode() for s in strings]]

    kind = docs.schema[id].dataType.simpleString()
    named = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(named, ["doc_id", "text"], f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string",
                    work, SLICE)


def alignments(docs: DataFrame, vocabulary_a: str, pattern: str, model_b: str, id: str, text: str) -> DataFrame:
    """A written table of two kinds of rows from one pass: documents (block, at, doc_id and counts, groups as
    SHA-256) and parts of bitmaps (block, pair, plane, bitmap), `pair` being null for documents.

    A block is a run of at most BLOCK documents of one task; the written table fixes the numbers. Memory:
    PART_POSTINGS postings and one slice of texts; one text's postings are its distinct pairs at most.
    """
    from pyspark import TaskContext

    kind = docs.schema[id].dataType.simpleString()
    schema = (f"block long, at int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pair long, plane int, bitmap binary")
    from basketry.llm.common import _arrow_schema
    arrow = _arrow_schema(docs.sparkSession, schema)
    paths = (vocabulary_a, pattern, model_b)

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            (columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type))
            if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches):
        number = TaskContext.get().partitionId()
        block, used, postings, held = number << 32, 0, 0, []

        def flush():
            if held:
                codes, rows, counts = (np.concatenate(x) for x in zip(*held))
                for plane, pairs, bitmaps in planes_of(codes, rows, counts):
                    for at in range(0, len(pairs), 50_000):
                        some = slice(at, at + 50_000)
                        n = len(pairs[some])
                        yield batch_of(n, block=np.full(n, block), pair=pairs[some], plane=np.full(n, plane), bitmap=bitmaps[some])
                held.clear()

        for batch in batches:
            for keys, texts in _slices(batch):
                for start in range(0, len(texts), BLOCK):
                    some = texts[start:start + BLOCK]
                    if used + len(some) > BLOCK or postings > BLOCK_POSTINGS:
                        yield from flush()
                        block, used, postings = block + 1, 0, 0
                    counts, strings, rows, codes, sums = _aligner(paths).slice(some)
                    yield batch_of(
                        len(some), block=np.full(len(some), block), at=np.arange(used, used + len(some)),
                        doc_id=keys.slice(start, len(some)).cast(arrow.field("doc_id").type),
                        **{name: counts[:, k] for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                        groups_sha256=[hashlib.sha256(s).hexdigest() if s else "" for s in strings])
                    held.append((codes, rows + used, sums))
                    used, postings = used + len(some), postings + len(codes)
                    if sum(len(h[0]) for h in held) > PART_POSTINGS:
                        yield from flush()
        yield from flush()

    named = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return staged(named.mapInArrow(run, schema), "alignments")


def pair_index(parts: DataFrame) -> DataFrame:
    """Postings (pair, block, plane, bitmap, n): parts of one pair, block and plane merged by OR, and counted.

    The key holds the block, so a pair that all documents hold is spread over all blocks of documents.
    """
    schema = "pair long, block long, plane int, bitmap binary, n long"
    from basketry.llm.common import _arrow_schema
    arrow = _arrow_schema(parts.sparkSession, schema)

    def run(batches):
        key, held = None, []

        def done(keys, bitmaps):
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], arrow.field(i).type) for i in range(3)] + [
                pa.array(bitmaps, pa.binary()).cast(arrow.field(3).type), pa.array([popcount(b) for b in bitmaps], pa.int64())], schema=arrow)

        for batch in batches:
            keys, bitmaps = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] == key:
                    held.append(row[3])
                    continue
                if held:
                    keys.append(key)
                    bitmaps.append(held[0] if len(held) == 1 else merged(held))
                key, held = row[:3], [row[3]]
            if keys:
                yield done(keys, bitmaps)
        if held:
            yield done([key], [held[0] if len(held) == 1 else merged(held)])

    dealt = parts.select("pair", "block", "plane", "bitmap").repartition("pair", "block").sortWithinPartitions("pair", "block", "plane")
    return staged(dealt.mapInArrow(run, schema), "pair-index")


def pair_table(index: DataFrame) -> DataFrame:
    """Rows (pair, a, b, n_docs, n_links, best): counts over all documents; best if no pair of `a` has more documents."""
    counted = index.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("n_docs"),
        F.sum(F.col("n") * F.pow(F.lit(2.0), F.greatest(F.col("plane") - 1, F.lit(0))).cast("long")).alias("n_links"))
    counted = staged(counted.select("pair", F.shiftright("pair", 32).cast("int").alias("a"),
                                    F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n_docs", "n_links"), "pairs")
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))  # at most one row per id of A
    return counted.join(most, "a").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("most")).alias("best"))


def document_scores(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (block, at, count_sum, n_best): the postings of a block add what each link scores to its documents."""
    schema = "block long, at int, count_sum long, n_best long"
    from basketry.llm.common import _arrow_schema
    arrow = _arrow_schema(index.sparkSession, schema)

    def run(batches):
        block, sums, best = None, None, None

        def done():
            if block is not None:
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(sums[at]),
                                                  pa.array(best[at])], schema=arrow)

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]))
            for start, end in zip(cuts, cuts[1:]):
                if end == start:
                    continue
                if blocks[start] != block:
                    yield from done()
                    block, sums, best = blocks[start], np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
                part = batch.slice(start, end - start)
                numbers = [members(b) for b in part.column(2).to_pylist()]
                n = [len(x) for x in numbers]
                at = np.concatenate(numbers)
                times = np.int64(1) << np.maximum(part.column(1).to_numpy().astype(np.int64) - 1, 0)
                np.add.at(sums, at, np.repeat(times * part.column(3).to_numpy(), n))
                np.add.at(best, at, np.repeat(times * part.column(4).to_numpy(zero_copy_only=False), n))
        yield from done()

    met = index.join(pairs.select("pair", "n_docs", "best"), "pair")
    dealt = met.select("block", "plane", "bitmap", "n_docs", "best").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, schema)


def aligned_documents(docs: DataFrame, vocabulary_a: str, pattern: str, model_b: str, id: str = "doc_id",
                      text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row of `docs` (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the `pair_table`.

    A row is a document: null and repeated ids are rows of their own and counted each. An id pair's
    count is the number of documents that hold it linked; `n_best` are links whose count is the highest of
    their A id, ties included; `count_sum` adds the counts of all links. Null and empty texts, and those
    that tokens do not spell, have zeros and ''. Empty tables stay empty; other columns are not read.
    """
    both = alignments(docs, vocabulary_a, pattern, model_b, id, text)
    index = pair_index(both.where("pair IS NOT NULL"))
    pairs = staged(pair_table(index), "pair-table")
    scores = staged(document_scores(index, pairs), "scores")
    rows = both.where("pair IS NULL").join(scores, ["block", "at"], "left")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"), pairs
