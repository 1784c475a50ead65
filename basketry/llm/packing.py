"""Packs tokenised documents into sequences of a fixed length by exact complements, then best fit.

Only the histogram of piece lengths (at most `capacity` numbers) is planned on the driver. The plan is
a list of patterns - lengths that share a sequence - with the number of sequences of each. Pieces
find their place by their rank among the pieces of their length: ranks come from counts per bucket,
so no task ever holds or sorts all pieces of one length.
"""

import os
import re
import struct
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from basketry.llm.common import map_rows, per_worker
from basketry.session import staged

#: Words kept between slices: at most twice as many, besides those of one slice. Idle workers keep them through other stages.
KNOWN_WORDS = 150_000
#: Words of these characters, in which no special token can start, meet a vocabulary's normaliser and
#: splitter as follows: lower case, then pieces; each byte of a piece stands for one character.
PLAIN = re.compile("(?:[!-;=-~\u00c0-\u00ff]|<(?![|]))+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_characters() -> dict[int, str]:
    """The usual printable stand-ins of bytes: themselves where printable, else 256 and up in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Ids of white-space free words as little-endian unsigned 32-bit bytes; words seen before are looked up.

    The vocabulary's normaliser and splitter never join across ASCII white space, so the ids of a text
    are those of its words. `quick` takes plain words straight to the merges; it holds for vocabularies
    that lower-case and split as PIECES does, which is tried on probe words first.
    """

    PROBES = ["It's", "don't", "x'RE9", "A1b22", "(Ab.c),", "<b>x</b>", "\u00c9t\u00e9", "stra\u00dfe\u00d7\u00f72", "a_b-c=d", "''ll", "\u00c0\u00d6\u00d8\u00de\u00ff"]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.characters = _byte_characters()
        try:
            self.quick = [self._quick(w) for w in self.PROBES] == self._slow(self.PROBES)
        except (AttributeError, TypeError):  # a model without tokenize(), or one that takes other arguments
            self.quick = False

    def _quick(self, word: str) -> bytes:
        ids = [t.id for piece in PIECES.findall(word.lower()) for t in self.tokenizer.model.tokenize(
            piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.characters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _slow(self, words: list[str]) -> list[bytes]:
        return [np.array(c.ids, "<u4").tobytes() for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        coded = words.flatten().dictionary_encode()
        ids = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[:len(ids) + 1][np.concatenate(([0], np.cumsum(counts)))].tolist()
        data = ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b""
        return [data[x:y] for x, y in zip(ends, ends[1:])]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Once KNOWN_WORDS are known they become the older ones, of which those met again stay."""
        found = list(map(self.known.get, words))
        new, other = [], []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            found[i] = self.older.pop(words[i], None)
            if found[i] is None:
                new.append(i)
            else:
                self.known[words[i]] = found[i]
        for i in new:
            word = words[i]
            if self.quick and len(word) < 64 and (not word or PLAIN.fullmatch(word)):
                found[i] = self._quick(word)
            else:
                other.append(i)
        for start in range(0, len(other), 20_000):
            part = other[start:start + 20_000]
            for i, ids in zip(part, self._slow([words[i] for i in part])):
                found[i] = ids
        self.known.update((words[i], found[i]) for i in new)
        if len(self.known) > KNOWN_WORDS:
            self.older, self.known = self.known, {}
        return found


def _words(path: str) -> Words:
    return per_worker(("words", path), lambda: Words(path))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids) of every row of `docs`; ids are little-endian uint32 bytes.

    A document is its ids and one `end`; only documents longer than `capacity` are cut, each `capacity`
    ids. A null or empty text is the end id alone. Repeated rows give their pieces again.
    """
    def work(columns):
        rows, cut, last = [], 4 * capacity, np.uint32(end).astype("<u4").tobytes()
        for key, ids in zip(columns[0], _words(vocabulary).encode(columns[1])):
            ids += last
            rows += [(key, n, at // 4, min(cut, len(ids) - at) // 4, ids[at:at + cut])
                     for n, at in enumerate(range(0, len(ids), cut))]
        return list(map(list, zip(*rows)))

    kind = docs.schema[id].dataType.simpleString()
    named = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(named, ["doc_id", "text"], f"doc_id {kind}, piece int, start long, length long, ids binary", work,
                    weight=2_000_000)


class _Counts:
    """How many pieces of each length are left, with the sums that pairs of available lengths make."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.n[length] = n
        here = (self.n > 0).astype(np.float64)
        size = 1 << int(np.ceil(np.log2(2 * capacity + 2)))
        spectrum = np.fft.rfft(here, size)
        self.pairs = np.rint(np.fft.irfft(spectrum * spectrum, size))[:capacity + 1].astype(np.int64)  # ordered pairs by sum

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if self.n[length] == 0:
            others = np.flatnonzero(self.n > 0)
            others = others[others + length < len(self.pairs)]
            self.pairs[others + length] -= 2
            if 2 * length < len(self.pairs):
                self.pairs[2 * length] -= 1

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.n[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with the largest part that sums to `gap`; equal parts need two pieces."""
        if gap < 2 or self.pairs[gap] <= 0:
            return None
        small = np.arange(1, gap // 2 + 1)
        fits = (self.n[small] > 0) & (self.n[gap - small] > 0) & ((2 * small < gap) | (self.n[small] > 1))
        at = np.flatnonzero(fits)
        return (gap - int(small[at[0]]), int(small[at[0]])) if len(at) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        if gap < 3:
            return None
        first = np.arange(gap - 2, 0, -1)
        for a in first[(self.n[first] > 0) & (self.pairs[gap - first] > 0)]:
            self.n[a] -= 1
            rest = self.pair(int(gap - a))
            self.n[a] += 1
            if rest:
                return (int(a), *rest)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their numbers of sequences for so many pieces of each length.

    From the longest length down, the gap beside it is filled exactly by one, two or three available
    lengths, as often as counts allow; each combination taken uses up a length, so there are at most as
    many as lengths. What has no exact complement goes by best fit, longest first, group by group.
    """
    left, made = _Counts(counts, capacity), []
    for length in range(capacity, 0, -1):
        while left.n[length] > 0:
            gap, have = capacity - length, int(left.n[length])
            left.n[length] -= 1
            rest = () if gap == 0 else left.single(gap) or left.pair(gap) or left.triple(gap)
            left.n[length] += 1
            if rest is None:
                break
            pattern = (length, *rest)
            need = {x: pattern.count(x) for x in pattern}
            times = min(int(left.n[x]) // k for x, k in need.items())
            for x, k in need.items():
                left.take(x, k * times)
            made.append((pattern, times))
            assert times > 0 and have > 0
    open_gaps: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in groups:
            groups[gap] = []
            insort(open_gaps, gap)
        groups[gap].append((pattern, times))

    for length in range(capacity, 0, -1):
        n = int(left.n[length])
        while n > 0:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                each = min(n, capacity // length)
                put((length,) * each, n // each)
                n -= each * (n // each)
                continue
            gap = open_gaps[at]
            pattern, times = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                open_gaps.pop(at)
            each = min(n, gap // length)
            used = min(times, n // each)
            if used < times:
                put(pattern, times - used)
            put(pattern + (length,) * each, used)
            n -= each * used
    return made + [x for gap in open_gaps for x in groups[gap]]


def pack(pieces: DataFrame, capacity: int = 2048, buckets: int | None = None) -> DataFrame:
    """`pieces` (doc_id, piece, start, length and others) with sequence_id and offset.

    Every piece gets a place of its own, equal rows too; offsets in a sequence leave no gap. `pieces`
    is read several times, so give a written table. An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, base, used = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in plan(counts, capacity):
        offset = 0
        for length in pattern:
            slots.append((length, used[length], used[length] + times, base, offset))
            used[length] += times
            offset += length
        base += times
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")),
                    "rank-starts")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_place", F.row_number().over(within) - 1).join(starts, ["length", "_bucket"]).withColumn(
        "_rank", F.col("_before") + F.col("_place"))
    plan_rows = spark.createDataFrame(
        [(length, [s[1:] for s in sorted(x for x in slots if x[0] == length)]) for length in counts],
        "length long, _slots array<struct<lo:long,hi:long,base:long,offset:long>>")
    # at most `capacity` rows, and a few slots for each length and pattern
    found = ranked.join(F.broadcast(plan_rows), "length").withColumn(
        "_slot", F.filter("_slots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"]))[0])
    return found.withColumns({
        "sequence_id": F.col("_slot.base") + F.col("_rank") - F.col("_slot.lo"), "offset": F.col("_slot.offset"),
    }).drop("_bucket", "_place", "_before", "_rank", "_slots", "_slot")


def sequences(placed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids): the joined ids of placed pieces that still have their `ids` bytes."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(F.transform(parts, lambda x: x["ids"]).alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"))
