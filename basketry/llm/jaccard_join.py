"""Documents whose sets of word shingles have a Jaccard similarity of THRESHOLD or more.

Postings (shingle, document) are shuffled once, to count in how many documents a shingle is. A shingle
of one document links nothing, and a set with too few shared shingles is out; both cut the
rest of the work to what can be near-duplicate. Exact copies are one set from there on.

Candidates come from two kinds of buckets, in the order of rising document frequency:
* heavy (large sets): the inverted lists of a set's rarest shingles, enough of them to meet any partner;
* light (small sets): all pairs (subsets of fixed size 2) of one shingle more than that.
Pairs of two light sets come from subsets, all others from lists. Which sizes are light is decided by
the cost of both for the data at hand.

Buckets are never paired out. In rounds, a growing number of pivots per bucket is compared to the members
that are not yet in the pivot's component; a bucket is done once it is one component or all of its
members were pivots. So a group of near copies costs one comparison each, and no link between
different texts is lost that could change a component. New links join the roots of the rounds before.

No task holds a hot shingle or bucket: shingles that a slice of texts finds frequent have the highest
document frequency without being counted, and buckets are counted, elect pivots (one per salt) and end by
aggregations that combine before they shuffle.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from basketry.llm.common import map_rows, per_worker
from basketry.llm.graph import components
from basketry.session import staged

SHINGLE = 5
#: The least similarity as a ratio of whole numbers.
THRESHOLD = (75, 100)
KEY_BITS = 48
SCAN_COST = 3
#: A shingle is frequent if FREQUENT texts of a slice and one in FREQUENT_SHARE hold it.
FREQUENT, FREQUENT_SHARE = 16, 64
#: How many times more pivots per bucket each round elects, and rows for which a small table has a further file.
GROWTH, FILE_ROWS = 16, 100_000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    out = []
    for x in (base, inverse):
        steps = np.full(size, x, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start places of the words in lower-cased bytes."""
    size = 1 << max(16, int(len(data) + 1).bit_length())
    up, down = per_worker(("powers", size), lambda: _powers(size))
    letters = per_worker(("letters",), lambda: np.random.default_rng(5).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(letters[data] * up[:len(data)], dtype=np.uint64)))
    value = (sums[ends] - sums[starts]) * down[starts]
    value ^= value >> np.uint64(32)
    value *= _MIX
    return value ^ (value >> np.uint64(29)), starts


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its `width`-word shingles; shorter texts have one, empty ones none."""
    coded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(coded), np.uint8)
    words, starts = _word_hashes(data)
    limits = np.searchsorted(starts, np.cumsum([0] + [len(c) + 1 for c in coded]))
    grams = words[:max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        grams = grams * _ODD + words[k:len(grams) + k]
    grams ^= grams >> np.uint64(31)
    grams *= _MIX
    grams ^= grams >> np.uint64(32)
    out = []
    for a, b in zip(limits, limits[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a:b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=int(b - a))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_sizes(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows (doc, size, digest, frequent) per document; `frequent` lists shingles that many texts of a slice hold, once per slice."""
    def work(columns):
        sets = shingle_sets(columns[1])
        listed, n = np.unique(np.concatenate(sets) >> np.uint64(64 - KEY_BITS), return_counts=True)
        frequent = listed[(n >= FREQUENT) & (FREQUENT_SHARE * n >= len(sets))].astype(np.int64)
        return [columns[0], list(map(len, sets)), [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets],
                [frequent.tolist() or None] + [None] * (len(sets) - 1)]

    kind = docs.schema[id].dataType.simpleString()
    named = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("doc"), F.col(text).alias("text"))
    return map_rows(named, ["doc", "text"], f"doc {kind}, size long, digest long, frequent array<long>", work, 1_000_000)


def postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows (shingle, doc); shingles are cut to KEY_BITS bits."""
    def work(columns):
        sets = shingle_sets(columns[1].to_pylist())
        keys = (np.concatenate(sets) >> np.uint64(64 - KEY_BITS)).astype(np.int64) if sets else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return [pa.array(keys), columns[0].take(pa.array(rows))]

    kind = docs.schema[id].dataType.simpleString()
    named = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("doc"), F.col(text).alias("text"))
    return map_rows(named, ["doc", "text"], f"shingle long, doc {kind}", work, 1_000_000, raw=True)


def _least_overlap(size: Column, threshold: tuple[int, int]) -> Column:
    """Of a set of `size` with any partner."""
    return F.ceil(size * threshold[0] / threshold[1]).cast("long")


def shared_sets(docs: DataFrame, sizes: DataFrame, frequent: DataFrame, id: str, text: str, threshold: tuple[int, int]) -> DataFrame:
    """Rows (doc, size, keys) of the documents with enough shared shingles to have a partner.

    `sizes` are rows (doc, size, copies) of one document per set. A key is a shingle with its document
    frequency above it, so sorted keys are sorted by frequency; a shingle found as often as
    its set has copies is in no other set. `frequent` shingles count as the most frequent.
    """
    most = (1 << 63 - KEY_BITS) - 1
    flagged = postings(docs, id, text).join(frequent.withColumn("hot", F.lit(True)), "shingle", "left")
    # a third of all rows may hold one frequent shingle: its rows are dealt by document, and nothing is counted
    place = Window.partitionBy("shingle", F.when(F.col("hot"), F.xxhash64("doc")))
    counted = flagged.withColumn("df", F.when(F.col("hot"), F.lit(most)).otherwise(F.count(F.lit(1)).over(place)))
    packed = F.shiftleft(F.least("df", F.lit(most)), KEY_BITS).bitwiseOR(F.col("shingle"))
    found = counted.where(F.col("df") > 1).groupBy("doc").agg(F.sort_array(F.collect_set(packed)).alias("keys"))
    met = found.join(sizes, "doc").withColumn("keys", F.filter(
        "keys", lambda k: (F.shiftright(k, KEY_BITS) != F.col("copies")) | (F.col("copies") >= most)))
    return staged(met.where(F.size("keys") >= _least_overlap(F.col("size"), threshold)).select("doc", "size", "keys"), "shared-sets")


def light_limit(sets: DataFrame) -> int:
    """The size below which subsets cost less rows than lists, summed per power of two of the size.

    A list's row is dealt and compared, and read again until its bucket is one component (SCAN_COST rows
    in all); a pair of rare shingles is seldom shared by unlinked sets, and costs one row.
    """
    scan = SCAN_COST * F.size("prefix")
    subsets = F.size("longer") * (F.size("longer") - 1) / 2
    steps = sets.groupBy(F.floor(F.log2("size")).alias("step")).agg(
        F.sum(scan).alias("scan"), F.sum(subsets).alias("subsets")).orderBy("step").collect()  # at most 64 rows
    best, limit, saved = 0.0, 1, 0.0
    for row in steps:
        saved += float(row["scan"]) - float(row["subsets"])
        if saved > best:
            best, limit = saved, 1 << (row["step"] + 1)
    return limit


def buckets(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Rows (bucket, doc, size, most, spread): buckets of two or more; members with the least `spread` share most.

    `most` bounds the overlap with a set whose first common shingles (in the order by frequency) are the bucket's.
    """
    size, own = F.col("size"), F.col("size") - F.size("keys")
    spare = size - _least_overlap(size, threshold) + 1 - own
    cut = sets.withColumns({"prefix": F.slice("keys", F.lit(1), F.greatest(spare, F.lit(0)).cast("int")),
                            "longer": F.slice("keys", F.lit(1), F.greatest(spare + 1, F.lit(0)).cast("int"))})
    limit = light_limit(cut)
    named = cut.select("doc", "size", own.alias("own"), "prefix", "longer", (size >= limit).alias("heavy"))
    lists = named.select("doc", "size", "own", "heavy", F.posexplode("prefix").alias("at", "bucket")).withColumn(
        "most", F.col("size") - F.col("own") - F.col("at")).drop("at")
    pairs = F.flatten(F.transform("longer", lambda x, i: F.transform(
        F.slice("longer", i + 2, F.size("longer")),
        lambda y, j: F.struct(F.xxhash64(x, y).alias("bucket"), (F.col("size") - F.col("own") - i - j).alias("most")))))
    light = named.where(~F.col("heavy")).select("doc", "size", "own", F.explode(pairs).alias("x")).select(
        "doc", "size", "own", F.lit(True).alias("heavy"), "x.*")
    members = lists.unionByName(light)
    # lists without a heavy set are left to the pairs
    met = staged(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("heavy").alias("any")).where("n > 1 AND any").select("bucket"), "met")
    return staged(members.join(met, "bucket").select("bucket", "doc", "size", "most", (F.col("own") / F.col("size")).alias("spread")), "buckets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) that link: overlaps are counted over whole sets."""
    left = sets.select(F.col("doc").alias("u"), F.col("size").alias("u_size"), F.col("keys").alias("u_keys"))
    right = sets.select(F.col("doc").alias("v"), F.col("size").alias("v_size"), F.col("keys").alias("v_keys"))
    met = pairs.join(left, "u").join(right, "v").withColumn("both", F.size(F.array_intersect("u_keys", "v_keys")))
    return met.where(threshold[1] * F.col("both") >= threshold[0] * (F.col("u_size") + F.col("v_size") - F.col("both"))).select("u", "v")


def _files(rows: int) -> int:
    return rows // FILE_ROWS + 1


def joined_roots(roots: DataFrame | None, links: DataFrame, files: int) -> DataFrame:
    """`roots` (node, root) with new links (u, v) joined in: only roots are linked anew."""
    if roots is None:
        return components(links, files)
    named = links
    for end in ("u", "v"):
        named = named.join(roots.select(F.col("node").alias(end), F.col("root").alias("_root")), end, "left").withColumn(
            end, F.coalesce("_root", end)).drop("_root")
    moved = components(named.select("u", "v"), files)
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left").select(
        "node", F.coalesce("_root", "root").alias("root"))
    new = moved.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return staged(old.unionByName(new).coalesce(files), "roots")


def linked_sets(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame | None:
    """Rows (node, root) of the sets that link to another one; None if there are none."""
    members = buckets(sets, threshold).withColumns({"root": F.col("doc"), "tried": F.lit(False)})
    files = _files(members.count())
    roots, salts = None, 1
    while not members.isEmpty():
        elected = members.where("NOT tried").groupBy("bucket", F.pmod(F.xxhash64("doc"), F.lit(salts)).alias("_salt")).agg(
            F.min(F.struct("spread", "doc", "size", "most", "root")).alias("p"))
        pivots = staged(elected.select("bucket", F.col("p.doc").alias("p_doc"), F.col("p.size").alias("p_size"), F.col("p.most").alias("p_most"),
                                       F.col("p.root").alias("p_root")).coalesce(files), "pivots")
        able = ((F.col("root") != F.col("p_root")) & ((threshold[0] + threshold[1]) * F.least("most", "p_most")
                                                      >= threshold[0] * (F.col("size") + F.col("p_size"))))
        met = members.where("NOT tried").join(pivots, "bucket").where(able)
        pairs = staged(met.select(F.least("doc", "p_doc").alias("u"), F.greatest("doc", "p_doc").alias("v")).distinct().coalesce(files), "pairs")
        links = staged(_verified(pairs, sets, threshold).coalesce(files), "links")
        now = members.join(pivots.select("bucket", F.col("p_doc").alias("doc"), F.lit(True).alias("_now")), ["bucket", "doc"], "left").withColumn(
            "tried", F.col("tried") | F.coalesce("_now", F.lit(False))).drop("_now")
        if not links.isEmpty():
            roots = joined_roots(roots, links, files)
            now = now.join(roots.select(F.col("node").alias("doc"), F.col("root").alias("_root")), "doc", "left").withColumn(
                "root", F.coalesce("_root", "doc")).drop("_root")
        now = staged(now.coalesce(files), "members")
        # a bucket is done once it is one component or each member was a pivot
        left = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.when(~F.col("tried"), 1)).alias("n"))
        members = staged(now.join(left.where("lo != hi AND n > 0").select("bucket"), "bucket").coalesce(files), "buckets")
        salts = min(salts * GROWTH, 1 << 30)
        files = _files(members.count())
    return roots


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text",
                      threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): classes of documents joined by links, named by their smallest id.

    Two documents link when threshold[1] * |intersection| >= threshold[0] * |union| of their sets of
    SHINGLE-word shingles (whole sequence where there are fewer words), over whole lower-cased (A-Z) texts.
    Null and empty texts have no set and link with nothing. Rows without an id are left out. An id is
    taken to name one text; it has one row however often it is repeated (with several texts: the largest
    set's size, and shared shingles of all). Shingles are told apart by 64 bits within a text and 48
    between texts.
    """
    sized = staged(set_sizes(docs, id, text), "sizes")
    frequent = staged(sized.select(F.explode("frequent").alias("shingle")).distinct(), "frequent")
    sizes = staged(sized.groupBy("doc").agg(F.max(F.struct("size", "digest")).alias("x")).select("doc", "x.size", "x.digest"), "sizes")
    groups = staged(sizes.where("size > 0").groupBy("size", "digest").agg(
        F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")), "sets")
    copies = staged(sizes.join(groups.where("copies > 1"), ["size", "digest"]).where(F.col("doc") != F.col("first")).select(
        "doc", "first"), "copies")
    sets = shared_sets(docs, groups.select(F.col("first").alias("doc"), "size", "copies"), frequent, id, text, threshold)
    roots = linked_sets(sets, threshold)
    named = sizes.join(copies, "doc", "left").withColumn("first", F.coalesce("first", "doc"))
    if roots is not None:
        named = named.join(roots.withColumnsRenamed({"node": "first", "root": "_root"}), "first", "left")
    else:
        named = named.withColumn("_root", F.col("first"))
    return named.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"),
                        F.coalesce("_root", "first").alias("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose id names its class; rows without an id stay."""
    gone = staged(similar_documents(docs, id, text, threshold).where("doc_id != component_id").select(
        F.col("doc_id").alias("_gone")), "gone")
    return docs.join(gone, F.col(id) == F.col("_gone"), "left_anti")
