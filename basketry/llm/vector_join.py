"""Vectors linked by cosine, by a pigeonhole join over subspaces.

Unit vectors with cosine c are sqrt(2 - 2c) apart. After a fixed random rotation their coordinates are split
into BLOCKS low-dimensional blocks; two linked vectors are within their proportional share of the squared
distance in one block at least. Per block a grid over two coordinates (quantiles of the data) deals the
vectors to cells, crowded cells to parts, and only cells whose boxes are near enough meet. A task
joins two such units by block distance, keeps a pair in the first block that finds it, and verifies it
exactly. It returns counts and a spanning forest, never all pairs, so dense groups stay linear in size.
"""

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_rows
from basketry.llm.graph import components
from basketry.session import staged

BLOCKS = 4
UNIT_ROWS = 16_384
#: Rows of one side compared at once, and candidate pairs verified at once.
STRIPE, CANDIDATES = 512, 65_536


def usable(vector: str) -> Column:
    """Vectors that can link: not null, no null or non-finite component, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dimensions: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).standard_normal((dimensions, dimensions)))[0]


def _blocks(dimensions: int, blocks: int) -> list[np.ndarray]:
    return [x for x in np.array_split(np.arange(dimensions), blocks) if len(x)]


def _units(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def joined(left: np.ndarray, right: np.ndarray, same: bool, block: int, blocks: int, cosine: float):
    """Index pairs of linked rows that `block` is the first to find; `same`: left is right, each pair once."""
    dimensions = left.shape[1]
    parts, turn = _blocks(dimensions, blocks), rotation(dimensions)
    total = 2 - 2 * cosine + 1e-9
    budgets = [total * len(p) / dimensions for p in parts]
    unit_left = _units(left)
    unit_right = unit_left if same else _units(right)
    turned_left = unit_left @ turn
    turned_right = turned_left if same else unit_right @ turn
    a, b = turned_left[:, parts[block]].astype(np.float32), turned_right[:, parts[block]].astype(np.float32)
    b_squares = (b * b).sum(axis=1)
    for start in range(0, len(a), STRIPE):
        stripe = a[start:start + STRIPE]
        first = start if same else 0
        near = (stripe * stripe).sum(axis=1)[:, None] + b_squares[None, first:] - 2 * stripe @ b[first:].T
        found = np.flatnonzero(near <= budgets[block] + 1e-5)
        for at in range(0, len(found), CANDIDATES):
            i, j = np.divmod(found[at:at + CANDIDATES], near.shape[1])
            i, j = i + start, j + first
            keep = i < j if same else np.ones(len(i), bool)
            for k in range(block + 1):  # the same sums whichever task computes them
                d = turned_left[i][:, parts[k]] - turned_right[j][:, parts[k]]
                within = (d * d).sum(axis=1) <= budgets[k]
                keep &= within if k == block else ~within
            i, j = i[keep], j[keep]
            real = np.einsum("ij,ij->i", unit_left[i], unit_right[j]) >= cosine
            if real.any():
                yield i[real], j[real]


def _forest(size: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index reachable from every index."""
    label = np.arange(size)
    if not pairs:
        return label
    u, v = (np.concatenate(x) for x in zip(*pairs))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if (label == before).all():
            return label


def _bounded_forest(size: int, pairs, weights: np.ndarray, right_at: int) -> tuple[np.ndarray, np.ndarray]:
    """Links per index and component labels, from pairs that are folded into the forest as they come."""
    links, forest, held, n = np.zeros(size, np.int64), np.arange(size), [], 0
    for i, j in pairs:
        j = j + right_at
        np.add.at(links, i, weights[j])
        np.add.at(links, j, weights[i])
        held.append((i, j))
        n += len(i)
        if n > 4 * size + 1_000_000:
            forest = _forest(size, held + [(np.arange(size), forest)])
            held, n = [], 0
    return links, _forest(size, held + [(np.arange(size), forest)])


def link_vectors(vectors: DataFrame, cosine: float = 0.9, id: str = "vec_id", vector: str = "embedding",
                 blocks: int = BLOCKS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Rows (vec_id, n_links, component_id) for every row of `vectors`.

    n_links counts the other vectors with cosine >= `cosine` (in doubles), component_id is the smallest id
    that links lead to. Null and zero vectors, and those with null or non-finite components, link with
    nothing and are their own component, as are rows without an id; vectors of different length never
    link. Equal vectors are compared as one. Rows that repeat an id keep a row each.
    """
    spark = vectors.sparkSession
    named = vectors.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("v")).where(usable("v"))
    distinct = staged(named.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vectors")
    copied = staged(distinct.where("copies > 1").select("v", F.col("id").alias("first")), "copies")
    copies = staged(named.join(copied, "v").groupBy("id").agg(F.min("first").alias("first")).where("id != first"), "copies")
    lengths = distinct.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()  # one row per length
    kind = vectors.schema[id].dataType.simpleString()
    results = [_link_equal_lengths(distinct.where(F.size("v") == r["n"]), r["n"], r["rows"], cosine, kind,
                                   min(blocks, r["n"]), unit_rows) for r in lengths if r["rows"] > 1]
    empty = spark.createDataFrame([], f"id {kind}, links long, root {kind}")
    found = empty
    for r in results:
        found = found.unionByName(r)
    found = staged(found, "found")
    roots = components(found.where("id != root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = staged(found.groupBy("id").agg(F.sum("links").alias("links")).join(
        distinct.select("id", "copies"), "id", "full").select(
        "id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links")), "link-counts")
    rows = vectors.select(F.col(id).alias("vec_id")).join(copies.withColumnRenamed("id", "_id"), F.col("vec_id") == F.col("_id"), "left")
    rows = rows.withColumn("first", F.coalesce("first", "vec_id"))
    rows = rows.join(links.withColumnRenamed("id", "first"), "first", "left").join(
        roots.withColumnsRenamed({"node": "first"}), "first", "left")
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "first").alias("component_id"))


def _link_equal_lengths(distinct: DataFrame, dimensions: int, rows: int, cosine: float, kind: str, blocks: int,
                        unit_rows: int) -> DataFrame:
    parts, spark = _blocks(dimensions, blocks), distinct.sparkSession
    cells = max(1, ceil(sqrt(rows / unit_rows)))
    axes = [p[k] for p in parts for k in (0, 1 if len(p) > 1 else 0)]

    def coordinates(columns):
        turned = (_units(_matrix(columns[0])) @ rotation(dimensions))[:, axes]
        return [*columns, pa.array(list(turned), pa.list_(pa.float64()))]

    element = distinct.schema["v"].dataType.simpleString()
    placed = map_rows(distinct, ["v", "id", "copies"], f"v {element}, id {kind}, copies long, axes array<double>",
                      coordinates, 400_000, raw=True)
    if cells > 1:
        wide = placed.select(*[F.col("axes")[k].alias(f"a{k}") for k in range(len(axes))])
        cuts = wide.approxQuantile(wide.columns, [k / cells for k in range(1, cells)], 0.01)
    else:
        cuts = [[] for _ in axes]

    def cell(k: int) -> Column:
        return sum((F.when(F.col("axes")[k] >= c, 1).otherwise(0) for c in cuts[k]), F.lit(0))

    exploded = placed.select("v", "id", "copies", F.explode(F.array(*[
        F.struct(F.lit(b).alias("block"), cell(2 * b).alias("x"), cell(2 * b + 1).alias("y")) for b in range(len(parts))])).alias("c")
    ).select("v", "id", "copies", "c.*")
    counts = exploded.groupBy("block", "x", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # rows / unit_rows per block
    sizes = {(r["block"], r["x"], r["y"]): max(1, ceil(r["n"] / (2 * unit_rows))) for r in counts}
    radius = [sqrt((2 - 2 * cosine + 1e-9) * len(p) / dimensions) for p in parts]

    def gap(k: int, one: int, two: int) -> float:
        low, high = sorted((one, two))
        return cuts[k][high - 1] - cuts[k][low] if high - low > 1 else 0.0

    meetings: dict[tuple, list] = {}
    for one in sizes:
        for two in sizes:
            b = one[0]
            if b == two[0] and one <= two and gap(2 * b, one[1], two[1]) ** 2 + (
                    gap(2 * b + 1, one[2], two[2]) ** 2 if len(parts[b]) > 1 else 0) <= radius[b] ** 2:
                for p in range(sizes[one]):
                    for q in range(p if one == two else 0, sizes[two]):
                        meeting = (b, *one[1:], p, *two[1:], q)
                        meetings.setdefault((*one, p), []).append((*meeting, 0))
                        if (*one, p) != (*two, q):
                            meetings.setdefault((*two, q), []).append((*meeting, 1))
    plan = spark.createDataFrame(
        [(*unit, [f"{':'.join(map(str, m[:-1]))}/{m[-1]}" for m in found], sizes[unit[:3]]) for unit, found in meetings.items()],
        "block int, x int, y int, part int, meetings array<string>, parts int")
    totals = plan.select("block", "x", "y", "parts").distinct()
    dealt = exploded.join(F.broadcast(totals), ["block", "x", "y"]).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    met = dealt.join(F.broadcast(plan.drop("parts")), ["block", "x", "y", "part"]).select(
        "block", "v", "id", "copies", F.explode("meetings").alias("m")).select(
        "block", "v", "id", "copies", F.substring_index("m", "/", 1).alias("meeting"), F.substring_index("m", "/", -1).cast("int").alias("side"))
    out = pa.schema([("id", pa.int64() if kind in ("bigint", "int") else pa.string()), ("links", pa.int64()),
                     ("root", pa.int64() if kind in ("bigint", "int") else pa.string())])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("id", "ascending")]).combine_chunks()
        side = np.asarray(table.column("side"))
        matrix, ids = _matrix(table.column("v").chunk(0)), table.column("id")
        weights, cut = np.asarray(table.column("copies")), int((side == 0).sum())
        halves = table.column("meeting")[0].as_py().split(":")
        same = halves[1:4] == halves[4:7]
        pairs = joined(matrix[:cut], matrix if same else matrix[cut:], same, int(halves[0]), blocks, cosine)
        links, label = _bounded_forest(len(side), pairs, weights, 0 if same else cut)
        at = np.flatnonzero(links)
        return pa.Table.from_arrays([ids.take(pa.array(at)).combine_chunks().cast(out.field(0).type), pa.array(links[at]),
                                     ids.take(pa.array(label[at])).combine_chunks().cast(out.field(2).type)], schema=out)

    return met.groupBy("meeting").applyInArrow(compare, f"id {'bigint' if kind in ('bigint', 'int') else 'string'}, links long, "
                                               f"root {'bigint' if kind in ('bigint', 'int') else 'string'}").select(
        F.col("id").cast(kind).alias("id"), "links", F.col("root").cast(kind).alias("root"))
