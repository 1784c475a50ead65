"""Quality of a clustering: silhouette and Davies-Bouldin index.

`k`, the number of clusters, is a small model parameter. Per-cluster sums are therefore gathered
into one array, which every row reads as a scalar subquery; no join and no pairs of rows.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators.distance_sums import Block, Sums, boxes
from basketry.session import staged

BLOCK_ROWS = 2_000, 1 << 16  # rows per block of the exact silhouette: more than the first only while every core has some blocks
RIGHT_ROWS = 8_000_000  # rows that one task of the exact silhouette meets
VALUE_ROWS = 32  # rows per cubed number of values of a feature that orders the blocks before the others: its planes lie as far apart as boxes in them are wide


def _sums(points: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row per cluster: size, sum of every feature and sum of squared norms."""
    norm = sum((F.col(c) * F.col(c) for c in features), F.lit(0.0))
    return points.groupBy(F.col(label).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(norm).alias("squares"),
        F.array(*[F.sum(c) for c in features]).alias("total"))


def _gathered(table: DataFrame) -> Column:
    """All rows of a table of clusters as one array."""
    return table.agg(F.collect_list(F.struct(*table.columns)).alias("all")).scalar()


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _width(own_distance: Column, nearest: Column, alone: Column) -> Column:
    larger = F.greatest(own_distance, nearest)
    return F.when(alone | (larger == 0), 0.0).otherwise((nearest - own_distance) / larger)


def silhouette_squared(points: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row: mean silhouette with squared Euclidean distances, in one pass over any number of rows.

    The mean squared distance from a row to a cluster follows from the cluster's size, feature sums
    and sum of squared norms. Fewer than two clusters give null.
    """
    clusters = _gathered(_sums(points, features, label))
    vector = F.array(*[F.col(c).cast("double") for c in features])
    rows = points.select(F.col(label).alias("cluster"), vector.alias("x"), clusters.alias("clusters"))
    rows = rows.withColumn("norm", _dot(F.col("x"), F.col("x")))

    def total_distance(c):
        return c["n"] * F.col("norm") - 2 * _dot(F.col("x"), c["total"]) + c["squares"]

    own = F.filter("clusters", lambda c: c["cluster"] == F.col("cluster"))[0]
    others = F.filter("clusters", lambda c: c["cluster"] != F.col("cluster"))
    measured = rows.select(
        F.size("clusters").alias("k"), own["n"].alias("own_n"),
        F.greatest(F.lit(0.0), total_distance(own)).alias("own_total"),
        F.array_min(F.transform(others, lambda c: F.greatest(F.lit(0.0), total_distance(c)) / c["n"])).alias("nearest"))
    width = _width(F.col("own_total") / F.greatest(F.col("own_n") - 1, F.lit(1)), F.col("nearest"), F.col("own_n") == 1)
    return measured.agg(F.when(F.max("k") > 1, F.avg(width)).alias("silhouette"),
                        F.lit("squared_euclidean").alias("measure"), F.count(F.lit(1)).alias("n"))


def silhouette_exact(points: DataFrame, features: Sequence[str], label: str, key: str,
                     block_rows: int | None = None) -> DataFrame:
    """One row: mean silhouette with Euclidean distances between all rows; see `silhouettes_exact`."""
    return silhouettes_exact(points, features, [label], key, block_rows).drop("label")


def silhouettes_exact(points: DataFrame, features: Sequence[str], labels: Sequence[str], key: str,
                      block_rows: int | None = None, right_blocks: int | None = None) -> DataFrame:
    """One row per column of `labels`: mean silhouette with Euclidean distances between all rows.

    `silhouette_squared` is the measure in one pass. Rows are written as blocks of numbers that lie close together; a task meets a
    few blocks with `right_blocks` others in a nested loop and returns only the summed distances of its rows to every cluster, so no
    row is written once per block. Near rows meet one by one, far boxes of rows through grids that hold each
    distance to 1e-10 of it (`distance_sums`), so the work grows with the square of the rows only where features are many or boxes never lie apart.
    A distance is computed once for all labelings. Neither a row per pair nor the whole table in one task exists at any time.
    """
    features, labels, n_features = list(features), list(labels), len(features)
    coded = points.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{d}") for d, c in enumerate(features)],
                          *[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(labels)])
    found = coded.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("c")) for i in range(len(labels))]))
                         .alias("at")).groupBy("at.i", "at.c").agg(F.count(F.lit(1)).alias("n")).collect()
    if any(r.c is None for r in found):
        raise ValueError("rows without a label have no silhouette")
    clusters = [sorted((r.c, r.n) for r in found if r.i == i) for i in range(len(labels))]
    rows = sum(n for _, n in clusters[0])
    if not rows:
        return _one_each([(name, F.lit(None).cast("double"), F.lit(0).cast("long")) for name in labels], points.agg(F.lit(1)))
    first = np.cumsum([0, *map(len, clusters)]).tolist()
    known = [np.array([c for c, _ in held]) for held in clusters]

    width, cores = first[-1], points.sparkSession.sparkContext.defaultParallelism
    block_rows = block_rows or min(max(BLOCK_ROWS[0], -(-rows // (4 * cores))), BLOCK_ROWS[1])
    right_blocks = right_blocks or max(1, RIGHT_ROWS // block_rows)
    small = np.uint8 if width <= 256 else np.int32
    held = [F.nanvl(F.col(f"x{d}"), F.lit(None).cast("double")) for d in range(n_features)]
    low, high, values = coded.agg(*[F.array(*[f(c) for c in held]) for f in (F.min, F.max, F.approx_count_distinct)]).first()
    leading = [f"x{d}" for d in range(n_features) if values[d] > 1 and values[d] ** 3 * VALUE_ROWS <= rows]

    def curved(batches):
        for batch in batches:
            x = np.stack([batch.column(d + 1).to_numpy(zero_copy_only=False).astype(np.float64) for d in range(n_features)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_curve(x, low, high))], names=[*batch.schema.names, "z"])

    def packed(batches):
        """Blocks: coordinates feature by feature, per labeling the place of the row's cluster among all clusters, and the boxes that order the rows."""
        held, n = [], 0

        def block(take):
            x, at = (np.concatenate([h[k] for h in held], 1) for k in (0, 1))
            held[:] = [(x[:, take:], at[:, take:])]
            order, table = boxes(x[:, :take])
            return x[:, order].tobytes(), at[:, order].tobytes(), table.tobytes()

        for batch in batches:
            x = np.stack([batch.column(d).to_numpy(zero_copy_only=False).astype(np.float64) for d in range(n_features)])
            at = np.stack([first[i] + np.searchsorted(c, batch.column(n_features + i).to_numpy()) for i, c in enumerate(known)])
            held.append((x, at.astype(small)))
            n += batch.num_rows
            while n >= block_rows:
                yield _blocks([block(block_rows)])
                n -= block_rows
        if n:
            yield _blocks([block(n)])

    # copies of a place are dealt by their keys, so that no task gets all of them
    ordered = (coded.mapInArrow(curved, T.StructType([*coded.schema.fields, T.StructField("z", T.LongType())]))
               .repartitionByRange(max(1, -(-rows // (4 * block_rows))), *leading, "z", F.xxhash64("key"))
               .sortWithinPartitions(*leading, "z").drop("key", "z"))
    blocks = staged(ordered.mapInArrow(packed, "x binary, at binary, boxes binary").withColumn("block", F.monotonically_increasing_id()), "blocks")
    count = blocks.count()
    tasks = min(count, max(8 * cores, count // 16))
    right_tasks = -(-count // right_blocks)
    right = blocks.select(F.col("x").alias("y"), F.col("at").alias("to"), F.col("boxes").alias("others")).repartition(right_tasks)
    pairs = blocks.repartition(tasks).crossJoin(right.hint("shuffle_replicate_nl"))
    codes, sums = [f"c{i}" for i in range(len(labels))], [f"t{c}" for c in range(width)]

    def total_distances(batches):
        block, mine = None, None

        def read(x, at, table):
            numbers = [np.frombuffer(c.as_buffer(), kind) for c, kind in ((x, np.float64), (at, small), (table, np.float64))]
            return Block(*(a.reshape(r, -1) for a, r in zip(numbers[:2], (n_features, len(labels)))), numbers[2].reshape(-1, 3 + 2 * n_features), width)

        def result():
            at, totals = mine.block.at.astype(np.int32), mine.result()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(totals), block)), pa.array(np.arange(len(totals), dtype=np.int32)), *map(pa.array, at), *(pa.array(t) for t in totals.T.copy())],
                names=["block", "row", *codes, *sums])

        for batch in batches:
            for *left, new, y, to, others in zip(*(batch.column(c) for c in ("x", "at", "boxes", "block", "y", "to", "others"))):
                if new.as_py() != block:
                    if block is not None:
                        yield result()
                    block, mine = new.as_py(), Sums(read(*left))
                mine.add(read(y, to, others))
        if block is not None:
            yield result()

    measured = pairs.mapInArrow(total_distances, "block long, row int, " + ", ".join([*(f"{c} int" for c in codes), *(f"{t} double" for t in sums)]))
    if right_tasks > 1:  # otherwise a block met all others in one task
        measured = measured.groupBy("block", "row", *codes).agg(*[F.sum(t).alias(t) for t in sums])
    scores = []
    for i, (name, held) in enumerate(zip(labels, clusters)):
        code = F.col(f"c{i}")
        own_n = F.element_at(F.array(*[F.lit(n) for _, n in held]), code - first[i] + 1)
        own_total = F.element_at(F.array(*[F.col(f"t{first[i] + j}") for j in range(len(held))]), code - first[i] + 1)
        nearest = F.array_min(F.array(*[F.when(code != first[i] + j, F.col(f"t{first[i] + j}") / n) for j, (_, n) in enumerate(held)]))
        silhouette = _width(own_total / F.greatest(own_n - 1, F.lit(1)), nearest, own_n == 1)
        scores.append((name, F.when(F.count(nearest) > 0, F.avg(silhouette)), F.count(F.lit(1))))
    return _one_each(scores, measured)


def _blocks(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["x", "at", "boxes"])


def _curve(x: np.ndarray, low: Sequence[float | None], high: Sequence[float | None]) -> np.ndarray:
    """Places of rows (features x rows) along a curve whose stretches are compact: the bits of all features in turn."""
    used = min(len(x), 60)
    bits, place = min(20, 60 // used), np.zeros(x.shape[1], np.int64)
    for d, (values, a, b) in enumerate(zip(x[:used], low, high)):
        with np.errstate(all="ignore"):
            share = np.nan_to_num((values - (a or 0.0)) / (((b or 0.0) - (a or 0.0)) or 1.0), nan=0.0).clip(0, 1)
        step = (share * (2**bits - 1)).astype(np.int64)
        for bit in range(bits):
            place |= ((step >> bit) & 1) << (bit * used + d)
    return place


def _one_each(scores: list[tuple[str, Column, Column]], rows: DataFrame) -> DataFrame:
    """One row (label, silhouette, measure, n) per score, all of them aggregated from `rows` in one pass."""
    one = rows.agg(*[c.alias(f"{kind}{i}") for i, (_, *pair) in enumerate(scores) for kind, c in zip(("s", "n"), pair)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("label"), F.col(f"s{i}").alias("silhouette"), F.lit("euclidean").alias("measure"), F.col(f"n{i}").alias("n"))
        for i, (name, *_) in enumerate(scores)])).alias("row")).select("row.*")


def davies_bouldin(points: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row: Davies-Bouldin index from centroids and mean distances to the own centroid."""
    features = list(features)
    centres = points.groupBy(F.col(label).alias("cluster")).agg(
        F.array(*[F.avg(c) for c in features]).alias("centre"))
    lookup = centres.agg(F.map_from_entries(F.collect_list(F.struct("cluster", "centre")))).scalar()
    vector = F.array(*[F.col(c).cast("double") for c in features])
    offsets = points.select(F.col(label).alias("cluster"), vector.alias("x")).withColumn("centre", lookup[F.col("cluster")])
    spread = offsets.groupBy("cluster").agg(
        F.first("centre").alias("centre"), F.avg(_distance(F.col("x"), F.col("centre"))).alias("spread"))
    everything = spread.agg(F.collect_list(F.struct("cluster", "centre", "spread")).alias("all"))
    each = everything.select("all", F.explode("all").alias("me"))

    def similarity(other):
        apart = _distance(other["centre"], F.col("me.centre"))
        return F.when(apart == 0, 0.0).otherwise((other["spread"] + F.col("me.spread")) / apart)

    worst = F.array_max(F.transform(
        F.filter("all", lambda c: c["cluster"] != F.col("me.cluster")), similarity))
    return each.select(worst.alias("worst")).agg(F.avg("worst").alias("davies_bouldin"))


def _distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v))
