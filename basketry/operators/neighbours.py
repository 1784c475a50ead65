"""Neighbour counts over columns of spots: rows that agree in all features but one, in the order of that one.

Days and numbers of invoices take few values, however many customers there are, so rows stand in a bounded number of columns.
What a spot reaches of a column is a range of the remaining feature, found by two binary searches. Work is spots times columns
in reach, whatever number of rows the columns hold.

Columns are written as blocks of numbers, by cells of the other features; blocks in reach of each other meet in a nested loop, so
no row is written once per block. A column of more rows than a block has is dealt over several.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import staged

#: Spots of a block, blocks that a task meets at most with its own, and searches that run at once.
BLOCK_SPOTS, RIGHT_BLOCKS, SEARCHES = 16_384, 128, 500_000


def _pack(n_flat: int):
    """A group of spots (flat features, the long one, rows) as one block, its columns one after the other."""
    def pack(table: pa.Table) -> pa.Table:
        values = [table.column(f"f{j}").to_numpy() for j in range(n_flat)]
        z, rows = table.column("z").to_numpy(), table.column("rows").to_numpy()
        order = np.lexsort((z, *values[::-1]))
        values, z, rows = [v[order] for v in values], z[order], rows[order]
        new = np.ones(len(z), bool)
        if len(z) > 1:
            new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0) if values else False
        starts = np.flatnonzero(new)
        flat = np.array([v[starts] for v in values]).reshape(n_flat, len(starts))
        return pa.table({"flat": pa.array([flat.tobytes()], pa.binary()), "starts": pa.array([starts.astype(np.int64).tobytes()], pa.binary()),
                         "z": pa.array([z.tobytes()], pa.binary()), "rows": pa.array([rows.astype(np.int64).tobytes()], pa.binary()),
                         "low": pa.array([[*map(float, flat.min(1)), float(z.min())]], pa.list_(pa.float64())),
                         "high": pa.array([[*map(float, flat.max(1)), float(z.max())]], pa.list_(pa.float64()))})
    return pack


def _unpacked(flat, starts, z, rows, n_flat: int) -> tuple:
    flat, starts, z, rows = (np.frombuffer(v.as_buffer(), t) for v, t in zip(
        (flat, starts, z, rows), (np.float64, np.int64, np.float64, np.int64)))
    return flat.reshape(n_flat, len(starts)), np.append(starts, len(z)), z, rows


def add_counts(counts: np.ndarray, own: tuple, other: tuple, eps: float, long_at: int) -> None:
    """Adds to `counts` the rows of block `other` within `eps` of every spot of block `own`.

    Searches use bounds that are wide by more than any rounding; spots between the wide and the narrow bound are
    judged by the distance itself, its squares added in the order of the features.
    """
    flat, starts, z, _ = own
    their_flat, their_starts, their_z, rows = other
    width = max(z.max(), their_z.max()) - min(z.min(), their_z.min()) + 4 * eps
    columns = their_flat.shape[1]
    far = float(columns * width + np.abs(z).max() + np.abs(their_z).max())
    slack = 1e-7 * eps + 8 * np.spacing(far)
    width += 4 * slack
    shifts = np.arange(columns) * width
    keys = their_z + np.repeat(shifts, np.diff(their_starts))
    padded = np.concatenate([[-np.inf], keys, [np.inf]])
    upto = np.concatenate([[0], np.cumsum(rows)])

    def apart(squares, gap):
        parts = list(squares)
        parts.insert(long_at, gap * gap)
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return np.sqrt(total)

    for c in range(flat.shape[1]):
        squares = [(flat[j, c] - their_flat[j]) ** 2 for j in range(len(flat))]
        met = np.flatnonzero(apart(squares, np.zeros(columns)) <= eps)
        if not len(met):
            continue
        squares = [s[met] for s in squares]
        half = np.sqrt(np.maximum(eps * eps - sum(squares, np.zeros(len(met))), 0.0))
        tile = max(1, SEARCHES // len(met))
        for start in range(starts[c], starts[c + 1], tile):
            x = z[start:min(start + tile, starts[c + 1])]
            centre = shifts[met][:, None] + x
            lowest, highest = centre - half[:, None], centre + half[:, None]
            first = np.searchsorted(keys, (lowest - slack).ravel()).reshape(lowest.shape)
            last = np.searchsorted(keys, (highest + slack).ravel(), "right").reshape(lowest.shape)

            def judged(place, at):
                """Whether the spots `at` are within reach in the searches `place`."""
                return apart([s[place[0]] for s in squares], x[place[1]] - their_z[at]) <= eps

            for bound, step in ((first, 1), (last, -1)):
                near = padded[first + 1] <= lowest + slack if step == 1 else padded[last] >= highest - slack
                place = np.nonzero(near & (first < last))
                while len(place[0]):
                    out = ~judged(place, bound[place] if step == 1 else bound[place] - 1)
                    place = place[0][out], place[1][out]
                    bound[place] += step
                    left = first[place] < last[place]
                    place = place[0][left], place[1][left]
            counts[start:start + len(x)] += (upto[last] - upto[first]).sum(0)


def counts_by_columns(spots: DataFrame, features: Sequence[str], eps: float, long: str,
                      block_spots: int = BLOCK_SPOTS, right_blocks: int = RIGHT_BLOCKS) -> DataFrame:
    """Rows (x, neighbours) for every spot x of `spots` (features, rows): all rows within `eps`, its own included.

    `long` is the feature in whose order columns stand. Spots are distinct and finite.
    """
    features = list(features)
    others, long_at = [c for c in features if c != long], features.index(long)
    n_flat, flat = len(others), [f"f{j}" for j in range(len(others))]
    cell = F.array(*[F.floor(F.col(c) / F.lit(eps)).cast("long") for c in others]) if others else F.array(F.lit(0).cast("long"))
    named = spots.select(*[F.col(c).alias(f) for c, f in zip(others, flat)], F.col(long).alias("z"), F.col("rows"), cell.alias("cell"))
    columns = staged(named.groupBy("cell", *flat).agg(F.count(F.lit(1)).alias("held")), "columns")
    cells = staged(columns.groupBy("cell").agg(F.sum("held").alias("cell_spots")), "cells")
    shares = (F.col("cell_spots") / block_spots).cast("long") + 1
    parts = (F.col("held") / block_spots).cast("long") + 1  # of a column with more spots than a block
    place = F.pmod(F.xxhash64("cell", *flat) + F.pmod(F.xxhash64("z"), parts), shares)
    dealt = named.join(columns, ["cell", *flat]).join(cells, "cell").select(*flat, "z", "rows", "cell", place.alias("share"))
    blocks = staged(dealt.groupBy("cell", "share").applyInArrow(
        _pack(n_flat), "flat binary, starts binary, z binary, rows binary, low array<double>, high array<double>")
        .withColumn("block", F.monotonically_increasing_id()), "blocks")
    count = blocks.count()
    right_tasks = -(-count // right_blocks)
    right = blocks.drop("block").withColumnsRenamed({c: f"to_{c}" for c in ("flat", "starts", "z", "rows", "low", "high")}).repartition(max(1, right_tasks))
    gaps = [F.greatest(F.col("low")[d] - F.col("to_high")[d], F.col("to_low")[d] - F.col("high")[d], F.lit(0.0)) for d in range(n_flat + 1)]
    reach = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= F.lit(eps * eps * (1 + 1e-9))
    pairs = blocks.repartition(max(1, count)).crossJoin(right.hint("shuffle_replicate_nl")).where(reach).select(
        "block", "flat", "starts", "z", "rows", "to_flat", "to_starts", "to_z", "to_rows")

    def counted(batches):
        block, own, counts = None, None, None

        def result():
            values = [np.repeat(v, np.diff(own[1])) for v in own[0]]
            values.insert(long_at, own[2])
            return pa.RecordBatch.from_arrays([*map(pa.array, values), pa.array(counts)], names=[*names, "n"])

        for batch in batches:
            for new, *values in zip(*batch.columns):
                if new.as_py() != block:
                    if block is not None:
                        yield result()
                    block, own = new.as_py(), tuple(v.copy() for v in _unpacked(*values[:4], n_flat))
                    counts = np.zeros(len(own[2]), np.int64)
                add_counts(counts, own, _unpacked(*values[4:], n_flat), eps, long_at)
        if block is not None:
            yield result()

    names = [f"x{d}" for d in range(len(features))]
    found = pairs.mapInArrow(counted, ", ".join([*(f"{c} double" for c in names), "n long"]))
    if right_tasks > 1:  # otherwise a block met all others in one task
        found = found.groupBy(*names).agg(F.sum("n").alias("n"))
    return found.select(F.array(*names).alias("x"), F.col("n").alias("neighbours"))
