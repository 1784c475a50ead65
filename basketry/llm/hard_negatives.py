"""Hard negatives by threshold joins over an inverted index with norm bounds (after L2AP).

Vectors are dealt to units of bounded bytes. A unit's index has one list per dimension, the dimensions in the
order of falling energy over all rows; it omits the last dimensions of a vector as soon as their norm,
times that of the queries there, stays below the threshold. Partial scores are accumulated list by list,
pairs whose score and remaining norms stay below their threshold are dropped, and what is left is scored
exactly. Thresholds start high and are lowered only for queries whose windows are not full.

Units are searched in rounds of growing size. What a round has found raises the floor of a full window
for the next ones, so the rows that leave the units stay a small multiple of the result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from basketry.session import staged

#: Bytes of a unit's vectors, of the queries beside them, and how many times more units the next round has.
UNIT_BYTES, QUERY_BYTES, ROUND = 4 << 20, 8 << 20, 16
#: Shares of the way from a window's floor to its top where thresholds stand.
STEPS = (0.7, 0.4, 0.0)
#: Queries accumulated together, pairs scored together, and dimensions per step of the accumulation.
QUERIES, PAIRS, DIMENSIONS = 64, 1 << 15, 8


class UnitIndex:
    """Index of whole-numbered vectors (rows of `matrix`) for thresholds from `floor` on and queries with `norms` left per step."""

    def __init__(self, matrix: np.ndarray, floor: float, query_left: np.ndarray):
        self.left = remaining_norms(matrix)
        needed = (self.left * query_left[None, :] >= floor).sum(1)  # steps that cannot be omitted
        self.order = np.argsort(-needed, kind="stable")
        self.needed, self.left = needed[self.order], self.left[self.order]
        self.lists = np.ascontiguousarray(matrix[self.order].T)

    def above(self, queries: np.ndarray, left: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that may score their threshold or more: none that does is missing."""
        n_rows = self.lists.shape[1]
        score = np.zeros((len(queries), n_rows))
        slack = 1e-9 * (1 + np.abs(thresholds))
        for step in range(left.shape[1] - 1):
            n = int(np.searchsorted(-self.needed, -step, "left"))  # rows whose lists reach this step
            if n == 0:
                break
            at = slice(step * DIMENSIONS, (step + 1) * DIMENSIONS)
            score[:, :n] += queries[:, at] @ self.lists[at, :n]
            # rows end with their own remaining norm, as nothing more is added to them
        rest = left[:, np.minimum(self.needed, left.shape[1] - 1)] * self.left[np.arange(n_rows), np.minimum(self.needed, left.shape[1] - 1)][None, :]
        q, y = np.nonzero(score + rest >= (thresholds - slack)[:, None])
        return q, self.order[y]


def remaining_norms(matrix: np.ndarray) -> np.ndarray:
    """Per row the norm of its dimensions from each step on; zero after the last."""
    steps = -(-matrix.shape[1] // DIMENSIONS)
    squares = np.zeros((len(matrix), steps * DIMENSIONS))
    squares[:, :matrix.shape[1]] = matrix.astype(np.float64) ** 2
    per_step = squares.reshape(len(matrix), steps, DIMENSIONS).sum(2)
    return np.sqrt(np.concatenate([np.cumsum(per_step[:, ::-1], 1)[:, ::-1], np.zeros((len(matrix), 1))], 1))


def _pruned(index: UnitIndex, queries: np.ndarray, left: np.ndarray, thresholds: np.ndarray, whole: np.ndarray,
            exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples (query, row, score) with scores of at least their threshold; `whole` and `exact` are 64-bit integers."""
    q, y = index.above(queries, left, thresholds)
    scores = np.concatenate([np.einsum("ij,ij->i", whole[q[i:i + PAIRS]], exact[y[i:i + PAIRS]])
                             for i in range(0, len(q), PAIRS)] or [np.zeros(0, np.int64)])
    enough = scores >= thresholds[q]
    return q[enough], y[enough], scores[enough]


def search_unit(ids, labels, matrix, query_ids, query_labels, queries, windows, k: int, same: bool):
    """The best `k` rows of a unit per window as (window, id, score), higher scores first, then smaller ids.

    `windows` are arrays (query, floor, top) of whole numbers; rows count if their label is that of the
    query (`same`) or another one, and their id is not the query's.
    """
    of, floor, top = windows
    norms = remaining_norms(queries)
    widest = np.sqrt((matrix.astype(np.float64) ** 2).sum(1).max(initial=0.0))
    most = norms[of, 0] * widest * (1 + 1e-9) + 1
    ceiling, bottom = np.minimum(top.astype(np.float64), most), np.maximum(floor.astype(np.float64), -most)
    pending = np.flatnonzero(ceiling >= bottom)
    out = []
    as_float = queries.astype(np.float64), matrix.astype(np.float64)
    for share in STEPS:
        if not len(pending):
            break
        # the last step takes the floor itself: every row down to it counts
        at = bottom + share * (ceiling - bottom) if share else np.floor(bottom)
        index = UnitIndex(as_float[1], float(at[pending].min()), norms[of[pending]].max(0))
        todo = []
        asked = np.unique(of[pending])
        for start in range(0, len(asked), QUERIES):
            some = asked[start:start + QUERIES]
            mine = pending[np.isin(of[pending], some)]
            thresholds = np.full(len(some), np.inf)
            np.minimum.at(thresholds, np.searchsorted(some, of[mine]), at[mine])
            q, y, scores = _pruned(index, as_float[0][some], norms[some], thresholds, queries[some], matrix)
            fits = ((labels[y] == query_labels[some[q]]) == same) & (ids[y] != query_ids[some[q]])
            q, y, scores = q[fits], y[fits], scores[fits]
            order = np.lexsort((ids[y], -scores, q))
            q, y, scores = q[order], y[order], scores[order]
            for w in mine.tolist():
                j = np.searchsorted(some, of[w])
                part = slice(*np.searchsorted(q, [j, j + 1]))
                inside = scores[part]
                good = np.flatnonzero((inside >= max(at[w], floor[w])) & (inside <= top[w]))[:k]
                if len(good) < k and share:
                    todo.append(w)
                else:
                    out.append((np.full(len(good), w), ids[y[part][good]], inside[good]))
        pending = np.array(sorted(todo), np.int64)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


# on Spark ----------------------------------------------------------------------------------------

def points(vectors: DataFrame, id: str, vector: str, label: str, scale: float) -> tuple[DataFrame, int]:
    """A written table (id, label, v) of the rows that take part, and the number of dimensions.

    `v` are the whole numbers floor(scale * x) as little-endian 64-bit integers, dimensions in the order of
    falling energy over all rows, shorter vectors filled with zeros. Of rows with the same id one is taken, the
    one with the smallest label and vector.
    """
    usable = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                            F.col(vector).cast("array<double>").alias("x")).where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    one = usable.where(finite).groupBy("id").agg(F.min(F.struct("label", "x")).alias("p")).select("id", "p.*")
    rows = staged(one, "vectors")

    def energies(batches):
        total = np.zeros(0)
        for batch in batches:
            for x in _ragged(batch.column(0)):
                whole = np.floor(scale * x) ** 2
                if len(whole) > len(total):
                    total = np.concatenate([total, np.zeros(len(whole) - len(total))])
                total[:whole.shape[0]] += whole
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["d", "energy"])

    # one row per dimension and task, then one per dimension
    order = [r["d"] for r in rows.select("x").mapInArrow(energies, "d int, energy double").groupBy("d").agg(
        F.sum("energy").alias("energy")).orderBy(F.desc("energy"), "d").collect()]
    width = len(order)

    def written(batches):
        for batch in batches:
            made = []
            for x in _ragged(batch.column(2)):
                full = np.zeros(width)
                full[:len(x)] = np.floor(scale * x)
                if width * float(np.abs(full).max(initial=0.0)) ** 2 >= 2.0 ** 53:
                    raise ArithmeticError("scores of these vectors exceed the whole numbers of a double")
                made.append(full[order].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["id", "label", "v"])

    return staged(rows.select("id", "label", "x").mapInArrow(written, "id long, label long, v binary"), "points"), width


def _ragged(column: pa.ListArray):
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for start, end in zip(offsets - offsets[0], offsets[1:] - offsets[0]):
        yield flat[start:end]


WINDOWS = T.ArrayType(T.StructType([T.StructField("w", T.LongType()), T.StructField("floor", T.LongType()), T.StructField("top", T.LongType())]))


def best_in_windows(rows: DataFrame, queries: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """Rows (id, w, other, score): per window (w, floor, top) of a query (id, label, v, windows) its best `k` rows.

    A window's answer holds the rows of another (or, if `same`, the same) label whose score lies in
    [floor, top], higher scores first, then smaller ids. Memory of a task: one unit of rows, one group of queries and
    QUERIES scores a row.
    """
    per_row = 8 * max(1, width)
    n_rows, n_queries = rows.count(), queries.count()
    units, groups = max(1, -(-n_rows * per_row // UNIT_BYTES)), max(1, -(-n_queries * per_row // QUERY_BYTES))
    dealt = rows.withColumn("unit", F.pmod(F.xxhash64("id"), F.lit(units)).cast("int"))
    schema = "id long, w long, other long, score long"

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        whole = [np.frombuffer(b"".join(t.column(c).to_pylist()), "<i8").reshape(t.num_rows, width) for t, c in ((left, "v"), (right, "query_v"))]
        ids, labels = left.column("id").to_numpy(), left.column("label").to_numpy()
        query_ids, query_labels = right.column("query").to_numpy(), right.column("query_label").to_numpy()
        listed = right.column("windows").to_pylist()
        flat = [(q, x["w"], x["floor"], x["top"]) for q, found in enumerate(listed) for x in found]
        out = [np.zeros(0, np.int64)] * 4
        if flat and left.num_rows:
            of, name, floor, top = (np.array(c, np.int64) for c in zip(*flat))
            w, other, score = search_unit(ids, labels, whole[0], query_ids, query_labels, whole[1], (of, floor, top), k, same)
            out = [query_ids[of[w]], name[w], other, score]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["id", "w", "other", "score"])

    place = Window.partitionBy("id", "w").orderBy(F.desc("score"), "other")
    found, done, upto = None, 0, 1
    while done < units:
        upto = min(units, upto)
        asked = queries
        if found is not None:
            full = found.groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            raised = full.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("_least"))  # windows of one query
            asked = queries.join(raised, "id", "left").withColumn("windows", F.transform("windows", lambda x: F.struct(
                x["w"].alias("w"), F.greatest(x["floor"], F.coalesce(F.try_element_at("_least", x["w"]), x["floor"])).alias("floor"),
                x["top"].alias("top")))).drop("_least")
        asked = asked.select(F.col("id").alias("query"), F.col("label").alias("query_label"), F.col("v").alias("query_v"), "windows",
                             F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("query_group"),
                             F.explode(F.sequence(F.lit(done), F.lit(upto - 1))).alias("query_unit"))
        some = dealt.where((F.col("unit") >= done) & (F.col("unit") < upto)).withColumn(
            "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        new = some.groupBy("unit", "group").cogroup(asked.groupBy("query_unit", "query_group")).applyInArrow(work, schema)
        both = new if found is None else found.unionByName(new)
        found = staged(both.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).drop("_n"), "best")
        done, upto = upto, upto * ROUND
    return found


def mine(vectors: DataFrame, anchor_every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         scale: float = 256.0, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by `anchor_every`. Scores are inner products of the whole numbers
    floor(scale * x). An anchor's positives are its `n_positives` best other rows of the same label; for each, its first
    `n_negatives` rows of other labels with low * positive <= 100 * negative <= high * positive are returned, ranked from 1. Higher scores
    come first, ties by smaller id. Fewer where there are fewer; anchors without positives and windows without rows give none.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part; an id counts once
    (`points`). Vectors of different lengths compare as if filled with zeros. Scores that may exceed 2**53 raise an error.
    Empty tables give no rows.
    """
    rows, width = points(vectors, id, vector, label, scale)
    anchors = rows.where(F.col("id") % anchor_every == 0)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(-(1 << 62)).alias("floor"), F.lit(1 << 62).alias("top")))
    positives = best_in_windows(rows, anchors.withColumn("windows", whole), width, n_positives, True)
    # whole-number bounds; a negative positive score leaves no room between them
    bounded = positives.where("score >= 0").select("id", F.struct(
        F.col("other").alias("w"), F.expr(f"(score * {low} + 99) div 100").alias("floor"), F.expr(f"score * {high} div 100").alias("top")).alias("x"))
    asked = staged(anchors.join(bounded.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("windows")), "id"), "anchors")
    negatives = best_in_windows(rows, asked, width, n_negatives, False)
    place = Window.partitionBy("id", "w").orderBy(F.desc("score"), "other")
    return negatives.withColumn("rank", F.row_number().over(place)).join(
        positives.select("id", F.col("other").alias("w"), F.col("score").alias("positive_score")), ["id", "w"]).select(
        F.col("id").alias("anchor_id"), F.col("w").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
