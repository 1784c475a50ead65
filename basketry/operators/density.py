"""Density-based clusters (DBSCAN), exact, without comparing all pairs of rows.

Space is cut into cells whose diagonal is just below `eps`: rows of one cell are always neighbours.
A cell with `min_samples` rows or more ("dense") therefore consists of core rows only, and nothing
inside it has to be compared. What is left:

* rows of sparse cells (fewer than `min_samples` per cell) count their neighbours in nearby cells,
* nearby cells with core rows are linked if some core rows of theirs are neighbours,
* linked cells form a cluster; rows that are not core take the first cluster in reach.

Every comparison first looks at the bounding boxes: boxes within `eps` altogether, or out of it,
need no look at rows. A hot cell, which may hold a third of all rows, is thus one box to most
others; where rows must be looked at, they are spread over salted tasks by a hash of their key.
Two large cells whose boxes do not decide are split into smaller boxes until they do.
"""

from collections.abc import Sequence
from functools import cached_property, reduce
from itertools import product
from math import ceil, sqrt
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry import fixed_values as fixed
from basketry.functions.lookups import lookup
from basketry.functions.ordering import numbered, value_buckets
from basketry.operators.components import merged
from basketry.operators.neighbours import counts_by_columns
from basketry.session import staged

PAIR_BUDGET = 1_000  # two boxes with at most this many pairs of rows are compared directly
ROW_BUDGET = 64  # a box on the rim with at most this many spots is compared spot by spot
SALT_ROWS = 50_000  # rows of one cell per task when a cell has to be looked at row by row
COLUMN_SPOTS, COLUMN_WORK = 8, 10**10  # columns serve with so many spots each, or so few pairs of spots and columns
FINER = 2  # how much finer the boxes of the next level are, per feature
NOISE = -1


class Space:
    """Cell arithmetic for one choice of features and `eps`."""

    def __init__(self, features: Sequence[str], eps: float):
        self.features, self.eps = list(features), eps
        self.side = eps / sqrt(len(self.features)) * (1 - 1e-9)
        reach = ceil(eps / self.side)
        self.offsets = [o for o in product(range(-reach, reach + 1), repeat=len(self.features))
                        if sum(max(abs(v) - 1, 0) ** 2 for v in o) * self.side ** 2 <= eps * eps]

    def cell(self, parts: int = 1) -> Column:
        """Cell of a row, as whole numbers per feature; cells `parts` times finer for parts > 1."""
        return F.array(*[F.floor(F.col(c) / F.lit(self.side / parts)).cast("long") for c in self.features])

    def box(self) -> list[Column]:
        """Aggregates for the bounding box of a group of rows."""
        return [F.array(*[F.min(c) for c in self.features]).alias("low"),
                F.array(*[F.max(c) for c in self.features]).alias("high"),
                F.count(F.lit(1)).alias("n")]

    def at(self) -> Column:
        return F.array(*[F.col(c) for c in self.features])

    def near(self, low_a, high_a, low_b, high_b) -> Column:
        """Least squared distance between two boxes."""
        return self._squares(lambda d: F.greatest(low_a[d] - high_b[d], low_b[d] - high_a[d], F.lit(0.0)))

    def far(self, low_a, high_a, low_b, high_b) -> Column:
        """Largest squared distance between two boxes."""
        return self._squares(lambda d: F.greatest(high_a[d] - low_b[d], high_b[d] - low_a[d]))

    def between(self, x, y) -> Column:
        """Squared distance between two rows."""
        return self._squares(lambda d: x[d] - y[d])

    def _squares(self, gap) -> Column:
        gaps = [gap(d) for d in range(len(self.features))]
        return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])

    def within(self, squared) -> Column:
        return F.sqrt(squared) <= F.lit(self.eps)


def _adjacent(cells: DataFrame, space: Space) -> DataFrame:
    """Rows (cell, other): occupied cells near enough to hold neighbours, the cell itself included."""
    shifts = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in space.offsets])
    shifted = F.transform(shifts, lambda o: F.zip_with("cell", o, lambda x, y: x + y))
    return cells.select("cell", F.explode(shifted).alias("other")).join(
        cells.select(F.col("cell").alias("other")), "other", "left_semi")


def _reached(asking: DataFrame, rows: DataFrame, boxes: DataFrame, adjacent: DataFrame, space: Space) -> DataFrame:
    """Rows (key, other, hits): how many of `rows` in cell `other` are within eps of a row of `asking`.

    `asking` has few rows per cell (cells of `min_samples` rows or more never ask).
    """
    targets = boxes.select(F.col("cell").alias("other"), "low", "high", "n", "cell_rows")
    asked = (asking.select("key", "cell", space.at().alias("x")).join(adjacent, "cell").join(targets, "other"))
    nearest = space.near(F.col("x"), F.col("x"), F.col("low"), F.col("high"))
    farthest = space.far(F.col("x"), F.col("x"), F.col("low"), F.col("high"))
    asked = asked.where(space.within(nearest)).withColumn("whole", space.within(farthest) | (F.col("cell") == F.col("other")))
    asked = staged(asked.select("key", "x", "other", "n", "cell_rows", "whole"), "asked")
    by_box = asked.where("whole").select("key", "other", F.col("n").alias("hits"))
    last_salt = F.floor((F.col("cell_rows") - 1) / SALT_ROWS)
    salted_open = asked.where("NOT whole").select(
        "key", "x", "other", F.explode(F.sequence(F.lit(0).cast("long"), last_salt)).alias("salt"))
    salted_rows = rows.select(F.col("cell").alias("other"), space.at().alias("y"),
                              F.pmod(F.xxhash64("key"), last_salt + 1).alias("salt"))
    by_row = (salted_open.join(salted_rows, ["other", "salt"]).where(space.within(space.between(F.col("x"), F.col("y"))))
              .groupBy("key", "other").agg(F.count(F.lit(1)).alias("hits")))
    return by_box.unionByName(by_row)


def neighbour_counts(points: DataFrame, features: Sequence[str], eps: float = fixed.EPS, key: str = "customer_id",
                     pair_budget: int = ROW_BUDGET, columns: bool | None = None) -> DataFrame:
    """Rows (key, neighbours): all rows within `eps`, the row itself included.

    Rows at one spot are counted once. Where the features but one take few values together (COLUMN_SPOTS, COLUMN_WORK), spots
    search columns (`neighbours.counts_by_columns`), else boxes; `columns` decides otherwise. Both are exact.
    """
    space = Space(features, eps)
    placed = points.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in space.features])
    spots = staged(placed.groupBy(*space.features).agg(F.count(F.lit(1)).alias("rows")).withColumn("cell", space.cell()), "spots")
    finite = reduce(and_, [F.abs(F.col(c)) < F.lit(float("inf")) for c in space.features])
    known = spots.where(finite)
    values = known.agg(*[F.approx_count_distinct(c).alias(c) for c in space.features]).first()
    long = max(space.features, key=lambda c: values[c])
    if columns is None:
        n, held = known.count(), known.select(*[c for c in space.features if c != long], F.lit(1)).distinct().count()
        columns = n * held <= COLUMN_WORK or n >= COLUMN_SPOTS * held
    counts = counts_by_columns(known, space.features, eps, long) if columns else _counts_by_boxes(spots, space, pair_budget)
    return lookup(placed.select("key", space.at().alias("x")), counts, ["x"]).select(F.col("key").alias(key), "neighbours")


def _counts_by_boxes(spots: DataFrame, space: Space, pair_budget: int) -> DataFrame:
    """Rows (x, neighbours) for every spot x.

    A spot takes boxes within its reach as a whole and drops those out
    of it; the few on the rim are split finer, level by level, until they hold at most `pair_budget`
    spots, which are compared one by one. Work follows the boxes on the rim, not the pairs of rows.
    """
    box = [*space.box()[:2], F.sum("rows").alias("n"), F.count(F.lit(1)).alias("spots")]
    adjacent = _adjacent(spots.select("cell").distinct(), space)
    asking = spots.select(space.at().alias("x"), "cell").join(adjacent, "cell").select("x", F.array("other").alias("path"))
    found, depth = None, 1
    while True:
        rows = spots.withColumn("path", _path(space, depth))
        level = staged(rows.groupBy("path").agg(*box), f"boxes-{depth}")
        met = asking.join(level, "path")
        x = F.col("x")
        met = met.where(space.within(space.near(x, x, F.col("low"), F.col("high")))).withColumn(
            "whole", space.within(space.far(x, x, F.col("low"), F.col("high"))))
        met = staged(met.select("x", "path", "n", "spots", "whole"), "asked")
        compared = (met.where(~F.col("whole") & (F.col("spots") <= pair_budget)).select("x", "path")
                    .join(rows.select("path", space.at().alias("y"), "rows"), "path")
                    .where(space.within(space.between(x, F.col("y")))).select("x", F.col("rows").alias("n")))
        hits = staged(met.where("whole").select("x", "n").unionByName(compared).groupBy("x").agg(F.sum("n").alias("n")), "hits")
        found = hits if found is None else found.unionByName(hits)
        left = met.where(~F.col("whole") & (F.col("spots") > pair_budget))
        if left.isEmpty():
            break
        depth += 1
        children = spots.select(_path(space, depth).alias("child")).distinct().withColumn("path", F.slice("child", 1, depth - 1))
        asking = left.select("x", "path").join(children, "path").select("x", F.col("child").alias("path"))
    return found.groupBy("x").agg(F.sum("n").alias("neighbours"))


def core_points(points: DataFrame, features: Sequence[str], eps: float = fixed.EPS,
                min_samples: int = fixed.MIN_SAMPLES, key: str = "customer_id") -> DataFrame:
    """Rows (key, is_core). Counting stops where `min_samples` are found."""
    counts = _Parts(points, features, eps, min_samples, key).counts
    return counts.select(F.col("key").alias(key), (F.col("neighbours") >= min_samples).alias("is_core"))


class _Parts:
    """Tables that the steps of the clustering share; each is written when first asked for."""

    def __init__(self, points, features, eps, min_samples, key):
        self.space, self.min_samples = Space(features, eps), min_samples
        placed = points.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in self.space.features])
        placed = placed.withColumn("cell", self.space.cell())
        self.boxes = staged(placed.groupBy("cell").agg(*self.space.box()).withColumn("cell_rows", F.col("n")), "boxes")
        self.rows = staged(lookup(placed, self.boxes.select("cell", "cell_rows"), ["cell"]), "rows")
        self.is_dense = F.col("cell_rows") >= min_samples

    @cached_property
    def adjacent(self) -> DataFrame:
        return staged(_adjacent(self.boxes, self.space), "adjacent")

    @cached_property
    def sparse(self) -> DataFrame:
        """Rows of sparse cells with their neighbours, counted up to `min_samples`."""
        rows = self.rows.where(~self.is_dense)
        found = _reached(rows, self.rows, self.boxes, self.adjacent, self.space)
        counts = found.groupBy("key").agg(F.least(F.sum("hits"), F.lit(self.min_samples)).alias("neighbours"))
        return staged(rows.join(counts, "key"), "sparse")

    @property
    def counts(self) -> DataFrame:
        full = F.lit(self.min_samples).cast("long").alias("neighbours")
        return self.rows.where(self.is_dense).select("key", full).unionByName(self.sparse.select("key", "neighbours"))

    @property
    def core(self) -> DataFrame:
        """Core rows: all of dense cells, and those of sparse cells with enough neighbours."""
        few = self.sparse.where(F.col("neighbours") >= self.min_samples).drop("neighbours")
        return self.rows.where(self.is_dense).unionByName(few)

    @property
    def rest(self) -> DataFrame:
        return self.sparse.where(F.col("neighbours") < self.min_samples).drop("neighbours")


def _components(core: DataFrame, boxes: DataFrame, adjacent: DataFrame, space: Space, pair_budget: int) -> DataFrame:
    """Rows (id, root): cells with core rows, by their first keys, and the smallest id of the cluster.

    Level by level, boxes that lie within `eps` altogether link their cells, boxes out of reach are
    dropped, boxes with few pairs of rows are compared row by row, and the rest is split into finer
    boxes. Cells that are already in one cluster are not looked at again, so the certain links of
    dense regions spare nearly all comparisons. Boxes shrink to single points in the end, whose
    distance decides, so the result is exact for any number of rows per cell.
    """
    depth = 1
    rows = core.select("key", *space.features, "cell", "cell_rows", _path(space, depth).alias("path"))
    level = boxes.select(F.array("cell").alias("path"), "low", "high", "n")
    ends = boxes.select("cell", F.col("first_key").alias("u"))
    pairs = (adjacent.join(ends, "cell").join(ends.select(F.col("cell").alias("other"), F.col("u").alias("v")), "other")
             .where(F.col("u") < F.col("v"))
             .select("u", "v", F.array("cell").alias("path_u"), F.array("other").alias("path_v")))
    roots = staged(boxes.select(F.col("first_key").alias("id"), F.col("first_key").alias("root")), "roots")
    while True:
        pairs = _judged(pairs, level, space, pair_budget)
        roots = merged(roots, pairs.where("verdict = 'linked'").select("u", "v").distinct())
        unsure = staged(_apart(pairs.where("verdict <> 'linked'"), roots), "unsure")
        roots = merged(roots, _compared(unsure.where("verdict = 'few'"), rows, space))
        left = staged(_apart(unsure.where("verdict = 'open'"), roots), "open-pairs")
        if left.isEmpty():
            return roots
        depth += 1
        open_cells = left.select(F.col("path_u")[0].alias("cell")).unionByName(left.select(F.col("path_v")[0].alias("cell")))
        rows = staged(lookup(rows, open_cells.distinct(), ["cell"], "inner").withColumn("path", _path(space, depth)), "open-rows")
        level = staged(rows.groupBy("path").agg(*space.box()).withColumn("parent", F.slice("path", 1, depth - 1)), "boxes")
        pairs = _children(left, level)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose cells are not in the same component."""
    of_u = roots.select(F.col("id").alias("u"), F.col("root").alias("root_u"))
    of_v = roots.select(F.col("id").alias("v"), F.col("root").alias("root_v"))
    return pairs.join(of_u, "u").join(of_v, "v").where("root_u <> root_v").drop("root_u", "root_v")


def _path(space: Space, depth: int) -> Column:
    """The boxes of a row from the coarsest level to the one at `depth`."""
    return F.array(*[space.cell(FINER ** step) for step in range(depth)])


def _children(pairs: DataFrame, level: DataFrame) -> DataFrame:
    one = level.select(F.col("parent").alias("path_u"), F.col("path").alias("child_u"))
    two = level.select(F.col("parent").alias("path_v"), F.col("path").alias("child_v"))
    return pairs.join(one, "path_u").join(two, "path_v").select(
        "u", "v", F.col("child_u").alias("path_u"), F.col("child_v").alias("path_v"))


def _judged(pairs: DataFrame, level: DataFrame, space: Space, pair_budget: int) -> DataFrame:
    """Pairs of boxes in reach with a verdict: linked, few (rows to compare) or open."""
    for side in "uv":
        box = level.select(F.col("path").alias(f"path_{side}"), F.col("low").alias(f"low_{side}"),
                           F.col("high").alias(f"high_{side}"), F.col("n").alias(f"n_{side}"))
        pairs = pairs.join(box, f"path_{side}")
    bounds = [F.col(c) for c in ("low_u", "high_u", "low_v", "high_v")]
    few = F.col("n_u") * F.col("n_v") <= pair_budget
    verdict = F.when(space.within(space.far(*bounds)), "linked").when(few, "few").otherwise("open")
    return staged(pairs.where(space.within(space.near(*bounds))).select(
        "u", "v", "path_u", "path_v", verdict.alias("verdict")), "pairs")


def _compared(few: DataFrame, rows: DataFrame, space: Space) -> DataFrame:
    """Those of the pairs of small boxes that hold rows within `eps` of each other."""
    wanted = few.select(F.col("path_u").alias("path")).unionByName(few.select(F.col("path_v").alias("path"))).distinct()
    held = lookup(rows.select("path", space.at().alias("at")), wanted, ["path"], "inner")
    left = held.select(F.col("path").alias("path_u"), F.col("at").alias("x"))
    right = held.select(F.col("path").alias("path_v"), F.col("at").alias("y"))
    return (few.join(left, "path_u").join(right, "path_v").where(space.within(space.between(F.col("x"), F.col("y"))))
            .select("u", "v").distinct())


def dbscan(points: DataFrame, features: Sequence[str], eps: float = fixed.EPS, min_samples: int = fixed.MIN_SAMPLES,
           key: str = "customer_id", pair_budget: int = PAIR_BUDGET) -> DataFrame:
    """Rows (key, Cluster_DBSCAN): clusters numbered by their smallest core key, -1 for noise.

    A row that is not core takes the lowest-numbered cluster that has a core row within `eps`.
    """
    parts = _Parts(points, features, eps, min_samples, key)
    space, core = parts.space, parts.core
    boxes = staged(core.groupBy("cell").agg(
        *space.box(), F.min("key").alias("first_key"), F.max("cell_rows").alias("cell_rows")), "core-boxes")
    roots = _components(core, boxes, parts.adjacent, space, pair_budget)
    clusters = staged(roots.select("root").distinct(), "clusters")
    numbers = numbered(value_buckets(clusters, "root"), "_bucket", ["root"]).select(
        "root", (F.col("row") - 1).cast("int").alias("Cluster_DBSCAN"))
    of_head = lookup(roots, numbers, ["root"])
    cells = staged(boxes.join(of_head, F.col("first_key") == F.col("id")).select("cell", "Cluster_DBSCAN"), "core-cells")
    of_core = lookup(core.select("key", "cell"), cells, ["cell"]).select("key", "Cluster_DBSCAN")
    reached = _reached(parts.rest, core, boxes, parts.adjacent, space)
    of_border = (reached.join(cells.withColumnRenamed("cell", "other"), "other")
                 .groupBy("key").agg(F.min("Cluster_DBSCAN").alias("Cluster_DBSCAN")))
    of_rest = parts.rest.select("key").join(of_border, "key", "left").select(
        "key", F.coalesce("Cluster_DBSCAN", F.lit(NOISE)).alias("Cluster_DBSCAN"))
    return of_core.unionByName(of_rest).withColumnRenamed("key", key)
