"""Sums of Euclidean distances from every row of one block to the rows of each cluster in another block.

The rows of a block lie in a tree of boxes. Boxes that are far apart, as their extents go, meet through the points of Chebyshev
grids, whose number does not grow with the rows: distances are smooth there, and grids are taken so fine that the error of a
distance is below TOLERANCE of it (errors of many distances cancel: sums over 900,000 rows differed by 4e-14 of them at most in trials). All other rows meet one by one. Every row counts; no distance is left out or drawn.
"""

from collections.abc import Sequence
from math import ceil, log, prod, sqrt

import numpy as np

#: Largest error of a distance between far boxes, as a share of it.
TOLERANCE = 1e-10
#: Rows of a box that is not split, and distances that are held at once.
LEAF, TILE = 512, 1 << 14
#: Rows per value of a feature whose values split the boxes: flat boxes need fewer points.
FLAT = 256
#: Points along one side of a grid.
ORDERS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18)
#: Per order the points on a side from -1 to 1, and the Chebyshev polynomials there (polynomials x points).
NODES = {q: np.cos((2 * np.arange(q) + 1) * np.pi / (2 * q)) if q > 1 else np.zeros(1) for q in ORDERS}
WAVES = {q: np.cos(np.arange(q)[:, None] * np.arccos(NODES[q])) for q in ORDERS}
#: Boxes that could be split meet through grids where that takes at most the first share of the distances of their rows, others the second.
WORTH, LEAF_WORTH = 0.3, 0.7


def boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of `x` (features x rows), and the tree of boxes over rows in that order: a row (start, stop, first of
    its two children or -1, least values, greatest values) per box."""
    order, found, k = np.arange(x.shape[1]), [[0, x.shape[1]]], 0
    while k < len(found):
        start, stop = found[k]
        mine = x[:, order[start:stop]]
        low, high = mine.min(1), mine.max(1)
        parts = _parted(mine, low, high) if stop - start > LEAF else None
        found[k] += [len(found) if parts else -1, *low, *high]
        if parts:
            order[start:stop] = order[start:stop][np.concatenate(parts)]
            middle = start + len(parts[0])
            found += [[start, middle], [middle, stop]]
        k += 1
    return order, np.array(found, np.float64)


def _parted(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The rows of a box as two: between values of a feature that has few of them, otherwise halves of the widest side."""
    n, few = x.shape[1], []
    for d in np.flatnonzero(high > low):
        if len(np.unique(x[d, ::-(-n // 1000)])) * FLAT <= n and len(values := np.unique(x[d])) * FLAT <= n:
            few.append((len(values), d, values))
    if few:
        _, d, values = min(few, key=lambda f: f[:2])
        right = x[d] >= max(np.median(x[d]), values[1])
        return np.flatnonzero(~right), np.flatnonzero(right)
    if not (high > low).any():
        return None
    at = np.argpartition(x[int((high - low).argmax())], n // 2)
    return at[:n // 2], at[n // 2:]


class Block:
    """Rows in the order of their boxes: `x` (features x rows) and `at` (labelings x rows), the place of a row's cluster among `width` of all labelings."""

    def __init__(self, x: np.ndarray, at: np.ndarray, table: np.ndarray, width: int):
        d = len(x)
        self.x, self.at, self.width, self.held = x, at, width, {}
        self.rows = [slice(int(start), int(stop)) for start, stop in table[:, :2]]
        self.children = [(int(k), int(k) + 1) if k >= 0 else () for k in table[:, 2]]
        self.low, self.high = table[:, 3:3 + d].tolist(), table[:, 3 + d:].tolist()
        self.member = np.zeros((x.shape[1], width))
        for place in at:
            self.member[np.arange(x.shape[1]), place] = 1.0

    def grid(self, box: int, orders: tuple[int, ...]) -> np.ndarray:
        """The points of a grid (features x points)."""
        found, points = np.empty((len(orders), prod(orders))), prod(orders)
        for d, (low, high, q) in enumerate(zip(self.low[box], self.high[box], orders)):
            points //= q
            found[d] = np.tile(np.repeat((low + high) / 2 + (high - low) / 2 * NODES[q], points), found.shape[1] // (points * q))
        return found

    def shares(self, box: int, orders: tuple[int, ...]):
        """A few rows of a box at a time: their slice, and two factors (rows x some points, rows x others) of what each point of the grid has of a row."""
        active = [d for d, q in enumerate(orders) if q > 1]
        first = prod(orders[d] for d in active[:-1])
        step = max(1, (16 * TILE) // first)
        for start in range(self.rows[box].start, self.rows[box].stop, step):
            part = slice(start, min(start + step, self.rows[box].stop))
            factors = [np.ones((part.stop - start, 1))]
            for d in active:
                low, high, q = self.low[box][d], self.high[box][d], orders[d]
                angle = np.arccos(np.clip((2 * self.x[d, part] - low - high) / (high - low), -1, 1))
                side = (2 * np.cos(angle[:, None] * np.arange(q)) @ WAVES[q] - 1) / q
                if d == active[-1]:
                    factors.append(side)
                else:
                    factors[0] = (factors[0][:, :, None] * side[:, None, :]).reshape(len(side), -1)
            yield part, factors[0], factors[1] if active else factors[0]

    def moments(self, box: int, orders: tuple[int, ...]) -> np.ndarray:
        """What the rows of a box weigh at the points of its grid (points x clusters)."""
        if (box, orders) not in self.held:
            total = np.zeros((self.width, prod(orders)))
            for part, some, others in self.shares(box, orders):
                for place in self.at[:, part]:
                    for c in np.flatnonzero(np.bincount(place, minlength=self.width)):
                        mine = place == c
                        total[c] += (some[mine].T @ others[mine]).ravel()
            self.held[box, orders] = total.T.copy()
        return self.held[box, orders]


def _orders(low: Sequence[float], high: Sequence[float], gaps: Sequence[float], apart: float, wanted: float) -> tuple[int, ...] | None:
    """Points along every side of a box for an error of at most exp(-wanted) of a distance over the `gaps`; None where that takes too many.

    Along a side the distance is analytic up to the nearest complex point where it vanishes; with every point the error falls
    by the parameter of the ellipse around the side through there.
    """
    found = []
    for a, b, gap in zip(low, high, gaps):
        half = (b - a) / 2
        if half == 0:
            found.append(1)
            continue
        across = sqrt(max(apart - gap * gap, 0.0)) / half
        root = complex(1 + gap / half if gap > 0 else 0, across)
        parameter = abs(root + (root * root - 1) ** 0.5)
        parameter = max(parameter, 1 / parameter) if parameter else 0
        if not parameter >= 2:
            return None
        need = ceil(wanted / log(parameter))
        if need > ORDERS[-1]:
            return None
        found.append(next(q for q in ORDERS if q >= need))
    return tuple(found)


def add_near(totals: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> None:
    """Adds to `totals` (points of `x` by clusters) the distances to all points of `y`, one by one."""
    tile = min(max(1, TILE // y.shape[1]), x.shape[1])
    gaps, gap = np.empty((2, tile, y.shape[1]))
    for start in range(0, x.shape[1], tile):
        part = x[:, start:start + tile]
        apart, one = gaps[:part.shape[1]], gap[:part.shape[1]]
        apart.fill(0.0)
        for mine, other in zip(part, y):
            np.subtract(mine[:, None], other, out=one)
            np.multiply(one, one, out=one)
            np.add(apart, one, out=apart)
        np.sqrt(apart, out=apart)
        totals[start:start + tile] += apart @ weights


def add_far(totals: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> None:
    """As `add_near` for boxes that lie apart: squared distances as products, from an origin among the points of `x`."""
    x, y = x - x[:, :1], y - x[:, :1]
    left = np.concatenate([-2 * x, np.ones((1, x.shape[1])), [(x * x).sum(0)]]).T
    right = np.concatenate([y, [(y * y).sum(0)], np.ones((1, y.shape[1]))])
    tile = max(1, 2 * TILE // y.shape[1])
    for start in range(0, len(left), tile):
        apart = left[start:start + tile] @ right
        np.sqrt(apart, out=apart)
        totals[start:start + tile] += apart @ weights


class Sums:
    """Summed distances of the rows of a block to the rows of each cluster, over blocks that are given one after another."""

    def __init__(self, block: Block):
        self.block, self.totals = block, np.zeros((block.x.shape[1], block.width))
        self.local: dict[tuple, np.ndarray] = {}

    def add(self, other: Block) -> None:
        mine, wanted, stack = self.block, -log(TOLERANCE / 2), [(0, 0)]
        while stack:
            a, b = stack.pop()
            rows, others = mine.rows[a], other.rows[b]
            n, m = rows.stop - rows.start, others.stop - others.start
            gaps = [max(la - hb, lb - ha, 0.0) for la, ha, lb, hb in zip(mine.low[a], mine.high[a], other.low[b], other.high[b])]
            apart = sum(g * g for g in gaps)
            grids = [_orders(block.low[k], block.high[k], gaps, apart, wanted) if apart > 0 else None for block, k in ((mine, a), (other, b))]
            points, weighed = (min(prod(q), size) if q else size for q, size in zip(grids, (n, m)))
            leaf = not mine.children[a] and not other.children[b]
            if points * weighed <= (LEAF_WORTH if leaf else WORTH) * n * m:
                x, totals = mine.x[:, rows], self.totals[rows]
                if points < n:
                    x = mine.grid(a, grids[0])
                    totals = self.local.setdefault((a, grids[0]), np.zeros((points, mine.width)))
                if weighed < m:
                    add_far(totals, x, other.grid(b, grids[1]), other.moments(b, grids[1]))
                else:
                    add_far(totals, x, other.x[:, others], other.member[others])
            elif leaf:
                add_near(self.totals[rows], mine.x[:, rows], other.x[:, others], other.member[others])
            elif other.children[b] and (m >= n or not mine.children[a]):
                stack += [(a, k) for k in other.children[b]]
            else:
                stack += [(k, b) for k in mine.children[a]]

    def result(self) -> np.ndarray:
        """Rows of the block by clusters."""
        for (box, orders), local in self.local.items():
            for part, some, others in self.block.shares(box, orders):
                share = (some[:, :, None] * others[:, None, :]).reshape(len(some), -1) if prod(orders) > 1 else some
                self.totals[part] += share @ local
        self.local.clear()
        return self.totals
