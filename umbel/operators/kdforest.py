"""A forest of randomised kd-trees with one best-bin-first search over all of them."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

TREES, CHECKS = 5, 50
#: Rows of a leaf; rows that spreads are measured on; the widest dimensions of which one is drawn.
LEAF, SAMPLE, WIDEST = 8, 100, 5


class KdForest:
    """``points`` (n x d) in ``trees`` trees, each of which cuts at the mean of one of the widest dimensions, drawn at random."""

    def __init__(self, points: np.ndarray, trees: int = TREES, seed: int = 0):
        self.points = np.asarray(points, float)
        rng = np.random.default_rng(seed)
        #: Of every node: dimension, cut, lower and upper child; a leaf has dimension -1 and its rows.
        self.nodes: list[tuple] = []
        self.roots = [self._grow(np.arange(len(self.points)), rng) for _ in range(trees if len(self.points) else 0)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, rows))
        if len(rows) > LEAF:
            some = self.points[rows[:: -(-len(rows) // SAMPLE)]]
            spread = some.var(axis=0)
            dim = int(rng.choice(np.argsort(-spread, kind="stable")[:WIDEST]))
            cut = some[:, dim].mean()
            low = self.points[rows, dim] < cut
            if not low.any() or low.all():  # the sample misleads, or all are equal here
                cut = np.median(self.points[rows, dim])
                low = self.points[rows, dim] < cut
            if low.any():
                self.nodes[at] = (dim, cut, self._grow(rows[low], rng), self._grow(rows[~low], rng))
        return at

    def nearest(self, query: np.ndarray, k: int = 2, checks: int | None = CHECKS) -> tuple[list[tuple[float, int]], int]:
        """The ``k`` nearest rows found as (squared distance, row), and how many rows were compared.

        Cells are opened in order of a lower bound of their distance, in all trees at once, until ``checks`` rows were
        compared; with None until no cell can hold a nearer row, which makes the search exact.
        """
        best: list[tuple[float, int]] = []
        seen: set[int] = set()
        heap = [(0.0, i, r, ()) for i, r in enumerate(self.roots)]
        order = len(heap)
        while heap and (checks is None or len(seen) < checks):
            bound, _, at, offsets = heappop(heap)
            if len(best) == k and bound > best[-1][0]:
                break
            offsets = dict(offsets)
            while self.nodes[at][0] >= 0:
                dim, cut, low, high = self.nodes[at]
                gap = query[dim] - cut
                near, far = (low, high) if gap < 0 else (high, low)
                # moving away in a dimension replaces the offset it had, so bounds stay below true distances
                away = bound - offsets.get(dim, 0.0) + gap * gap
                order += 1
                heappush(heap, (away, order, far, (*((d, o) for d, o in offsets.items() if d != dim), (dim, gap * gap))))
                at = near
            rows = [r for r in self.nodes[at][1].tolist() if r not in seen]
            if rows:
                seen.update(rows)
                d = ((self.points[rows] - query) ** 2).sum(axis=1).tolist()
                best = sorted([*best, *zip(d, rows, strict=True)])[:k]
        return best, len(seen)
