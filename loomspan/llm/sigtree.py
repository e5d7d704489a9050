"""Signature trees: set similarity by dual traversal of nodes that hold OR-combined token bitmaps and size ranges.

A leaf holds a few sets of like sizes, an inner node a few nodes. A token sets the bit of its hash in a bitmap. Two sets
of nodes X and Y share at most the bits that both nodes have, and one more for each token of a set beyond its number of
bits; if even so many shared tokens would be too few for the smallest sizes in both ranges, the pair of nodes is pruned.
The bound is exact, so no similar pair is lost. Whatever is linked already, directly or over others, is passed over.
"""

from __future__ import annotations

import numpy as np

from loomspan.llm._shared import Forest

LEAF = 32
FANOUT = 8
MOST_BITS = 1 << 17


def bits_for(size: int) -> int:
    """At least as many bits as tokens, a power of two."""
    return min(MOST_BITS, max(64, 1 << int(size - 1).bit_length())) if size > 1 else 64


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Little-endian words of the tokens' bitmap. Bitmaps of fewer bits are this one folded by OR."""
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_or.reduce(words.reshape(-1, bits // 64), axis=0)


class Tree:
    """`sizes` and `maps` (one row of words for each set), all bitmaps of one width; `num / den` is the least Jaccard similarity."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.order = np.lexsort((*maps[:, :2].T, sizes))
        self.sizes, self.maps = sizes[self.order], maps[self.order]
        self.excess = np.maximum(self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64), 0)
        #: Levels from the leaves up: first and last set of each node, OR bitmap, size range, greatest excess.
        self.levels: list[tuple[np.ndarray, ...]] = []
        starts, step = np.arange(0, len(sizes), LEAF), LEAF
        while True:
            ends = np.minimum(starts + step, len(sizes))
            self.levels.append((starts, ends, np.bitwise_or.reduceat(self.maps, starts, axis=0), self.sizes[starts], self.sizes[ends - 1], np.maximum.reduceat(self.excess, starts)))
            if len(starts) == 1:
                return
            step *= FANOUT
            starts = np.arange(0, len(sizes), step)

    def enough(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether `shared` common tokens of sets of `a` and `b` tokens reach the similarity."""
        return (self.num + self.den) * shared >= self.num * (a + b)

    def _hopeless(self, level: int, x: int, y: int) -> bool:
        _, _, maps, low, high, excess = self.levels[level]
        if self.den * high[x] < self.num * low[y] or self.den * high[y] < self.num * low[x]:
            return True
        most = min(int(np.bitwise_count(maps[x] & maps[y]).sum()) + min(int(excess[x]), int(excess[y])), int(high[x]), int(high[y]))
        return (self.num + self.den) * most < self.num * int(low[x] + low[y])

    def link(self, forest: Forest, same) -> list[tuple[int, int]]:
        """Joins all sets that `same(i, j)` accepts, and gives the pairs that joined two parts: a spanning forest of all links."""
        found, order = [], self.order
        work = [(len(self.levels) - 1, 0, 0)]
        while work:
            level, x, y = work.pop()
            starts, ends = self.levels[level][:2]
            xs, ys = slice(starts[x], ends[x]), slice(starts[y], ends[y])
            rx, ry = self._roots(forest, order[xs]), self._roots(forest, order[ys])
            if (rx == rx[0]).all() and (ry == rx[0]).all():
                continue
            if x != y and self._hopeless(level, x, y):
                continue
            if level:
                below = len(self.levels[level - 1][0])
                ax, ay = range(x * FANOUT, min((x + 1) * FANOUT, below)), range(y * FANOUT, min((y + 1) * FANOUT, below))
                work += [(level - 1, i, j) for i in reversed(ax) for j in reversed(ay) if i < j or (i != j and x != y)]
                if x == y:
                    work += [(level - 1, i, i) for i in reversed(ax)]
                continue
            shared = np.bitwise_count(self.maps[xs, None] & self.maps[None, ys]).sum(2, dtype=np.int64)
            most = np.minimum(shared + np.minimum(self.excess[xs, None], self.excess[None, ys]), np.minimum(self.sizes[xs, None], self.sizes[None, ys]))
            able = self.enough(most, self.sizes[xs, None], self.sizes[None, ys]) & (rx[:, None] != ry[None, :])
            if x == y:
                able = np.triu(able, 1)
            for i, j in zip(*np.nonzero(able), strict=True):
                a, b = int(order[starts[x] + i]), int(order[starts[y] + j])
                if forest.root(a) != forest.root(b) and same(a, b):
                    forest.join(a, b)
                    found.append((a, b))
        return found

    @staticmethod
    def _roots(forest: Forest, which: np.ndarray) -> np.ndarray:
        up = forest.up
        at = up[which]
        while True:
            above = up[at]
            if np.array_equal(above, at):
                up[which] = at
                return at
            at = above


def links(sizes: np.ndarray, maps: np.ndarray, num: int, den: int, same=None, forest: Forest | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; without `same`, of what the bitmaps can't rule out."""
    if len(sizes) < 2:
        return []
    return Tree(sizes, maps, num, den).link(forest or Forest(len(sizes)), same or (lambda a, b: True))


def common_width(maps: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Bitmaps as rows of one width. Wider ones are folded to the narrowest that has as many bits as the smallest set has tokens:

    sets of like sizes have like widths, and a fold keeps the bound exact.
    """
    bits = min(64 * len(m) for m in maps)
    return np.stack([folded(m, bits) for m in maps])
