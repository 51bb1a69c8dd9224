"""Order statistics and robust means of sliding windows, for all windows at once.

A tree over the ranks of the values keeps, at every level, the values of a
node (a range of ranks) next to each other in time order: those that go left
before those that go right (the layout of a wavelet matrix, so one count per
position leads to the next level). A window of neighbouring cadences is then a
range at every node, so its k-th value, and sums over the values of a window
that lie in a value range, take one step per level whatever the window holds.
All windows descend together in NumPy vectors. Sums are kept about the middle of
each node and only nodes inside the value range are added, so nothing cancels.
"""

from __future__ import annotations

import numpy as np

#: Powers kept per node: the bisquare weight times the value has degree five.
_POWERS = 5


class RankTree:
    """Windows are position ranges [first, last) over ``values`` (finite numbers in time order)."""

    def __init__(self, values: np.ndarray):
        n = self.n = len(values)
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        ranks = np.empty(n, np.int64)
        # ranks start at 1: 0 and n + 1 are bounds outside
        ranks[order] = np.arange(1, n + 1)
        self.levels = (n + 1).bit_length()
        self._lower, self._sums, self._middle, self._half = [], [None], [None], [None]
        layout = ranks
        for level in range(self.levels):
            shift = self.levels - 1 - level
            left = (layout >> shift) & 1 == 0
            self._lower.append(np.concatenate([[0], np.cumsum(left)]))
            layout = np.concatenate([layout[left], layout[~left]])
            node = layout >> shift
            # a node holds the ranks that share its leading bits
            bounds = np.clip(np.arange((n >> shift) + 2) << shift, 1, n + 1) - 1
            first, last = bounds[:-1], bounds[1:] - 1
            held = last >= first
            low, high = self.sorted[np.minimum(first, n - 1)], self.sorted[np.maximum(last, 0)]
            middle, half = np.where(held, 0.5 * (low + high), 0.0), np.where(held, 0.5 * (high - low), 0.0)
            t = (self.sorted[layout - 1] - middle[node]) / np.where(half > 0, half, 1.0)[node]
            powers = np.zeros((n + 1, _POWERS))
            power = np.ones(n)
            for p in range(_POWERS):
                power = power * t
                np.cumsum(power, out=powers[1:, p])
            self._sums.append(powers)
            self._middle.append(middle)
            self._half.append(half)

    def kth(self, first: np.ndarray, last: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest value (from 0) of every window; ``k`` lies in the window."""
        node, k = np.zeros(len(first), np.int64), k.copy()
        for lower in self._lower:
            a, b = lower.take(first), lower.take(last)
            count = b - a
            up = k >= count
            k -= count * up
            first, last = np.where(up, lower[-1] + first - a, a), np.where(up, lower[-1] + last - b, b)
            node += node + up
        return self.sorted[node - 1]

    def medians(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(median, median of the absolute deviations from it) of every window; windows are not empty."""
        count = last - first
        half = count // 2
        median = self.kth(first, last, half)
        even = np.flatnonzero(count % 2 == 0)
        median[even] = 0.5 * (self.kth(first[even], last[even], half[even] - 1) + median[even])
        # deviations rise to both sides of the middle: the wanted one is found between two rising runs, i of it from below
        wanted = (count - 1) // 2 + 1
        low, high = np.maximum(0, wanted - (count - half)), np.minimum(wanted, half)

        def below(at, i):
            return median[at] - self.kth(first[at], last[at], half[at] - 1 - i)

        def above(at, j):
            return self.kth(first[at], last[at], half[at] + j) - median[at]

        while len(at := np.flatnonzero(low < high)):
            i = (low[at] + high[at]) // 2
            more = below(at, i) < above(at, wanted[at] - i - 1)
            low[at], high[at] = np.where(more, i + 1, low[at]), np.where(more, high[at], i)
        i, j = low, wanted - low

        def side(get, number, inside, other):
            out = np.full(len(count), other)
            at = np.flatnonzero(inside)
            out[at] = get(at, number[at])
            return out

        deviation = np.maximum(side(below, i - 1, i > 0, -np.inf), side(above, j - 1, j > 0, -np.inf))
        after = np.minimum(side(below, i, i < half, np.inf), side(above, j, j < count - half, np.inf))
        deviation[even] = 0.5 * (deviation[even] + after[even])
        return median, deviation

    def bisquare(self, first, last, centre: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per window, the sums of the weights (1 - u^2)^2 and of weight times u, where u = (value - centre) / scale lies in (-1, 1)."""
        weight, moment = np.zeros(len(first)), np.zeros(len(first))
        low = np.searchsorted(self.sorted, centre - scale, side="right")
        high = np.maximum(np.searchsorted(self.sorted, centre + scale, side="left"), low) + 1
        ends = [[low, np.zeros_like(low), first, last], [high, np.zeros_like(low), first, last]]
        for level, lower in enumerate(self._lower):
            shift = self.levels - 1 - level
            apart = ends[0][1] != ends[1][1]
            for side, end in enumerate(ends):
                bound, node, x, y = end
                a, b = lower.take(x), lower.take(y)
                up = (bound >> shift) & 1 == 1
                right = lower[-1] + x - a, lower[-1] + y - b
                # the child between the two bounds lies wholly in the value range
                at = np.flatnonzero(apart & (up if side else ~up))
                p, q = (a[at], b[at]) if side else (right[0][at], right[1][at])
                some = q > p
                at, p, q = at[some], p[some], q[some]
                self._add(level + 1, 2 * node[at] + (1 - side), p, q, centre[at], scale[at], weight, moment, at)
                end[1:] = 2 * node + up, np.where(up, right[0], a), np.where(up, right[1], b)
        return weight, moment

    def _add(self, level, node, first, last, centre, scale, weight, moment, at) -> None:
        """Add the sums of whole nodes, moved from the middle of the node to the centre of the window."""
        a, b = (self._middle[level][node] - centre) / scale, self._half[level][node] / scale
        one, two, three, four, five = (self._sums[level].take(last, axis=0) - self._sums[level].take(first, axis=0)).T
        bb, aa = b * b, a * a
        one, two, three, four, five = one * b, two * bb, three * (bb * b), four * (bb * bb), five * (bb * bb * b)
        rest = 1 - aa
        none = (last - first) * rest * rest
        weight[at] += none - 4 * a * (rest * one - three) + (6 * aa - 2) * two + four
        moment[at] += a * (none + (10 * aa - 6) * two + 5 * four) + (1 - 6 * aa + 5 * aa * aa) * one + (10 * aa - 2) * three + five


def biweight_location(times: np.ndarray, values: np.ndarray, half: np.ndarray, iterations: int, cval: float) -> np.ndarray:
    """Tukey biweight of the values within ``half`` of each time; times are sorted integers.

    Values that are no finite number take no part; a time without any value
    near it has none. The time per cadence grows with the logarithm of the
    number of cadences, not with what a window holds.
    """
    out = np.full(len(times), np.nan)
    good = np.isfinite(values)
    known = times[good]
    first, last = np.searchsorted(known, times - half, side="left"), np.searchsorted(known, times + half, side="right")
    asked = np.flatnonzero(last > first)
    if not len(asked):
        return out
    first, last = first[asked], last[asked]
    tree = RankTree(values[good])
    location, scale = tree.medians(first, last)
    scale = cval * scale
    at = np.flatnonzero(scale > 0)
    for _ in range(iterations):
        weight, moment = tree.bisquare(first[at], last[at], location[at], scale[at])
        at, moment = at[weight > 0], moment[weight > 0] / weight[weight > 0]
        location[at] += scale[at] * moment
    out[asked] = location
    return out
