"""Suffix sorting by merging, with hash comparisons: common extensions are found by binary search on prefix hashes."""

from __future__ import annotations

import numpy as np

from sparkscope.llm.shingles import powers

U = np.uint64


class Extensions:
    """Longest common extensions of suffixes of one byte array.

    ``prefix[i]`` is the polynomial hash of the first i bytes; two substrings are compared by cross-multiplied
    differences, so an extension takes log2(length) probes.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.up, _ = powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + U(1)) * self.up[: len(data)], out=self.prefix[1:])

    def equal(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.prefix[x + n] - self.prefix[x]) * self.up[y] == (self.prefix[y + n] - self.prefix[y]) * self.up[x]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y, ``most`` at most."""
        low, high = np.zeros_like(most), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.equal(x, y, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, np.maximum(middle - 1, low))
        return low

    def verified(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bool:
        """Whether the bytes agree as the hashes say."""
        ends = np.cumsum(n)
        inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
        return bool((self.data[np.repeat(x, n) + inside] == self.data[np.repeat(y, n) + inside]).all())


class SuffixSort:
    """Sorts bounded suffixes by (group, bytes). ``order`` is the result; ``shared[k]`` is what its k-th suffix has in
    common with the one before it (0 across groups)."""

    def __init__(self, ext: Extensions, group: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.ext, self.group, self.start, self.length = ext, group, start, length
        self.order = np.argsort(group, kind="stable")
        self._merge_sort()
        self.shared = self._shared()
        if not ext.verified(start[self.order[1:]], start[self.order[:-1]], self.shared[1:]):
            self._sort_bytes()  # two different strings share a hash

    def _less(self, i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix i goes before suffix j; equal ones as ``ties`` says."""
        gi, gj = self.group[i], self.group[j]
        out = gi < gj
        same = np.flatnonzero(gi == gj)
        if len(same):
            a, b = i[same], j[same]
            la, lb = self.length[a], self.length[b]
            most = np.minimum(la, lb)
            n = self.ext.common(self.start[a], self.start[b], most)
            inside = n < most
            last = len(self.ext.data) - 1
            ca = self.ext.data[np.minimum(self.start[a] + n, last)]
            cb = self.ext.data[np.minimum(self.start[b] + n, last)]
            out[same] = np.where(inside, ca < cb, np.where(la == lb, ties, la < lb))
        return out

    def _merge_sort(self) -> None:
        """Bottom up. Pairs of runs that are in order already are left alone; the others are merged by the rank of
        each suffix in the other run, found by binary search for all of them at once."""
        n, width = len(self.order), 1
        while width < n:
            left = np.arange(0, n - width, 2 * width)
            edge = left + width
            wrong = self._less(self.order[edge], self.order[edge - 1], False)
            left, edge = left[wrong], edge[wrong]
            if len(left):
                stop = np.minimum(edge + width, n)
                self._merge(left, edge, stop)
            width *= 2

    def _merge(self, left: np.ndarray, edge: np.ndarray, stop: np.ndarray) -> None:
        old = self.order.copy()
        for first, last, low, high, ties in ((left, edge, edge, stop, True), (edge, stop, left, edge, False)):
            sizes = last - first
            of = np.repeat(np.arange(len(first)), sizes)
            at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of]
            lo, hi = low[of].copy(), high[of].copy()
            mine = old[at]
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                middle = (lo[live] + hi[live]) >> 1
                # Those of the other run that go before mine: all smaller ones, and equal ones if mine is on the right.
                before = self._less(old[middle], mine[live], not ties)
                lo[live[before]] = middle[before] + 1
                hi[live[~before]] = middle[~before]
            self.order[(at - first[of]) + (lo - low[of]) + left[of]] = mine

    def _shared(self) -> np.ndarray:
        a, b = self.order[:-1], self.order[1:]
        most = np.where(self.group[a] == self.group[b], np.minimum(self.length[a], self.length[b]), 0)
        return np.concatenate([[0], self.ext.common(self.start[a], self.start[b], most)]).astype(np.int64)

    def _sort_bytes(self) -> None:
        data = self.ext.data.tobytes()
        text = [data[s : s + n] for s, n in zip(self.start.tolist(), self.length.tolist())]
        self.order = np.array(sorted(range(len(text)), key=lambda i: (self.group[i], text[i])), dtype=np.int64)
        shared = [0]
        for i, j in zip(self.order[:-1], self.order[1:]):
            n = 0
            if self.group[i] == self.group[j]:
                while n < min(len(text[i]), len(text[j])) and text[i][n] == text[j][n]:
                    n += 1
            shared.append(n)
        self.shared = np.array(shared, dtype=np.int64)

    def classes(self, n: int) -> np.ndarray:
        """A number for each suffix; within a group, those of ``n`` bytes or more with equal first n bytes share it."""
        new = self.shared < n
        if n == 0:
            g = self.group[self.order]
            new = np.concatenate([[True], g[1:] != g[:-1]])
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.cumsum(new)
        return out
