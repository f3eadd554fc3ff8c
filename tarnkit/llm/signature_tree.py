"""Signature trees over token sets, and their dual traversal.

Sets are laid out so that similar ones are neighbours; LEAF of them share a leaf,
FAN nodes a parent. A node holds its range of set sizes and a token bitmap, the OR of
its sets' bitmaps. Several tokens of one set may share a bit, so a bit carries the
largest number of tokens that a set of the node has there, and the sum of the
smaller counts over all bits bounds the overlap of any two sets of two nodes from
above. A pair of nodes is dropped when its size ranges are too far apart, when that
bound is less than the least overlap that a link needs, or when all its sets are in
one component already: only the components matter, so links inside one need no check.
"""

from __future__ import annotations

import numpy as np

BITS, LEAF, FAN = 256, 16, 8


class UnionFind:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        while (nxt := self.up[self.up]).tobytes() != self.up.tobytes():
            self.up = nxt
        return self.up


class SignatureTree:
    """tokens: one sorted array a set; sizes: the sets' full sizes, which may exceed
    the tokens given when these are bottom sketches of keep tokens."""

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray, keep: int | None = None, least: int = 0) -> None:
        first = np.array([t[0] for t in tokens], np.uint64)
        self.order = np.lexsort((sizes, first))
        chosen = [tokens[i] for i in self.order]
        self.n, self.sizes, self.keep, self.least = len(chosen), np.asarray(sizes)[self.order], keep, least
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in chosen])])
        flat = np.concatenate(chosen)
        self.vocabulary, self.ids = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(self.vocabulary), bool)
        self.levels = [self._leaves(flat)]
        while len(self.levels[-1][0]) > 1:
            low, high, bits = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(bits, at)))

    def _leaves(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(0, self.n, LEAF)
        out = np.zeros((len(at), BITS), np.uint16)
        bit = (flat >> np.uint64(20)) % np.uint64(BITS)
        for k, i in enumerate(at):
            j = min(i + LEAF, self.n)
            a, b = self.bounds[i], self.bounds[j]
            row = np.repeat(np.arange(j - i), np.diff(self.bounds[i : j + 1]))
            counts = np.bincount(row * BITS + bit[a:b].astype(np.int64), minlength=(j - i) * BITS).reshape(j - i, BITS)
            out[k] = np.minimum(counts.max(axis=0), 65535)
        return np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at), out

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a link."""
        low, high, bits = self.levels[level]
        near = (100 * high[i] >= 75 * low[j]) & (100 * high[j] >= 75 * low[i])
        out = np.zeros(len(i), bool)
        rows = np.flatnonzero(near)
        for part in np.array_split(rows, max(1, len(rows) // 4096)):
            a, b = i[part], j[part]
            bound = np.minimum(bits[a], bits[b]).sum(axis=1, dtype=np.int64)
            need = -(-3 * (low[a] + low[b]) // 7)  # J >= 3/4 needs 3/7 of the summed sizes
            out[part] = bound >= (need if self.keep is None else np.minimum(need, self.least))
        return out

    def _overlap(self, a: int, i: int, j: int) -> np.ndarray:
        """Tokens that set a shares with each of the sets i to j."""
        mine = self.ids[self.bounds[a] : self.bounds[a + 1]]
        self.mark[mine] = True
        hits = np.concatenate([[0], np.cumsum(self.mark[self.ids[self.bounds[i] : self.bounds[j]]])])
        self.mark[mine] = False
        at = self.bounds[i : j + 1] - self.bounds[i]
        return hits[at[1:]] - hits[at[:-1]]

    def _linked(self, a: int, i: int, j: int) -> np.ndarray:
        """Which of the sets i to j set a links with, or may link with by sketches."""
        shared = self._overlap(a, i, j)
        if self.keep is None:
            return 100 * shared >= 75 * (self.sizes[a] + self.sizes[i:j] - shared)
        length = np.diff(self.bounds[i : j + 1])
        return sketches_match(shared, self.bounds[a + 1] - self.bounds[a] + length - shared, self.keep, self.least)

    def link(self, known: list | None = None) -> np.ndarray:
        """The component of each set, as the place of one of its members in the input.

        known: labels; sets with one label are in one component already."""
        union = self.union = UnionFind(self.n)
        first: dict = {}
        for place, k in enumerate(self.order.tolist() if known else ()):
            union.join(first.setdefault(known[k], place), place)
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            ok = self._possible(level, i, j) | (i == j)
            i, j = i[ok], j[ok]
            n, grid = len(self.levels[level - 1][0]), np.arange(FAN)
            a = (i[:, None, None] * FAN + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
            b = (j[:, None, None] * FAN + 0 * grid[None, :, None] + grid[None, None, :]).ravel()
            ok = (a < n) & (b < n) & (a <= b)
            i, j = a[ok], b[ok]
        order = np.argsort(j - i, kind="stable")
        i, j = i[order], j[order]
        ok = (i == j) | self._possible(0, i, j)
        i, j = i[ok], j[ok]
        step, at = max(256, self.n // 8), 0  # pairs between looks at what has joined meanwhile
        while at < len(i):
            part = slice(at, at + step)
            roots = union.roots()
            starts = np.arange(0, self.n, LEAF)
            lo, hi = np.minimum.reduceat(roots, starts), np.maximum.reduceat(roots, starts)
            todo = np.flatnonzero(~((lo[i[part]] == hi[i[part]]) & (lo[j[part]] == hi[j[part]]) & (lo[i[part]] == lo[j[part]])) | (i[part] == j[part]))
            for k in todo + at:
                self._leaf_pair(i[k] * LEAF, min(i[k] * LEAF + LEAF, self.n), j[k] * LEAF, min(j[k] * LEAF + LEAF, self.n))
            at += step
        out = np.empty(self.n, np.int64)
        out[self.order] = self.order[union.roots()]
        return out

    def _leaf_pair(self, a0: int, a1: int, b0: int, b1: int) -> None:
        union = self.union
        theirs = np.array([union.find(b) for b in range(b0, b1)])
        for a in range(a0, a1):
            start = max(b0, a + 1)
            if start >= b1 or (theirs[start - b0 :] == union.find(a)).all():
                continue
            near = np.flatnonzero(self._linked(a, start, b1))
            for b in near + start:
                union.join(a, b)
            if len(near):
                theirs = np.array([union.find(b) for b in range(b0, b1)])


def sketches_match(shared: np.ndarray, total: np.ndarray, keep: int, least: int) -> np.ndarray:
    """Whether bottom sketches leave J >= 3/4 possible, by what they share and hold together:
    exact while both sets fit their sketches, else by at least `least` shared hashes."""
    return np.where(total < keep, 100 * shared >= 75 * total, shared >= least)
