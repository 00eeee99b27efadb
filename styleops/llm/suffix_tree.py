"""Suffix trees of number sequences, and longest common extensions in constant time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (at least 0, below ``size``), whose last one must occur nowhere else.

    Nodes are numbered as they are made, 0 is the root. ``start`` and ``end`` give the label of the edge to
    a node; a leaf's label runs to the end. ``child`` maps node * size + first symbol to the child.
    """

    def __init__(self, symbols: Sequence[int], size: int):
        n = len(symbols)
        start, end, link, child = [0], [0], [0], {}
        find = child.get
        node, edge, length, waiting = 0, 0, 0, 0
        for at, symbol in enumerate(symbols):
            waiting += 1
            inner = 0  # the inner node made last, which still lacks its suffix link
            while waiting:
                if not length:
                    edge = at
                key = node * size + symbols[edge]
                below = find(key)
                if below is None:
                    child[key] = len(start)
                    start.append(at)
                    end.append(n)
                    link.append(0)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    first = start[below]
                    span = end[below] - first
                    if length >= span:
                        node, edge, length = below, edge + span, length - span
                        continue
                    if symbols[first + length] == symbol:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    made = len(start)
                    start.append(first)
                    end.append(first + length)
                    link.append(0)
                    child[key] = made
                    start[below] = first + length
                    child[made * size + symbols[first + length]] = below
                    child[made * size + symbol] = made + 1
                    start.append(at)
                    end.append(n)
                    link.append(0)
                    if inner:
                        link[inner] = made
                    inner = made
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - waiting + 1
        self.length, self.size = n, size
        self.start, self.end, self.child = start, end, child

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in the order of their leaves, and the depth of the lowest node above each leaf and the one before it.

        Children are visited by their first symbol, so the order is that of the suffixes. The depths are the part of
        the Euler tour that range minima are asked from: between two leaves the tour's lowest node is one of these.
        """
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        nodes = np.fromiter(self.child.values(), np.int64, len(self.child))
        order = np.argsort(keys)[::-1]  # the last child is pushed first
        below = nodes[order].tolist()
        from_, counts = np.unique(keys // self.size, return_counts=True)
        lo = np.zeros(len(self.start) + 1, np.int64)
        lo[from_ + 1] = counts
        lo = (len(below) - np.cumsum(lo)).tolist()  # children of node v: below[lo[v + 1]:lo[v]]
        start, end, n = self.start, self.end, self.length
        leaves, depths = [], []
        stack = [(0, 0, 0)]
        while stack:
            node, depth, shared = stack.pop()
            a, b = lo[node + 1], lo[node]
            if a == b:
                leaves.append(n - depth)
                depths.append(shared)
                continue
            b -= 1
            for k in range(a, b):
                v = below[k]
                stack.append((v, depth + end[v] - start[v], depth))
            v = below[b]
            stack.append((v, depth + end[v] - start[v], shared))
        return np.asarray(leaves, np.int64), np.asarray(depths, np.int32)


class Extensions:
    """Longest common extensions of pairs of places, as minima over the tour of a suffix tree."""

    def __init__(self, symbols: Sequence[int], size: int):
        self.order, depths = SuffixTree(symbols, size).tour()
        self.rank = np.empty(len(self.order), np.int64)
        self.rank[self.order] = np.arange(len(self.order))
        self.levels = [depths]
        step = 1
        while 2 * step <= len(depths):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols are equal from places ``a`` and ``b`` (which differ) on."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        return out
