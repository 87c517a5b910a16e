"""Ukkonen's suffix tree of a sequence, and longest common extensions from an Euler tour of it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class SuffixTree:
    """The tree of symbols (integers above 0), with an end of its own that is less than all of them.

    ``rank[i]`` is the place of suffix i among the sorted suffixes; the end's own suffix has place 0. A symbol takes
    about two nodes and one dictionary, some 600 bytes while the tree is built.
    """

    def __init__(self, symbols: Sequence[int]):
        self._s = [*symbols, 0]
        self._build()
        self._tour()

    def _build(self) -> None:
        """Online construction: one phase a symbol, suffix links between the inner nodes of a phase."""
        s, n = self._s, len(self._s)
        start, stop, link, edges = [0], [0], [0], [{}]
        node = away = pending = 0  # the active point: away symbols below node, on the edge of symbol s[lead]
        lead = 0
        for i, symbol in enumerate(s):
            pending += 1
            unlinked = 0
            while pending:
                if not away:
                    lead = i
                first = s[lead]
                below = edges[node].get(first)
                if below is None:
                    edges[node][first] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    edges.append(None)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    span = (stop[below] if stop[below] <= i else i + 1) - start[below]
                    if away >= span:
                        node = below
                        lead += span
                        away -= span
                        continue
                    at = start[below] + away
                    if s[at] == symbol:
                        away += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(start)
                    start += (start[below], i)
                    stop += (at, n)
                    link += (0, 0)
                    edges += ({s[at]: below, symbol: middle + 1}, None)
                    edges[node][first] = middle
                    start[below] = at
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                pending -= 1
                if node:
                    node = link[node]
                elif away:
                    away -= 1
                    lead = i - pending + 1
        self._edges, self._start, self._stop = edges, start, stop

    def _tour(self) -> None:
        """Depths of the nodes met on a walk around the tree; between two leaves the least is that of their meeting."""
        n, edges, start, stop = len(self._s), self._edges, self._start, self._stop
        depths: list[int] = []
        leaf, order = [0] * n, []
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            if node >= 0:
                depth += stop[node] - start[node]
                below = edges[node]
                if below is not None:
                    for symbol in sorted(below, reverse=True):
                        todo.append((below[symbol], depth))
                        todo.append((-1, depth))
                    continue
                leaf[n - depth] = len(depths)
                order.append(n - depth)
            depths.append(depth)
        del self._edges, self._start, self._stop
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self._leaf = np.array(leaf, np.int64)
        self._least = [np.array(depths, np.int32)]
        while (1 << len(self._least)) <= len(depths):
            last, half = self._least[-1], 1 << (len(self._least) - 1)
            self._least.append(np.minimum(last[:-half], last[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that suffixes i and j, different ones, have in common from their starts: two look-ups each."""
        a, b = self._leaf[i], self._leaf[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            of = level == k
            out[of] = np.minimum(self._least[k][low[of]], self._least[k][high[of] - (1 << k) + 1])
        return out
