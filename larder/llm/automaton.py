"""A suffix automaton over several sequences of words, each with the document that it comes from."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

NEVER = (1 << 63) - 1


class SuffixAutomaton:
    """Every run of words of the sequences added, as a path; first[state] is the smallest owner of that state's runs."""

    def __init__(self) -> None:
        self.edges: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [NEVER]

    def _state(self, edges: dict, link: int, length: int) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(NEVER)
        return len(self.link) - 1

    def _split(self, at: int, word, target: int) -> int:
        """A copy of target for the shorter runs that reach it from at and at's suffixes."""
        copy = self._state(dict(self.edges[target]), self.link[target], self.length[at] + 1)
        self.link[target] = copy
        while at >= 0 and self.edges[at].get(word) == target:
            self.edges[at][word] = copy
            at = self.link[at]
        return copy

    def _step(self, last: int, word) -> int:
        edges, link, length = self.edges, self.link, self.length
        known = edges[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        new, at = self._state({}, 0, length[last] + 1), last
        while at >= 0 and word not in edges[at]:
            edges[at][word] = new
            at = link[at]
        if at >= 0:
            target = edges[at][word]
            link[new] = target if length[target] == length[at] + 1 else self._split(at, word, target)
        return new

    def add(self, words: Sequence, owner: int) -> None:
        last = 0
        for word in words:
            last = self._step(last, word)
            if owner < self.first[last]:
                self.first[last] = owner

    def finish(self) -> SuffixAutomaton:
        """Hand owners down to suffixes; call once after the last add."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if self.first[state] < self.first[up]:
                self.first[up] = self.first[state]
        return self

    def owners(self, words: Sequence, least: int) -> Iterator[int | None]:
        """Matching statistics: per word, the smallest owner of the run of ``least`` words that ends there, if any."""
        edges, link, length, first = self.edges, self.link, self.length, self.first
        state = matched = 0
        for word in words:
            while state and word not in edges[state]:
                state = link[state]
                matched = length[state]
            after = edges[state].get(word)
            if after is None:
                matched = 0
            else:
                state, matched = after, matched + 1
            while state and length[link[state]] >= least:
                state = link[state]
                matched = length[state]
            yield first[state] if matched >= least else None
