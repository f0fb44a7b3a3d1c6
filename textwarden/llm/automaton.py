"""An Aho-Corasick automaton over words, built and run by whole numpy arrays.

Patterns are sequences of word numbers. States are their distinct prefixes, 0 is the empty one; steps are one hash table
of (state, word); a state's failure link leads to the longest shorter suffix that is a prefix, too. As no state is deeper than
the longest pattern, what a text's part does depends on that many words before it: texts are scanned in
many parts side by side, each begun so many words early.

Memory: about 45 bytes a state (twice as many table places as states, at most four times, of 12 bytes, and 12 bytes
of links); a window of n words has at most n states.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .words import U, mix

#: Words of a part of a text that is scanned beside others.
PART = 64


class Steps:
    """(state, word) to state; keys are distinct and never removed."""

    def __init__(self, n: int) -> None:
        self.bits = max(4, int(2 * n).bit_length())
        self.keys = np.zeros(1 << self.bits, np.int64)  # key + 1; 0 is a free place
        self.values = np.zeros(1 << self.bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(U)) >> U(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            first = np.unique(slot, return_index=True)[1]
            take = first[self.keys[slot[first]] == 0]
            self.keys[slot[take]] = keys[left[take]] + 1
            self.values[slot[take]] = values[left[take]]
            go = np.ones(len(left), bool)
            go[take] = False
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """0 where there is no step."""
        out = np.zeros(len(keys), np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            held = self.keys[slot]
            same = held == keys[left] + 1
            out[left[same]] = self.values[slot[same]]
            go = ~same & (held != 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


class Automaton:
    def __init__(self, patterns: Sequence[np.ndarray], words: int) -> None:
        """patterns: arrays (how many, length) of word numbers under ``words``; ends has each pattern's state, in their order."""
        self.words, self.depth = words, max((p.shape[1] for p in patterns), default=0)
        at = [np.zeros(len(p), np.int64) for p in patterns]
        levels, n = [], 1
        for d in range(self.depth):
            live = [i for i, p in enumerate(patterns) if p.shape[1] > d]
            keys = np.concatenate([at[i] * words + patterns[i][:, d] for i in live])
            new, which = np.unique(keys, return_inverse=True)
            cut = 0
            for i in live:
                at[i] = n + which[cut : cut + len(at[i])]
                cut += len(at[i])
            levels.append((n, new))
            n += len(new)
        self.n = n
        self.ends = np.concatenate([np.empty(0, np.int64), *at])
        self.steps = Steps(n)
        for first, keys in levels:
            self.steps.add(keys, np.arange(first, first + len(keys), dtype=np.int32))
        self.root = np.zeros(words, np.int32)
        if levels:
            self.root[levels[0][1]] = np.arange(1, 1 + len(levels[0][1]))
        self.fail = np.zeros(n, np.int32)
        # out: the longest pattern that ends in a state (itself or a suffix), 0 for none; size: its words.
        self.out, self.size = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.out[self.ends] = self.ends
        for p, x in zip(patterns, at, strict=True):
            self.size[x] = p.shape[1]
        self.shorter = np.zeros(n, np.int32)  # of a state where a pattern ends: the next shorter pattern that ends there
        for first, keys in levels:
            own = np.arange(first, first + len(keys))
            if first > 1:
                self.fail[own] = self.move(self.fail[keys // words], keys % words)
            inherited = self.out[self.fail[own]]
            self.shorter[own] = inherited
            mine = self.out[own] > 0
            self.out[own[~mine]] = inherited[~mine]
            self.size[own[~mine]] = self.size[inherited[~mine]]

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.steps.keys, self.steps.values, self.root, self.fail, self.out, self.size, self.shorter, self.ends))

    def move(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The state after a word (-1 for one in no pattern), for each pair."""
        out = np.zeros(len(states), np.int32)
        known = words >= 0
        top = np.flatnonzero(known & (states == 0))
        out[top] = self.root[words[top]]
        left = np.flatnonzero(known & (states != 0))
        states = states[left].astype(np.int64)
        while len(left):
            found = self.steps.get(states * self.words + words[left])
            out[left] = found
            go = found == 0
            left, states = left[go], self.fail[states[go]].astype(np.int64)
            end = states == 0
            out[left[end]] = self.root[words[left[end]]]
            left, states = left[~end], states[~end]
        return out

    def scan(self, words: np.ndarray) -> np.ndarray:
        """The longest pattern (its state) that ends at each word of a stream, 0 for none; -1 parts texts."""
        n, early = len(words), max(self.depth - 1, 0)
        if not n or not self.depth:
            return np.zeros(n, np.int32)
        parts = -(-n // PART)
        padded = np.full(early + parts * PART, -1, np.int64)
        padded[early : early + n] = words
        rows = np.lib.stride_tricks.sliding_window_view(padded, early + PART)[::PART]
        columns = np.ascontiguousarray(rows.T)
        out = np.empty((PART, parts), np.int32)
        states = np.zeros(parts, np.int32)
        for t, column in enumerate(columns):
            states = self.move(states, column)
            if t >= early:
                out[t - early] = self.out[states]
        return np.ascontiguousarray(out.T).ravel()[:n]
