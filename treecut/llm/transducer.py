"""A minimal acyclic transducer: sorted byte strings to their ordinals.

Built from sorted keys in one pass: what two neighbouring keys do not share is
closed from the end, and a closed state that equals an earlier one is that state.
Every transition carries the number of keys below the earlier transitions of its
state, so the sum along a key's path is the key's ordinal.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Builder:
    """Takes keys in ascending order, without repeats."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.below: list[int] = []  # keys that end in or under a closed state
        self.edges: list[tuple] = []  # of a closed state: (byte, state), ...
        self.final: list[bool] = []
        self.last = b""
        self.n = 0
        self.path: list[list] = [[False, []]]  # open states: final, edges

    def add(self, key: bytes) -> None:
        if self.n and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        for a, b in zip(key, self.last):
            if a != b:
                break
            shared += 1
        self._close(shared)
        self.path += [[False, []] for _ in key[shared:]]
        self.path[-1][0] = True
        self.last = key
        self.n += 1

    def _close(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            state = self._state(self.path.pop())
            self.path[-1][1].append((self.last[len(self.path) - 1], state))

    def _state(self, open_state: list) -> int:
        final, edges = open_state
        same = (final, tuple(edges))
        if same not in self.known:
            self.known[same] = len(self.below)
            self.below.append(final + sum(self.below[s] for _, s in edges))
            self.edges.append(same[1])
            self.final.append(final)
        return self.known[same]

    def finish(self) -> "Transducer":
        self._close(0)
        root = self._state(self.path[0])
        source, byte, target, skipped = [], [], [], []
        for state, edges in enumerate(self.edges):
            before = int(self.final[state])
            for label, to in edges:
                source.append(state)
                byte.append(label)
                target.append(to)
                skipped.append(before)
                before += self.below[to]
        return Transducer(root, np.array(self.final, dtype=bool), np.array(source, dtype=np.int64), np.array(byte, dtype=np.int64), np.array(target, dtype=np.int64), np.array(skipped, dtype=np.int64), self.n)


def build(keys: Iterable[bytes]) -> "Transducer":
    made = Builder()
    for key in keys:
        made.add(key)
    return made.finish()


class Transducer:
    """Transitions lie in an open hash table of (state, byte), so that many keys
    are walked at once, a byte of each in a step."""

    def __init__(self, root, final, source, byte, target, skipped, n) -> None:
        self.root, self.final, self.n = root, final, n
        self.states, self.transitions = len(final), len(source)
        size = 1 << max(3, int(2 * len(source)).bit_length())
        self.key = np.full(size, -1, dtype=np.int64)
        self.target = np.zeros(size, dtype=np.int32)
        self.skipped = np.zeros(size, dtype=np.int32)
        own = source << 8 | byte
        left, step = np.arange(len(own)), 0
        while len(left):  # each round puts one of those that want a free place there
            at = self._place(own[left], step)
            free = self.key[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put, place = left[free][first], at[free][first]
            self.key[place], self.target[place], self.skipped[place] = own[put], target[put], skipped[put]
            stays = np.ones(len(left), dtype=bool)
            stays[np.flatnonzero(free)[first]] = False
            left, step = left[stays], step + 1
        self.rounds = step

    def _place(self, key: np.ndarray, step: int) -> np.ndarray:
        size = len(self.key)
        mixed = key.astype(np.uint64) * _MIX
        return ((mixed >> np.uint64(20)).astype(np.int64) + step) & (size - 1)

    def ordinals(self, keys: list[bytes]) -> np.ndarray:
        """The ordinal of each key, -1 if it is none of the transducer's."""
        lengths = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
        text = np.frombuffer(b"".join(keys), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, sums = np.full(len(keys), self.root, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        alive, depth = np.arange(len(keys)), 0
        while True:
            alive = alive[lengths[alive] > depth]
            if not len(alive):
                break
            wanted = state[alive] << 8 | text[starts[alive] + depth]
            found = np.full(len(alive), -1, dtype=np.int64)
            open_, step = np.arange(len(alive)), 0
            while len(open_) and step < self.rounds:
                at = self._place(wanted[open_], step)
                hit = self.key[at] == wanted[open_]
                found[open_[hit]] = at[hit]
                open_ = open_[~hit & (self.key[at] >= 0)]
                step += 1
            sums[alive[found < 0]] = -1
            alive, found = alive[found >= 0], found[found >= 0]
            state[alive] = self.target[found]
            sums[alive] += self.skipped[found]
            depth += 1
        ended = (sums >= 0) & self.final[state]
        return np.where(ended, sums, -1)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, numbers=np.array([self.root, self.n, self.transitions, self.rounds]), final=self.final, key=self.key, target=self.target, skipped=self.skipped)
        return out.getvalue()


def loads(blob: bytes) -> Transducer:
    held = np.load(io.BytesIO(blob))
    made = Transducer.__new__(Transducer)
    made.root, made.n, made.transitions, made.rounds = held["numbers"].tolist()
    made.final, made.key, made.target, made.skipped = held["final"], held["key"], held["target"], held["skipped"]
    made.states = len(made.final)
    return made
