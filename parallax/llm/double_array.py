"""Double-array tries over byte strings: built in numpy, walked by many text positions at once.

A state is a slot.  The child of state s by byte c is slot ``base[s] + c``,
and it is one only if ``check`` of that slot is s.  Slot 0 is the root."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: bases tried at once for a node with several children
WINDOW = 256


class Trie(NamedTuple):
    base: np.ndarray     # int32 per slot
    check: np.ndarray    # int32 per slot, -1: free
    accept: np.ndarray   # int32 per slot: number of the key that ends here, -1: none

    def walk(self, key: bytes, state: int = 0) -> int:
        """The state after ``key`` from ``state``, -1 if there is none."""
        for c in key:
            to = int(self.base[state]) + c
            if self.check[to] != state:
                return -1
            state = to
        return state


class _Slots:
    """Free slots of growing arrays."""

    def __init__(self) -> None:
        self.free = np.ones(1 << 12, bool)
        self.free[:256] = False  # a leaf's base is 0: what it points to stays free
        self.floor = 256

    def _reach(self, n: int) -> None:
        if n > len(self.free):
            self.free = np.concatenate([self.free, np.ones(max(n, 2 * len(self.free)) - len(self.free), bool)])

    def fit(self, chars: np.ndarray) -> int:
        """A base at which all ``chars`` fall on free slots, which are taken."""
        at = self.floor
        while True:
            self._reach(at + WINDOW + 256)
            good = np.flatnonzero(self.free[np.arange(at, at + WINDOW)[:, None] + (chars - chars[0])].all(axis=1))
            if len(good):
                base = at + int(good[0]) - int(chars[0])
                self.free[base + chars] = False
                return base
            # a window too full for a node of this size is left to the nodes with one child
            self.floor = at = at + WINDOW

    def take(self, n: int) -> np.ndarray:
        """The lowest ``n`` free slots, which are taken."""
        got = np.flatnonzero(self.free)
        if len(got) < n:
            self._reach(len(self.free) + n - len(got))
            got = np.flatnonzero(self.free)
        got = got[:n]
        self.free[got] = False
        return got


def build(keys: list[bytes]) -> Trie:
    """The trie of distinct keys in ascending byte order, none empty; key i is accepted with number i."""
    text = np.frombuffer(b"".join(keys), np.uint8).astype(np.int64)
    length = np.fromiter(map(len, keys), np.int64, len(keys))
    start = np.cumsum(length) - length
    slots = _Slots()
    base, check = np.zeros(1 << 12, np.int32), np.full(1 << 12, -1, np.int32)
    accept_at = np.zeros(len(keys), np.int64)
    key, state, depth = np.arange(len(keys)), np.zeros(len(keys), np.int64), 0
    while len(key):
        char = text[start[key] + depth]
        new = np.ones(len(key), bool)
        new[1:] = (state[1:] != state[:-1]) | (char[1:] != char[:-1])
        parent, label = state[new], char[new]
        first = np.ones(len(parent), bool)
        first[1:] = parent[1:] != parent[:-1]
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(parent)))
        child = np.empty(len(parent), np.int64)
        node_base = np.empty(len(at), np.int64)
        for i in np.flatnonzero(size > 1):
            chars = label[at[i]:at[i] + size[i]]
            node_base[i] = slots.fit(chars)
            child[at[i]:at[i] + size[i]] = node_base[i] + chars
        single = np.flatnonzero(size == 1)
        child[at[single]] = slots.take(len(single))
        node_base[single] = child[at[single]] - label[at[single]]
        need = int(child.max()) + 512
        if need > len(base):
            more = max(need, 2 * len(base)) - len(base)
            base, check = np.concatenate([base, np.zeros(more, np.int32)]), np.concatenate([check, np.full(more, -1, np.int32)])
        base[parent[at]] = node_base
        check[child] = parent
        state = child[np.cumsum(new) - 1]
        depth += 1
        ends = length[key] == depth
        accept_at[key[ends]] = state[ends]
        key, state = key[~ends], state[~ends]
    top = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
    top = max(top, int(base.max(initial=0)) + 257)
    grown = np.zeros(max(top, len(base)), np.int32)
    grown[:len(base)] = base
    closed = np.full(len(grown), -1, np.int32)
    closed[:len(check)] = check
    accept = np.full(len(grown), -1, np.int32)
    accept[accept_at] = np.arange(len(keys))
    return Trie(grown[:top], closed[:top], accept[:top])


def match(trie: Trie, root: int, text: np.ndarray, starts: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Numbers of the keys found from ``starts`` on, one for each find.

    All positions advance by one byte a level; a key counts where the byte
    after it is a ``stop`` byte (a table of 256 flags).  The text must end
    with a byte that no key contains and that stops."""
    found = []
    at, state = starts, np.full(len(starts), root, np.int32)
    while len(at):
        char = text[at]
        number = trie.accept[state[stop[char]]]
        found.append(number[number >= 0])
        to = trie.base[state] + char
        alive = trie.check[to] == state
        at, state = at[alive] + 1, to[alive]
    return np.concatenate(found) if found else np.empty(0, np.int32)
