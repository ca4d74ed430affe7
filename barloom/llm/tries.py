"""Double-array tries over sequences of words, built and walked with numpy.

A word is spelt in a fixed number of byte symbols, so no node has more than 256 children.
The child of node s for symbol c is slot ``base[s] + c``, if ``check`` there names s.
"""

from __future__ import annotations

import numpy as np

_SYMBOLS = 256
#: Nodes with so many children get 256 slots of their own; smaller ones share.
_WIDE = 16


class _Slots:
    """Free places of the array, found for many nodes at once."""

    def __init__(self):
        self.rng = np.random.default_rng(0)
        self.used = np.zeros(2 * _SYMBOLS, dtype=bool)
        self.used[:_SYMBOLS] = True  # a base may lie up to 255 below its first child

    def grow(self, n: int) -> int:
        start = len(self.used)
        self.used = np.concatenate((self.used, np.zeros(n, dtype=bool)))
        return start

    def place(self, codes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A base for each node, whose children's symbols are ``codes[first : first + count]``."""
        base = np.zeros(len(first), dtype=np.int64)
        wide = np.flatnonzero(count >= _WIDE)
        base[wide] = self.grow(_SYMBOLS * len(wide)) + _SYMBOLS * np.arange(len(wide))
        slots = self._slots(codes, first[wide], count[wide], base[wide])
        self.used[slots] = True
        for n in range(_WIDE - 1, 1, -1):
            self._share(base, np.flatnonzero(count == n), codes, first, n)
        lone = np.flatnonzero(count == 1)
        free = np.flatnonzero(~self.used)
        if len(free) < len(lone):
            start = self.grow(len(lone) - len(free))
            free = np.concatenate((free, np.arange(start, len(self.used))))
        base[lone] = free[: len(lone)] - codes[first[lone]]
        self.used[free[: len(lone)]] = True
        return base

    def _slots(self, codes, first, count, base):
        if not len(first):
            return np.empty(0, dtype=np.int64)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(base, count) + codes[np.repeat(first, count) + within]

    def _share(self, base, nodes, codes, first, n):
        """Random bases in a fresh stretch, again for those that met a used slot or each other."""
        if not len(nodes):
            return
        start, width = self.grow(4 * n * len(nodes) + _SYMBOLS), 4 * n * len(nodes)
        children = codes[first[nodes][:, None] + np.arange(n)]
        while len(nodes):
            tried = start + self.rng.integers(0, width, len(nodes))
            slots = tried[:, None] + children
            fits = ~self.used[slots].any(axis=1)
            # Of nodes that want one slot, only the first has it.
            flat = slots[fits].ravel()
            _, chosen = np.unique(flat, return_index=True)
            mine = np.zeros(len(flat), dtype=bool)
            mine[chosen] = True
            good = np.flatnonzero(fits)[mine.reshape(-1, n).all(axis=1)]
            base[nodes[good]] = tried[good]
            self.used[slots[good].ravel()] = True
            left = np.ones(len(nodes), dtype=bool)
            left[good] = False
            nodes, children = nodes[left], children[left]


class Trie:
    """Sequences of ``width`` word keys; the number of a sequence is its row in ``sequences``, which must be distinct."""

    def __init__(self, sequences: np.ndarray):
        n, self.width = sequences.shape
        self.words = np.unique(sequences)
        ids = np.searchsorted(self.words, sequences)
        self.digits = max(1, -(-(max(1, len(self.words)) - 1).bit_length() // 8))
        shifts = 8 * np.arange(self.digits - 1, -1, -1)
        self.symbols = ((np.arange(len(self.words))[:, None] >> shifts) & 255).astype(np.int64)
        order = np.lexsort(ids.T[::-1])
        rows = self.symbols[ids[order]].reshape(n, self.width * self.digits)
        slots = _Slots()
        links, parent = [], np.zeros(n, dtype=np.int64)  # the root is slot 0
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        for depth in range(rows.shape[1]):
            above = np.flatnonzero(new)
            new = new.copy()
            new[1:] |= rows[1:, depth] != rows[:-1, depth]
            here = np.flatnonzero(new)
            if depth == 0:
                above = here[:1]
            first = np.searchsorted(here, above)
            count = np.diff(np.append(first, len(here)))
            base = slots.place(rows[here, depth], first, count)
            child = np.repeat(base, count) + rows[here, depth]
            links.append((parent[above], base, child, np.repeat(parent[above], count)))
            parent = np.repeat(child, np.diff(np.append(here, n)))
        size = len(slots.used) + _SYMBOLS
        self.base = np.zeros(size, dtype=np.int32)
        self.check = np.full(size, -1, dtype=np.int32)
        self.accept = np.full(size, -1, dtype=np.int32)
        for node, base, child, owner in links:
            self.base[node] = base
            self.check[child] = owner
        self.accept[parent] = order

    def word_ids(self, keys: np.ndarray) -> np.ndarray:
        """The trie's own number of each word key, or -1."""
        if not len(self.words):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, at, -1)

    def accepted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, sequence) of every sequence in a text of word ids; -1 belongs to none.

        The states of all positions advance together, one symbol a step; positions without a state are dropped.
        """
        position = np.flatnonzero(ids >= 0)
        state = np.zeros(len(position), dtype=np.int64)
        for step in range(self.width):
            inside = position + step < len(ids)
            position, state = position[inside], state[inside]
            word = ids[position + step]
            known = word >= 0
            position, state, word = position[known], state[known], word[known]
            for digit in range(self.digits):
                child = self.base[state] + self.symbols[word, digit]
                goes_on = self.check[child] == state
                position, state, word = position[goes_on], child[goes_on], word[goes_on]
        return position, self.accept[state]
