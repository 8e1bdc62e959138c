"""Double-array tries over short sequences of numbers, built and walked in numpy.

A symbol (a word's number) is spelled by ``DIGITS`` digits of ``BASE`` values, so that every node has at
most ``BASE`` children. A node is a slot; the child by digit x of the node in slot s is in slot
``first[s] + x`` if ``owner`` of that slot is s.
"""

from __future__ import annotations

import numpy as np

BASE, DIGITS = 64, 4
#: symbols have numbers below this
MOST_SYMBOLS = BASE**DIGITS
#: nodes with more children get a stretch of slots of their own; smaller ones fill what is free there
CROWDED = 6


class DoubleArray:
    def __init__(self, first: np.ndarray, owner: np.ndarray, entry: np.ndarray):
        self.first, self.owner, self.entry = first, owner, entry

    def step(self, state: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states have the child, and the slots that it is in."""
        slot = self.first[state] + digit
        return self.owner[slot] == state, slot


def digits(symbols: np.ndarray) -> np.ndarray:
    """``[DIGITS, n]``, most significant first."""
    return np.stack([(symbols >> 6 * (DIGITS - 1 - d)) & (BASE - 1) for d in range(DIGITS)]).astype(np.int32)


def build(roots: int, root: np.ndarray, symbols: np.ndarray) -> DoubleArray:
    """The trie of sequences ``symbols[k]`` (-1 behind a sequence's end) below root ``root[k]``; roots are slots 0, 1, ...

    ``entry`` of a sequence's last slot is its index k, and -1 elsewhere. Sequences are distinct.
    """
    node, live = root.astype(np.int64), np.arange(len(root), dtype=np.int32)
    parents, marks, made = [], [], roots  # nodes are numbered level by level, in order of their parents
    last = np.full(len(root), -1, np.int32)
    for k in range(symbols.shape[1]):
        go = symbols[live, k] >= 0
        live, node = live[go], node[go]
        if not len(live):
            break
        for x in digits(symbols[live, k]):
            key, node = np.unique(node * BASE + x, return_inverse=True)
            parents.append((key // BASE).astype(np.int32))
            marks.append((key % BASE).astype(np.uint8))
            node += made
            made += len(key)
        last[live] = node
    del node, live
    if made == roots:
        return DoubleArray(np.zeros(roots + BASE, np.int32), np.full(roots + BASE, -1, np.int32), np.full(roots + BASE, -1, np.int32))
    parent, mark = np.concatenate(parents), np.concatenate(marks)
    del parents, marks
    slot, who, origin, size = place(roots, parent, mark)
    out = DoubleArray(np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32))
    out.first[slot[who]] = origin
    out.owner[slot[roots:]] = slot[parent]
    out.entry[slot[last]] = np.arange(len(root))
    return out


def place(roots: int, parent: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(slot of every node, nodes with children and the origin of these, number of slots); ``parent`` ascends, its nodes are ``roots, roots + 1, ...``."""
    begin = np.append(0, np.flatnonzero(parent[1:] != parent[:-1]) + 1).astype(np.int32)
    who, many = parent[begin], np.diff(np.append(begin, len(parent))).astype(np.int32)
    origin = np.zeros(len(who), np.int32)
    wide = np.flatnonzero(many > CROWDED)
    low = roots + BASE
    origin[wide] = low + np.arange(len(wide)) * BASE
    size = int(max(low + BASE * (len(wide) + 1), low + len(parent) * 5 // 3 + BASE))
    taken = np.zeros(size + BASE, bool)
    taken[:low] = True

    def spots(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(child, index into ``groups``) of all children of the groups."""
        n = many[groups]
        which = np.repeat(np.arange(len(groups), dtype=np.int32), n)
        return np.repeat(begin[groups] - np.cumsum(n, dtype=np.int32) + n, n) + np.arange(n.sum(), dtype=np.int32), which

    child, which = spots(wide)
    taken[origin[wide][which] + mark[child]] = True
    rng = np.random.default_rng(7)
    claim = np.zeros(size + BASE, np.int32)
    for n in range(CROWDED, 1, -1):
        left = np.flatnonzero(many == n)
        while len(left):
            at = rng.integers(low, size - BASE, len(left), dtype=np.int32)
            child, which = spots(left)
            where = at[which] + mark[child]
            claim[where] = which
            bad = np.bincount(which[taken[where] | (claim[where] != which)], minlength=len(left)) > 0
            good = ~bad
            origin[left[good]] = at[good]
            taken[where[good[which]]] = True
            left = left[bad]
    del claim
    alone = np.flatnonzero(many == 1)
    origin[alone] = np.flatnonzero(~taken[:size])[:len(alone)] - mark[begin[alone]]
    slot = np.empty(roots + len(parent), np.int32)
    slot[:roots] = np.arange(roots)
    slot[roots:] = np.repeat(origin, many) + mark
    return slot, who, origin, size + BASE
