"""Hierarchical index over 64-bit codes in Gray order, for all pairs within a few differing bits.

Codes that follow each other in Gray order agree in their leading bits. A node of the index stands for ``FANOUT`` consecutive nodes
of the level below, leaves for as many codes; what all codes of a node share is factored into it as a mask and a pattern. Two
nodes differ at least in the shared bits in which their patterns differ; the count adds up on the way down, and a
pair of nodes is dropped with all its codes once it exceeds the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Codes of a leaf and children of an upper node.
FANOUT = 2
#: Pairs of nodes or codes held at once; a larger search goes on in slices.
FRONTIER = 1 << 20


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of a code in the reflected Gray sequence: neighbours in it differ by one bit."""
    x = code.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class Tree:
    """Levels from the codes (0) up to one root: bits set in all codes of a node, and bits that all of them share."""

    def __init__(self, ands: np.ndarray, ors: np.ndarray | None = None, height: int = 0):
        ors = ands if ors is None else ors
        self.levels = [(ands, ~(ands ^ ors))]
        while len(ands) > 1 or len(self.levels) <= height:
            starts = np.arange(0, len(ands), FANOUT)
            ands, ors = np.bitwise_and.reduceat(ands, starts), np.bitwise_or.reduceat(ors, starts)
            self.levels.append((ands, ~(ands ^ ors)))

    @property
    def height(self) -> int:
        return len(self.levels) - 1


def _children(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of pairs of nodes, of which there are ``n`` and ``m`` on their level."""
    step = np.arange(FANOUT)
    left = (a[:, None] * FANOUT + step).repeat(FANOUT, axis=1).reshape(-1)
    right = np.tile(b[:, None] * FANOUT + step, (1, FANOUT)).reshape(-1)
    there = (left < n) & (right < m)
    return left[there], right[there]


def tree_pairs(one: Tree, other: Tree, bits: int, seen: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (i, j) arrays of all pairs of level 0 within ``bits`` bits; of a tree with itself those with i <= j.

    The trees have one height. ``seen`` adds up how many pairs each level looked at.
    """
    same, top = one is other, one.height

    def down(level: int, a: np.ndarray, b: np.ndarray):
        (x, shared_x), (y, shared_y) = one.levels[level], other.levels[level]
        if same:
            a, b = a[a <= b], b[a <= b]
        if seen is not None:
            seen[level] += len(a)
        near = np.bitwise_count((x[a] ^ y[b]) & shared_x[a] & shared_y[b]) <= bits
        a, b = a[near], b[near]
        if level == 0:
            if len(a):
                yield a, b
            return
        slice_ = FRONTIER // FANOUT**2
        for at in range(0, len(a), slice_):
            yield from down(level - 1, *_children(a[at : at + slice_], b[at : at + slice_], len(one.levels[level - 1][0]), len(other.levels[level - 1][0])))

    if len(one.levels[0][0]) and len(other.levels[0][0]):
        yield from down(top, np.zeros(1, np.int64), np.zeros(1, np.int64))


def close_pairs(codes: np.ndarray, run_sizes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (i, j) index arrays, i < j, of all pairs in one run that differ in at most ``bits`` bits; runs are in Gray order."""
    at = 0
    for n in run_sizes.tolist():
        tree = Tree(codes[at : at + n])
        for i, j in tree_pairs(tree, tree, bits):
            yield i[i < j] + at, j[i < j] + at
        at += n


def close_between(a: np.ndarray, b: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (i, j) of all pairs of a code of ``a`` and one of ``b``, each in Gray order, within ``bits`` bits."""
    height = max(Tree(a).height, Tree(b).height) if len(a) and len(b) else 0
    yield from tree_pairs(Tree(a, height=height), Tree(b, height=height), bits)


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` items over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label
