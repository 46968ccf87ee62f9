"""The prefix-tree join of one block of sets, run inside a task.

Sets are stored in a trie under one global order of tokens, frequent ones first, so that near copies share long paths. A set walks the trie
with the overlap reached so far; a subtree is left as soon as the tokens that one side has already missed exceed what its longest set
allows. Only connectivity is wanted, so a subtree whose sets all belong to the walker's component is left too: a group of near copies
costs about one comparison per set. The tokens between two forks are compared at once: what both sides have missed never shrinks on the way.
"""
from __future__ import annotations

from bisect import bisect_right

import numpy as np


class _Node:
    __slots__ = ("path", "kids", "ends", "high", "mark")

    def __init__(self, path: np.ndarray, high: int, mark: int):
        self.path, self.kids, self.ends, self.high, self.mark = path, {}, [], high, mark


class Forest:
    """Union-find over set numbers; the smaller number is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _similar(overlap: int, a: int, b: int) -> bool:
    """100 * intersection >= 75 * union, in whole numbers."""
    return 7 * overlap >= 3 * (a + b)


def _walk(root: _Node, tokens: list[int], has: np.ndarray, me: int, sizes: list[int], forest: Forest) -> None:
    """Joins `me` with the stored sets that are similar. `has` tells for each token whether it is one of `tokens`."""
    n, stack = len(tokens), [(root, 0, 0, 0)]
    while stack:
        node, overlap, at, depth = stack.pop()
        high, path = node.high, node.path
        if 4 * high < 3 * n or (node.mark >= 0 and forest.root(node.mark) == forest.root(me)):
            continue
        if len(path):
            overlap += np.count_nonzero(has[path])
            depth += len(path)
            at = bisect_right(tokens, path[-1], at)
            if 7 * (depth + at - 2 * overlap) > high + n:
                continue
        for other in node.ends:
            if _similar(overlap, sizes[other], n):
                forest.join(other, me)
        best = node.kids.get(tokens[at]) if at < n else None
        stack.extend((kid, overlap, at, depth) for kid in node.kids.values() if kid is not best)
        if best is not None:
            stack.append((best, overlap, at, depth))


def _insert(root: _Node, tokens: list[int], array: np.ndarray, me: int, forest: Forest) -> None:
    """Stores `me`; `array` holds its tokens too."""
    node, at, n = root, 0, len(tokens)
    while True:
        node.high = max(node.high, n)
        if node.mark >= 0 and forest.root(node.mark) != forest.root(me):
            node.mark = -1
        path = node.path
        both = min(len(path), n - at)
        unlike = np.flatnonzero(path[:both] != array[at:at + both])
        same = int(unlike[0]) if len(unlike) else both
        if same < len(path):
            rest = _Node(path[same:], node.high, node.mark)
            rest.kids, rest.ends = node.kids, node.ends
            node.path, node.kids, node.ends = path[:same], {int(path[same]): rest}, []
        at += same
        if at == n:
            node.ends.append(me)
            return
        kid = node.kids.get(tokens[at])
        if kid is None:
            kid = node.kids[tokens[at]] = _Node(array[at:], n, me)
            kid.ends.append(me)
            return
        node = kid


def _mark_anew(root: _Node, forest: Forest) -> None:
    """Sets every mark to the component that the whole subtree belongs to by now, -1 if to several."""
    order, at = [root], 0
    while at < len(order):
        order.extend(order[at].kids.values())
        at += 1
    for node in reversed(order):
        marks = {forest.root(e) for e in node.ends} | {kid.mark for kid in node.kids.values()}
        node.mark = marks.pop() if len(marks) == 1 else -1


def join_block(sets: list[list[int]], groups: list[int] | None = None) -> list[int]:
    """The component (smallest set number) of each set. `sets` hold ascending tokens; sets of equal `groups` are joined beforehand."""
    forest, first = Forest(len(sets)), {}
    for i, group in enumerate(groups or ()):
        forest.join(first.setdefault(group, i), i)
    sizes = [len(s) for s in sets]
    arrays = [np.array(s, dtype=np.int64) for s in sets]
    has = np.zeros(1 + max((s[-1] for s in sets if s), default=0), dtype=bool)
    root, due = None, 32
    for number, me in enumerate(sorted(range(len(sets)), key=sizes.__getitem__)):
        if not sizes[me]:
            continue
        if root is None:
            root = _Node(arrays[me][:0], sizes[me], me)
        else:
            has[arrays[me]] = True
            _walk(root, sets[me], has, me, sizes, forest)
            has[arrays[me]] = False
        _insert(root, sets[me], arrays[me], me, forest)
        if number >= due:
            # Components grow together; marks that were mixed when they were set may be whole now.
            _mark_anew(root, forest)
            due = number + max(32, number // 8)
    return [forest.root(i) for i in range(len(sets))]
