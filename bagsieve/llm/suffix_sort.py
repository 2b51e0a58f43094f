"""Deep-shallow suffix sorting, and what repeats follow from the order.

``deep_shallow`` sorts byte strings that are suffixes of texts: multikey quicksort, eight bytes at a time, down to
``SHALLOW`` bytes; strings that still agree there go through a blind trie, which looks at branching bytes only and
compares each string once in full.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 48
_STEP = 8


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Branch:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict) -> None:
        self.depth, self.children = depth, children


def _blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """``group`` in the order of its strings, which agree up to ``depth``."""
    same: dict[int, list[int]] = {group[0]: [group[0]]}
    root: _Branch | int = group[0]
    for k in group[1:]:
        s = strings[k]
        path: list[tuple[_Branch, int]] = []
        node = root
        while isinstance(node, _Branch):
            at = s[node.depth] if node.depth < len(s) else -1
            if at not in node.children:
                at = next(iter(node.children))
            path.append((node, at))
            node = node.children[at]
        other = strings[node]
        length = common(s, other, depth)
        if length == len(s) == len(other):
            same[node].append(k)
            continue
        same[k] = [k]
        own = s[length] if length < len(s) else -1
        upto = next((j for j, (branch, _) in enumerate(path) if branch.depth >= length), len(path))
        below = path[upto][0] if upto < len(path) else node
        if isinstance(below, _Branch) and below.depth == length:
            below.children[own] = k
            continue
        split = _Branch(length, {own: k, (other[length] if length < len(other) else -1): below})
        if upto:
            branch, at = path[upto - 1]
            branch.children[at] = split
        else:
            root = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Branch):
            stack.extend(node.children[at] for at in sorted(node.children, reverse=True))
        else:
            out += same[node]
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of ``strings`` in ascending order."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
            continue
        if depth >= shallow:
            out += _blind_trie(strings, group, depth)
            continue
        keys = [strings[k][depth : depth + _STEP] for k in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        equal = [k for k, key in zip(group, keys) if key == pivot]
        more = [k for k, key in zip(group, keys) if key > pivot]
        less = [k for k, key in zip(group, keys) if key < pivot]
        stack.append((more, depth))
        if len(pivot) < _STEP:  # these strings end here: they are one string
            stack.extend(([k], depth) for k in reversed(equal))
        else:
            stack.append((equal, depth + _STEP))
        stack.append((less, depth))
    return out


def _nodes(lcp: list[int], n: int):
    """(depth, low, high) of every inner node of the tree over ``n`` sorted strings with neighbours' ``lcp``."""
    stack: list[tuple[int, int]] = []  # (depth, leftmost place)
    for k in range(1, n + 1):
        now, left = (lcp[k - 1] if k < n else -1), k - 1
        while stack and stack[-1][0] > now:
            depth, left = stack.pop()
            yield depth, left, k - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def repeated_starts(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For places with the text to the left (reversed) and to the right: the starts of repeated strings over them.

    Each interval (low, high) says that the strings of ``length`` bytes which start low to high bytes before the
    place also stand at another place, at as many bytes before it.  Two places share such strings where the common
    text to the left and to the right has ``length`` bytes.  The tree over the right sides groups places by their
    common right text; inside each of its nodes, the neighbours in the order of the left sides have the longest
    common left text.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in lefts]
    if len(lefts) == 2:
        left, right = common(*lefts), common(*rights)
        if left + right >= length:
            out[0] = out[1] = [(max(0, length - right), left)]
        return out
    by_right, by_left = deep_shallow(rights), deep_shallow(lefts)
    lcp = [common(rights[a], rights[b]) for a, b in zip(by_right, by_right[1:])]
    side = [common(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])]
    most = [0] * len(lefts)
    for order, near in ((by_right, lcp), (by_left, side)):
        for k, a, b in zip(order, [0, *near], [*near, 0]):
            most[k] += a if a > b else b
    # Places that can't reach ``length`` with any other go before the tree is walked; the orders stay.
    if min(most) < length:
        by_right, by_left = [k for k in by_right if most[k] >= length], [k for k in by_left if most[k] >= length]
        if len(by_right) < 2:
            return out
        lcp = [common(rights[a], rights[b]) for a, b in zip(by_right, by_right[1:])]
    # Nodes come deepest first.  A place whose whole left side has matched can gain nothing from a shallower node.
    order = np.array(by_right)
    rank = np.zeros(len(lefts), np.int64)
    rank[by_left] = np.arange(len(by_left))
    ranks, full = rank[order], np.array([len(lefts[k]) for k in by_right])
    side = [common(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])]
    least, reached, todo = _Least(side), np.full(len(order), -1), np.ones(len(order), bool)
    for depth, low, high in _nodes(lcp, len(order)):
        if not todo[low : high + 1].any():
            continue
        need = length - depth
        sort = np.argsort(ranks[low : high + 1]) + low  # the node's places by their left sides
        near = least(ranks[sort[:-1]], ranks[sort[1:]])
        best = np.zeros(len(sort), np.int64)
        best[1:] = near
        best[:-1] = np.maximum(best[:-1], near)
        better = (best >= need) & (best > reached[sort])
        for j, x in zip(sort[better].tolist(), best[better].tolist()):
            out[by_right[j]].append((max(0, need), x))
        reached[sort[better]] = best[better]
        todo[sort[better]] = best[better] < full[sort[better]]
    return [_merged(x) for x in out]


class _Least:
    """The least of ``values[a:b]`` for many ranges at once."""

    def __init__(self, values: list[int]) -> None:
        self.levels = [np.array(values, np.int64)]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, span = np.empty(len(a), np.int64), b - a
        level = np.frexp(span)[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << k)])
        return out


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals that overlap or touch as one."""
    done: list[tuple[int, int]] = []
    for low, high in sorted(intervals):
        if done and low <= done[-1][1] + 1:
            done[-1] = (done[-1][0], max(done[-1][1], high))
        else:
            done.append((low, high))
    return done
