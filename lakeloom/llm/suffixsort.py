"""Deep-shallow sorting of byte strings, and the longest common prefixes of neighbours.

Shallow phase: multikey quicksort.  All open groups are split in one vectorised
pass, each by the three-way comparison of its strings' next eight bytes with the
group's pivot; strings equal to the pivot move on by eight bytes.  Groups that still
hold together at ``SHALLOW`` bytes go to the deep phase: a blind trie each, which
keeps only branching depths and first bytes; a string is inserted by one blind
descent, one comparison with the leaf it meets, and one split.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32
_STEP = 8


class BlindTrie:
    """Strings in order, each leaf a list of equal ones; inner nodes hold a depth and children by next byte (-1: end)."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    def _leaf(self, node):
        while type(node) is list:
            node = next(iter(node[1].values()))
        return node

    def insert(self, k: int) -> None:
        text = self.strings[k]
        if self.root is None:
            self.root = (k,)
            return
        node = self.root
        while type(node) is list:  # blind: skipped bytes aren't looked at
            at = text[node[0]] if node[0] < len(text) else -1
            below = node[1].get(at)
            if below is None:
                break
            node = below
        other = self.strings[self._leaf(node)[0]]
        shared = common_prefix(text, other)
        mine = text[shared] if shared < len(text) else -1
        above, key, node = None, None, self.root
        while type(node) is list and node[0] < shared:
            above, key = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][key]
        if shared == len(text) == len(other) and type(node) is tuple:
            new = (*node, k)
        elif type(node) is list and node[0] == shared:
            below = node[1].get(mine)
            node[1][mine] = (k,) if below is None else (*below, k)
            return
        else:
            first = self.strings[self._leaf(node)[0]]
            theirs = first[shared] if shared < len(first) else -1
            new = [shared, {theirs: node, mine: (k,)}]
        if above is None:
            self.root = new
        else:
            above[1][key] = new

    def ordered(self) -> tuple[list[int], list[int]]:
        """Strings in order; for each the length it shares with the one before."""
        order: list[int] = []
        shared: list[int] = []
        stack = [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            if type(node) is list:
                keys = sorted(node[1], reverse=True)
                for i, key in enumerate(keys):
                    stack.append((node[1][key], depth if i == len(keys) - 1 else node[0]))
            else:
                order.extend(node)
                shared.append(depth)
                shared.extend([len(self.strings[node[0]])] * (len(node) - 1))
        return order, shared


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def sort(strings: list[bytes], groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by (group, string), and each one's common prefix with the one before (-1: another group)."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = shallow + _STEP
    # a length byte after each eight bytes' zero padding isn't needed: ends are told apart in the deep phase
    head = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").astype(np.uint64).reshape(n, width // _STEP)
    order = np.argsort(groups, kind="stable")
    depth = np.zeros(n, np.int64)  # by place in order, as are starts
    fresh = np.ones(n, bool)
    fresh[1:] = groups[order][1:] != groups[order][:-1]
    while True:
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, n))
        of = np.repeat(np.arange(len(start)), size)
        at = np.flatnonzero(((size > 1) & (depth[start] < shallow))[of])
        if not len(at):
            break
        word = head[order[at], depth[at] // _STEP]
        group = of[at]
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        count = np.diff(np.append(edge, len(at)))
        three = np.sort(np.stack((word[edge], word[edge + count // 2], word[edge + count - 1])), axis=0)
        pivot = np.repeat(three[1], count)
        side = (word > pivot).astype(np.int64) - (word < pivot)
        move = np.argsort(group * 3 + side + 1, kind="stable")
        order[at] = order[at][move]
        equal = side[move] == 0
        depth[at] += _STEP * equal
        key = group * 3 + side[move] + 1
        fresh[at[1:]] |= key[1:] != key[:-1]
    start = np.flatnonzero(fresh)
    shared = np.full(n, -2)
    for a, size in zip(start.tolist(), np.diff(np.append(start, n)).tolist(), strict=True):
        if size > 1:
            trie = BlindTrie([strings[i] for i in order[a : a + size].tolist()])
            for k in range(size):
                trie.insert(k)
            places, lengths = trie.ordered()
            order[a : a + size] = order[a : a + size][places]
            shared[a + 1 : a + size] = lengths[1:]
    for a in start.tolist():  # between groups of the shallow phase: compare the neighbours
        if a and groups[order[a]] == groups[order[a - 1]]:
            shared[a] = common_prefix(strings[order[a - 1]], strings[order[a]])
        else:
            shared[a] = -1
    return order, shared
