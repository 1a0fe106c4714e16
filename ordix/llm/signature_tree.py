"""Set-similarity links by dual traversal of signature trees.

Sets are token codes in ascending order. A leaf holds a few sets, a node a few
nodes; each carries the OR and the AND of its sets' token bitmaps and its range
of sizes. A pair of nodes is left when no two of their sets can reach the
overlap that a link needs, or when all their sets are in one component already:
links are wanted for components, so what is joined needn't be compared again.
"""

from __future__ import annotations

import numpy as np

from .components import local

#: Sets in a leaf, nodes in a node.
LEAF, FAN = 16, 8
#: Pairs of sets that are looked at together, and tokens of the sets that are counted together.
CHUNK, TOKENS = 1 << 15, 1 << 20
#: Sets from which on a few hubs are compared with all others before the traversal.
HUBS_FROM, HUBS = 48, 16
#: A group of at most so many sets is two leaves: its pairs are looked at without a tree, many groups at a time.
SMALL = 2 * LEAF


class Sets:
    def __init__(self, tokens: np.ndarray, off: np.ndarray, percent: int):
        self.percent = percent
        self.off, self.size = off, np.diff(off)
        names, code = np.unique(tokens, return_inverse=True)
        self.code, self.mark = code.astype(np.int64), np.zeros(len(names), np.int64)
        self.label = np.arange(len(self.size))

    def needs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common tokens that sets of sizes a and b need to link."""
        return (self.percent * (a + b) + 99 + self.percent) // (100 + self.percent)

    def verify(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs link, by their exact common tokens."""
        out = np.zeros(len(i), bool)
        order = np.argsort(i, kind="stable")
        first = np.flatnonzero(np.diff(i[order], prepend=-1))
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            one, many = i[order[a]], j[order[a:z]]
            own = self.code[self.off[one] : self.off[one + 1]]
            self.mark[own] = 1
            size = self.size[many]
            at = np.repeat(self.off[many] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            got = np.concatenate(([0], np.cumsum(self.mark[self.code[at]])))
            ends = np.cumsum(size)
            common = got[ends] - got[ends - size]
            out[order[a:z]] = common * (100 + self.percent) >= self.percent * (self.size[one] + size)
            self.mark[own] = 0
        return out

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the components of the pairs that link, a chunk at a time."""
        open_ = (self.label[i] != self.label[j]) & (np.minimum(self.size[i], self.size[j]) * 100 >= self.percent * np.maximum(self.size[i], self.size[j]))
        i, j = i[open_], j[open_]
        step = 64
        while len(i):
            step = max(1, min(step, int(np.searchsorted(np.cumsum(self.size[j[:step]]), TOKENS, "right"))))
            a, b, i, j = i[:step], j[:step], i[step:], j[step:]
            ok = self.verify(a, b)
            if ok.any():
                self.label = local(len(self.label), a[ok], b[ok], self.label)
                open_ = self.label[i] != self.label[j]
                i, j = i[open_], j[open_]
            step = min(4 * step, 1 << 14)


class Tree:
    """Levels of nodes over some of the sets, from the leaves up; sets lie by size and least token."""

    def __init__(self, s: Sets, members: np.ndarray, words: int):
        least = np.array([s.code[s.off[m]] for m in members]) if len(members) else members
        self.members = members = members[np.lexsort((least, s.size[members]))]
        n = len(members)
        bits = np.zeros((n, words), np.uint64)
        at = np.concatenate([np.arange(s.off[m], s.off[m + 1]) for m in members]) if n else members
        bit = (s.code[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(words * 64).bit_length() + 1)
        np.bitwise_or.at(bits.reshape(-1), np.repeat(np.arange(n), s.size[members]) * words + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        self.bits = bits
        self.levels = [(bits, bits, s.size[members], s.size[members])]
        self.fan = [1]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            o, a, lo, hi = self.levels[-1]
            start = np.arange(0, len(o), fan)
            self.levels.append((np.bitwise_or.reduceat(o, start), np.bitwise_and.reduceat(a, start), np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)))
            self.fan.append(fan)
            fan = FAN

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """By level: each node's component, or -1 when its sets are in several."""
        out = [label[self.members]]
        for fan in self.fan[1:]:
            start = np.arange(0, len(out[-1]), fan)
            lo, hi = np.minimum.reduceat(out[-1], start), np.maximum.reduceat(out[-1], start)
            out.append(np.where(lo == hi, lo, -1))
        return out


def _possible(s: Sets, x: Tree, y: Tree, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether two sets of the nodes i of x and j of y could link."""
    lx, ly = min(level, len(x.levels) - 1), min(level, len(y.levels) - 1)
    ox, ax, lox, hix = (v[i] for v in x.levels[lx])
    oy, ay, loy, hiy = (v[j] for v in y.levels[ly])
    most = np.minimum(hix - np.bitwise_count(ax & ~oy).sum(axis=1, dtype=np.int64), hiy - np.bitwise_count(ay & ~ox).sum(axis=1, dtype=np.int64))
    return (most >= s.needs(lox, loy)) & (hix * 100 >= s.percent * loy) & (hiy * 100 >= s.percent * lox)


def _traverse(s: Sets, x: Tree, y: Tree) -> None:
    if not len(x.members) or not len(y.members):
        return
    same = x is y
    top = max(len(x.levels), len(y.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        most = CHUNK // LEAF**2 if level else CHUNK
        if len(i) > most:
            stack += [(level, i[a : a + most], j[a : a + most]) for a in range(0, len(i), most)]
            continue
        ux, uy = x.uniform(s.label), y.uniform(s.label)
        cx, cy = ux[min(level, len(ux) - 1)][i], uy[min(level, len(uy) - 1)][j]
        go = ((cx != cy) | (cx < 0)) & _possible(s, x, y, level, i, j)
        i, j = i[go], j[go]
        if not len(i):
            continue
        if not level:
            s.compare(x.members[i], y.members[j])
            continue
        ci, ni = _children(x, level, i)
        cj, nj = _children(y, level, j)
        both = ni * nj
        k = np.repeat(np.arange(len(i)), both)
        at = np.arange(len(k)) - np.repeat(np.cumsum(both) - both, both)
        a, b = ci[k] + at // nj[k], cj[k] + at % nj[k]
        if same:
            keep = a < b if level == 1 else a <= b
            a, b = a[keep], b[keep]
        stack.append((level - 1, a, b))


def _children(t: Tree, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if level >= len(t.levels):  # the other tree is higher
        return i, np.ones(len(i), np.int64)
    first = i * t.fan[level]
    return first, np.minimum(t.fan[level], len(t.levels[level - 1][0]) - first)


def link(tokens: np.ndarray, off: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """The smallest set of each set's component, by links of 100 * common >= percent * union.

    side: only sets of side 0 are compared with sets of side 1, if there are any of side 1.
    """
    s = Sets(tokens, off, percent)
    n = len(s.size)
    if n >= HUBS_FROM:
        # Most sets of a family link with one that lies in its midst.
        rest = np.arange(n)
        for _ in range(HUBS):
            if len(rest) < 2:
                break
            hub = rest[len(rest) // 2]
            others = rest[rest != hub]
            s.compare(np.full(len(others), hub), others)
            rest = others[s.label[others] != s.label[hub]]
    median = int(np.median(s.size)) if n else 1
    words = 1 << max(0, min(5, (median // 16).bit_length()))
    left = np.arange(n) if side is None or not side.any() else np.flatnonzero(side == 0)
    x = Tree(s, left, words)
    _traverse(s, x, x if len(left) == n else Tree(s, np.flatnonzero(side == 1), words))
    return s.label


def link_groups(tokens: np.ndarray, off: np.ndarray, percent: int, group: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """link() of small groups, in which alone sets are compared; group: ascending.

    In each round the first open set of every group is compared with the open
    ones after it that aren't in its component yet.
    """
    n = len(off) - 1
    size, label = np.diff(off), np.arange(n)
    names, code = np.unique(tokens, return_inverse=True)
    span = len(names)
    held = np.repeat(np.arange(n), size) * span + code  # ascending, as each set is
    any_side = np.zeros(n, bool) if side is None else np.maximum.reduceat(side, np.flatnonzero(np.diff(group, prepend=-1)))[np.cumsum(np.diff(group, prepend=-1) != 0) - 1] > 0
    open_ = np.arange(n)
    while len(open_):
        head = np.diff(group[open_], prepend=-1) != 0
        hub = open_[head][np.cumsum(head) - 1]
        i, j = hub[~head], open_[~head]
        open_ = j
        go = (label[i] != label[j]) & (np.minimum(size[i], size[j]) * 100 >= percent * np.maximum(size[i], size[j]))
        if side is not None:
            go &= ~any_side[i] | (side[i] != side[j])
        i, j = i[go], j[go]
        step = max(1, int(TOKENS // max(1, size[i].max()))) if len(i) else 1
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            m = size[a]
            own = held[np.repeat(off[a] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())] + np.repeat((b - a) * span, m)
            place = np.minimum(np.searchsorted(held, own), len(held) - 1)
            common = np.add.reduceat((held[place] == own).astype(np.int64), np.concatenate(([0], np.cumsum(m)[:-1]))) if len(own) else np.zeros(len(a), np.int64)
            ok = common * (100 + percent) >= percent * (m + size[b])
            if ok.any():
                label = local(n, a[ok], b[ok], label)
    return label
