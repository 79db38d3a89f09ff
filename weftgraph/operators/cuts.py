"""What cutting one edge does to a component of cycles, for all its edges at once.

An edge whose removal leaves the component strongly connected frees nothing.  The others
are bridges of the paths from a root, or of the paths to it: edges (u, v) where u is the
immediate dominator of v and v dominates all other nodes with an edge to v.  Without a bridge from
the root, the nodes that v dominates fall off, and the loops among them are those of a
depth-first search's loop nesting that do not reach out of them; all other nodes stay
together.  Without a bridge to the root the same holds backwards, and an edge that
is both loses both sets of nodes.  So two dominator trees and two loop nestings give the
number of freed nodes of every edge, in time that is linear but for a logarithm.

A component is a group of one task; the caller bounds its edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from weftgraph.plans import bounded


class Tree:
    """A rooted tree over nodes 0 to n - 1, given by parents (the root's is itself)."""

    def __init__(self, parent: np.ndarray) -> None:
        n = len(parent)
        self.parent, self.depth = parent, np.zeros(n, np.int64)
        root = int(np.flatnonzero(parent == np.arange(n))[0])
        order = np.argsort(parent, kind="stable")
        ends = np.searchsorted(parent[order], np.arange(n + 1))
        children = [order[a:b][order[a:b] != root].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.first, self.size, top_down, stack = np.zeros(n, np.int64), np.ones(n, np.int64), [], [root]
        while stack:
            node = stack.pop()
            self.first[node] = len(top_down)
            top_down.append(node)
            stack += children[node]
        for node in top_down[1:]:
            self.depth[node] = self.depth[parent[node]] + 1
        for node in top_down[:0:-1]:
            self.size[parent[node]] += self.size[node]
        self.bottom_up = top_down[::-1]
        self.jumps = [parent]
        while (1 << len(self.jumps)) <= int(self.depth.max()):
            self.jumps.append(self.jumps[-1][self.jumps[-1]])

    def holds(self, above: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Is ``node`` in the subtree of ``above``?"""
        return (self.first[above] <= self.first[node]) & (self.first[node] < self.first[above] + self.size[above])

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Nearest common ancestors."""
        a, b = np.where(self.depth[a] >= self.depth[b], a, b), np.where(self.depth[a] >= self.depth[b], b, a)
        lift = self.depth[a] - self.depth[b]
        for k, jump in enumerate(self.jumps):
            a = np.where(lift >> k & 1, jump[a], a)
        for jump in reversed(self.jumps):
            apart = jump[a] != jump[b]
            a, b = np.where(apart, jump[a], a), np.where(apart, jump[b], b)
        return np.where(a == b, a, self.parent[a])

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values in each subtree."""
        total = values.tolist()
        for node in self.bottom_up[:-1]:
            total[self.parent[node]] += total[node]
        return np.array(total, np.int64)


def depth_first(following: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order of discovery from node 0, parent of each as a place in that order)."""
    place, order, parents, stack = [-1] * len(following), [], [], [(0, 0)]
    while stack:
        node, parent = stack.pop()
        if place[node] >= 0:
            continue
        place[node] = len(order)
        order.append(node)
        parents.append(parent)
        stack += [(x, place[node]) for x in reversed(following[node]) if place[x] < 0]
    return np.array(order), np.array(parents)


def dominators(parent: list[int], before: list[list[int]]) -> np.ndarray:
    """Immediate dominators of nodes numbered in order of discovery; ``before``: nodes with an edge to each."""
    n = len(parent)
    semi, best, above, idom = list(range(n)), list(range(n)), [-1] * n, [0] * n
    waiting: list[list[int]] = [[] for _ in range(n)]

    def least(v: int) -> int:
        """The node of least semidominator on the linked path above ``v``, itself included."""
        path = []
        while above[v] >= 0 and above[above[v]] >= 0:
            path.append(v)
            v = above[v]
        for x in reversed(path):
            if semi[best[above[x]]] < semi[best[x]]:
                best[x] = best[above[x]]
            above[x] = above[v]
        return best[path[0]] if path else best[v]

    for w in range(n - 1, 0, -1):
        semi[w] = min([semi[w], *(semi[least(v)] for v in before[w])])
        waiting[semi[w]].append(w)
        above[w] = parent[w]
        for v in waiting[parent[w]]:
            u = least(v)
            idom[v] = u if semi[u] < semi[v] else parent[w]
        waiting[parent[w]] = []
    for w in range(1, n):
        if idom[w] != semi[w]:
            idom[w] = idom[idom[w]]
    return np.array(idom)


def loops(tree: Tree, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Header of the innermost loop around each node of a strongly connected graph (node 0's is itself):
    its nearest ancestor in the depth-first tree that it reaches within that ancestor's subtree."""
    n = len(tree.parent)
    meets = tree.meet(src, dst)
    order = np.argsort(meets, kind="stable")
    ends = np.searchsorted(meets[order], np.arange(n + 1)).tolist()
    pairs = list(zip(src[order].tolist(), dst[order].tolist(), strict=True))
    header, group = [0] * n, list(range(n))
    into: list[list[int]] = [[] for _ in range(n)]

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for u in range(n - 1, -1, -1):
        work = []
        for a, b in pairs[ends[u] : ends[u + 1]]:  # both ends are u or below it, in different branches
            if b == u:
                work.append(find(a))
            else:
                into[find(b)].append(a)
        while work:
            x = work.pop()
            if x == u or group[x] != x:
                continue
            header[x], group[x] = u, u
            work += [y for y in map(find, into[x]) if y != u]  # all of them lie in this loop now
            into[x] = []
    return np.array(header)


def _side(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[Tree, np.ndarray, np.ndarray]:
    """(dominator tree, innermost loop headers, which edges are bridges) of paths from node 0."""
    order, parent = depth_first(bounded.neighbours(n, src, dst))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b = place[src], place[dst]
    idom = dominators(parent.tolist(), bounded.neighbours(n, b, a))
    dominated = Tree(idom)
    outside = ~dominated.holds(b, a)  # v has one such edge at least; a bridge is the only one
    entries = np.bincount(b[outside], minlength=n)
    bridge = outside & (entries[b] == 1) & (b != 0)
    header = loops(Tree(parent), a, b)
    own_idom, own_header = np.empty(n, np.int64), np.empty(n, np.int64)
    own_idom[order], own_header[order] = order[idom], order[header]
    return Tree(own_idom), own_header, bridge


def _rectangles(x: np.ndarray, y: np.ndarray, value: np.ndarray, corners: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    """Sum of the values at points (x, y) with x0 <= x < x1 and y0 <= y < y1, for every corner (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = corners
    sums, out = [0] * (n + 1), np.zeros(len(x0), np.int64)

    def until(k: int) -> int:
        total = 0
        while k > 0:
            total += sums[k]
            k &= k - 1
        return total

    asked = sorted([(int(c), q, -1) for q, c in enumerate(x0)] + [(int(c), q, 1) for q, c in enumerate(x1)])
    points, k = sorted(zip(x.tolist(), y.tolist(), value.tolist(), strict=True)), 0
    for at, q, sign in asked:
        while k < len(points) and points[k][0] < at:
            place, gain = points[k][1] + 1, points[k][2]
            while place <= n:
                sums[place] += gain
                place += place & -place
            k += 1
        out[q] += sign * (until(int(y1[q])) - until(int(y0[q])))
    return out


def freed(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For every edge of a strongly connected graph (no loops, no repeats): how many nodes lie on no
    cycle once it is cut."""
    ahead, ahead_header, from_root = _side(n, src, dst)
    back, back_header, to_root = _side(n, dst, src)
    alone = []  # by direction: nodes that are no loop's header, and where they stop falling off alone
    for tree, header in ((ahead, ahead_header), (back, back_header)):
        nodes = np.setdiff1d(np.arange(1, n), header)
        alone.append((nodes, tree.meet(nodes, header[nodes])))
    single = [tree.below(np.bincount(nodes, minlength=n) - np.bincount(stops, minlength=n)) for tree, (nodes, stops) in zip((ahead, back), alone, strict=True)]
    out = np.zeros(len(src), np.int64)
    one, other, both = from_root & ~to_root, to_root & ~from_root, np.flatnonzero(from_root & to_root)
    out[one] = single[0][dst[one]] + (ahead.size[dst[one]] == n - 1)
    out[other] = single[1][src[other]] + (back.size[src[other]] == n - 1)
    if len(both):
        u, v = src[both], dst[both]
        corners = (ahead.first[v], ahead.first[v] + ahead.size[v], back.first[u], back.first[u] + back.size[u])
        shared = _rectangles(ahead.first, back.first, np.ones(n, np.int64), corners, n)
        nodes, stops = alone[0]
        x, y = np.concatenate([ahead.first[nodes], ahead.first[stops]]), np.tile(back.first[nodes], 2)
        twice = _rectangles(x, y, np.repeat([1, -1], len(nodes)), corners, n)
        out[both] = single[0][v] + single[1][u] - twice + (ahead.size[v] + back.size[u] - shared == n - 1)
    return out


def best_cut(table: pa.Table) -> pa.Table:
    """The edge of one component (scc, src, dst) whose removal frees most nodes (ties: the least), if any frees some."""
    ids, (src, dst) = bounded.coded(table, "src", "dst")
    frees = freed(len(ids), src, dst)
    best = int(np.lexsort((dst, src, -frees))[0])
    rows = [(table["scc"][0].as_py(), len(ids), ids[src[best]], ids[dst[best]], int(frees[best]))] if frees[best] else []
    kind = table.schema.field("src").type
    types = (kind, pa.int64(), kind, kind, pa.int64())
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("scc", "size", "src", "dst", "frees"), columns, types, strict=True)})
