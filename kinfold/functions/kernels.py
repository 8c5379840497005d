"""Kernels for what a relational plan cannot express, over one bounded group at a time."""

from __future__ import annotations

import heapq

import numpy as np


def hungarian(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total gain; rows and columns may stay alone at gain 0."""
    n, m = gain.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1:n + 1, 1:m + 1] = -np.maximum(gain, 0.0)
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    match, way = np.zeros(size + 1, int), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least = np.full(size + 1, np.inf)
        done = np.zeros(size + 1, bool)
        while True:
            done[j0] = True
            reduced = cost[match[j0]] - u[match[j0]] - v
            better = ~done & (reduced < least)
            better[0] = False
            least[better] = reduced[better]
            way[better] = j0
            open_columns = np.where(done, np.inf, least)
            open_columns[0] = np.inf
            j1 = int(open_columns.argmin())
            delta = open_columns[j1]
            u[match[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if 0 < match[j] <= n and gain[match[j] - 1, j - 1] > 0]


def sparse_assignment(edges: list[tuple]) -> list[tuple]:
    """Pairs (row, column) of greatest total gain from ``edges(row, column, gain)``; memory grows with the edges.

    Rows enter one by one, each along the shortest augmenting path under the duals so far; a path
    may end by leaving a row alone at gain 0.
    """
    near: dict = {}
    for i, j, gain in edges:
        if gain > 0:
            near.setdefault(i, []).append((j, -gain))
    u: dict = {}
    v: dict = {}
    owner: dict = {}
    chosen: dict = {}
    for start in sorted(near):
        u[start] = min(0, min(c - v.get(j, 0) for j, c in near[start]))
        reach, before, done, scanned = {}, {}, {}, {start: 0}
        heap: list = []
        i, base, ends = start, 0, None
        while ends is None:
            heapq.heappush(heap, (base - u[i], 1, i))  # left alone
            for j, c in near[i]:
                d = base + c - u[i] - v.get(j, 0)
                if j not in done and (j not in reach or d < reach[j]):
                    reach[j], before[j] = d, i
                    heapq.heappush(heap, (d, 0, j))
            while True:
                base, alone, x = heapq.heappop(heap)
                if alone or x not in done:
                    break
            if alone or x not in owner:
                ends = (alone, x)
            else:
                done[x] = base
                i = owner[x]
                scanned[i] = base
        for r, d in scanned.items():
            u[r] += base - d
        for c, d in done.items():
            v[c] = v.get(c, 0) - (base - d)
        alone, x = ends
        if alone:
            row, x = x, chosen.pop(x, None)
            if row == start:
                continue
        while True:
            row = before[x]
            freed = chosen.get(row)
            owner[x], chosen[row] = row, x
            if row == start:
                break
            x = freed
    return sorted(chosen.items())


class UnionFind:
    """Disjoint sets; the smallest member leads its set."""

    def __init__(self, items=()):
        self.parent = {x: x for x in items}

    def find(self, x):
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def cliques(edges: list[tuple], largest: int) -> dict:
    """Greedy cliques: edges (u, v, p, digest) by falling p merge two clusters if all cross pairs are edges."""
    have = {frozenset((u, v)) for u, v, *_ in edges}
    cluster = {x: {x} for u, v, *_ in edges for x in (u, v)}
    for u, v, *_ in sorted(edges, key=lambda e: (-e[2], e[3], e[0], e[1])):
        a, b = cluster[u], cluster[v]
        if a is b or len(a) + len(b) > largest or any(frozenset((x, y)) not in have for x in a for y in b):
            continue
        a |= b
        for x in b:
            cluster[x] = a
    return {x: min(members) for x, members in cluster.items()}


def agglomerate(edges: list[tuple], apart: set, dataset: dict, largest: int, one_per_dataset: bool) -> dict:
    """Edges (u, v, w) by falling weight merge clusters unless size, a cannot-link or a shared data set forbids it."""
    cluster = {x: {x} for u, v, *_ in edges for x in (u, v)}
    for u, v, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = cluster[u], cluster[v]
        if a is b or len(a) + len(b) > largest or any(frozenset((x, y)) in apart for x in a for y in b):
            continue
        if one_per_dataset and {dataset.get(x) for x in a} & {dataset.get(x) for x in b}:
            continue
        a |= b
        for x in b:
            cluster[x] = a
    return {x: min(members) for x, members in cluster.items()}


def pivots(edges: list[tuple], apart: set, dataset: dict, largest: int, one_per_dataset: bool, threshold: float) -> dict:
    """Correlation clustering: take the best connected vertex left, add neighbours whose net agreement is not negative."""
    weight: dict = {}
    for u, v, w in edges:
        weight.setdefault(u, {})[v] = w
        weight.setdefault(v, {})[u] = w
    left, out = set(weight), {}
    while left:
        def rank(x):
            near = [w for y, w in weight[x].items() if y in left and w >= threshold]
            return len(near), sum(w - threshold for w in near), x

        pivot = max(left, key=rank)
        members = [pivot]
        for y, w in sorted(((y, w) for y, w in weight[pivot].items() if y in left and w >= threshold), key=lambda t: (-t[1], t[0])):
            if len(members) >= largest or any(frozenset((x, y)) in apart for x in members):
                continue
            if one_per_dataset and dataset.get(y) in {dataset.get(x) for x in members}:
                continue
            agreement = sum(weight[x].get(y, 0.0) - threshold for x in members)
            if len(members) == 1 or agreement >= 0:
                members.append(y)
        for x in members:
            out[x] = min(members)
        left -= set(members)
    return out
