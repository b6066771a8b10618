"""Brute force of path searches and end rules in one small graph, for the tests. Scores and lengths are compared at 1e-9."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np


@dataclass
class Ends:
    """Two ends (positions in the track's voxel list), the path between them, confidence and length."""

    start: int
    end: int
    path: list[int]
    confidence: float
    length: float


class Graph:
    """Voxels in id order with their links; neighbours in ascending order."""

    def __init__(self, xyz: np.ndarray, energy: np.ndarray, links: Iterable[tuple[int, int]]) -> None:
        self.xyz, self.energy, self.n = xyz, energy, len(energy)
        near: list[set[int]] = [set() for _ in range(self.n)]
        for a, b in links:
            near[a].add(b)
            near[b].add(a)
        self.near = [sorted(s) for s in near]
        self.degree = np.array([len(s) for s in near])
        self.trees: dict[int, list[int]] = {}

    def gap(self, a: int, b: int) -> float:
        return float(np.linalg.norm(self.xyz[a] - self.xyz[b]))

    def extent(self) -> float:
        return float(np.linalg.norm(self.xyz.max(0) - self.xyz.min(0)))

    def tree(self, root: int) -> list[int]:
        """Parents of a breadth-first search, -1 where not reached; kept for the root."""
        if root not in self.trees:
            parent = [-1] * self.n
            parent[root] = root
            queue = deque([root])
            while queue:
                v = queue.popleft()
                for w in self.near[v]:
                    if parent[w] < 0:
                        parent[w] = v
                        queue.append(w)
            self.trees[root] = parent
        return self.trees[root]

    def path(self, a: int, b: int, parent: list[int] | None = None) -> list[int]:
        """Fewest-links path, or the path of a given tree rooted in a; empty if there is none."""
        parent = parent or self.tree(a)
        if parent[b] < 0:
            return []
        out = [b]
        while out[-1] != a:
            out.append(parent[out[-1]])
        return out[::-1]

    def length(self, path: list[int]) -> float:
        return float(np.linalg.norm(np.diff(self.xyz[path], axis=0), axis=1).sum()) if len(path) > 1 else 0.0

    def weighted_tree(self, root: int, weight: Callable[[int, int], float]) -> tuple[list[float], list[int]]:
        """Distances and parents by least summed weight."""
        dist, parent = [float("inf")] * self.n, [-1] * self.n
        dist[root], parent[root] = 0.0, root
        heap = [(0.0, root)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for w in self.near[v]:
                if (c := d + weight(v, w)) < dist[w]:
                    dist[w], parent[w] = c, v
                    heapq.heappush(heap, (c, w))
        return dist, parent

    def spanning_tree(self) -> Graph:
        """Minimum spanning forest by (distance, ends)."""
        up = list(range(self.n))

        def root(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        kept = []
        for _, a, b in sorted((self.gap(a, b), a, b) for a in range(self.n) for b in self.near[a] if a < b):
            if (ra := root(a)) != (rb := root(b)):
                up[ra] = rb
                kept.append((a, b))
        return Graph(self.xyz, self.energy, kept)

    def curvature(self) -> np.ndarray:
        """Mean of 1 - |cos| over pairs of neighbours; 0 with fewer than two, 1 if no pair has a direction (0 for two neighbours)."""
        out = np.zeros(self.n)
        for v, ns in enumerate(self.near):
            if len(ns) < 2:
                continue
            d = self.xyz[ns] - self.xyz[v]
            size = np.linalg.norm(d, axis=1)
            bends = [1 - abs(np.clip(d[i] @ d[j] / size[i] / size[j], -1, 1)) for i, j in combinations(range(len(ns)), 2) if min(size[i], size[j]) > 1e-6]
            out[v] = np.mean(bends) if bends else float(len(ns) > 2)
        return out

    def outermost(self) -> list[int]:
        """First least and first greatest voxel along x, y and z."""
        return [int(f(self.xyz[:, c])) for c in range(3) for f in (np.argmin, np.argmax)]


def best_pair(g: Graph, candidates: Iterable[int], score: Callable[[int, int, list[int], float], float | None], least: float = 0.0) -> Ends | None:
    """The first pair of candidates (in their order) whose score is greatest and above least; confidence is left at 0."""
    best, found = least, None
    for a, b in combinations(dict.fromkeys(candidates), 2):
        path = g.path(a, b)
        if not path:
            continue
        length = g.length(path)
        value = score(a, b, path, length)
        if value is not None and (value := round(value, 9)) > best:
            best, found = value, Ends(a, b, path, 0.0, length)
    return found


def by_distance(g: Graph, confidence: float) -> Ends:
    """The two voxels farthest apart: of all up to 50 voxels, of the outermost ones beyond."""
    pool = range(g.n) if g.n <= 50 else dict.fromkeys(g.outermost())
    far, pair = 0.0, (0, min(1, g.n - 1))
    for a, b in combinations(pool, 2):
        if (d := round(g.gap(a, b), 9)) > far:
            far, pair = d, (a, b)
    path = g.path(*pair)
    return Ends(*pair, path, confidence, g.length(path))


def _coverage_confidence(cover: float, good: tuple[float, float], poor: tuple[float, float]) -> float:
    base, slope = good if cover >= 0.5 else poor
    return base + slope * min(1.0, cover)


def by_topology(g: Graph) -> Ends:
    """The voxels of degree 1: two of them, or the pair with the longest path."""
    tips = np.flatnonzero(g.degree == 1).tolist()
    if len(tips) < 2:
        return by_distance(g, 0.6)
    found = best_pair(g, tips, lambda a, b, path, length: length) or Ends(tips[0], tips[1], g.path(tips[0], tips[1]), 0.0, 0.0)
    cover = found.length / max(g.extent(), 1.0)
    two = len(tips) == 2
    found.confidence = _coverage_confidence(cover, (0.85, 0.1) if two else (0.75, 0.15), (0.5, 0.3) if two else (0.4, 0.3))
    return found


def by_curvature(g: Graph) -> Ends:
    """The pair among the six straightest voxels, at least 2 mm apart, with the longest path plus a bonus for straightness."""
    if g.n < 3:
        return by_distance(g, 0.7)
    c = g.curvature()
    order = np.argsort(np.round(c, 9), kind="stable")[:6].tolist()
    bonus = lambda a, b: 2 / (c[a] + c[b] + 1e-6)
    found = best_pair(g, order, lambda a, b, path, length: length + bonus(a, b) if g.gap(a, b) >= 2 else None)
    if not found:
        return Ends(order[0], order[1], [], 0.0, 0.0)
    found.confidence = float(min(0.7 + 0.2 * bonus(found.start, found.end) / 10, 0.9))
    return found


def by_space(g: Graph) -> Ends:
    """The longest path between outermost voxels and voxels of least degree."""
    if g.n == 1:
        return Ends(0, 0, [0], 1.0, 0.0)
    pool = list(dict.fromkeys([*g.outermost(), *np.flatnonzero(g.degree == g.degree.min()).tolist()]))
    found = best_pair(g, pool, lambda a, b, path, length: length)
    if not found:
        return Ends(pool[0], pool[min(1, len(pool) - 1)], [], 0.75, 0.0)
    sure = 0.75 + 0.1 * (g.gap(found.start, found.end) / found.length > 0.8) + min(0.1, found.length / 500)
    sure += 0.05 * (g.degree[[found.start, found.end]].mean() < 0.7 * g.degree.mean())
    found.confidence = float(min(sure, 0.95))
    return found


def by_energy(g: Graph, min_coverage: float = 0.6) -> Ends:
    """Far-apart, energetic voxels: path length weighed by end energies and coverage; without a pair that covers enough, a
    looser rule of low confidence."""
    if g.n == 1:
        return Ends(0, 0, [0], 1.0, 0.0)
    e, top, extent = g.energy, float(g.energy.max()), max(g.extent(), 1.0)
    high = float(e.mean()) + 0.5 * (top - float(e.mean()))
    hot = np.flatnonzero(e >= high).tolist()
    pool = list(dict.fromkeys([*hot, *g.outermost()]))
    if len(pool) > 20:
        pool = list(dict.fromkeys([*sorted(hot, key=lambda v: -e[v])[:10], *g.outermost()]))
    weigh = lambda a, b: 1 + 0.5 * (e[a] + e[b]) / top

    def strict(a: int, b: int, path: list[int], length: float) -> float | None:
        cover = length / extent
        return length * weigh(a, b) * min(cover, 1.5) if g.gap(a, b) >= 5 and cover >= min_coverage else None

    found = best_pair(g, pool, strict, -np.inf)
    if found:
        n_hot = int(e[found.start] >= high) + int(e[found.end] >= high)
        straight = g.gap(found.start, found.end) / max(found.length, 1.0)
        found.confidence = float(min(0.95, (0.1, 0.25, 0.4)[n_hot] + min(0.4, 0.4 * found.length / extent) + 0.2 * min(1.0, straight / 0.8)))
        return found
    found = best_pair(g, pool, lambda a, b, path, length: length * weigh(a, b) if g.gap(a, b) >= 3 else None, -np.inf)
    found = found or Ends(pool[0], pool[min(1, len(pool) - 1)], [], 0.0, 0.0)
    found.confidence = min(0.5, 0.2 + 0.3 * found.length / extent)
    return found


def by_edge_energy(g: Graph, floor: float = 1e-6, alpha: float = 1.0, beta: float = 1.0) -> Ends:
    """Double sweep by link costs d^alpha / (mean energy + floor)^beta, which avoid shortcuts through empty regions."""
    if g.n == 1:
        return Ends(0, 0, [0], 1.0, 0.0)
    e = g.energy
    floor = max(floor, 1e-6 * max(float(e.max()), 1e-12))
    cost = lambda a, b: g.gap(a, b) ** alpha / (0.5 * (e[a] + e[b]) + floor) ** beta
    u = int(np.argmax(np.round(g.weighted_tree(0, cost)[0], 9)))
    dist, parent = g.weighted_tree(u, cost)
    w = int(np.argmax(np.round(dist, 9)))
    path = g.path(u, w, parent)
    if not path:
        return Ends(u, w, [], 0.0, 0.0)
    length, straight = g.length(path), g.gap(u, w)
    ratio = length / straight if straight > 0 else np.inf
    return Ends(u, w, path, float(np.clip(0.5 + 0.5 * np.tanh((ratio - 1.05) / 0.25), 0, 1)), length)


def by_spanning_tree(g: Graph) -> Ends:
    """The diameter of the minimum spanning tree, by two breadth-first sweeps."""
    t = g.spanning_tree()

    def farthest(root: int) -> int:
        parent, depth = t.tree(root), [-1] * t.n
        depth[root] = 0
        queue = deque([root])
        while queue:
            v = queue.popleft()
            for x in t.near[v]:
                if depth[x] < 0 and parent[x] == v:
                    depth[x] = depth[v] + 1
                    queue.append(x)
        return int(np.argmax(depth))

    u = farthest(0)
    w = farthest(u)
    path = t.path(u, w)
    return Ends(u, w, path, 1.0, t.length(path))


def combined(g: Graph, use_energy: bool = True, use_edge_energy: bool = True, use_spanning_tree: bool = False, dense: float = 6.0) -> Ends:
    """Topology if it is sure; then by density the energetic, spatial and straightness rules, or the longest of them."""
    topo = by_topology(g)
    if topo.confidence >= 0.85:
        return topo
    if g.degree.mean() <= dense:
        if topo.confidence >= 0.8:
            return topo
        bent = by_curvature(g)
        return bent if bent.length > 1.1 * topo.length + 1e-9 else topo
    hot = None
    for wanted, rule in ((use_edge_energy, by_edge_energy), (use_energy, by_energy)):
        if wanted:
            hot = rule(g)
            if hot.confidence >= 0.85 or hot.length > 1.1 * topo.length + 1e-9:
                return hot
    wide = by_space(g)
    if wide.length > 1.2 * topo.length + 1e-9:
        return wide
    ranked = [hot] if use_energy else []
    ranked += [wide, by_curvature(g), topo]
    most = max(round(r.length, 9) for r in ranked)
    if use_spanning_tree and round((tree := by_spanning_tree(g)).length, 9) >= most:
        return tree
    # equal lengths: energy, space, topology, then straightness
    order = [*ranked[:-2], topo, ranked[-2]]
    return next(r for r in order if round(r.length, 9) == most)


RULES: dict[str, Callable[[Graph], Ends]] = {
    "topology": by_topology,
    "curvature": by_curvature,
    "spatial": by_space,
    "energy": by_energy,
    "edge_energy": by_edge_energy,
    "mst": by_spanning_tree,
    "distance": lambda g: by_distance(g, 0.6),
    "combined": combined,
    "combined_mst": lambda g: combined(g, use_spanning_tree=True),
}
