"""Walks over a graph that spread over its communities: many at once, as arrays."""

from __future__ import annotations

import numpy as np

# Fixed values, ours: what a step gains by the first node of a community, by distance (as a share of the graph's longest edge),
# and the temperature at which steps are drawn.
NEW_COMMUNITY, DISTANCE, TEMPERATURE = 2.0, 1.0, 0.25
#: Entries of the arrays (walks x nodes) held at a time.
HELD = 8_000_000


class Adjacency:
    """Nodes by number, in the order of their names, with their neighbours and distances one after another."""

    def __init__(self, g: dict, community: dict):
        self.names = list(g)
        number = {a: i for i, a in enumerate(self.names)}
        self.neighbours = np.array([number[b] for a in self.names for b in g[a]], np.int64)
        self.distances = np.array([x[1] for a in self.names for x in g[a].values()], float)
        self.bounds = np.concatenate([[0], np.cumsum([len(g[a]) for a in self.names])]).astype(np.int64)
        self.community = np.unique([community.get(a, 0) for a in self.names], return_inverse=True)[1].ravel()

    def around(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index in nodes, neighbour, distance) of all edges of these nodes."""
        n = self.bounds[nodes + 1] - self.bounds[nodes]
        edge = np.repeat(self.bounds[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(nodes)), n), self.neighbours[edge], self.distances[edge]


def spread_walks(g: dict, n: int, community: dict, rng: np.random.Generator, max_depth: int | None = None, trials: int = 256, top_k: int = 16, branching: bool = False) -> list[list]:
    """The top_k walks of n nodes (or of max_depth + 1) by what their steps gained.

    Walks start at random. In each step the frontier of a walk is what its last node is linked to (what any is, if
    branching) and isn't in it. A frontier node gains NEW_COMMUNITY if its community is not in the walk yet, and
    DISTANCE times its distance to the nearest node of the walk that it is linked to. One is drawn with a
    probability that grows exponentially with its gain over TEMPERATURE. A walk without a frontier ends early.
    A graph of n nodes or fewer is its own only walk."""
    if len(g) <= n:
        return [list(g)]
    graph = Adjacency(g, community)
    longest = graph.distances.max() if len(graph.distances) and graph.distances.max() > 0 else 1.0
    steps = min(n - 1 if max_depth is None else max_depth, n - 1)
    at_once = max(1, HELD // len(g))
    walks: list[tuple[float, int, list[int]]] = []
    for first in range(0, trials, at_once):
        count = min(at_once, trials - first)
        path, gained = _walk(graph, count, steps, longest, rng, branching)
        walks += [(-gained[i], first + i, path[i][path[i] >= 0].tolist()) for i in range(count)]
    return [[graph.names[i] for i in w] for _, _, w in sorted(walks)[:top_k]]


def _walk(graph: Adjacency, count: int, steps: int, longest: float, rng: np.random.Generator, branching: bool) -> tuple[np.ndarray, np.ndarray]:
    nodes = len(graph.names)
    path, gained = np.full((count, steps + 1), -1), np.zeros(count)
    inside = np.zeros((count, nodes), bool)
    known = np.zeros((count, int(graph.community.max()) + 1), bool)
    near = np.full((count, nodes), np.inf)
    going, last = np.arange(count), rng.integers(nodes, size=count)
    for step in range(steps + 1):
        path[going, step], inside[going, last], known[going, graph.community[last]] = last, True, True
        if step == steps:
            break
        which, node, distance = graph.around(last)
        near[going[which], node] = np.minimum(near[going[which], node], distance)
        if branching:
            which, node = np.nonzero(np.isfinite(near[going]) & ~inside[going])
        else:
            free = ~inside[going[which], node]
            which, node = which[free], node[free]
        if not len(which):
            break
        walk = going[which]
        gain = NEW_COMMUNITY * ~known[walk, graph.community[node]] + DISTANCE * near[walk, node] / longest
        order = np.lexsort((node, -(gain + TEMPERATURE * rng.gumbel(size=len(gain))), which))
        drawn = order[np.concatenate([[True], np.diff(which[order]) > 0])]
        going, last = walk[drawn], node[drawn]
        gained[going] += gain[drawn]
    return path, gained
