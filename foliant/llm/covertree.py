"""Cover trees of up to some thousand points: greedy nets, level-wise covering radii, and best-first descent for many queries at once.

Points are augmented by one coordinate that gives all of them the norm of the longest, so that they lie on a sphere: the angle
between a query and a point then decides their inner product, and angles keep the triangle inequality. A point of a level covers
those that join under it on lower levels; ``radius`` holds, for each point and level, the largest angle to any of them.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, fields

import numpy as np

BASE = 1.3
#: Scores up to this are told apart by the bounds, whose rounding is far below one part in 10**7.
SLACK = 1e-7
#: Pairs of query and point that are multiplied at a time.
PAIRS = 1 << 16


@dataclass
class Tree:
    """Points with their rows, ids and labels; ``children`` of one parent and level form a group, ``following`` is the parent's next lower group."""

    vectors: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    nameless: np.ndarray
    labels: np.ndarray
    norm: np.ndarray
    root: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    children: np.ndarray
    following: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> "Tree":
        with np.load(io.BytesIO(data)) as found:
            return Tree(**{name: found[name] for name in found.files})


def build(vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, nameless: np.ndarray, labels: np.ndarray) -> Tree:
    """The points come in by farthest-first order: the distance of a point to those before it gives its level."""
    n = len(vectors)
    x = vectors.astype(float)
    squares = (x * x).sum(axis=1)
    top = squares.max()
    extra = np.sqrt(top - squares)
    away = np.sqrt(np.maximum(2 * (top - x @ x.T - np.outer(extra, extra)), 0))
    root = int(away.mean(axis=0).argmin())
    near, joined = away[root].copy(), np.zeros(n)
    near[root] = -1
    for _ in range(n - 1):
        i = int(near.argmax())
        joined[i] = near[i]
        np.minimum(near, away[i], out=near)
        near[i] = -1
    with np.errstate(divide="ignore"):
        level = np.floor(np.log(joined) / np.log(BASE))
    finite = level[np.isfinite(level)]
    level[~np.isfinite(level)] = (finite.min() if len(finite) else 0) - 1
    level[root] = level.max() + 1
    parent = np.full(n, root)
    for at in np.unique(level)[-2::-1] if n > 1 else ():
        here, above = np.flatnonzero(level == at), np.flatnonzero(level > at)
        parent[here] = above[away[np.ix_(here, above)].argmin(axis=1)]

    children = np.array([i for i in np.lexsort((np.arange(n), -level, parent)).tolist() if i != root], np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (parent[children[1:]] != parent[children[:-1]]) | (level[children[1:]] != level[children[:-1]])])) if len(children) else np.empty(0, np.int64)
    ends = np.concatenate([starts[1:], [len(children)]]).astype(np.int64) if len(starts) else starts
    owner = parent[children[starts]] if len(starts) else starts
    group = np.full(n, -1)
    group[children] = np.repeat(np.arange(len(starts)), ends - starts)
    radius = np.zeros(len(starts))
    low, high = np.full(len(starts), np.iinfo(np.int64).max), np.full(len(starts), np.iinfo(np.int64).min)
    point, at = children.copy(), children.copy()
    while len(point):
        np.maximum.at(radius, group[at], away[parent[at], point])
        np.minimum.at(low, group[at], labels[point])
        np.maximum.at(high, group[at], labels[point])
        at = parent[at]
        point, at = point[at != root], at[at != root]
    following, first = np.full(len(starts), -1), np.full(n, -1)
    for g in range(len(starts) - 1, -1, -1):
        first[owner[g]] = g
        if g + 1 < len(starts) and owner[g + 1] == owner[g]:
            following[g], radius[g] = g + 1, max(radius[g], radius[g + 1])
            low[g], high[g] = min(low[g], low[g + 1]), max(high[g], high[g + 1])
    norm = np.sqrt(top)
    angle = 2 * np.arcsin(np.minimum(1, radius / (2 * norm))) if norm > 0 else radius
    return Tree(vectors, rows, ids, nameless, labels, np.array(norm), np.array(root), first, starts, ends, children, following, angle, low, high)


def bounds(scores: np.ndarray, norms: np.ndarray, norm: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of queries of length ``norms`` with points within ``angle`` of one whose inner product is ``scores``."""
    scale = norms * norm
    turn = np.arccos(np.clip(np.divide(scores, scale, out=np.ones_like(scale), where=scale > 0), -1, 1))
    slack = SLACK * scale + 0.5
    return scale * np.cos(np.minimum(np.pi, turn + angle)) - slack, scale * np.cos(np.maximum(0, turn - angle)) + slack


def exact_kind(a: np.ndarray, b: np.ndarray):
    """The number type in which inner products of integer rows are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


@dataclass
class Queries:
    """What is asked: the ``most`` best points with a score of lo .. hi, of the query's label (``same``) or of others, not the query's own row."""

    vectors: np.ndarray
    labels: np.ndarray
    same: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    own: np.ndarray

    def part(self, a: int, b: int) -> "Queries":
        return Queries(*(getattr(self, f.name)[a:b] for f in fields(self)))


def _rank(groups: np.ndarray) -> np.ndarray:
    """Place of each entry within its run of equal ``groups``."""
    begin = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.empty(0, np.int64)
    return np.arange(len(groups)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(groups)]])))


def best(tree: Tree, asked: Queries, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, point, score) of the answers within this tree, and how many inner products it took."""
    kind = exact_kind(asked.vectors, tree.vectors)
    left, right = asked.vectors.astype(kind), tree.vectors.astype(kind)
    norms = np.sqrt((asked.vectors.astype(float) ** 2).sum(axis=1))
    least = asked.lo.copy()
    kept = [np.empty(0, np.int64)] * 3
    count = 0

    def multiply(q, p):
        nonlocal count
        count += len(q)
        parts = [np.einsum("ij,ij->i", left[q[i:i + PAIRS]], right[p[i:i + PAIRS]]) for i in range(0, len(q), PAIRS)]
        return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)

    def offer(q, p, s):
        nonlocal kept
        fits = (s >= least[q]) & (s <= asked.hi[q]) & ((tree.labels[p] == asked.labels[q]) == asked.same[q]) & (tree.rows[p] != asked.own[q])
        if fits.any():
            q, p, s = (np.concatenate([a, b[fits]]) for a, b in zip(kept, (q, p, s)))
            order = np.lexsort((tree.ids[p], tree.nameless[p], -s, q))
            q, p, s = q[order], p[order], s[order]
            rank = _rank(q)
            kept = [a[rank < most] for a in (q, p, s)]
            full = rank == most - 1
            least[q[full]] = np.maximum(least[q[full]], s[full])

    everyone = np.arange(len(left))
    scores = multiply(everyone, np.full(len(left), int(tree.root)))
    offer(everyone, np.full(len(left), int(tree.root)), scores)
    q, g, s = everyone, np.full(len(left), tree.first[tree.root]), scores
    open_q, open_g, open_s, open_least, open_most = q[:0], g[:0], s[:0], np.empty(0), np.empty(0)
    take = 8
    while True:
        there = g >= 0
        q, g, s = q[there], g[there], s[there]
        lower, upper = bounds(s.astype(float), norms[q], tree.norm, tree.radius[g])
        open_q, open_g, open_s, open_least, open_most = (np.concatenate(x) for x in ((open_q, q), (open_g, g), (open_s, s), (open_least, lower), (open_most, upper)))
        labels = asked.labels[open_q]
        named = (tree.low[open_g] <= labels) & (labels <= tree.high[open_g])
        alone = (tree.low[open_g] == labels) & (labels == tree.high[open_g])
        live = (open_most >= least[open_q]) & (open_least <= asked.hi[open_q]) & np.where(asked.same[open_q], named, ~alone)
        order = np.flatnonzero(live)
        if not len(order):
            return *kept, count
        order = order[np.lexsort((-np.minimum(open_most, asked.hi[open_q])[order], open_q[order]))]
        now = _rank(open_q[order]) < take
        chosen, later = order[now], order[~now]
        q, g, s = open_q[chosen], open_g[chosen], open_s[chosen]
        open_q, open_g, open_s, open_least, open_most = (x[later] for x in (open_q, open_g, open_s, open_least, open_most))
        size = tree.end[g] - tree.begin[g]
        again = np.repeat(np.arange(len(g)), size)
        child = tree.children[tree.begin[g][again] + np.arange(len(again)) - np.repeat(np.cumsum(size) - size, size)]
        found = multiply(q[again], child)
        offer(q[again], child, found)
        q, g, s = np.concatenate([q, q[again]]), np.concatenate([tree.following[g], tree.first[child]]), np.concatenate([s, found])
        take *= 2
