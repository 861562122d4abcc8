"""All geometry metrics of a segment at once, in one shuffle by segment.

Vertices and faces of a segment meet in one task, where vectorised numpy does
what would take dozens of shuffles as joins (rings, components, neighbours).
Time grows as n log n: rings are searched from blocks of faces along sparse
adjacency, neighbours in grid cells.  Memory grows with the segment (figures in
the README); tasks hold one segment at a time.  The joins in ``graph`` are the
way for segments that don't fit a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tritri import intersect

RESULT = "segment_id long, metric string, score double, details map<string,double>, problem_faces array<long>, error string"


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    lab = np.arange(n)
    while True:
        before = lab.copy()
        np.minimum.at(lab, a, lab[b])
        np.minimum.at(lab, b, lab[a])
        lab = lab[lab]
        if (lab == before).all():
            return lab


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _degrees(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(np.clip((a * b).sum(axis=1), -1, 1)))


def vertex_fans(tri: np.ndarray, n: int) -> np.ndarray:
    """Edge-connected groups of the triangles around each of n vertices; tri: rows of three places."""
    m = len(tri)
    u = np.concatenate([tri[:, k] for k in (0, 1, 2)]).astype(np.int64)
    w = np.concatenate([tri[:, k] for k in (1, 2, 0)]).astype(np.int64)
    key, face = np.minimum(u, w) * (n + 1) + np.maximum(u, w), np.tile(np.arange(m), 3)
    order = np.lexsort((face, key))
    key, face = key[order], face[order]
    same = np.flatnonzero((key[:-1] == key[1:]) & (face[:-1] != face[1:]))
    u, w, a, b = key[same] // (n + 1), key[same] % (n + 1), face[same], face[same + 1]
    inc = np.unique((tri.astype(np.int64) * m + np.arange(m)[:, None]).ravel())
    at = lambda v, f: np.searchsorted(inc, v * m + f)
    lab = labels(len(inc), np.concatenate((at(u, a), at(w, a))), np.concatenate((at(u, b), at(w, b))))
    return np.bincount(inc[np.unique(lab)] // m, minlength=n)


class Adjacency:
    """Neighbours of n nodes, each once and without the node itself, by rows."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        key = np.unique(np.concatenate((a * np.int64(n) + b, b * np.int64(n) + a)))
        key = key[key // n != key % n]
        self.n, self.to = n, key % n
        self.head = np.searchsorted(key // n, np.arange(n + 1))

    def step(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, neighbour) of all neighbours."""
        count = self.head[nodes + 1] - self.head[nodes]
        at = np.repeat(np.arange(len(nodes)), count)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, self.to[self.head[nodes][at] + nth]


def _without(x: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Elements of x that aren't in ``gone`` (both sorted)."""
    if not len(gone):
        return x
    return x[gone[np.minimum(np.searchsorted(gone, x), len(gone) - 1)] != x]


def ring_sums(values: np.ndarray, a: np.ndarray, b: np.ndarray, hops: int, chunk: int = 512) -> np.ndarray:
    """Sum of ``values`` over all nodes within ``hops`` steps, each once: level by level from a chunk of sources."""
    n = len(values)
    near, out = Adjacency(n, a, b), values.astype(float)
    for at in range(0, n, chunk):
        size = min(chunk, n - at)
        before, now = np.zeros(0, np.int64), np.arange(size) * np.int64(n) + np.arange(at, at + size)
        for _ in range(hops):
            source, node = now // n, now % n
            i, to = near.step(node)
            # a neighbour of a level lies in it, in the one before or in the next
            before, now = now, _without(_without(np.unique(source[i] * np.int64(n) + to), before), now)
            if not len(now):
                break
            source, node = now // n, now % n
            for c in range(values.shape[1]):
                out[at : at + size, c] += np.bincount(source, values[node, c], size)
    return out


def _ranked(d: np.ndarray, idx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of each row of d, ties by idx: (idx, d)."""
    bar = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(d <= bar)
    own, dist = idx[row, col], d[row, col]
    order = np.lexsort((own, dist, row))
    row, own, dist = row[order], own[order], dist[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return own[first].reshape(-1, k), dist[first].reshape(-1, k)


def nearest(points: np.ndarray, k: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances of the k nearest, self included, ties by index.

    Points lie in cells of a grid; a query looks at the 27 cells around it, which
    hold all points within one cell's width.  Those whose k-th neighbour is
    farther come again with cells twice as wide.
    """
    n, asked = len(points), np.arange(len(points)) if asked is None else asked
    k = min(k, n)
    idx, dist = np.zeros((len(asked), k), np.int64), np.zeros((len(asked), k))
    if not n or not len(asked):
        return idx, dist
    low, extent = points.min(axis=0), float(np.ptp(points, axis=0).max())
    squared = lambda q, p: np.round(sum((q[..., c] - p[..., c]) ** 2 for c in range(points.shape[1])), 9)
    some = points[asked[:: max(1, len(asked) // 32)][:32]]
    width = float(np.sqrt(np.quantile(np.partition(squared(some[:, None], points[None]), k - 1, axis=1)[:, k - 1], 0.75))) * 1.0001 + 1e-9
    left = np.arange(len(asked))
    while len(left):
        whole = width >= extent
        width = max(width, extent / 2e6)  # cell numbers of three axes fit 63 bits
        cell = np.floor((points - low) / width).astype(np.int64)
        size = cell.max(axis=0) + 3
        code = lambda c, size=size: ((c[..., 0] + 1) * size[1] + c[..., 1] + 1) * size[2] + c[..., 2] + 1
        key = code(cell)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        around = np.stack(np.meshgrid(*[[-1, 0, 1]] * 2, indexing="ij"), -1).reshape(-1, 2)
        # cells of one column are neighbours in the order of keys: nine ranges, not 27 cells
        own = cell[asked[left]]
        beside = own[:, None, :] + np.concatenate((around, np.zeros((9, 1), np.int64)), axis=1)[None]
        lo, hi = np.searchsorted(ranked, code(beside) - 1), np.searchsorted(ranked, code(beside) + 1, "right")
        count = (hi - lo).sum(axis=1)
        again = []
        begin = 0
        by_count = np.argsort(count, kind="stable")  # rows of like length fill a block well
        while begin < len(left):
            rows = by_count[begin : begin + max(1, 2_000_000 // max(1, int(count[by_count[min(begin + 4095, len(left) - 1)]])))][:4096]
            begin += len(rows)
            most = int(count[rows].max())
            r, c = lo[rows].ravel(), (hi - lo)[rows].ravel()
            flat = np.repeat(r, c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            filled = np.arange(most)[None, :] < count[rows][:, None]
            near = np.zeros((len(rows), most), np.int64)
            near[filled] = order[flat]
            d = np.where(filled, squared(points[asked[left[rows]]][:, None], points[near]), np.inf)
            full = np.flatnonzero(count[rows] >= k)
            done = np.zeros(len(rows), bool)
            if len(full):
                found, away = _ranked(d[full], near[full], k)
                safe = (away[:, -1] < width * width * (1 - 1e-9)) | whole
                idx[left[rows[full[safe]]]], dist[left[rows[full[safe]]]] = found[safe], away[safe]
                done[full[safe]] = True
            again.append(left[rows[~done]])
        left = np.sort(np.concatenate(again))
        width *= 2
    return idx, dist


class Segment:
    """Arrays of one mesh: positions, triangles (by position), shared intermediates."""

    def __init__(self, vertices: pd.DataFrame, faces: pd.DataFrame):
        vertices, faces = vertices.sort_values("vertex_id"), faces.sort_values("face_id")
        self.vertex_ids = vertices["vertex_id"].to_numpy()
        self.face_ids = faces["face_id"].to_numpy()
        self.xyz = vertices[["x", "y", "z"]].to_numpy(float)
        self.tri = np.searchsorted(self.vertex_ids, faces[["v0", "v1", "v2"]].to_numpy())
        p = self.xyz[self.tri]
        self.edges = np.stack((p[:, 1] - p[:, 0], p[:, 2] - p[:, 1], p[:, 0] - p[:, 2]), axis=1)
        self.length = np.sqrt((self.edges**2).sum(axis=2))
        cross = np.cross(self.edges[:, 0], -self.edges[:, 2])
        self.area = 0.5 * np.sqrt((cross**2).sum(axis=1))
        self.normal = _unit(cross)
        self.centroid = p.mean(axis=1)
        n = len(self.tri)
        u = np.concatenate([self.tri[:, k] for k in (0, 1, 2)])
        w = np.concatenate([self.tri[:, k] for k in (1, 2, 0)])
        key = np.minimum(u, w).astype(np.int64) * (len(self.xyz) + 1) + np.maximum(u, w)
        face = np.tile(np.arange(n), 3)
        order = np.lexsort((face, key))
        self.key, self.face = key[order], face[order]
        self.edge_keys, self.edge_counts = np.unique(self.key, return_counts=True)
        i, j = [], []
        for d in (1, 2):
            same = np.flatnonzero(self.key[:-d] == self.key[d:])
            i.append(self.face[same])
            j.append(self.face[same + d])
        self.i, self.j = np.concatenate(i), np.concatenate(j)
        self.deviation = None

    def ends(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys // (len(self.xyz) + 1), keys % (len(self.xyz) + 1)

    def triangle_quality(self):
        low, high = self.length.min(axis=1), self.length.max(axis=1)
        aspect = np.divide(high, low, out=np.full(len(low), np.inf), where=low > 0)
        least = np.full(len(low), np.inf)
        for a, b in ((0, 2), (1, 0), (2, 1)):
            d = self.length[:, a] * self.length[:, b]
            c = np.divide(-(self.edges[:, a] * self.edges[:, b]).sum(axis=1), d, out=np.zeros(len(d)), where=d > 0)
            least = np.minimum(least, np.degrees(np.arccos(np.clip(c, -1, 1))))
        mean = self.area.mean()
        cv = self.area.std() / mean if mean > 0 else np.inf
        score = 0.4 * (aspect < 5).mean() + 0.4 * (least > 15).mean() + 0.2 * max(0.0, 1 - cv)
        finite = aspect[np.isfinite(aspect)]
        return score, {"area_cv": cv} | ({"mean_aspect": finite.mean()} if len(finite) else {}), np.flatnonzero((aspect >= 5) | (least <= 15))

    def topology(self):
        n = len(self.tri)
        edge_ok = self.edge_counts.max() <= 2
        fans = vertex_fans(self.tri, len(self.xyz))
        vertex_ok = (fans <= 1).all()
        parts = len(np.unique(labels(n, self.i, self.j)))
        odd = int((self.edge_counts != 2).sum())
        score = 0.4 * (0.5 * edge_ok + 0.5 * vertex_ok) + 0.3 / parts + 0.3 * min(1.0, max(0.0, 1 - odd / max(int(1.5 * n), 1)))
        return score, {"n_components": parts, "n_boundary_edges": odd, "edge_manifold": float(edge_ok), "vertex_manifold": float(vertex_ok)}, None

    def normal_consistency(self):
        if not len(self.i):
            return 1.0, {"n_pairs": 0.0}, None
        angle = _degrees(self.normal[self.i], self.normal[self.j])
        return (angle < 30).mean(), {"n_pairs": len(angle), "mean_dihedral": angle.mean()}, None

    def smooth_deviation(self) -> np.ndarray:
        if self.deviation is None:
            self.deviation = _degrees(self.normal, _unit(ring_sums(self.normal, self.i, self.j, 8)))
        return self.deviation

    def sheet_switching(self):
        flagged = self.smooth_deviation() > 35
        total = self.area.sum()
        both = flagged[self.i] & flagged[self.j]
        lab = labels(len(self.tri), self.i[both], self.j[both])
        size = np.bincount(lab[flagged], minlength=len(lab))
        large = flagged & (size[lab] >= 20)
        score = 1.0 if not large.any() else (1 - self.area[large].sum() / total if total > 0 else 0.0)
        return score, {"n_flagged": flagged.sum(), "n_clusters": len(np.unique(lab[large])), "flagged_area": self.area[large].sum()}, np.flatnonzero(large) if large.any() else None

    def self_intersections(self, most: int = 2000):
        n = len(self.tri)
        if not n:
            return 1.0, {}, None
        asked = np.arange(n)
        if n > most:  # a fixed sample, as the metric defines it
            asked = np.sort(np.random.default_rng(42).choice(n, most, replace=False))
        near, _ = nearest(self.centroid, min(50, n), asked)
        shares = (self.tri[asked][:, None, :, None] == self.tri[near][:, :, None, :]).any(axis=(2, 3))
        free = ~shares & (near != asked[:, None])
        free &= np.cumsum(free, axis=1) <= 30
        q, k = np.nonzero(free)
        hit = intersect(self.xyz[self.tri[asked[q]]], self.xyz[self.tri[near[q, k]]])
        fraction = len(np.unique(q[hit])) / len(asked)
        pairs = int(hit.sum() * (n / len(asked)))
        return 1 - 20 * min(0.05, fraction), {"tested": len(asked), "pairs": pairs, "fraction": fraction}, None

    def noise(self):
        rim = self.ends(self.edge_keys[self.edge_counts == 1])
        ring = np.zeros(len(self.xyz), bool)
        ring[np.concatenate(rim)] = True
        u, w = self.ends(self.edge_keys)
        for _ in range(3):
            grown = ring.copy()
            grown[w[ring[u]]] = True
            grown[u[ring[w]]] = True
            ring = grown
        inside = np.flatnonzero(~ring)
        if len(inside) < 20:
            return 1.0, {"n_interior": len(inside)}, np.zeros(0, np.int64)
        mean = np.sqrt(nearest(self.xyz[inside], 20)[1]).mean(axis=1)
        out = inside[~(mean < mean.mean() + 5 * mean.std(ddof=1))]
        score = 1 - 12.5 * min(0.08, len(out) / len(self.xyz))
        faces = np.flatnonzero(np.isin(self.tri, out).any(axis=1))
        return score, {"n_interior": len(inside), "n_outliers": len(out)}, faces

    def edge_gradient(self, values: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Change of a vertex value along edges, by length."""
        length = np.sqrt(((self.xyz[u] - self.xyz[w]) ** 2).sum(axis=1))
        return np.abs(values[u] - values[w]) / np.maximum(length, 1e-12)

    def winding(self, axis: np.ndarray):
        """Angles around the axis (rows y, x, z) from the first vertex along edges; jumps over 15 degrees."""
        ux, uz = _axis_at(self.xyz[:, 1], axis)
        theta = np.degrees(np.arctan2(self.xyz[:, 2] - uz, self.xyz[:, 0] - ux))
        u, w = self.ends(self.edge_keys)
        u, w = u[u != w], w[u != w]
        turn = np.full(len(theta), np.iinfo(np.int64).min)
        turn[0] = 0
        frontier, near = np.array([0]), Adjacency(len(theta), u, w)
        while len(frontier):
            at, to = near.step(frontier)
            new = turn[to] == np.iinfo(np.int64).min
            order = np.lexsort((frontier[at[new]], to[new]))
            child, first = np.unique(to[new][order], return_index=True)
            parent = frontier[at[new]][order][first]
            jump = theta[child] - theta[parent]
            turn[child] = turn[parent] + np.where(jump > 180, -1, np.where(jump < -180, 1, 0))
            frontier = child
        angle = theta - theta[0] + 360.0 * turn
        ok = (turn[u] != np.iinfo(np.int64).min) & (turn[w] != np.iinfo(np.int64).min)
        if not ok.any():
            return 1.0, {"n_edges": 0.0}, None
        bad = ok & (np.abs(angle[u] - angle[w]) > 15)
        reached = angle[turn != np.iinfo(np.int64).min]
        flagged = np.unique(np.concatenate((u[bad], w[bad])))
        faces = np.flatnonzero(np.isin(self.tri, flagged).any(axis=1)) if bad.any() else None
        return min(1.0, max(0.0, 1 - bad.sum() / ok.sum() / 0.05)), {"n_edges": ok.sum(), "n_flagged": bad.sum(), "range": np.ptp(reached), "mean_gradient": self.edge_gradient(angle, u[ok], w[ok]).mean()}, faces


def _axis_at(y: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piecewise linear between the axis points, extended beyond the ends."""
    axis = axis[np.argsort(axis[:, 0], kind="stable")]
    if len(axis) == 1:
        return np.full(len(y), axis[0, 1]), np.full(len(y), axis[0, 2])
    k = np.clip(np.searchsorted(axis[:, 0], y, "right") - 1, 0, len(axis) - 2)
    lo, hi = axis[k], axis[k + 1]
    t = (y - lo[:, 0]) / np.where(hi[:, 0] == lo[:, 0], 1, hi[:, 0] - lo[:, 0])
    return lo[:, 1] + t * (hi[:, 1] - lo[:, 1]), lo[:, 2] + t * (hi[:, 2] - lo[:, 2])


GEOMETRY = ("triangle_quality", "topology", "normal_consistency", "sheet_switching", "self_intersections", "noise")
#: Name -> function of a ``Segment`` that returns (score, details, places of problem faces or None); ``register`` adds to it.
METRICS = {name: getattr(Segment, name) for name in GEOMETRY}
#: The metric name of rows that report a failure.
ERROR = "error"
_EMPTY = {"triangle_quality": 0.0}


def register(name: str, metric) -> None:
    """Make a metric of one's own known by name; it must be importable on the executors."""
    METRICS[name] = metric


def measure(vertices: DataFrame, faces: DataFrame, metrics: tuple[str, ...] = GEOMETRY, axis: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """metric rows for every segment that has vertices or faces; ``axis``: (y, x, z) rows add winding_angle.

    A segment that raises gives one row of the metric ``error``, with the text.
    """
    rod = np.array(axis, float) if axis is not None else None

    def run(key, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        segment = key[0]
        rows: list[tuple] = []
        try:
            mesh = Segment(v, f) if len(f) and len(v) else None
            steps = [(name, METRICS[name]) for name in metrics] + ([("winding_angle", lambda m: m.winding(rod))] if rod is not None else [])
            for name, metric in steps:
                score, details, faces_ = metric(mesh) if mesh else (_EMPTY.get(name, 1.0), {}, None)
                rows.append((segment, name, float(score), {k: float(x) for k, x in details.items()}, None if faces_ is None else mesh.face_ids[faces_].tolist(), None))
        except Exception as e:  # one bad segment is a row of its own, as the ranking reports it
            rows = [(segment, ERROR, 0.0, {}, None, f"{type(e).__name__}: {e}"[:500])]
        return pd.DataFrame(rows, columns=["segment_id", "metric", "score", "details", "problem_faces", "error"])

    return vertices.groupBy("segment_id").cogroup(faces.groupBy("segment_id")).applyInPandas(run, RESULT)


def deviations(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """segment_id, face_id, deviation: angle between a face's normal and its 8-ring's mean normal."""

    def run(key, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(f):
            return pd.DataFrame({"segment_id": [], "face_id": [], "deviation": []})
        m = Segment(v, f)
        return pd.DataFrame({"segment_id": key[0], "face_id": m.face_ids, "deviation": m.smooth_deviation()})

    return vertices.groupBy("segment_id").cogroup(faces.groupBy("segment_id")).applyInPandas(run, "segment_id long, face_id long, deviation double")


def pinched(faces: DataFrame) -> DataFrame:
    """segment_id, n_pinched, n_vertices: vertices of faces with more than one fan (``graph.vertex_fans``), and all."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        ids, tri = np.unique(f[["v0", "v1", "v2"]].to_numpy(), return_inverse=True)
        fans = vertex_fans(tri.reshape(-1, 3), len(ids))
        return pd.DataFrame({"segment_id": [key[0]], "n_pinched": [int((fans > 1).sum())], "n_vertices": [len(ids)]})

    return faces.groupBy("segment_id").applyInPandas(run, "segment_id long, n_pinched long, n_vertices long")


def neighbours(points: DataFrame, k: int, columns: tuple[str, ...] = ("x", "y", "z"), key: str = "vertex_id") -> DataFrame:
    """segment_id, key, rank, neighbour, d2: k nearest of each point in its segment, self first."""

    def run(group, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values(key)
        ids = v[key].to_numpy()
        idx, dist = nearest(v[list(columns)].to_numpy(float), k)
        n = idx.shape[1]
        return pd.DataFrame({"segment_id": group[0], key: np.repeat(ids, n), "rank": np.tile(np.arange(1, n + 1), len(ids)), "neighbour": ids[idx.ravel()], "d2": dist.ravel()})

    return points.select("segment_id", key, *columns).groupBy("segment_id").applyInPandas(run, f"segment_id long, {key} long, rank int, neighbour long, d2 double")


def find_peaks(y: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Strict local maxima (middle of flat tops) at least ``height``, the highest first within ``distance``."""
    n = len(y)
    if n < 3:
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
    end = np.concatenate((edge[1:], [n])) - 1
    value = y[edge]
    top = np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])) + 1
    peaks = (edge[top] + end[top]) // 2
    peaks = peaks[y[peaks] >= height]
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(y[peaks], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            keep[near] = False
    return peaks[keep]


def peak_rows(y: np.ndarray, height: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """``find_peaks`` of all rows of y at once: (row, place) of the peaks, by row and place."""
    m, n = y.shape
    if n < 3 or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.ones((m, n), bool)
    starts[:, 1:] = y[:, 1:] != y[:, :-1]
    flat = y.ravel()
    edge = np.flatnonzero(starts)
    end = np.append(edge[1:], m * n) - 1
    value = flat[edge]
    top = np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])) + 1
    top = top[(edge[top] % n != 0) & (end[top] % n != n - 1)]
    place = (edge[top] + end[top]) // 2
    place = place[flat[place] >= height[place // n]]
    row, place = place // n, place % n
    order = np.lexsort((-place, -y[row, place], row))  # the highest first, the last of equals
    row, place = row[order], place[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    most = int(nth.max()) + 1 if len(row) else 0
    table = np.full((m, most), -distance - n)
    keep = np.zeros((m, most), bool)
    table[row, nth], keep[row, nth] = place, True
    for k in range(most):
        near = (np.abs(table - table[:, k : k + 1]) < distance) & keep[:, k : k + 1]
        near[:, k] = False
        keep &= ~near
    left = keep[row, nth]
    row, place = row[left], place[left]
    order = np.lexsort((place, row))
    return row[order], place[order]


def layer_scores(profiles: DataFrame, key: str = "sample_id", distance: int = 8) -> DataFrame:
    """key, n_peaks, mean and std of the gaps between peaks; profiles: key, pos, value."""

    def run(group, p: pd.DataFrame) -> pd.DataFrame:
        y = p.sort_values("pos")["value"].to_numpy(float)
        at = find_peaks(y, float(np.median(y)), distance)
        gaps = np.diff(at)
        return pd.DataFrame({key: [group[0]], "n_peaks": [len(at)], "mean_gap": [gaps.mean() if len(gaps) else None], "std_gap": [gaps.std() if len(gaps) else None]})

    return profiles.select(key, "pos", "value").groupBy(key).applyInPandas(run, f"{key} long, n_peaks long, mean_gap double, std_gap double")
