"""Triangle against triangle, for arrays of pairs: interval test, with separating axes where coplanar."""

from __future__ import annotations

import numpy as np

EPS = 1e-8


def _intervals(p: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extent, along the planes' common line, of each triangle's cut: projections p and signed distances d, (n, 3)."""
    low, high = np.full(len(p), np.inf), np.full(len(p), -np.inf)
    for i, j in ((0, 1), (1, 2), (2, 0)):
        gap = d[:, i] - d[:, j]
        meets = d[:, i] * d[:, j] <= 0
        t = np.where(np.abs(gap) > 1e-12, d[:, i] / np.where(np.abs(gap) > 1e-12, gap, 1), 0)
        at = p[:, i] + t * (p[:, j] - p[:, i])
        low, high = np.where(meets, np.minimum(low, at), low), np.where(meets, np.maximum(high, at), high)
    for i in range(3):
        on = np.abs(d[:, i]) < EPS
        low, high = np.where(on, np.minimum(low, p[:, i]), low), np.where(on, np.maximum(high, p[:, i]), high)
    return low, high


def _coplanar(a: np.ndarray, b: np.ndarray, normal: np.ndarray) -> np.ndarray:
    drop = np.abs(normal).argmax(axis=1)
    keep = np.array([[1, 2], [0, 2], [0, 1]])[drop]
    a, b = (np.take_along_axis(x, keep[:, None, :], axis=2) for x in (a, b))
    apart = np.zeros(len(a), bool)
    for shape in (a, b):
        for i in range(3):
            edge = shape[:, (i + 1) % 3] - shape[:, i]
            axis = np.stack((-edge[:, 1], edge[:, 0]), axis=1)
            pa, pb = (np.einsum("nij,nj->ni", x, axis) for x in (a, b))
            split = (pa.max(axis=1) <= pb.min(axis=1)) | (pb.max(axis=1) <= pa.min(axis=1))
            apart |= split & ((axis * axis).sum(axis=1) >= 1e-12)
    return ~apart


def intersect(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether triangles a[k] and b[k], (n, 3, 3), cut through each other; touching alone doesn't count."""
    na, nb = (np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]) for x in (a, b))
    db = np.einsum("nij,nj->ni", b - a[:, :1], na)
    da = np.einsum("nij,nj->ni", a - b[:, :1], nb)
    out = np.ones(len(a), bool)
    for d in (da, db):
        out &= ~((d > EPS).all(axis=1) | (d < -EPS).all(axis=1))
    flat = (np.abs(db) < EPS).all(axis=1)
    line = np.cross(na, nb)
    axis = np.abs(line).argmax(axis=1)[:, None, None]
    pa, pb = (np.take_along_axis(x, axis, axis=2)[:, :, 0] for x in (a, b))
    (la, ha), (lb, hb) = _intervals(pa, da), _intervals(pb, db)
    cut = (la < hb) & (lb < ha)
    at = np.flatnonzero(out & flat)
    if len(at):
        cut[at] = _coplanar(a[at], b[at], na[at])
    return out & cut
