"""Vertices and triangles in PLY (ASCII, binary) and STL (ASCII, binary) files."""

from __future__ import annotations

import numpy as np

_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def _fans(polygons: list) -> np.ndarray:
    return np.array([(p[0], p[k], p[k + 1]) for p in polygons for k in range(1, len(p) - 1)], np.int64).reshape(-1, 3)


def parse_ply(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    head, _, rest = body.partition(b"end_header")
    rest = rest[rest.index(b"\n") + 1 :]
    kind, elements = "ascii", []
    for words in (line.split() for line in head.decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    order = ">" if kind == "binary_big_endian" else "<"
    xyz, polygons, at = np.zeros((0, 3)), [], 0
    lines = iter(rest.split(b"\n")) if kind == "ascii" else None
    for name, count, properties in elements:
        lists = any(p[0] == "list" for p in properties)
        if lines is not None:
            rows = [next(lines).split() for _ in range(count)]
            if name == "vertex":
                names = [p[-1] for p in properties]
                xyz = np.array([[float(r[names.index(c)]) for c in "xyz"] for r in rows]).reshape(-1, 3)
            elif name == "face":
                polygons = [[int(x) for x in r[1 : 1 + int(r[0])]] for r in rows]
        elif not lists:
            kinds = np.dtype([(p[-1], order + _TYPES[p[0]]) for p in properties])
            table = np.frombuffer(rest, kinds, count, at)
            at += kinds.itemsize * count
            if name == "vertex":
                xyz = np.stack([table[c].astype(float) for c in "xyz"], axis=1)
        else:
            for _ in range(count):
                for p in properties:
                    if p[0] != "list":
                        at += np.dtype(_TYPES[p[0]]).itemsize
                        continue
                    size, item = np.dtype(order + _TYPES[p[1]]), np.dtype(order + _TYPES[p[2]])
                    n = int(np.frombuffer(rest, size, 1, at)[0])
                    at += size.itemsize
                    if name == "face" and p[-1] in ("vertex_indices", "vertex_index"):
                        polygons.append(np.frombuffer(rest, item, n, at).tolist())
                    at += item.itemsize * n
    return xyz, _fans(polygons)


def parse_stl(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Corners at the same place become one vertex, in the order of their first use."""
    count = int.from_bytes(body[80:84], "little") if len(body) >= 84 else -1
    if count >= 0 and len(body) == 84 + 50 * count:
        kinds = np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")])
        corners = np.frombuffer(body, kinds, count, 84)["p"].reshape(-1, 3).astype(float)
    else:
        words = (line.split() for line in body.decode("ascii", "replace").splitlines())
        corners = np.array([[float(x) for x in w[1:4]] for w in words if w[:1] == ["vertex"]]).reshape(-1, 3)
    _, first, inverse = np.unique(corners, axis=0, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return corners[np.sort(first)], rank[inverse.reshape(-1)].reshape(-1, 3)
