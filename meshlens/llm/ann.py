"""Approximate nearest neighbours by cross-polytope hashing, reranked exactly.

A vector is turned by fast pseudo-random rotations (three rounds of random
signs and a Hadamard transform); its hash is the nearest signed axis.  A table
uses two rotations: the first axis deals the rows out, the second tells the
bucket.  A query probes, in each table, the pairs of axes with the largest sum
of coordinates (multiprobe), takes what lies there as candidates and scores
them exactly, in double precision, on the original vectors.

How many pairs of axes a table probes follows from the rows: for a bounded
sample of queries (``SAMPLE``, the smallest by hash of the id) all rows are
searched, and the probes are as many as find ``recall`` of those neighbours.
The more rows there are, the nearer are the nearest, and the smaller is the
share of the rows that is scored.

Dealt groups (table, first axis) are split by a hash of the id once they hold
more than ``GROUP_ROWS`` rows, and queries go to each part, so that many equal
vectors don't meet in one task.  Queries that found fewer neighbours than
there are to find search all rows in the same blocks; so k are always
returned where k exist.

Left out, as query and candidate: null or zero vectors, null or non-finite
components, lengths other than the commonest among the others (of equally
common ones the longest), null ids.
Rows that share an id are candidates of each other's queries only by other
ids; equal scores go to the smaller id.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

GROUP_ROWS = 4096
#: Queries that the number of probes is fitted on.
SAMPLE = 128


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """Signs of three rounds for each rotation; the padded width is a power of two."""
    width = 1 << max(0, dim - 1).bit_length()
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (count, 3, width))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    n, width = len(x), signs.shape[-1]
    y = np.zeros((n, width))
    y[:, : x.shape[1]] = x
    for round_ in signs:
        y = y * round_
        half = 1
        while half < width:
            z = y.reshape(n, width // (2 * half), 2, half)
            y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), axis=2).reshape(n, width)
            half *= 2
        y = y / np.sqrt(width)
    return y


def _axes(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    y = rotate(x, signs)
    return np.concatenate((y, -y), axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    y = x / scale
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and valid vectors of a batch, in double precision."""
    ids, lists = batch.column("_nn_id"), batch.column("_nn_vector")
    good = [i for i, (d, n) in enumerate(zip(ids.is_valid().to_pylist(), lists.value_lengths().to_pylist())) if d and n == dim]
    if not good:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    flat = lists.take(pa.array(good)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    own = ids.take(pa.array(good)).to_numpy(zero_copy_only=False)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return own[ok], x[ok]


_INDEX = "_nn_table int, _nn_axis int, _nn_fine int, _nn_id long, _nn_body binary"
_INDEX_SCHEMA = pa.schema([("_nn_table", pa.int32()), ("_nn_axis", pa.int32()), ("_nn_fine", pa.int32()), ("_nn_id", pa.int64()), ("_nn_body", pa.binary())])
_PROBE = "_nn_table int, _nn_axis int, _nn_mask binary, _nn_id long, _nn_body binary"
_PROBE_SCHEMA = pa.schema([("_nn_table", pa.int32()), ("_nn_axis", pa.int32()), ("_nn_mask", pa.binary()), ("_nn_id", pa.int64()), ("_nn_body", pa.binary())])


def _bodies(x: np.ndarray, kind: str) -> list[bytes]:
    return [row.tobytes() for row in x.astype(kind)]


def _index(dim: int, tables: int, seed: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = rotations(dim, 2 * tables, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                ids, x = _vectors(batch.slice(at, 2048), dim)
                if not len(ids):
                    continue
                bodies, unit = pa.array(_bodies(x, kind), pa.binary()), _unit(x)
                for t in range(tables):
                    axis, fine = (_axes(unit, signs[2 * t + k]).argmax(axis=1).astype(np.int32) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(axis), pa.array(fine), pa.array(ids), bodies], schema=_INDEX_SCHEMA)

    return run


def _probe(dim: int, tables: int, probes: int, seed: int, kind: str, everything: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = rotations(dim, 2 * tables, seed)
        width = 2 * signs.shape[-1]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, x = _vectors(batch.slice(at, 128), dim)
                if not len(ids):
                    continue
                bodies, unit = _bodies(x, kind), _unit(x)
                for t in range(1 if everything else tables):
                    if everything:
                        hit = np.ones((len(ids), width, width), bool)
                    else:
                        a, b = (_axes(unit, signs[2 * t + k]) for k in (0, 1))
                        sums = (a[:, :, None] + b[:, None, :]).reshape(len(ids), -1)
                        n = min(probes, width * width)
                        best = np.argpartition(-sums, n - 1, axis=1)[:, :n]
                        hit = np.zeros(sums.shape, bool)
                        np.put_along_axis(hit, best, True, axis=1)
                        hit = hit.reshape(len(ids), width, width)
                    row, axis = np.nonzero(hit.any(axis=2))
                    masks = [m.tobytes() for m in np.packbits(hit[row, axis], axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(axis.astype(np.int32)), pa.array(masks, pa.binary()), pa.array(ids[row]), pa.array([bodies[i] for i in row], pa.binary())], schema=_PROBE_SCHEMA)

    return run


_FOUND = "_nn_query long, _nn_id long, _nn_score double"
_FOUND_SCHEMA = pa.schema([("_nn_query", pa.int64()), ("_nn_id", pa.int64()), ("_nn_score", pa.float64())])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b; depends on the two rows alone."""
    p, q = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def _rank(dim: int, k: int, kind: str):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if rows.num_rows and queries.num_rows:
            ids, fine = rows["_nn_id"].to_numpy(), rows["_nn_fine"].to_numpy()
            v = np.frombuffer(b"".join(rows["_nn_body"].to_pylist()), kind).reshape(-1, dim).astype(float)
            unit = _unit(v)
            own = queries["_nn_id"].to_numpy()
            q = np.frombuffer(b"".join(queries["_nn_body"].to_pylist()), kind).reshape(-1, dim).astype(float)
            masks = np.frombuffer(b"".join(queries["_nn_mask"].to_pylist()), np.uint8).reshape(len(own), -1)
            step = max(1, (1 << 20) // len(ids))
            for at in range(0, len(own), step):
                here = slice(at, at + step)
                probed = np.unpackbits(masks[here], axis=1).astype(bool)[:, fine]
                near = np.where(probed & (own[here, None] != ids[None, :]), _unit(q[here]) @ unit.T, -np.inf)
                # all that may be among the k largest, up to rounding; then exact scores
                m = min(k, len(ids))
                bar = np.partition(near, len(ids) - m, axis=1)[:, len(ids) - m]
                i, j = np.nonzero((near >= bar[:, None] - 1e-9) & np.isfinite(near))
                score = cosines(q[here][i], v[j]) if len(i) else np.zeros(0)
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                keep = nth < k
                for col, part in zip(out, (own[here][i[keep]], ids[j[keep]], score[keep])):
                    col.append(part)
        return pa.table([pa.array(np.concatenate(x)) for x in out], schema=_FOUND_SCHEMA)

    return run


def _exact(own: np.ndarray, asked: np.ndarray, dim: int, k: int):
    """The k nearest of each asked vector among a task's rows, with their vectors."""
    schema = pa.schema([("_nn_query", pa.int64()), ("_nn_id", pa.int64()), ("_nn_score", pa.float64()), ("_nn_body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids, body = np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int64), np.zeros((len(own), k, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                here, x = _vectors(batch.slice(at, 4096), dim)
                if not len(here):
                    continue
                near = np.where(own[:, None] == here[None, :], -np.inf, asked @ _unit(x).T)
                all_score, all_ids = np.concatenate((score, near), axis=1), np.concatenate((ids, np.broadcast_to(here, near.shape)), axis=1)
                best = np.lexsort((all_ids, -all_score), axis=1)[:, :k]
                score, ids = (np.take_along_axis(z, best, axis=1) for z in (all_score, all_ids))
                body = np.where((best < k)[:, :, None], np.take_along_axis(body, np.minimum(best, k - 1)[:, :, None], axis=1), x[np.maximum(best - k, 0)])
        i, j = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[i, j]), pa.array(score[i, j]), pa.array([v.tobytes() for v in body[i, j]], pa.binary())], schema=schema)

    return run


def fit_probes(rows: DataFrame, asked: DataFrame, dim: int, k: int, tables: int, seed: int, recall: float) -> int:
    """Pairs of axes to probe in each table, from the nearest neighbours of a sample of queries among all rows."""
    picked = asked.filter(F.size("_nn_vector") == dim).orderBy(F.xxhash64("_nn_id"), "_nn_id").limit(SAMPLE).toArrow()
    parts = [_vectors(b, dim) for b in picked.to_batches()]
    own, x = (np.concatenate(z) for z in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros((0, dim)))
    signs = rotations(dim, 2 * tables, seed)
    width = 2 * signs.shape[-1]
    if not len(own):
        return 1
    unit = _unit(x)
    found = rows.mapInArrow(_exact(own, unit, dim, k), "_nn_query long, _nn_id long, _nn_score double, _nn_body binary")
    best = Window.partitionBy("_nn_query").orderBy(F.col("_nn_score").desc(), "_nn_id")
    near = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("_nn_query", "_nn_body").collect()  # SAMPLE x k rows at most
    if not near:
        return 1
    place = {d: i for i, d in enumerate(own.tolist())}
    at = np.array([place[r["_nn_query"]] for r in near])
    v = _unit(np.frombuffer(b"".join(bytes(r["_nn_body"]) for r in near)).reshape(-1, dim))
    rank = np.full(len(near), width * width)
    for t in range(tables):
        a, b = (_axes(unit, signs[2 * t + i]) for i in (0, 1))
        p, q = (_axes(v, signs[2 * t + i]).argmax(axis=1) for i in (0, 1))
        for n, (i, own_sum) in enumerate(zip(at, a[at, p] + b[at, q])):
            rank[n] = min(rank[n], int((np.add.outer(a[i], b[i]) > own_sum).sum()))
    return min(width * width, int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))))]) + 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 16, probes: int | None = None, recall: float = 0.96, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine of each query.

    ``probes``: pairs of axes that each table probes; fitted to ``recall`` if not given.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("_nn_id"), F.col(vector_col).alias("_nn_vector"))
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    rows, asked = pick(vectors), pick(queries)
    odd = "exists(_nn_vector, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))"
    good = rows.filter(f"_nn_id is not null and not {odd} and exists(_nn_vector, x -> x <> 0)")
    lengths = good.groupBy(F.size("_nn_vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = int(lengths[0]["n"]) if lengths else 0
    spark = vectors.sparkSession
    if dim <= 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probes = probes or fit_probes(rows, asked, dim, k, tables, seed, recall)

    index = rows.mapInArrow(_index(dim, tables, seed, kind), _INDEX)
    # at most tables x axes rows: bounded by parameters
    counts = index.groupBy("_nn_table", "_nn_axis").agg(F.count("*").alias("n"))
    split = F.broadcast(materialize(counts.select("_nn_table", "_nn_axis", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("_nn_parts")), "ann-parts"))
    dealt = index.join(split, ["_nn_table", "_nn_axis"]).withColumn("_nn_part", F.expr("cast(pmod(xxhash64(_nn_id), _nn_parts) as int)")).drop("_nn_parts")
    keys = ["_nn_table", "_nn_axis", "_nn_part"]

    def search(some: DataFrame, everything: bool) -> DataFrame:
        probed = some.mapInArrow(_probe(dim, tables, probes, seed, kind, everything), _PROBE)
        sent = probed.join(split, ["_nn_table", "_nn_axis"]).withColumn("_nn_part", F.explode(F.expr("sequence(0, _nn_parts - 1)"))).drop("_nn_parts")
        return dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_rank(dim, k, kind), _FOUND)

    best = Window.partitionBy("_nn_query").orderBy(F.col("_nn_score").desc(), "_nn_id")
    ranked = lambda found: found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = materialize(ranked(search(asked, False)), "ann-found")
    # Who found fewer than k: all rows, unless the table has no more.
    full = first.groupBy("_nn_query").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = materialize(asked.join(full, F.col("_nn_id") == F.col("_nn_query"), "left_anti"), "ann-short")
    if short.limit(1).count():
        more = ranked(search(short, True))
        first = first.join(short, F.col("_nn_query") == short["_nn_id"], "left_anti").unionByName(more)
    return first.select(F.col("_nn_query").alias("query_id"), "rank", F.col("_nn_id").alias("vec_id"), F.col("_nn_score").alias("score"))
