"""SimHash near-dedup of texts whose shingle sets have a Jaccard similarity of at least a threshold.

A text is the set of its shingles' XXH64 values (seed 42); equal sets are one
node.  Candidates come from two sources and are verified on the whole sets in
integers, so that no pair below the threshold is linked:

* the Golay keys of ``simhash``: nodes whose fingerprints differ in at most two
  bits.  At a similarity of 0.8 two fingerprints differ in about ten bits of 64,
  which no Golay key of three segments reaches;
* so, beyond that reach, minima: nodes that share all ``ROWS`` minhashes of one
  of ``BANDS`` groups.  A pair of similarity s is missed with probability
  (1 - s^ROWS)^BANDS, 1.3e-7 at 0.8 and less above.

A bucket of minima gives all pairs of nodes that are not yet in one component,
if there are at most ``EACH`` for each node.  Larger ones give the pairs with a
few centres and come again with the components found so far.  What is left
after ``COARSE_ROUNDS`` (texts around a large group, or that share a passage but
not the rest) gives no pairs: the bucket's sets, one row for each node, meet in
a task, which compares every node outside of the largest component with all
others at once and returns the links of a forest.  Buckets of more than
``HELD`` nodes get finer keys first (``FINE_ROWS`` of ``FINE_BANDS``, missed as
rarely); if one is as large even then, centres go on, four times as many each
round, until every pair is settled.

Null and wordless texts have the hash of the empty text as their set; texts
with fewer words than a shingle have one shingle; very long texts count whole.
Rows with a null id take part; a component's id is the smallest non-null one in
it.  Rows that share an id get a row each.  Other columns may have any name but
the operator's own (prefixed ``_near_``).  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import components
from .simhash import _keys as golay_keys
from .simhash import _links as golay_links
from .wordhash import mix64

BANDS, ROWS = 52, 6
FINE_BANDS, FINE_ROWS = 230, 12
EACH, CENTRES, COARSE_ROUNDS, HELD = 4, 2, 2, 4096
#: Rows of nodes or links for each file of a written table.
FILE_ROWS = 50_000


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; the bytes are UTF-8."""
    words = text.lower().split()  # bytes: A-Z only
    body = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(body, 42)], np.uint64)
    edges = np.cumsum([0] + [len(w) + 1 for w in words])
    starts, ends = edges[: len(words) - shingle + 1].tolist(), (edges[shingle:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(body[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 42)


def fingerprint_of(own: np.ndarray) -> int:
    """The SimHash fingerprint of a set."""
    ones = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big")


class Minima:
    """Keys of sets: the minima of ``rows`` random orders for each of ``bands`` keys."""

    def __init__(self, bands: int, rows: int, seed: int):
        salts = mix64(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) + np.uint64(seed << 32))
        self.bands, self.rows = bands, rows
        self.xor, self.times = salts[: bands * rows, None], salts[bands * rows :, None] | np.uint64(1)

    def keys(self, own: np.ndarray) -> bytes:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        step = max(1, (1 << 17) // len(least))
        for at in range(0, len(own), step):
            least = np.minimum(least, ((own[None, at : at + step] ^ self.xor) * self.times).min(axis=1))
        out = np.zeros(self.bands, np.uint64)
        for row in least.reshape(self.bands, self.rows).T:
            out = mix64(out + row)
        return mix64(out + np.arange(self.bands, dtype=np.uint64)).tobytes()


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * least.denominator >= (len(a) + len(b) - common) * least.numerator


def _body(value: pa.Scalar) -> bytes:
    return b.to_pybytes() if (b := value.as_buffer()) is not None else b""


def _sketch(shingle: int):
    schema = pa.schema([("_near_id", pa.int64()), ("_near_node", pa.int64()), ("_near_print", pa.int64()), ("_near_keys", pa.binary()), ("_near_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = Minima(BANDS, ROWS, 0)
        for batch in batches:
            own = [shingle_set(_body(x), shingle) for x in batch.column("_near_text")]
            nodes, prints = (pa.array(np.array([f(x) for x in own], np.uint64).view(np.int64)) for f in (node_of, fingerprint_of))
            yield pa.RecordBatch.from_arrays([batch.column("_near_id"), nodes, prints, pa.array([coarse.keys(x) for x in own], pa.binary()), batch.column("_near_text")], schema=schema)

    return run


_MEMBERS = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def _members(nodes: pa.Array, keys: list[bytes]) -> pa.RecordBatch:
    key = np.frombuffer(b"".join(keys), np.int64)
    node = np.repeat(nodes.to_numpy(zero_copy_only=False), len(key) // max(1, len(keys)))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], schema=_MEMBERS)


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _members(batch.column("_near_node"), batch.column("_near_keys").to_pylist())


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minima = Minima(FINE_BANDS, FINE_ROWS, 1)
    for batch in batches:
        yield _members(batch.column("node"), [minima.keys(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column("own")])


def bucket_pairs(node: np.ndarray, label: np.ndarray, turn: int, centres: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a bucket's nodes with different labels, and whether these are all such pairs."""
    n = len(node)
    sizes = np.unique(label, return_counts=True)[1]
    whole = n <= centres or (n * n - int((sizes * sizes).sum())) // 2 <= EACH * n
    # the choice of centres depends on the node and the round alone: buckets of one group agree
    order = np.argsort(mix64(node.view(np.uint64) ^ np.uint64(turn + 1)), kind="stable")
    u, v = [], []
    for i, a in enumerate(order[: n if whole else centres]):
        rest = order[i + 1 :]
        other = rest[label[rest] != label[a]]
        u.append(np.full(len(other), node[a]))
        v.append(node[other])
    return np.concatenate(u), np.concatenate(v), whole


def _pairs(turn: int, centres: int):
    schema = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def batch_of(key: np.ndarray | None, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()) if key is None else pa.array(key), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], schema=schema)

    def solve(key: np.ndarray, node: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets, keys in order: pairs (key null) and the nodes of buckets that come again."""
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(key)])))
        pair = heads[sizes == 2]
        pair = pair[label[pair] != label[pair + 1]]
        yield batch_of(None, node[pair], node[pair + 1])
        for at, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = node[at : at + n]
            u, v, whole = bucket_pairs(own, label[at : at + n], turn, centres)
            yield batch_of(None, u, v)
            if not whole:
                yield batch_of(key[at : at + n], own, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the last bucket may go on

        def flush(parts: list) -> Iterator[pa.RecordBatch]:
            if parts:
                # one batch for many small buckets
                found = pa.Table.from_batches(solve(*(np.concatenate(c) for c in zip(*parts))), schema=schema)
                yield from found.combine_chunks().to_batches(max_chunksize=65536)

        for batch in batches:
            key, node, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "label"))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1][0][0] != key[0]):
                yield from flush([*held, (key[:cut], node[:cut], label[:cut])])
                held = []
            held.append((key[cut:], node[cut:], label[cut:]))
        yield from flush(held)

    return run


def bucket_links(node: np.ndarray, label: np.ndarray, own: list[np.ndarray], least: Fraction) -> list[tuple[int, int]]:
    """Links that connect what similar pairs of a bucket's nodes connect, beyond the labels."""
    n, size = len(node), np.array(list(map(len, own)), np.int64)
    flat = np.concatenate(own)
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], np.repeat(np.arange(n), size)[order]
    root = np.unique(label, return_inverse=True)[1]
    links = []
    for i in np.flatnonzero(root != np.bincount(root).argmax()):
        lo, hi = np.searchsorted(flat, own[i]), np.searchsorted(flat, own[i], "right")
        at = np.repeat(lo, hi - lo) + np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        common = np.bincount(holder[at], minlength=n)
        near = common * least.denominator >= (size + size[i] - common) * least.numerator
        for j in np.flatnonzero(near & (root != root[i])):
            if root[j] != root[i]:
                links.append((int(node[i]), int(node[j])))
                root[root == root[j]] = root[i]
    return links


def _held(least: Fraction):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        key, node, label = (rows[c].to_numpy() for c in ("key", "node", "label"))
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["own"]]
        links = [x for a, b in zip(heads, [*heads[1:], len(key)]) for x in bucket_links(node[a:b], label[a:b], own[a:b], least)]
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last bucket may go on
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1].column("key")[0].as_py() != key[0]):
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _sets(shingle: int):
    schema = pa.schema([("node", pa.int64()), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(_body(x), shingle).tobytes() for x in batch.column("_near_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_near_node"), pa.array(found, pa.binary())], schema=schema)

    return run


def _verified(least: Fraction):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("a", "b"))
            near = pa.array([similar(a, b, least) for a, b in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(near), batch.column("v").filter(near)], schema=schema)

    return run


def _golay_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): nodes of one fingerprint, and a node of each of two fingerprints that the Golay keys link."""
    first = materialize(nodes.groupBy(F.col("_near_print").alias("_sim_print")).agg(F.min("_near_node").alias("_near_first_node")), "near-prints")
    keys = first.select("_sim_print").mapInArrow(golay_keys, "_sim_key long, _sim_print long")
    links = keys.repartition("_sim_key").sortWithinPartitions("_sim_key").mapInArrow(golay_links(2), "u long, v long").distinct()
    ends = [first.select(F.col("_sim_print").alias(c), F.col("_near_first_node").alias(f"{c}_node")) for c in ("u", "v")]
    far = links.join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    near = nodes.join(first, nodes["_near_print"] == first["_sim_print"]).select(F.col("_near_node").alias("u"), F.col("_near_first_node").alias("v"))
    return far.union(near).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def similar_components(docs: DataFrame, shingle: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, component_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("_near_id"), F.col(text_col).cast("string").alias("_near_text"))
    sketch = materialize(rows.mapInArrow(_sketch(shingle), "_near_id long, _near_node long, _near_print long, _near_keys binary, _near_text string"), "near-sketch")
    nodes = materialize(sketch.groupBy("_near_node").agg(F.min("_near_id").alias("_near_first"), F.min("_near_print").alias("_near_print"), F.min("_near_keys").alias("_near_keys")), "near-nodes")
    # files by the rows that they may hold: many small ones cost more than their rows
    files = max(8, -(-nodes.count() // FILE_ROWS))
    written = lambda df, name: materialize(df.coalesce(files), name)
    members = nodes.select("_near_node", "_near_keys").mapInArrow(_coarse, "key long, node long").withColumn("label", F.col("node"))
    found = written(members.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(0, CENTRES), "key long, u long, v long"), "near-pairs")
    golay = written(_golay_pairs(nodes), "near-golay")
    company = found.select("u", "v").union(golay).select(F.explode(F.array("u", "v")).alias("_near_node")).distinct()
    texts = sketch.select("_near_node", "_near_text").join(company, "_near_node", "left_semi").groupBy("_near_node").agg(F.first("_near_text").alias("_near_text"))
    sets = written(texts.mapInArrow(_sets(shingle), "node long, own binary"), "near-sets")  # of all nodes that have a candidate
    labels = sets.select("node", F.col("node").alias("label"))

    def merged(links: DataFrame) -> None:
        """Join the components that links (u, v) connect."""
        nonlocal labels
        ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("u", "v")]
        joins = written(links.join(ends[0], "u").join(ends[1], "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v")).distinct(), "near-links")
        n = joins.count()
        if n:
            roots = components(joins, max(1, -(-n // FILE_ROWS)))
            before, labels = labels, written(labels.join(roots.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "near-labels")
            release(before)
        release(joins)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
        return both.select("u", "v", "a", "b").mapInArrow(_verified(least), "u long, v long")

    merged(verified(found.filter("key is null").select("u", "v").union(golay)))
    turn, centres, fine = 1, CENTRES, False
    while True:
        again = found.filter("key is not null").select("key", F.col("u").alias("node"))
        if again.isEmpty():
            break
        if turn >= COARSE_ROUNDS:
            sizes = again.groupBy("key").agg(F.count("*").alias("n"))
            small = again.join(sizes.filter(F.col("n") <= HELD).select("key"), "key").join(labels, "node").join(sets, "node").select("key", "node", "label", "own")
            merged(small.repartition("key").sortWithinPartitions("key").mapInArrow(_held(least), "u long, v long"))
            again = again.join(sizes.filter(F.col("n") > HELD).select("key"), "key")
            if again.isEmpty():
                break
            if not fine:
                fine = True
                again = again.select("node").distinct().join(sets, "node").select("node", "own").mapInArrow(_fine, "key long, node long")
            else:
                centres *= 4
        spent, found = found, written(again.join(labels, "node").select("key", "node", "label").repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(turn, centres), "key long, u long, v long"), "near-pairs")
        release(spent)
        merged(verified(found.filter("key is null").select("u", "v")))
        turn += 1
    linked = nodes.select("_near_node", "_near_first").join(labels.select(F.col("node").alias("_near_node"), F.col("label").alias("_near_root")), "_near_node", "left").withColumn("_near_root", F.coalesce("_near_root", "_near_node"))
    smallest = linked.groupBy("_near_root").agg(F.min("_near_first").alias("_near_component"))
    component = linked.join(smallest, "_near_root").select("_near_node", "_near_component")
    out = sketch.select("_near_id", "_near_node").join(component, "_near_node")
    return out.select(F.col("_near_id").alias(id_col), F.col("_near_component").alias("component_id"))


def dedup_similar(docs: DataFrame, shingle: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    Rows with a null id stay only if no row of their component has an id.
    """
    found = similar_components(docs, shingle, least, id_col, text_col)
    keep = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_near_id")).distinct()
    named = docs.withColumn("_near_key", F.col(id_col).cast("long"))
    return named.join(keep, named["_near_key"].eqNullSafe(keep["_near_id"]), "left_semi").drop("_near_key")
