"""SimHash near-dedup by Golay-code fuzzy hashing.

A document's fingerprint has a bit set where over half of its shingles' XXH64
values (seed 42) have it set.  Two fingerprints are linked if they differ in at
most two bits.  Links are found without comparing all pairs:

* the 64 bits are cut into segments of 22, 21 and 21.  Two errors leave, for
  one of three ordered choices (exact segment, fuzzy segment), the exact one
  untouched and the fuzzy one with at most one error (pigeonhole);
* the fuzzy segment is decoded by the perfect binary (23, 12) Golay code.  Its
  nearest codeword and, where it lies three bits off, the five codewords four
  bits off give its keys; words one bit apart always have a key in common;
* fingerprints meet under (choice, exact segment, codeword index) and are
  verified.  In a bucket only a spanning forest of the links is kept, and
  large buckets are linked by masking every pair of free bits, which takes
  n log n steps for each mask and never lists pairs.

Equal fingerprints are one node, so copies cost nothing.  Components come from
``components``; all stays distributed.

Texts: null and wordless texts have the fingerprint zero, which links like any
other; texts with fewer words than a shingle hash as one.  Rows with a null id
take part; a component's id is the smallest non-null one in it.  Rows that
share an id get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

#: Fixed value: the generator polynomial of the binary (23, 12) Golay code.
GOLAY_POLYNOMIAL = 0xC75
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Ordered choices (exact, fuzzy) that cover every spread of two errors.
CHOICES = ((0, 1), (1, 2), (2, 0))
#: Buckets with more distinct fingerprints are linked by masks.
LARGE = 192


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    for bit in range(22, 10, -1):
        x = np.where(x >> np.uint32(bit) & np.uint32(1), x ^ np.uint32(GOLAY_POLYNOMIAL << (bit - 11)), x)
    return x


class Golay:
    """Decoding tables, built from the polynomial."""

    def __init__(self):
        bits = np.uint32(1) << np.arange(23, dtype=np.uint32)
        errors = [np.zeros(1, np.uint32), bits]
        a, b = np.triu_indices(23, 1)
        errors.append(bits[a] | bits[b])
        i, j, k = (x.ravel() for x in np.indices((23, 23, 23)))
        own = (i < j) & (j < k)
        errors.append(bits[i[own]] | bits[j[own]] | bits[k[own]])
        flat = np.concatenate(errors)
        self.error = np.zeros(2048, np.uint32)
        self.error[_remainder(flat)] = flat  # perfect: each syndrome once
        messages = np.arange(4096, dtype=np.uint32) << np.uint32(11)
        words = messages | _remainder(messages)
        sevens = words[np.bitwise_count(words) == 7]
        self.offsets = np.zeros((2048, 6), np.uint32)  # codeword indices to xor
        self.count = np.ones(2048, np.int64)
        for syndrome in np.flatnonzero(np.bitwise_count(self.error) == 3):
            e = self.error[syndrome]
            near = sevens[(sevens & e) == e]
            self.offsets[syndrome, 1 : 1 + len(near)] = near >> np.uint32(11)
            self.count[syndrome] += len(near)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the word, codeword index) for each of its keys."""
        syndrome = _remainder(words)
        index = (words ^ self.error[syndrome]) >> np.uint32(11)
        count = self.count[syndrome]
        row = np.repeat(np.arange(len(words)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return row, index[row] ^ self.offsets[syndrome[row], nth]


def bucket_keys(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit bucket key of every fingerprint's keys."""
    rows, keys = [], []
    for choice, (exact, fuzzy) in enumerate(CHOICES):
        part = [(prints >> np.uint64(s)) & np.uint64((1 << n) - 1) for s, n in (SEGMENTS[exact], SEGMENTS[fuzzy])]
        row, index = golay.keys(part[1].astype(np.uint32))
        rows.append(row)
        keys.append((np.uint64(choice) << np.uint64(34)) | (part[0][row] << np.uint64(12)) | index.astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text; the bytes are UTF-8."""
    words = text.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(body, 42)
    edges = np.cumsum([0] + [len(w) + 1 for w in words])
    starts, ends = edges[: len(words) - shingle + 1].tolist(), (edges[shingle:] - 1).tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), 65536):
        raw = b"".join([digest(body[a:b], 42) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _prints(shingle: int):
    schema = pa.schema([("_sim_id", pa.int64()), ("_sim_print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("_sim_text"):
                body = value.as_buffer()
                out.append(fingerprint(body.to_pybytes() if body is not None else b"", shingle))
            yield pa.RecordBatch.from_arrays([batch.column("_sim_id"), pa.array(np.array(out, np.uint64).view(np.int64))], schema=schema)

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    schema = pa.schema([("_sim_key", pa.int64()), ("_sim_print", pa.int64())])
    for batch in batches:
        prints = batch.column("_sim_print").to_numpy(zero_copy_only=False).view(np.uint64)
        row, key = bucket_keys(prints, golay)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(prints[row].view(np.int64))], schema=schema)


def _forest(prints: np.ndarray, free: int, bits: int) -> list[tuple[int, int]]:
    """Edges that connect what chains of links connect among distinct fingerprints."""
    n = len(prints)
    if n <= LARGE:
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
        root, edges = list(range(n)), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(*np.nonzero(np.triu(near, 1))):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                edges.append((prints[a], prints[b]))
        return edges
    # Fingerprints that agree outside of ``bits`` free bits are links of each other.
    places = [np.uint64(1 << b) for b in range(64) if free >> b & 1]
    masks = [a | b for i, a in enumerate(places) for b in places[i + 1 :]] if bits == 2 else places[:] if bits == 1 else [np.uint64(0)]
    label = np.arange(n)
    while True:
        before = label.copy()
        for mask in masks:
            kept = prints & ~mask
            order = np.argsort(kept, kind="stable")
            ranked = kept[order]
            new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
            if new.all():
                continue
            group = np.cumsum(new) - 1
            least = np.minimum.reduceat(label[order], np.flatnonzero(new))
            label[order] = least[group]
        label = label[label]
        if (label == before).all():
            break
    return [(prints[i], prints[r]) for i, r in enumerate(label) if i != r]


def _links(bits: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def solve(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        """Whole buckets, keys in order."""
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(key)])))
        pair = heads[sizes == 2]
        near = np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= bits
        u, v = [prints[pair][near]], [prints[pair + 1][near]]
        for at, n in zip(heads[sizes > 2], sizes[sizes > 2]):
            exact = CHOICES[int(key[at]) >> 34][0]
            shift, width = SEGMENTS[exact]
            edges = _forest(np.unique(prints[at : at + n]), ~(((1 << width) - 1) << shift) & (1 << 64) - 1, bits)
            if edges:
                a, b = zip(*edges)
                u.append(np.array(a, np.uint64))
                v.append(np.array(b, np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last bucket may go on
        for batch in batches:
            key = batch.column("_sim_key").to_numpy(zero_copy_only=False)
            prints = batch.column("_sim_print").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1][0][0] != key[0]):
                held.append((key[:cut], prints[:cut]))
                full = [x for x in held if len(x[0])]
                if full:
                    yield solve(np.concatenate([x[0] for x in full]), np.concatenate([x[1] for x in full]))
                held = []
            held.append((key[cut:], prints[cut:]))
        if held:
            yield solve(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

    return run


def simhash_components(docs: DataFrame, shingle: int = 5, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id."""
    if not 0 <= bits <= 2:
        raise ValueError("the Golay keys cover up to two differing bits")
    rows = docs.select(F.col(id_col).cast("long").alias("_sim_id"), F.col(text_col).cast("string").alias("_sim_text"))
    prints = materialize(rows.mapInArrow(_prints(shingle), "_sim_id long, _sim_print long"), "simhash-prints")
    nodes = materialize(prints.groupBy("_sim_print").agg(F.min("_sim_id").alias("_sim_first")), "simhash-nodes")
    keys = nodes.select("_sim_print").mapInArrow(_keys, "_sim_key long, _sim_print long")
    links = keys.repartition("_sim_key").sortWithinPartitions("_sim_key").mapInArrow(_links(bits), "u long, v long")
    links = materialize(links, "simhash-links")
    roots = components(links, max(8, -(-links.count() // 50_000))).withColumnRenamed("node", "_sim_print").withColumnRenamed("root", "_sim_root")
    linked = nodes.join(roots, "_sim_print", "left").withColumn("_sim_root", F.coalesce("_sim_root", "_sim_print"))
    least = linked.groupBy("_sim_root").agg(F.min("_sim_first").alias("_sim_component"))
    component = linked.join(least, "_sim_root").select("_sim_print", "_sim_component")
    out = prints.join(component, "_sim_print")
    return out.select(F.col("_sim_id").alias(id_col), F.lower(F.lpad(F.hex("_sim_print"), 16, "0")).alias("fingerprint"), F.col("_sim_component").alias("component_id"))


def dedup_similar(docs: DataFrame, shingle: int = 5, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    Rows with a null id stay only if no row of their component has an id.
    """
    found = simhash_components(docs, shingle, bits, id_col, text_col)
    keep = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_sim_id")).distinct()
    named = docs.withColumn("_sim_key", F.col(id_col).cast("long"))
    return named.join(keep, named["_sim_key"].eqNullSafe(keep["_sim_id"]), "left_semi").drop("_sim_key")
