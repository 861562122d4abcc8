"""Exact dedup: owners of equal texts, found in Patricia tries.

Texts are dealt by length and content hash; within a partition they arrive in
the order (length, bytes), and a compressed radix trie over the full byte
strings decides which are equal.  A terminal node stores the owner (the
smallest or the largest identifier) and the number of rows.  Before the
shuffle each task runs a trie of its own over what it reads, so that a text
which a third of all rows hold is sent once a task and not once a row.

Memory: the trie counts the bytes it holds.  Beyond ``TRIE_BYTES`` the map
side sends its terminals on and starts anew; on the reduce side, where keys
come in order, all subtrees left of the path to the last key are complete and
are spilled as result rows, so only that path stays.

Null texts count as empty.  Rows with a null id belong to their group (they
count in ``group_size``) but are never its owner unless no row has an id.  Of
rows that share an id all are kept or none.  Other columns take no part.

Tries tell texts apart by their bytes; rows then find their text's owner by
length-and-content hash of 256 bits (SHA-256), taken for identity in that join
alone.  Very long texts go through whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a trie holds before it spills.
TRIE_BYTES = 24 << 20

_PARTIAL = "_ed_sha string, _ed_length long, _ed_text binary, _ed_owner long, _ed_rows long"
_PARTIAL_SCHEMA = pa.schema([("_ed_sha", pa.string()), ("_ed_length", pa.int64()), ("_ed_text", pa.binary()), ("_ed_owner", pa.int64()), ("_ed_rows", pa.int64())])
_OWNER = "_ed_sha string, _ed_length long, _ed_owner long, _ed_rows long"
_OWNER_SCHEMA = pa.schema([("_ed_sha", pa.string()), ("_ed_length", pa.int64()), ("_ed_owner", pa.int64()), ("_ed_rows", pa.int64())])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by doubling and halving slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    while step > 1:
        step //= 2
        if a[low : low + step] == b[low : low + step]:
            low += step
    return low


class _Node:
    __slots__ = ("children", "label", "owner", "rows", "tag")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.rows = 0
        self.owner: int | None = None
        self.tag: object = None


class PatriciaTrie:
    """A compressed radix trie from byte strings to (owner, rows, tag)."""

    def __init__(self, largest: bool = False):
        self.better = max if largest else min
        self.clear()

    def clear(self) -> None:
        self.root = _Node(b"")
        self.bytes = 0

    def insert(self, key: bytes, owner: int | None, rows: int = 1, tag: object = None) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                leaf = _Node(key[at:])
                node.children[key[at]] = leaf
                self.bytes += len(leaf.label) + 200
                node, at = leaf, len(key)
                break
            shared = _common(child.label, key[at : at + len(child.label)])
            if shared < len(child.label):
                upper = _Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.bytes += 200
                child = upper
            node, at = child, at + shared
        node.rows += rows
        node.tag = tag if node.tag is None else node.tag
        if owner is not None:
            node.owner = owner if node.owner is None else self.better(node.owner, owner)

    def items(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int, object]]:
        """Terminals in the order of their keys."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.rows:
                yield key, node.owner, node.rows, node.tag
            stack.extend((node.children[k], key) for k in sorted(node.children, reverse=True))

    def spill(self, last: bytes) -> Iterator[tuple[bytes, int | None, int, object]]:
        """Take out all subtrees that hold no prefix of ``last``, for keys that come in order."""
        node, prefix = self.root, b""
        while True:
            key = prefix + node.label
            onward = last[len(key)] if len(key) < len(last) else None
            for first in [k for k in node.children if k != onward]:
                yield from self.items(node.children.pop(first), key)
            if onward is None or onward not in node.children:
                break
            node, prefix = node.children[onward], key
        self.bytes = len(last) + 200


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _combine(largest: bool):
    """Map side: one row for each distinct text of what the task reads."""

    def flush(trie: PatriciaTrie) -> pa.RecordBatch:
        found = list(trie.items())
        trie.clear()
        texts, owners, rows, tags = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(texts, pa.binary()), pa.array(owners, pa.int64()), pa.array(rows, pa.int64())], schema=_PARTIAL_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest)
        for batch in batches:
            for doc, sha, text in _rows(batch, "_ed_id", "_ed_sha", "_ed_text"):
                trie.insert(text, doc, 1, sha)
                if trie.bytes > TRIE_BYTES:
                    yield flush(trie)
        if trie.root.rows or trie.root.children:
            yield flush(trie)

    return run


def _own(largest: bool):
    """Reduce side: texts of one length and hash range in order."""

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        texts, owners, rows, tags = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(owners, pa.int64()), pa.array(rows, pa.int64())], schema=_OWNER_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, length = PatriciaTrie(largest), -1
        for batch in batches:
            for text, size, owner, rows, sha in _rows(batch, "_ed_text", "_ed_length", "_ed_owner", "_ed_rows", "_ed_sha"):
                if size != length:  # a trie of its own for each length
                    if found := list(trie.items()):
                        yield rows_of(found)
                    trie.clear()
                    length = size
                trie.insert(text, owner, rows, sha)
                if trie.bytes > TRIE_BYTES and (found := list(trie.spill(text))):
                    yield rows_of(found)
        if found := list(trie.items()):
            yield rows_of(found)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest": the id of each group of equal texts
    that stays.  An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    largest = keep == "largest"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("_ed_id"), F.sha2(text, 256).alias("_ed_sha"), text.cast("binary").alias("_ed_text"))
    partial = keyed.mapInArrow(_combine(largest), _PARTIAL)
    owners = partial.repartition("_ed_length", "_ed_sha").sortWithinPartitions("_ed_length", "_ed_text").mapInArrow(_own(largest), _OWNER)
    members = keyed.select("_ed_id", "_ed_sha")
    joined = members.join(owners, "_ed_sha")
    return joined.select(
        F.col("_ed_id").alias(id_col),
        F.col("_ed_owner").alias("keep_id"),
        F.col("_ed_rows").alias("group_size"),
        F.coalesce(F.col("_ed_id").eqNullSafe(F.col("_ed_owner")), F.lit(False)).alias("kept"),
        F.col("_ed_sha").alias("text_sha256"),
    )


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that own their text; all columns as they are.

    Rows that share the owner's id but hold another text are judged on their
    own text.
    """
    groups = exact_groups(docs, id_col, text_col, keep).filter("kept").select(F.col(id_col).alias("_ed_id"), F.col("text_sha256").alias("_ed_sha")).distinct()
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    named = docs.select("*", F.col(id_col).cast("long").alias("_ed_id"), sha.alias("_ed_sha"))
    on = named["_ed_id"].eqNullSafe(groups["_ed_id"]) & (named["_ed_sha"] == groups["_ed_sha"])
    return named.join(groups, on, "left_semi").drop("_ed_id", "_ed_sha")
