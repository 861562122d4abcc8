"""Substring dedup by seed and extend over winnowed anchors.

Every run of ``min_words`` consecutive words (a window) holds exactly one
winnowing choice among its ``min_words - gram + 1`` word grams: the anchor.
The choice depends only on what the window holds, so equal windows share
their anchor and the place of the anchor in them.  Hence

1. *seed*: each document sends its anchors, with the run of window starts
   that each anchor owns, to hash buckets; a bucket tells which anchors occur
   more than once (about one word in six is an anchor);
2. *extend*: where an anchor is repeated, the windows it owns are extended to
   both sides to their full length, and buckets by anchor find for each window
   the earliest start.  Windows are equal if a 128-bit BLAKE2 digest of their
   words' bytes is; the anchors' fast hashes only choose candidates, so texts
   made to collide under them cost time and never a wrong word;
3. every window that isn't the earliest of its kind is covered: overlapping
   windows join, so that a repeat of any length is cut in its maximal extent,
   without the first copy.

Nothing is emitted per pair.  A task sends each distinct anchor or window once
(its own earliest start) and settles the others itself, so that a passage
which a third of all documents hold reaches a bucket once a task.

Rows: null text is an empty document; rows with a null ``doc_id`` take no part,
lose nothing and are not shuffled; rows that share a ``doc_id`` are copies at
one place, none earlier than another (they meet in one task); very long texts
go through whole, in one task each; other columns of the input pass through untouched and
may have any name but the operator's own (prefixed ``_sd_``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, text_bytes
from .wordhash import gram_hashes, mix64, sliding_argmin, word_hashes, word_spans

#: Bytes of text that one numpy pass works on.
PIECE_BYTES = 2 << 20
#: Anchors that a task gathers before it sends them on.
FLUSH = 400_000

#: Bytes of a window's digest.
DIGEST = 16

MESSAGE = "_sd_key int, _sd_kind int, _sd_body binary"
_MESSAGE_SCHEMA = pa.schema([("_sd_key", pa.int32()), ("_sd_kind", pa.int32()), ("_sd_body", pa.binary())])

_ASK, _TOLD = 0, 1
_RUN = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])


def _pack(parts: list[np.ndarray]) -> bytes:
    """Columns one after another: equal bytes meet, so shuffles compress well."""
    return np.array([len(parts[0])], "<u8").tobytes() + b"".join(x.tobytes() for x in parts)


def _unpack(body: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, "<u8", 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _pack_spans(spans: np.ndarray) -> bytes:
    return _pack([spans["doc"], spans["start"], spans["n"]])


def _unpack_spans(body: bytes) -> np.ndarray:
    doc, start, n = _unpack(body, ("<i8", "<u4", "<u4"))
    out = np.empty(len(doc), _SPAN)
    out["doc"], out["start"], out["n"] = doc, start, n
    return out


def _spans(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Runs of consecutive starts, from distinct (doc, start) in any order."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return np.empty(0, _SPAN)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)))
    at = np.flatnonzero(new)
    out = np.empty(len(at), _SPAN)
    out["doc"], out["start"] = doc[at], start[at]
    out["n"] = np.diff(np.concatenate((at, [len(doc)])))
    return out


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    keys, kinds, bodies = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(kinds, pa.int32()), pa.array(bodies, pa.binary())], schema=_MESSAGE_SCHEMA)


def _text_pieces(batch: pa.RecordBatch, ids: str, text: str) -> Iterator[tuple[list[int], list[bytes]]]:
    """Documents of a batch in pieces of about PIECE_BYTES; null ids are left out."""
    docs: list[int] = []
    texts: list[bytes] = []
    size = 0
    for doc, value in zip(batch.column(ids), batch.column(text)):
        if (key := doc.as_py()) is None:
            continue
        body = value.as_buffer()
        docs.append(key)
        texts.append(body.to_pybytes() if body is not None else b"")
        size += len(texts[-1]) + 1
        if size >= PIECE_BYTES:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of joined texts, and where each text's words begin."""
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_spans(buf)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    return word_hashes(buf, starts, ends, 0), np.searchsorted(starts, edges)


def _runs(docs: np.ndarray, hashes: np.ndarray, first: np.ndarray, size: int, gram: int) -> np.ndarray:
    """The anchors of texts with the run of window starts that each owns."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, _RUN)
    grams = gram_hashes(hashes, gram, 0)
    chosen = sliding_argmin(grams, size - gram + 1)
    owner = np.repeat(np.arange(len(docs)), np.diff(first))
    inside = np.flatnonzero(owner[:n] == owner[size - 1 :])
    if not len(inside):
        return np.empty(0, _RUN)
    at, doc = chosen[inside], owner[inside]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
    head = np.flatnonzero(new)
    out = np.empty(len(head), _RUN)
    out["anchor"] = grams[at[head]]
    out["doc"] = docs[doc[head]]
    out["start"] = inside[head] - first[doc[head]]
    out["n"] = np.diff(np.concatenate((head, [len(inside)])))
    return out


def _by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else []
    for a, b in zip(heads, [*heads[1:], len(ranked)]):
        yield int(ranked[a]), order[a:b]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _doc_key(doc: np.ndarray, parts: int) -> np.ndarray:
    """As the SQL expression ``pmod(xxhash64(doc_id), parts)``: XXH64 of eight bytes, seed 42."""
    x = np.full(len(doc), np.uint64(50) + _P5) ^ _rotated(doc.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
    x = _rotated(x, 27) * _P1 + _P4
    x = (x ^ x >> np.uint64(33)) * _P2
    x = (x ^ x >> np.uint64(29)) * _P3
    return np.mod((x ^ x >> np.uint64(32)).view(np.int64), parts)


def _seed(size: int, gram: int, buckets: int, parts: int):
    def send(runs: np.ndarray) -> pa.RecordBatch:
        if not len(runs):
            return _batch([])
        order = np.lexsort((runs["start"], runs["doc"], runs["anchor"]))
        runs = runs[order]
        same = runs["anchor"][1:] == runs["anchor"][:-1]
        again = np.concatenate(([False], same))
        shared = again | np.concatenate((same, [False]))
        rows = []
        told = runs[shared]
        for key, at in _by_key(_doc_key(told["doc"], parts)):
            rows.append((key % buckets, _TOLD, np.array([key], "<i4").tobytes() + _pack_spans(told[["doc", "start", "n"]][at])))
        # Of a repeated anchor the first alone goes to the bucket, so that other tasks learn of it.
        ask, done = runs[~again], shared[~again]
        for key, at in _by_key((mix64(ask["anchor"]) % np.uint64(buckets)).astype(np.int64)):
            part = ask[at]
            rows.append((key, _ASK, _pack([part["anchor"], part["doc"], part["start"], part["n"].astype("<u2"), done[at].astype("u1")])))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for docs, texts in _text_pieces(batch, "_sd_id", "_sd_text"):
                hashes, first = _words_of(texts)
                held.append(_runs(np.array(docs, np.int64), hashes, first, size, gram))
                if sum(map(len, held)) >= FLUSH:
                    yield send(np.concatenate(held))
                    held = []
        if held:
            yield send(np.concatenate(held))

    return run


def _repeated(parts: int):
    """In a bucket: which anchors occur more than once."""

    def run(messages: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        asks = []
        for kind, body in zip(messages["_sd_kind"].to_pylist(), messages["_sd_body"].to_pylist()):
            if kind == _TOLD:
                rows.append((int(np.frombuffer(body, "<i4", 1)[0]), _TOLD, body[4:]))
            else:
                asks.append(_unpack(body, ("<u8", "<i8", "<u4", "<u2", "u1")))
        if asks:
            anchor, doc, start, n, done = (np.concatenate(x) for x in zip(*asks))
            order = np.argsort(anchor, kind="stable")
            ranked = anchor[order]
            same = ranked[1:] == ranked[:-1]
            hit = order[(np.concatenate(([False], same)) | np.concatenate((same, [False]))) & (done[order] == 0)]
            spans = np.empty(len(hit), _SPAN)
            spans["doc"], spans["start"], spans["n"] = doc[hit], start[hit], n[hit]
            for key, at in _by_key(_doc_key(spans["doc"], parts)):
                rows.append((key, _TOLD, _pack_spans(spans[at])))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    shift = start.astype(np.int64) - np.concatenate(([0], np.cumsum(n[:-1].astype(np.int64))))
    return out + np.repeat(shift, n)


def _same(*keys: np.ndarray) -> np.ndarray:
    """Which rows have the keys of the row before."""
    out = np.ones(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        out &= k[1:] == k[:-1]
    return np.concatenate((np.zeros(min(1, len(keys[0])), bool), out))


def _extend(size: int, gram: int, buckets: int, parts: int):
    """Hash the windows that repeated anchors own; a group of documents with its seeds."""

    def windows(docs: list[int], texts: list[bytes], seeds: np.ndarray) -> list[np.ndarray]:
        buf = b" ".join([b" ".join(t.split()) for t in texts])  # one space between words: equal windows have equal bytes
        raw = np.frombuffer(buf, np.uint8)
        begin, end = word_spans(raw)
        edges = np.cumsum([0] + [len(t.split()) for t in texts])
        hashes, first = word_hashes(raw, begin, end, 0), edges
        ids = np.array(docs, np.int64)
        if len(hashes) < size:
            return []
        order = np.argsort(ids, kind="stable")
        lo, hi = np.searchsorted(ids[order], seeds["doc"]), np.searchsorted(ids[order], seeds["doc"], "right")
        out = []
        for copy in range(int((hi - lo).max(initial=0))):  # rows that share a doc_id
            have = lo + copy < hi
            part = seeds[have]
            row = order[(lo + copy)[have]]
            start = _ranges(part["start"], part["n"])
            row = np.repeat(row, part["n"])
            inside = start + size <= first[row + 1] - first[row]
            row, start = row[inside], start[inside]
            out.append((ids[row], start, first[row] + start))
        if not out:
            return []
        doc, start, at = (np.concatenate(x) for x in zip(*out))
        grams = gram_hashes(hashes, gram, 0)
        anchor = grams[sliding_argmin(grams, size - gram + 1)[at]]
        made = b"".join([blake2b(buf[a:b], digest_size=DIGEST).digest() for a, b in zip(begin[at].tolist(), end[at + size - 1].tolist())])
        window = np.frombuffer(made, "<u8").reshape(-1, 2)
        return [anchor, window[:, 0], window[:, 1], doc, start.astype("<u4")]

    def run(docs: pa.Table, seeds: pa.Table) -> pa.Table:
        bodies = seeds["_sd_body"].to_pylist()
        if not bodies or not docs.num_rows:
            return pa.Table.from_batches([_batch([])])
        spans = np.unique(np.concatenate([_unpack_spans(x) for x in bodies]))
        found = []
        for batch in docs.to_batches():
            for ids, texts in _text_pieces(batch, "_sd_id", "_sd_text"):
                seeded = np.isin(np.array(ids, np.int64), spans["doc"]).tolist()
                ids, texts = [i for i, x in zip(ids, seeded) if x], [t for t, x in zip(texts, seeded) if x]
                own = np.unique(np.array(ids, np.int64))
                lo, hi = np.searchsorted(spans["doc"], own), np.searchsorted(spans["doc"], own, "right")
                if part := windows(ids, texts, spans[_ranges(lo, hi - lo)]):
                    found.append(part)
        if not found:
            return pa.Table.from_batches([_batch([])])
        anchor, high, low, doc, start = (np.concatenate(x) for x in zip(*found))
        del found
        order = np.lexsort((start, doc, low, high, anchor))
        anchor, high, low, doc, start = (x[order] for x in (anchor, high, low, doc, start))
        again = _same(anchor, high, low)
        # Another start of the same window in this group comes earlier: settled, wherever else it occurs.
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
        later = again & ((doc != doc[head]) | (start != start[head]))
        rows = []
        told = _spans(doc[later], start[later])
        for key, at in _by_key(_doc_key(told["doc"], parts)):
            rows.append((key % buckets, _TOLD, np.array([key], "<i4").tobytes() + _pack_spans(told[at])))
        anchor, high, low, doc, start = (x[~again] for x in (anchor, high, low, doc, start))
        # In the order of the text, windows of one anchor are neighbours: runs.
        order = np.lexsort((start, doc))
        anchor, high, low, doc, start = (x[order] for x in (anchor, high, low, doc, start))
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)))
        at = np.flatnonzero(new)
        n = np.diff(np.concatenate((at, [len(new)])))
        for key, own in _by_key((mix64(anchor[at]) % np.uint64(buckets)).astype(np.int64)):
            heads, counts = at[own], n[own]
            inside = _ranges(heads, counts)
            body = _pack([anchor[heads], doc[heads], start[heads], counts.astype("<u2")])
            rows.append((key, _ASK, body + high[inside].tobytes() + low[inside].tobytes()))
        return pa.Table.from_batches([_batch(rows)])

    return lambda docs, seeds: run(docs, seeds)


def _earliest(parts: int):
    """In a bucket: of each window, all starts but the earliest."""

    def run(messages: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        found = []
        for kind, body in zip(messages["_sd_kind"].to_pylist(), messages["_sd_body"].to_pylist()):
            if kind == _TOLD:
                rows.append((int(np.frombuffer(body, "<i4", 1)[0]), _TOLD, body[4:]))
                continue
            anchor, doc, start, n = _unpack(body, ("<u8", "<i8", "<u4", "<u2"))
            high, low = np.frombuffer(body, "<u8", -1, 8 + len(anchor) * 22).reshape(2, -1)
            found.append((np.repeat(anchor, n), high, low, np.repeat(doc, n), _ranges(start, n).astype("<u4")))
        if found:
            anchor, high, low, doc, start = (np.concatenate(x) for x in zip(*found))
            del found
            order = np.lexsort((start, doc, low, high, anchor))
            again = order[_same(anchor[order], high[order], low[order])]
            told = _spans(doc[again], start[again])
            for key, at in _by_key(_doc_key(told["doc"], parts)):
                rows.append((key, _TOLD, _pack_spans(told[at])))
        return pa.Table.from_batches([_batch(rows)])

    return run


_RESULT = "_sd_id long, _sd_words long, _sd_removed long, _sd_kept binary"
_RESULT_SCHEMA = pa.schema([("_sd_id", pa.int64()), ("_sd_words", pa.int64()), ("_sd_removed", pa.int64()), ("_sd_kept", pa.binary())])


def _cut(size: int, digest: bool):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        bodies = told["_sd_body"].to_pylist()
        spans = np.concatenate([_unpack_spans(x) for x in bodies]) if bodies else np.empty(0, _SPAN)
        spans = spans[np.argsort(spans["doc"], kind="stable")]
        ids, words, removed, kept = [], [], [], []
        for doc, value in zip(docs["_sd_id"], docs["_sd_text"]):
            body = value.as_buffer()
            own = body.to_pybytes().split() if body is not None else []
            key = doc.as_py()
            gone = 0
            if key is not None:
                mine = spans[np.searchsorted(spans["doc"], key) : np.searchsorted(spans["doc"], key, "right")]
                if len(mine):
                    depth = np.zeros(len(own) + 1, np.int64)
                    np.add.at(depth, np.minimum(mine["start"], len(own)), 1)
                    np.add.at(depth, np.minimum(mine["start"].astype(np.int64) + mine["n"] + size - 1, len(own)), -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    gone = len(own) - int(stay.sum())
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], stay, [False]))))
                    left = [own[a:b] for a, b in zip(edges[::2], edges[1::2])]
                    count, own = len(own), [w for run in left for w in run]
                else:
                    count = len(own)
            else:
                count = len(own)
            text = b" ".join(own)
            ids.append(key)
            words.append(count)
            removed.append(gone)
            kept.append(hashlib.sha256(text).hexdigest().encode() if digest else text)
        return pa.table([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], schema=_RESULT_SCHEMA)

    return run


def _whole(digest: bool):
    """Rows that lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, none = _cut(1, digest), pa.table({"_sd_body": pa.array([], pa.binary())})
        for batch in batches:
            yield from cut(pa.Table.from_batches([batch]), none).to_batches()

    return run


def remove_repeats(docs: DataFrame, min_words: int = 20, gram: int = 10, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Cut from each document the words that repeat an earlier passage.

    A word goes if a window of ``min_words`` words that covers it also starts
    earlier: in a document with a smaller id, or earlier in the same one.
    Returns ``id_col``, ``n_words``, ``n_removed`` and ``kept_text`` (words
    joined by one space) or, with ``digest``, its SHA-256 as ``kept_sha256``.
    Empty input gives an empty result; documents shorter than ``min_words``
    lose nothing.
    """
    if not 1 <= gram <= min_words:
        raise ValueError("gram must be from 1 to min_words")
    rows = docs.select(F.col(id_col).cast("long").alias("_sd_id"), F.col(text_col).cast("string").alias("_sd_text"))
    total = text_bytes(rows, "_sd_text")
    buckets, parts = parts_for(total, 16 << 20), parts_for(total, 12 << 20)
    nameless = rows.filter("_sd_id is null").mapInArrow(_whole(digest), _RESULT)
    rows = rows.filter("_sd_id is not null")
    keyed = rows.withColumn("_sd_key", F.expr(f"cast(pmod(xxhash64(_sd_id), {parts}) as int)"))

    seeds = rows.mapInArrow(_seed(min_words, gram, buckets, parts), MESSAGE)
    repeated = seeds.groupBy("_sd_key").applyInArrow(_repeated(parts), MESSAGE)
    windows = keyed.groupBy("_sd_key").cogroup(repeated.groupBy("_sd_key")).applyInArrow(_extend(min_words, gram, buckets, parts), MESSAGE)
    told = windows.groupBy("_sd_key").applyInArrow(_earliest(parts), MESSAGE)
    cut = keyed.groupBy("_sd_key").cogroup(told.groupBy("_sd_key")).applyInArrow(_cut(min_words, digest), _RESULT)
    return cut.unionByName(nameless).select(
        F.col("_sd_id").alias(id_col),
        F.col("_sd_words").alias("n_words"),
        F.col("_sd_removed").alias("n_removed"),
        F.col("_sd_kept").cast("string").alias("kept_sha256" if digest else "kept_text"),
    )
