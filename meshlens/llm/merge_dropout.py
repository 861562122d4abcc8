"""SentencePiece encoding with seeded merge-dropout, and decoding.

Byte-pair merges run from an agenda, best score first and leftmost among
equals.  Each candidate merge that comes up is skipped with probability
``dropout``, by a hash keyed with the seed, the document's id, the unit's place
in the text and the candidate's place in the order in which they come up.  A
skipped candidate stays skipped; its symbols may still merge with others.  So
every occurrence of a word draws for itself, each reproducible from the seed,
and all segmentations decode to the same text.  Without dropout the result is
the library's own.

Texts are cut into units between any two characters that no piece of the
vocabulary has side by side (letters and commas, say, or the space that begins
a word and what stands before it), as no merge can span these.  A unit's result
depends on which of its candidates are skipped alone, so units are nodes of a
tree: the unit without skips, and below each node one child for each candidate
that may be skipped next.  An occurrence goes down by its own draws until no
skip is left; nodes are merged in batches when first reached and kept while
memory lasts.  Nothing bounds the number of segmentations that a unit can
have.  Long units have no nodes: each occurrence runs through a heap.

Characters outside of the vocabulary are written as byte pieces; so is a
literal U+2581, which would otherwise come back as a space.  Null and empty
texts have no tokens.  Rows with a null or repeated id are encoded like any
other (null draws as id 0; equal texts of one id draw alike).  Texts without a
space are one unit, of n log n steps.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix64

_NEVER = np.int32(1 << 23)
#: Nodes that a worker keeps before it starts anew.
MEMO_NODES = 700_000
#: Characters of a unit above which a heap takes the place of the batch.
LONG = 128
#: Units that are merged at once: their arrays stay in the cache.
CHUNK = 8192
_NO_SKIP = np.iinfo(np.int32).max


def gap_table(dropout: float) -> np.ndarray:
    """Ascending thresholds on a 64-bit draw: how many of them lie at or below it is the number of candidates taken before the next skip.

    A draw falls below dropout * 2**64 with probability ``dropout`` (no candidate
    is taken first), and so on: the geometric distribution of independent skips.
    """
    if dropout and not 0.001 <= dropout <= 0.999:
        raise ValueError("dropout must be 0 or from 0.001 to 0.999")
    out, keep, share = [], 1 << 64, int(dropout * (1 << 64))
    while dropout and keep:
        keep -= -(-keep * share >> 64)
        out.append((1 << 64) - keep)
    return np.array([x for x in out if x < 1 << 64], np.uint64)


class MergeDropout:
    """Encoder and decoder for one model file, dropout rate and seed."""

    def __init__(self, path: str, dropout: float = 0.1, seed: int = 0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        side = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        joining = {c: 1 + i for i, c in enumerate(sorted({c for pair in side for c in pair}))}
        #: classes of the characters that have a neighbour in some piece, and which classes stand side by side
        self.char_class = np.zeros(0x110000, np.int16)
        self.together = np.zeros((1 + len(joining), 1 + len(joining)), bool)
        for c, i in joining.items():
            self.char_class[ord(c)] = i
        self.char_class[ord(" ")], self.char_class[ord("▁")] = self.char_class[ord("▁")], 0
        for a, b in side:
            self.together[joining[a], joining[b]] = True
        self.byte = [self._byte_id(names, b) for b in range(256)]
        self.size = n
        self.dropout, self.seed, self.gaps = dropout, seed, gap_table(dropout)
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.decoded: list[bytes] = [names[i].replace("▁", " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.decoded[i] = bytes([b])
        #: piece of each code point, or -1; spaces are written as U+2581, which itself has none
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[ord(" ")], self.symbol[ord("▁")] = self.symbol[ord("▁")], -1
        scores = np.array([model.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self._tabulate(pairs, rank)
        self.pairs = {(k // n, k % n): (int(rank[i]), i) for k, i in pairs.items()}
        self._forget()

    @staticmethod
    def _byte_id(names: list[str], b: int) -> int:
        return names.index(f"<0x{b:02X}>")

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of texts, one after another, and how many each text has; a space goes before each text."""
        joined = "".join([" " + t for t in texts if t])
        points = self.char_class[np.frombuffer(joined.encode("utf-32-le"), "<i4")]
        edges = np.cumsum([0] + [len(t) + 1 if t else 0 for t in texts])
        first = np.ones(len(points) + 1, bool)
        if len(points):
            first[1:-1] = ~self.together[points[:-1], points[1:]]
        first[edges] = True
        starts = np.flatnonzero(first)
        at = starts.tolist()
        return [joined[a:b] for a, b in zip(at, at[1:])], np.diff(np.searchsorted(starts, edges))

    def _candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of symbol pairs; impossible ones never come up."""
        key = np.where((left < self.size) & (right < self.size), left * np.int64(self.size) + right, -1)
        at = self._slots(key)
        found = self.slot_key[at] == key
        for step in range(1, self.probes):
            lost = np.flatnonzero(~found)
            if not len(lost):
                break
            at[lost] += step
            found[lost] = self.slot_key[at[lost]] == key[lost]
            at[lost] -= np.where(found[lost], 0, step)
        return np.where(found, self.slot_rank[at], _NEVER), self.slot_id[at]

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _tabulate(self, pairs: dict[int, int], rank: np.ndarray) -> None:
        """An open hash table of the pairs, eight to sixteen slots for each."""
        keys = np.array(list(pairs), np.int64)
        self.slot_bits = len(pairs).bit_length() + 3
        size = (1 << self.slot_bits) + 64
        self.slot_key, self.slot_rank, self.slot_id = np.full(size, -2), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.probes = 1
        for k, at in zip(keys.tolist(), self._slots(keys).tolist()):
            probe = 0
            while self.slot_key[at + probe] != -2:
                probe += 1
            self.probes = max(self.probes, probe + 1)
            self.slot_key[at + probe], self.slot_id[at + probe] = k, pairs[k]
        self.slot_rank = rank[self.slot_id].astype(np.int32)

    def _symbols(self, units: list[str]) -> np.ndarray:
        """Piece of each character; one without a piece is a symbol of its own that never merges."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), "<i4")
        known = self.symbol[points]
        return np.where(known >= 0, known, np.int32(self.size) + points)

    def _bytes(self, sym: np.ndarray, own: np.ndarray, units: int) -> list[bytes]:
        """Ids of each unit from the symbols that are left, characters without a piece as bytes."""
        if (sym >= self.size).any():
            spread = [[i] if i < self.size else [self.byte[b] for b in chr(i - self.size).encode()] for i in sym.tolist()]
            own = np.repeat(own, list(map(len, spread)))
            sym = np.array([i for x in spread for i in x], np.int64)
        edges = np.searchsorted(own, np.arange(units + 1)) * self.kind.itemsize
        body = sym.astype(self.kind).tobytes()
        return [body[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]

    def merge(self, units: list[str], skips: list[tuple[int, ...]]) -> tuple[list[bytes], list[int]]:
        """Piece ids of units and how many candidates came up; ``skips``: which of those, ascending, each unit skips."""
        sizes = np.fromiter(map(len, units), np.int32, len(units))
        sym = self._symbols(units)
        own = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        begin = np.arange(len(sym), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
        width = 1 + max(map(len, skips), default=0)
        due = np.full((len(units), width), _NO_SKIP, np.int32)
        for k in range(width - 1):
            due[:, k] = [s[k] if len(s) > k else _NO_SKIP for s in skips]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        came, passed = np.zeros(len(units), np.int32), np.zeros(len(units), np.int32)
        rank, into = np.full(len(sym), _NEVER, np.int32), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            at = np.flatnonzero(own[:-1] == own[1:])
            rank[at], into[at] = self._candidates(sym[at], sym[at + 1])
        while len(sym):
            heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            order = rank * np.int32(LONG) + begin
            best = np.minimum.reduceat(order, heads)  # leftmost among equals
            live = best < _NEVER * np.int32(LONG)
            count = np.diff(np.concatenate((heads, [len(sym)])))
            stay = np.repeat(live, count)
            if not live.all():
                done.append((sym[~stay], own[~stay]))
                sym, own, begin, rank, into, order = (x[stay] for x in (sym, own, begin, rank, into, order))
                if not len(sym):
                    break
                best, count = best[live], count[live]
            hit = np.flatnonzero(order == np.repeat(best, count))
            unit = own[hit]
            skip = due[unit, passed[unit]] == came[unit]
            came[unit] += 1
            passed[unit[skip]] += 1
            rank[hit[skip]] = _NEVER
            hit = hit[~skip]
            if not len(hit):
                continue
            sym[hit] = into[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, own, begin, rank, into = (x[keep] for x in (sym, own, begin, rank, into))
            hit = moved[hit]
            near = np.zeros(len(sym) + 1, bool)
            near[hit] = near[hit - 1] = True
            changed = np.flatnonzero(near[:-1])
            rank[changed] = _NEVER
            inside = changed[changed + 1 < len(sym)]
            inside = inside[own[inside] == own[inside + 1]]
            rank[inside], into[inside] = self._candidates(sym[inside], sym[inside + 1])
        sym, own = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(own, kind="stable")  # a unit is finished at once: its symbols stay in order
        return self._bytes(sym[order], own[order], len(units)), came.tolist()

    def merge_long(self, unit: str, key: int) -> bytes:
        """Ids of one unit of any length, by a heap of candidates over linked symbols; ``key``: of its draws."""
        sym = self._symbols([unit]).tolist()
        n, came, nth = len(sym), 0, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []
        skip = self._next(np.array([key], np.uint64), 0, np.array([-1]))[0] if len(self.gaps) else -1

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                found = self.pairs.get((sym[i], sym[j]))
                if found:
                    heapq.heappush(agenda, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, a, b, whole = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has merged since
            came += 1
            if came - 1 == skip:
                nth += 1
                skip = self._next(np.array([key], np.uint64), nth, np.array([skip]))[0]
                continue
            sym[i], sym[j] = whole, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        left = np.array(sym, np.int64)
        left = left[left >= 0]
        return self._bytes(left, np.zeros(len(left), np.int64), 1)[0]

    def _forget(self) -> None:
        self.units: dict[str, int] = {}  # unit -> its node without skips
        self.children: dict[int, int] = {}  # (node, next skip) -> node
        # node 0 stands for long units
        self.text: list[str] = [""]
        self.skipped: list[tuple[int, ...]] = [()]
        self.encoded: list[bytes] = [b""]
        self.came = np.zeros(1024, np.int64)

    def _grow(self, new: list[tuple[str, tuple[int, ...]]]) -> int:
        """Nodes for units with their skips; the first one's number."""
        first = len(self.encoded)
        if first + len(new) > len(self.came):
            self.came = np.concatenate((self.came, np.zeros(max(len(new), len(self.came)), np.int64)))
        for at in range(0, len(new), CHUNK):
            part = new[at : at + CHUNK]
            found, came = self.merge([u for u, _ in part], [s for _, s in part])
            self.encoded.extend(found)
            self.came[first + at : first + at + len(part)] = came
        self.text.extend(u for u, _ in new)
        self.skipped.extend(s for _, s in new)
        return first

    def _next(self, key: np.ndarray, nth: int, after: np.ndarray) -> np.ndarray:
        """Place of each occurrence's ``nth`` skip, the one before being at ``after``."""
        draw = mix64(key + np.uint64((nth + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return after + 1 + np.searchsorted(self.gaps, draw, "right")

    def encode(self, text: bytes, key: int = 0) -> np.ndarray:
        """Piece ids of a UTF-8 text; ``key`` is the document's id."""
        return self.encode_many([text], [key])[0]

    def encode_many(self, texts: list[bytes], keys: list[int]) -> list[np.ndarray]:
        """As ``encode``, with the new nodes of all texts merged together."""
        units, sizes = self.cut([t.decode("utf-8", "replace") for t in texts])
        if len(self.encoded) > MEMO_NODES:
            self._forget()
        new, long = set(units).difference(self.units), False
        if any(len(u) > LONG for u in new):
            long = True
            new = [u for u in new if len(u) <= LONG]
        new = list(new)
        if new:
            first = self._grow([(u, ()) for u in new])
            self.units.update(zip(new, range(first, first + len(new))))
        get = (lambda u: self.units.get(u, 0)) if long else self.units.__getitem__
        node = np.fromiter(map(get, units), np.int64, len(units))
        key = np.zeros(len(node), np.uint64)
        if len(self.gaps):
            seed = mix64(np.array([k & (1 << 64) - 1 for k in keys], np.uint64) + mix64(np.array([self.seed & (1 << 64) - 1], np.uint64)))
            place = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key = mix64(np.repeat(seed, sizes) ^ mix64(place.astype(np.uint64) + np.uint64(1)))
            at, after, nth = np.arange(len(node)), np.full(len(node), -1), 0
            while len(at):
                after = self._next(key[at], nth, after)
                skips = after < self.came[node[at]]
                at, after, nth = at[skips], after[skips], nth + 1
                wanted, back = np.unique(node[at] << np.int64(32) | after, return_inverse=True)
                wanted = wanted.tolist()
                unknown = [w for w in wanted if w not in self.children]
                if unknown:
                    first = self._grow([(self.text[w >> 32], (*self.skipped[w >> 32], w & 0xFFFFFFFF)) for w in unknown])
                    self.children.update(zip(unknown, range(first, first + len(unknown))))
                node[at] = np.array([self.children[w] for w in wanted], np.int64)[back] if wanted else node[at]
        parts, out, begin = list(map(self.encoded.__getitem__, node.tolist())), [], 0
        if long:
            for i in np.flatnonzero(node == 0).tolist():
                parts[i] = self.merge_long(units[i], int(key[i]))
        for n in sizes.tolist():
            out.append(np.frombuffer(b"".join(parts[begin : begin + n]), self.kind))
            begin += n
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text whose pieces these are, without the space that encoding puts first."""
        body = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        return body[1:] if body[:1] == b" " else body


_OUT = "_md_id long, _md_tokens long, _md_crc long, _md_lossless boolean, _md_ids binary"
_OUT_SCHEMA = pa.schema([("_md_id", pa.int64()), ("_md_tokens", pa.int64()), ("_md_crc", pa.int64()), ("_md_lossless", pa.bool_()), ("_md_ids", pa.binary())])
_CODERS: dict[tuple, MergeDropout] = {}


def _coder(*key) -> MergeDropout:
    if key not in _CODERS:
        _CODERS[key] = MergeDropout(*key)
    return _CODERS[key]


def _groups(batch: pa.RecordBatch, most: int = 3 << 20) -> Iterator[tuple[list, list[bytes]]]:
    docs, texts, size = [], [], 0
    for doc, value in zip(batch.column("_md_id").to_pylist(), batch.column("_md_text")):
        body = value.as_buffer()
        docs.append(doc)
        texts.append(body.to_pybytes() if body is not None else b"")
        size += len(texts[-1])
        if size > most:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def _encode(path: str, dropout: float, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, dropout, seed)
        for batch in batches:
            for docs, texts in _groups(batch):
                cols: list[list] = [[] for _ in range(5)]
                for doc, text, ids in zip(docs, texts, coder.encode_many(texts, [d or 0 for d in docs])):
                    raw = ids.tobytes()
                    for col, x in zip(cols, (doc, len(ids), zlib.crc32(raw), coder.decode(ids) == text, raw if with_ids else None)):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT_SCHEMA)], schema=_OUT_SCHEMA)

    return run


def encode_documents(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_crc32, lossless and, on request, ids (binary: little-endian ids of 16 bits, of 32 for vocabularies over 65,536)."""
    rows = docs.select(F.col(id_col).cast("long").alias("_md_id"), F.col(text_col).cast("string").alias("_md_text"))
    out = rows.mapInArrow(_encode(model_path, dropout, seed, with_ids), _OUT)
    cols = [F.col("_md_id").alias(id_col), F.col("_md_tokens").alias("n_tokens"), F.col("_md_crc").alias("ids_crc32"), F.col("_md_lossless").alias("lossless")]
    return out.select(*cols, *([F.col("_md_ids").alias("ids")] if with_ids else []))


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text from the ids that ``encode_documents`` returned; null ids give null."""
    schema = pa.schema([("_md_id", pa.int64()), ("_md_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model_path, 0.0, 0)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.frombuffer(x, coder.kind)).decode() for x in batch.column("_md_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_md_id"), pa.array(texts, pa.string())], schema=schema)

    rows = encoded.select(F.col(id_col).cast("long").alias("_md_id"), F.col(ids_col).alias("_md_ids"))
    return rows.mapInArrow(run, "_md_id long, _md_text string").select(F.col("_md_id").alias(id_col), F.col("_md_text").alias("text"))
