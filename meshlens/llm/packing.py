"""Best-fit packing of documents into sequences, by bin completion.

A document is its token ids and a closing id; those longer than a sequence are
cut into full pieces, so that only the last piece may be shorter.  Packing
depends on the pieces' lengths alone, and there are at most ``capacity`` of
those: Spark counts the pieces of each length, and the driver packs the
*histogram*, whatever the number of documents.

Bins are completed around the largest length left: fillings of the rest are
enumerated with the least waste first, dominated ones (in which a piece could
be swapped for a longer one that is there and still fits) are skipped, and a
branch is cut when the waste so far exceeds what the incumbent allows.  The
first incumbent is best-fit decreasing; search ends at the lower bound or when
its nodes are used up.  A filling is applied as often as its lengths last, so
that the plan has few entries.

Each piece then finds its place by arithmetic: its rank among the pieces of
its length (a count in its task and the sums of the tasks before) selects the
entry of the plan, the copy and the offset.

Null text counts as empty (one piece: the closing id).  Rows with a null or
repeated id are packed like any other.  Empty tables give empty results.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MEMO_WORDS = 250_000
OPEN = 64
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_PROBES = ("The", "thanedble,", "Éaux.", "weiß!!", "don", "a", "Straße---", "ñÑ?", "x%%%", "ZZZ***", "öÖ|", "re", "lls;")


class _Words(dict):
    """Ids by word; one that isn't there is taken from the older generation, or encoded, as it is looked up."""

    def __init__(self, encoder: WordEncoder, old: dict[bytes, bytes]):
        self.old, self.fullmatch, self.simple, self.whole, self.odd = old, _SIMPLE.fullmatch, encoder._simple, encoder._whole, 0

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            text = word.decode("utf-8", "replace")
            parts = self.fullmatch(text)
            if parts:
                found = self.simple(parts[1], parts[2])
            else:
                self.odd += 1
                found = self.whole(text)
        self[word] = found
        return found


class WordEncoder:
    """Token ids of texts, word by word, with the words' ids kept.

    For tokenizers whose tokens never span white space: each white-space
    delimited run of a text has the same ids by itself as within the text.
    New words are encoded many at once, joined by spaces, and told apart by
    the tokens' offsets.  Words of Latin letters with signs behind them are
    given to the tokenizer's model directly, where probes show that this gives
    the same ids.  Of two generations of known words the older is dropped when
    the younger is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._check(path)
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}
        self.tokenize = self.tokenizer.model.tokenize  # each access of the model makes an object
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        #: the byte-level alphabet: bytes without a printable sign follow from 256 on
        self.alphabet = {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}
        try:
            self.simple = all(self._simple(*_SIMPLE.fullmatch(w).groups()) == self._whole(w) for w in _PROBES)
        except Exception:
            self.simple = False
        self.direct = self.simple  # words are encoded as they are looked up

    def _check(self, path: str) -> None:
        """Raise unless the tokenizer cuts at white space and drops it, so that words may be encoded alone."""
        cut, norm = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        pieces = lambda t: [p for p, _ in cut.pre_tokenize_str(norm.normalize_str(t) if norm else t)]
        spaced = any(any(c.isspace() for c in t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        for space in " \t\n\r\v\f":
            words = ("Ab", "c1", "é!", "don't")
            if cut is None or spaced or pieces(f"{space}{space}".join(words) + space) != [p for w in words for p in pieces(w)]:
                raise ValueError(f"tokens of {path} may span white space")

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _simple(self, letters: str, signs: str) -> bytes:
        low = letters.lower()
        # letters of ASCII stand for their own bytes
        tokens = self.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.alphabet))
        if signs not in self.signs:
            if len(self.signs) > 10_000:
                self.signs = {"": b""}
            self.signs[signs] = self._whole(signs)
        ids = array("I", [t.id for t in tokens])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes() + self.signs[signs]

    def _learn(self, words: list[bytes]) -> None:
        if self.simple:
            rest = []
            for w in words:
                found = _SIMPLE.fullmatch(w.decode("utf-8", "replace"))
                if found:
                    self.memo[w] = self._simple(*found.groups())
                else:
                    rest.append(w)
            words = rest
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            texts = [w.decode("utf-8", "replace") for w in part]
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            begin = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            edges = np.searchsorted(begin, starts)
            for w, a, b in zip(part, edges.tolist(), edges[1:].tolist()):
                self.memo[w] = ids[a:b].tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_WORDS:
            self.old, self.memo = dict(self.memo), {}
        if self.direct:
            # new words are rare enough to encode where they occur, which spares the set of all words
            if not isinstance(self.memo, _Words):
                self.memo = _Words(self, self.old)
            known = self.memo.__getitem__
            out = [b"".join(map(known, t.split())) for t in texts]
            if self.memo.odd > max(1000, len(self.memo) // 20):  # many that only the whole tokenizer knows: many at once
                self.direct, self.memo = False, dict(self.memo)
            return out
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.memo)
        known = new.intersection(self.old) if self.old else ()
        for w in known:
            self.memo[w] = self.old[w]
        if new:
            self._learn([w for w in new if w not in known])
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder for a worker process: tasks that it runs later know its words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _groups(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[list, list[bytes]]]:
    docs, texts, size = [], [], 0
    for doc, value in zip(batch.column("_pk_id").to_pylist(), batch.column("_pk_text")):
        body = value.as_buffer()
        docs.append(doc)
        texts.append(body.to_pybytes() if body is not None else b"")
        size += len(texts[-1])
        if size > most:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


_PIECES = "_pk_id long, _pk_piece int, _pk_start long, _pk_length int, _pk_crc long, _pk_task int, _pk_nth long"
_PIECES_SCHEMA = pa.schema([("_pk_id", pa.int64()), ("_pk_piece", pa.int32()), ("_pk_start", pa.int64()), ("_pk_length", pa.int32()), ("_pk_crc", pa.int64()), ("_pk_task", pa.int32()), ("_pk_nth", pa.int64())])


def _cut(path: str, capacity: int, closing: int):
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for docs, texts in _groups(batch):
                cols: list[list] = [[] for _ in range(7)]
                for doc, ids in zip(docs, encoder.encode(texts)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        length = len(own) // 4
                        for col, x in zip(cols, (doc, piece, at // 4, length, zlib.crc32(own), task, int(seen[length]))):
                            col.append(x)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECES_SCHEMA)], schema=_PIECES_SCHEMA)

    return run


Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: patterns and how often each is used."""
    open_: dict[int, list[list]] = defaultdict(list)  # free space -> [pattern, bins]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for free in sorted(f for f in open_ if f >= size):
            if not left:
                break
            each, groups = free // size, open_.pop(free)
            for g, (pattern, bins) in enumerate(groups):
                full = min(bins, left // each)
                rest = min(left - full * each, each - 1) if full < bins else 0
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        open_[free - k * size].append([pattern + ((size, k),), n])
                used = full + (1 if rest else 0)
                left -= full * each + rest
                if bins > used:
                    open_[free].append([pattern, bins - used])
        each = capacity // size
        for n, k in ((left // each, each), (1 if left % each else 0, left % each)):
            if n:
                open_[capacity - k * size].append([((size, k),), n])
    return [(p, n) for groups in open_.values() for p, n in groups if n]


def _fillings(space: int, sizes: list[int], counts: Counter, waste: int, budget: list[int]) -> Iterator[tuple[int, Pattern]]:
    """Undominated fillings of ``space``: (waste, pattern), least waste first, longest pieces first.

    ``reach[k]`` has a bit for each sum that pieces of the k smallest sizes make,
    so that no way is entered that doesn't end in a filling.
    """
    reach, full = [1], (1 << (space + 1)) - 1
    for s in sizes:
        if s > space:
            break
        sums, left, n = reach[-1], min(counts[s], space // s), 1
        while left:
            n = min(n, left)
            sums |= sums << (n * s)
            left -= n
            n *= 2
        sums &= full
        reach.append(reach[-1] if sums == reach[-1] else sums)  # once all sums are reached, one object
    chosen: list[tuple[int, int]] = []

    def undominated(lost: int) -> bool:
        pattern = dict(chosen)
        for s in (*pattern, 0):  # a longer piece would still fit in its place, or another one beside (0)
            k = bisect_right(sizes, s)
            if k < len(sizes) and sizes[k] - s <= lost and counts[sizes[k]] > pattern.get(sizes[k], 0):
                return False
        return True

    def descend(rest: int, k: int, lost: int) -> Iterator[tuple[int, Pattern]]:
        """Fillings that add pieces of the k smallest sizes, ``rest`` in all."""
        budget[0] -= 1
        if rest == 0:
            if undominated(lost):
                yield lost, tuple(chosen)
            return
        k = min(k, bisect_right(sizes, rest))
        while k and reach[k] >> rest & 1 and budget[0] > 0:
            s = sizes[k - 1]
            for n in range(min(counts[s], rest // s), 0, -1):
                if reach[k - 1] >> (rest - n * s) & 1:
                    chosen.append((s, n))
                    yield from descend(rest - n * s, k - 1, lost)
                    chosen.pop()
                    if budget[0] <= 0:
                        return
            k -= 1

    try:
        for lost in range(min(waste, space) + 1):
            if reach[-1] >> (space - lost) & 1:
                yield from descend(space - lost, len(reach) - 1, lost)
            if budget[0] <= 0:
                return
    finally:
        descend = None  # it refers to itself: what it holds would wait for the collector of cycles


def _fullest(counts: Counter, capacity: int) -> int:
    """The most tokens that any bin can hold."""
    sums = 1
    for s, n in counts.items():
        left, k = min(n, capacity // s), 1
        while left:
            k = min(k, left)
            sums |= sums << (k * s)
            left -= k
            k *= 2
        sums &= (1 << (capacity + 1)) - 1
    return sums.bit_length() - 1


def bin_completion(counts: Counter, capacity: int, nodes: int = 3000, effort: int = 400_000) -> list[tuple[Pattern, int]]:
    """Patterns and multiplicities that pack the histogram in few bins.

    Branches are all undominated fillings, taken one at a time, each as often
    as its lengths last and then once, until ``nodes`` branches or ``effort``
    steps are used up.
    """
    counts = Counter({s: n for s, n in counts.items() if n > 0})
    total = sum(s * n for s, n in counts.items())
    incumbent = best_fit(counts, capacity)
    best = sum(n for _, n in incumbent)
    if not counts:
        return incumbent
    capacity = _fullest(counts, capacity)
    # bins for pieces over half the capacity can't be shared with one another
    bound = max(-(-total // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    if best <= bound:
        return incumbent
    left, budget = nodes, [effort]
    lengths = np.arange(capacity + 1)

    def listed(link: tuple | None) -> list[tuple[Pattern, int]]:
        out = []
        while link:
            link, step = link
            out.append(step)
        return out[::-1]

    def options(wasted: int, place: list) -> Iterator[tuple[Pattern, int, int]]:
        """(pattern, how often, waste of one) around the largest length, from ``place`` on, which follows."""
        sizes = np.flatnonzero(own).tolist()
        here = Counter({s: int(own[s]) for s in sizes})
        large = sizes[-1]
        here[large] -= 1
        rest = [s for s in sizes if here[s]]
        for once in (False, True)[place[0] :]:
            begin = place[1] if once == place[0] else 0
            for nth, (lost, filling) in enumerate(_fillings(capacity - large, rest, here, (best - 1) * capacity - total - wasted, budget)):
                if nth < begin:
                    continue
                allowed = (best - 1) * capacity - total - wasted
                if lost > allowed:
                    return
                chosen = Counter(dict(filling))
                chosen[large] += 1
                often = min(int(own[s]) // k for s, k in chosen.items())
                if lost:
                    often = min(often, max(1, allowed // lost))
                place[:] = once, nth + 1
                if not once or often > 1:
                    yield tuple(sorted(chosen.items(), reverse=True)), 1 if once else often, lost

    # A branch is its options that are left, its place among them, the steps so far (a linked list), its bins and its waste.
    # Only the last OPEN branches hold their options; the others make them anew from their place.
    # ``own`` has the counts of the last branch alone: steps are taken from it, and given back when their branch is left.
    stack: list[list] = []
    own = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        own[s] = n

    def give(pattern: Pattern, often: int) -> None:
        for s, k in pattern:
            own[s] += k * often

    def enter(made: tuple | None, bins: int, wasted: int) -> bool:
        nonlocal incumbent, best
        sizes = np.flatnonzero(own).tolist()
        if not sizes:
            if bins < best:
                incumbent, best = listed(made), bins
            return False
        if bins + -(-int(own @ lengths) // capacity) >= best:
            return False
        if left % 16 == 0:  # an incumbent: this start, completed by best fit
            rest = best_fit(Counter({s: int(own[s]) for s in sizes}), capacity)
            if bins + sum(n for _, n in rest) < best:
                incumbent, best = listed(made) + rest, bins + sum(n for _, n in rest)
        stack.append([None, [False, 0], made, bins, wasted])
        if len(stack) > OPEN:
            stack[-1 - OPEN][0] = None
        return True

    enter(None, 0, 0)
    while stack and left > 0 and budget[0] > 0 and best > bound:
        more, place, made, bins, wasted = stack[-1]
        if more is None:
            more = stack[-1][0] = options(wasted, place)
        step = next(more, None)
        if step is None:
            stack.pop()
            if made:
                give(*made[1])
            continue
        left -= 1
        pattern, often, lost = step
        give(pattern, -often)
        if not enter((made, (pattern, often)), bins + often, wasted + lost * often):
            give(pattern, often)
    return incumbent


def _plan(patterns: list[tuple[Pattern, int]]) -> tuple[np.ndarray, ...]:
    """Entries sorted by (length, first rank): first rank, copies, first sequence, first offset."""
    used: Counter = Counter()
    entries, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size, k in pattern:
            entries.append((size, used[size], k, sequence, offset))
            used[size] += k * times
            offset += size * k
        sequence += times
    entries.sort()
    return tuple(np.array(x, np.int64) for x in zip(*entries)) if entries else tuple(np.zeros(0, np.int64) for _ in range(5))


_PLACE = "_pk_id long, _pk_piece int, _pk_start long, _pk_length long, _pk_crc long, _pk_sequence long, _pk_offset long"
_PLACE_SCHEMA = pa.schema([("_pk_id", pa.int64()), ("_pk_piece", pa.int32()), ("_pk_start", pa.int64()), ("_pk_length", pa.int64()), ("_pk_crc", pa.int64()), ("_pk_sequence", pa.int64()), ("_pk_offset", pa.int64())])


def _place(plan: tuple[np.ndarray, ...]):
    size, first, copies, sequence, offset = plan
    key = size * (1 << 48) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("_pk_length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_pk_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            nth = rank - first[at]
            own = [batch.column("_pk_id"), batch.column("_pk_piece"), batch.column("_pk_start"), pa.array(length), batch.column("_pk_crc")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * length)], schema=_PLACE_SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("_pk_id"), F.col(text_col).cast("string").alias("_pk_text"))
    pieces = materialize(rows.mapInArrow(_cut(tokenizer_path, capacity, closing), _PIECES), "pack-pieces")
    counts = pieces.groupBy("_pk_length", "_pk_task").agg(F.count("*").alias("_pk_n"))
    before = Window.partitionBy("_pk_length").orderBy("_pk_task").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task and length: no more than tasks x capacity
    files = max(8, -(-pieces.count() // 100_000))  # no more rows than pieces
    bases = materialize(counts.withColumn("_pk_base", F.coalesce(F.sum("_pk_n").over(before), F.lit(0))).coalesce(files), "pack-counts")
    totals = Counter({r["_pk_length"]: r["n"] for r in bases.groupBy("_pk_length").agg(F.sum("_pk_n").alias("n")).collect()})  # at most capacity rows
    plan = _plan(bin_completion(totals, capacity))
    # merged, not broadcast: the bases grow with the tasks
    ranked = pieces.join(bases.select("_pk_length", "_pk_task", "_pk_base").hint("merge"), ["_pk_length", "_pk_task"]).withColumn("_pk_rank", F.col("_pk_nth") + F.col("_pk_base"))
    placed = ranked.select("_pk_id", "_pk_piece", "_pk_start", "_pk_length", "_pk_crc", "_pk_rank").mapInArrow(_place(plan), _PLACE)
    return placed.select(F.col("_pk_id").alias(id_col), F.col("_pk_piece").alias("piece"), F.col("_pk_start").alias("start"), F.col("_pk_length").alias("length"), F.col("_pk_crc").alias("ids_crc32"), F.col("_pk_sequence").alias("sequence_id"), F.col("_pk_offset").alias("offset"))
