"""Toxicity: a counterfactual-regularised classifier over word features.

Features of a text: which words it holds (letters, lower-cased) and their
first four and five letters, so that unseen endings of a known stem count.
Those that speak for the label (likelihood-ratio statistic over ``LEAST_G``)
enter a logistic model, along with the identity terms.

Identity terms are swapped for one another in the labelled texts that hold
them, and the loss penalises the squared change of the logit, so that mentions
of a group don't raise a score.  There are two sources of them: the pairs of
``IDENTITY_PAIRS`` in four languages, and pairs learned from the labels, for
corpora whose names of groups no list knows: words that lean most towards the
label though most labelled texts with them are neutral, each with a word as
frequent that doesn't lean.  ``ToxicityModel.report`` tells how many texts had
a counterfactual, and the mean change of the logit and the share of neutral
mentions that pass 0.7 with the penalty and without.

Fitting takes a bounded sample of labelled rows (``max_rows``, the smallest by
hash of the id); feature counts and sparse rows are computed on executors, and
what reaches the driver is bounded by ``max_rows``.  Scoring reads whole texts
and sees nothing but the text.

Null and empty texts get the intercept's score.  Repeated ids get a row each;
a label holds for each document of its id, and ``max_rows`` bounds those too.
Without labels of both kinds every text scores the share of label 1 (0 if
there is none).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Identity terms, in pairs that are swapped for one another; English, French, German, Spanish.
IDENTITY_PAIRS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("muslim", "christian"), ("muslims", "christians"), ("jewish", "catholic"), ("jews", "catholics"), ("black", "white"),
    ("african", "european"), ("asian", "american"), ("immigrant", "citizen"), ("immigrants", "citizens"), ("transgender", "cisgender"),
    ("disabled", "healthy"), ("old", "young"), ("mexican", "canadian"), ("arab", "english"), ("hindu", "buddhist"),
    ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("musulman", "chrétien"), ("musulmans", "chrétiens"),
    ("juif", "catholique"), ("juifs", "catholiques"), ("noir", "blanc"), ("noirs", "blancs"), ("immigré", "citoyen"),
    ("immigrés", "citoyens"), ("homosexuel", "hétérosexuel"), ("arabe", "français"), ("africain", "européen"), ("handicapé", "valide"),
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("muslime", "christen"), ("jude", "christ"),
    ("juden", "katholiken"), ("schwarze", "weiße"), ("ausländer", "inländer"), ("einwanderer", "bürger"), ("schwule", "heterosexuelle"),
    ("türke", "deutscher"), ("türken", "deutsche"), ("afrikaner", "europäer"), ("behinderte", "gesunde"), ("alte", "junge"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("niña", "niño"), ("musulmanes", "cristianos"), ("judío", "católico"),
    ("judíos", "católicos"), ("negro", "blanco"), ("negros", "blancos"), ("inmigrante", "ciudadano"), ("inmigrantes", "ciudadanos"),
    ("gitano", "payo"), ("africano", "europeo"), ("árabe", "español"), ("discapacitado", "sano"), ("viejo", "joven"),
)
#: Pairs that are learned from the labels, and the statistic from which a feature counts.
LEARNED_PAIRS, LEAST_G = 32, 18.0


def swaps(pairs: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """Each term's counterpart; of a term in several pairs the first counts."""
    out: dict[str, str] = {}
    for a, b in pairs:
        out.setdefault(a, b)
        out.setdefault(b, a)
    return out


_BLOCKS, _BITS = 64, 22
_SIZE = 1 << _BITS
_STRIP = re.compile(r"[\W\d_]+")
_MEMO_WORDS = 200_000


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a white-space word: each run of letters and its beginnings."""
    out = []
    for run in _STRIP.split(word.decode("utf-8", "replace").lower()):
        if run:
            out.append(_slot("w", run))
            if len(run) >= 4:
                out.append(_slot("4", run[:4]))
            if len(run) >= 5:
                out.append(_slot("5", run[:5]))
    return tuple(out)


def _slot(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value}", 11) >> (64 - _BITS)


class _Words(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes):
        if len(self) >= _MEMO_WORDS:
            self.clear()
        self[word] = found = self.make(word)
        return found


def _features(text: bytes, words: _Words) -> set[int]:
    out: set[int] = set()
    for found in map(words.__getitem__, set(text.split())):
        if found:
            out.update(found)
    return out


def _swapped(text: bytes, words: _Words, swap: dict[str, str]) -> set[int] | None:
    """Features with identity terms swapped, or None where there are none."""
    own = set(text.split())
    out: set[int] = set()
    changed = False
    for word in own:
        runs = [r for r in _STRIP.split(word.decode("utf-8", "replace").lower()) if r]
        if any(r in swap for r in runs):
            changed = True
            for r in runs:
                out.update(word_features(swap.get(r, r).encode()))
        else:
            out.update(words[word])
    return out if changed else None


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for value in batch.column(column):
        body = value.as_buffer()
        yield body.to_pybytes() if body is not None else b""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of the features, by label, in blocks of hash space."""
    counts = np.zeros((2, _SIZE), np.int32)
    words = _Words(word_features)
    for batch in batches:
        for label, text in zip(batch.column("_tx_label").to_pylist(), _texts(batch, "_tx_text")):
            own = np.fromiter(_features(text, words), np.int64)
            counts[label, own] += 1
    width = _SIZE // _BLOCKS
    rows = []
    for b in range(_BLOCKS):
        part = counts[:, b * width : (b + 1) * width]
        at = np.flatnonzero(part.any(axis=0)).astype("<i4")
        rows.append(at.tobytes() + part[:, at].astype("<i4").tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array(rows, pa.binary())], names=["_tx_block", "_tx_body"])


def _association(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Likelihood-ratio statistic of features that speak for label 1, else 0."""
    n = n_pos + n_neg
    total = pos + neg
    g = np.zeros(len(pos))
    for seen, size in ((pos, n_pos), (neg, n_neg)):
        for have, mean in ((seen, total * size / n), (size - seen, (n - total) * size / n)):
            ok = (have > 0) & (mean > 0)
            g[ok] += 2 * have[ok] * np.log(have[ok] / mean[ok])
    return np.where(pos * n_neg > neg * n_pos, g, 0.0)


def _select(n_pos: int, n_neg: int):
    least = max(3, (n_pos + n_neg) // 2000)

    def run(parts: pa.Table) -> pa.Table:
        width = _SIZE // _BLOCKS
        counts = np.zeros((2, width), np.int64)
        for body in parts["_tx_body"].to_pylist():
            at, pos, neg = np.frombuffer(body, "<i4").reshape(3, -1)
            counts[0, at] += pos
            counts[1, at] += neg
        g = _association(counts[1].astype(float), counts[0].astype(float), n_pos, n_neg)
        own = np.flatnonzero((g > LEAST_G) & (counts.sum(axis=0) >= least))
        block = parts["_tx_block"][0].as_py() if parts.num_rows else 0
        return pa.table({"slot": pa.array(block * width + own, pa.int64()), "g": pa.array(g[own], pa.float64())})

    return run


def _sparse(slots: dict[int, int], swap: dict[str, str]):
    schema = pa.schema([("label", pa.int32()), ("x", pa.binary()), ("swap", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(word_features)
        pack = lambda found: np.array(sorted(slots[f] for f in found if f in slots), "<i4").tobytes()
        for batch in batches:
            xs, swaps = [], []
            for text in _texts(batch, "_tx_text"):
                xs.append(pack(_features(text, words)))
                other = _swapped(text, words, swap)
                swaps.append(None if other is None else pack(other))
            yield pa.RecordBatch.from_arrays([batch.column("_tx_label"), pa.array(xs, pa.binary()), pa.array(swaps, pa.binary())], schema=schema)

    return run


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature slot, the intercept, and what the counterfactuals did."""

    weights: dict[int, float] = field(default_factory=dict)
    intercept: float = -3.0
    report: dict[str, float] = field(default_factory=dict)
    learned: tuple[tuple[str, str], ...] = ()

    def _word(self, word: bytes) -> tuple[int, ...]:
        return tuple(f for f in word_features(word) if f in self.weights)

    def logit(self, text: bytes, words: _Words | None = None) -> float:
        found = _features(text, words or _Words(self._word))
        return self.intercept + math.fsum(self.weights[f] for f in found if f in self.weights)

    def score(self, text: bytes, words: _Words | None = None) -> float:
        z = max(-500.0, min(500.0, self.logit(text, words)))
        return 1.0 / (1.0 + math.exp(-z))


class _Rows:
    """Sparse binary rows."""

    def __init__(self, bodies: list[bytes], features: int):
        parts = [np.frombuffer(b, "<i4") for b in bodies]
        self.col = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.n, self.features = len(parts), features

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], self.features)


def fit_logistic(x: _Rows, y: np.ndarray, a: _Rows, b: _Rows, fairness: float, ridge: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept; a and b: rows whose logits should agree (text and counterfactual)."""
    w, c = np.zeros(x.features), 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v = np.zeros(x.features + 1), np.zeros(x.features + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + c, -60, 60)))
        r = weight * (p - y)
        grad = np.append(x.back(r) + ridge * w, r.sum())
        if a.n:
            gap = (a.dot(w) - b.dot(w)) * (2 * fairness / a.n)
            grad[:-1] += a.back(gap) - b.back(gap)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        step *= min(1.0, 2 * (1 - t / (steps + 1)))
        w, c = w - step[:-1], c - step[-1]
    return w, float(c)


def _sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labels (_tx_id, _tx_label), the smallest by hash of the id."""
    # All hash cells before the one in which max_rows is passed, from a histogram of 4096; of that cell the smallest hashes.
    hashed = F.xxhash64("_tx_id")
    cell = F.shiftrightunsigned(hashed, 52)
    cells = labels.groupBy(cell.alias("c")).count().orderBy("c").collect()
    total = 0
    for r in cells:
        if total + r["count"] > max_rows:
            rest = labels.filter(cell == r["c"]).orderBy(hashed, "_tx_id", "_tx_label").limit(max_rows - total)
            return labels.filter(cell < r["c"]).unionByName(rest)
        total += r["count"]
    return labels


def learned_pairs(sample: DataFrame, n_pos: int, n_neg: int, most: int = LEARNED_PAIRS) -> tuple[tuple[str, str], ...]:
    """Words that lean towards the label but stand mostly in neutral texts, each with a word as frequent that doesn't lean."""
    words = sample.select("_tx_label", F.explode(F.array_distinct(F.split(F.lower("_tx_text"), r"[^\p{L}]+"))).alias("word")).filter("length(word) > 1")
    counts = words.groupBy("word").agg(F.sum("_tx_label").alias("pos"), F.sum(1 - F.col("_tx_label")).alias("neg")).filter(F.col("neg") >= max(5, n_neg // 500))
    lean = (F.col("pos") + 0.5) / (n_pos + 1) / ((F.col("neg") + 0.5) / (n_neg + 1))
    counts = counts.select("word", "neg", lean.alias("lean"), (F.col("pos") <= F.col("neg")).alias("neutral"))
    leaning = counts.filter("neutral and lean > 1").orderBy(F.desc("lean"), "word").limit(most)
    even = counts.filter("lean <= 1").orderBy(F.desc("lean"), "word").limit(16 * most)
    got = leaning.withColumn("even", F.lit(False)).unionByName(even.withColumn("even", F.lit(True))).collect()
    free = {r["word"]: r["neg"] for r in got if r["even"]}
    pairs = []
    for r in got:
        if not r["even"] and free:
            near = min(free, key=lambda w: (abs(free[w] - r["neg"]), w))
            pairs.append((r["word"], near))
            del free[near]
    return tuple(pairs)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000, fairness: float = 1.0, ridge: float = 1e-5, pairs: tuple[tuple[str, str], ...] = IDENTITY_PAIRS, learn: int = LEARNED_PAIRS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from the labelled documents: rows of ``labels`` with a 0/1 label.

    At most ``max_rows`` labels are used, so their table may be broadcast.
    ``learn``: how many pairs of terms to learn beside ``pairs``.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_tx_id"), F.col(label_col).cast("int").alias("_tx_label")).filter(F.col("_tx_id").isNotNull() & F.col("_tx_label").isin(0, 1))
    chosen_labels = F.broadcast(_sample(known, max_rows))  # max_rows rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("_tx_id"), F.col(text_col).cast("string").alias("_tx_text"))
    sample = materialize(texts.join(chosen_labels, "_tx_id"), "toxicity-sample")
    sized = lambda: {r["_tx_label"]: r["count"] for r in sample.groupBy("_tx_label").count().collect()}
    sizes = sized()
    if sum(sizes.values()) > max_rows:  # ids with many documents
        sample = materialize(sample.orderBy(F.xxhash64("_tx_id", "_tx_text", "_tx_label")).limit(max_rows), "toxicity-sample")
        sizes = sized()
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        share = n_pos / max(1, n_pos + n_neg)
        return ToxicityModel({}, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    learned = learned_pairs(sample, n_pos, n_neg, learn) if learn else ()
    swap = swaps((*pairs, *learned))
    blocks = sample.coalesce(16).mapInArrow(_count, "_tx_block int, _tx_body binary")
    chosen = blocks.groupBy("_tx_block").applyInArrow(_select(n_pos, n_neg), "slot long, g double").orderBy(F.desc("g"), "slot").collect()
    identity = {f for term in swap for f in word_features(term.encode())}
    order = list(dict.fromkeys([r["slot"] for r in chosen] + sorted(identity)))
    slots = {s: i for i, s in enumerate(order)}
    got = sample.mapInArrow(_sparse(slots, swap), "label int, x binary, swap binary").collect()
    y = np.array([r["label"] for r in got], float)
    x = _Rows([bytes(r["x"]) for r in got], len(order))
    swapped = [r for r in got if r["swap"] is not None]
    own, other = (_Rows([bytes(r[c]) for r in swapped], len(order)) for c in ("x", "swap"))
    w, c = fit_logistic(x, y, own, other, fairness, ridge)
    report = {"rows": len(got), "features": len(order), "counterfactuals": len(swapped), "learned_pairs": len(learned)}
    neutral = np.array([r["label"] == 0 for r in swapped], bool)
    for name, (v, d) in (("fair", (w, c)), ("plain", fit_logistic(x, y, own, own, 0.0, ridge) if fairness and swapped else (w, c))):
        a, b = own.dot(v), other.dot(v)
        report[f"gap_{name}"] = float(np.abs(a - b).mean()) if swapped else 0.0
        report[f"false_positives_{name}"] = float((np.maximum(a, b) + d > math.log(7 / 3))[neutral].mean()) if neutral.any() else 0.0
    return ToxicityModel({s: float(v) for s, v in zip(order, w) if v}, c, report, learned)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score for every row."""
    schema = pa.schema([("_tx_id", pa.int64()), ("_tx_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(model._word)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_tx_id"), pa.array([model.score(t, words) for t in _texts(batch, "_tx_text")], pa.float64())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("_tx_id"), F.col(text_col).cast("string").alias("_tx_text"))
    return rows.mapInArrow(run, "_tx_id long, _tx_score double").select(F.col("_tx_id").alias(id_col), F.col("_tx_score").alias("score"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, in one pass; all columns."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(model._word)
        for batch in batches:
            keep = [model.score(t, words) < threshold for t in _texts(batch, text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
