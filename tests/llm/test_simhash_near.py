import random

import pytest

import corpus_pipeline
from meshlens.llm import simhash_near


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _kept_by_hand(docs):
    """Smallest id of each group of texts linked by a similarity of 0.8."""
    sets, root = [_shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return {min(g) for g in groups.values()}


def _edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def _check(spark, docs):
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == _kept_by_hand(docs)
    return len(docs) - len(kept)


def test_stage_equals_jaccard_groups(spark):
    rng = random.Random(5)
    texts = [None, "", "a b", "A  b", "a b c"]
    for g in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((12, 60, 200, 700)))]
        texts += [" ".join(words)] + [_edited(rng, words, max(1, round(len(words) * share))) for share in (0.005, 0.015, 0.02, 0.025, 0.04)]
    rng.shuffle(texts)
    assert _check(spark, list(enumerate(texts))) > 20


@pytest.mark.parametrize("rounds,held", [(1, 4096), (2, 20), (1, 3)])
def test_stage_on_a_large_group(spark, monkeypatch, rounds, held):
    """Buckets over the limit come again, are held in a task or get fine keys: chains and outliers are found whichever way."""
    monkeypatch.setattr(simhash_near, "HELD", held)
    monkeypatch.setattr(simhash_near, "EACH", 1)
    monkeypatch.setattr(simhash_near, "CENTRES", 2)
    monkeypatch.setattr(simhash_near, "COARSE_ROUNDS", rounds)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(words)] + [_edited(rng, words, rng.randrange(1, 6)) for _ in range(90)]
    rng.shuffle(texts)
    assert _check(spark, list(enumerate(texts))) > 20


def test_stage_on_the_given_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert _check(spark, docs) > 0


def test_near_dedup_odd(odd_docs, no_docs):
    kept = simhash_near.dedup_similar(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 5), (False, 9)]
    assert simhash_near.dedup_similar(no_docs).count() == 0
