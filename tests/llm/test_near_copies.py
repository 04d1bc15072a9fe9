"""The pipeline's third stage against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from lumenfold.llm.near_copies import marks, without_near_copies
from lumenfold.llm.ngrams import WordHashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def alike(a, b, shingle=5):
    cut = lambda t: {tuple(w[s : s + shingle]) for w in [t.lower().split()] for s in range(max(1, len(w) - shingle + 1))} if t.split() else set()
    a, b = cut(a), cut(b)
    return bool(a or b) and 5 * len(a & b) >= 4 * len(a | b)


def edited(seed=6):
    rnd, rows = random.Random(seed), []
    for i in range(20):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([4, 60, 150]))]
        rows.append((10 * i, " ".join(words)))
        for c in range(1, rnd.choice([2, 3, 9])):
            for _ in range(rnd.choice([1, 2, 6])):
                words[rnd.randrange(len(words))] = f"X{rnd.randrange(99)}"
            rows.append((10 * i + c, " ".join(words)))
    long = [f"v{k}" for k in range(200)]
    rows += [(1000 + k, " ".join([*long[:k], f"Y{k}", *long[k + 1 :]])) for k in range(40)]
    rnd.shuffle(rows)
    return rows


def held(rows, kept):
    texts = dict(rows)
    names = sorted(texts)
    assert not [(a, b) for a in kept for b in kept if a < b and alike(texts[a], texts[b])]
    return all(any(alike(texts[a], texts[b]) for b in names if b < a) for a in names if a not in kept)


@pytest.mark.parametrize("how", [{}, {"block": 3, "most": 1}])
def test_no_near_copies_stay(spark, how):
    rows = edited()
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows] + [(None, rows[0][1], "x", "y", 1), (2000, "", "x", "y", 1), (2001, None, "x", "y", 1)], SCHEMA)
    kept = without_near_copies(docs, **how)
    assert kept.columns == docs.columns
    names = [r["doc_id"] for r in kept.collect()]
    assert None in names and {2000, 2001} <= set(names)
    assert held(rows, {n for n in names if n is not None and n < 2000})
    assert without_near_copies(docs.limit(0)).count() == 0


def test_the_stage_leaves_no_near_copies(spark, sf):
    rows = edited()
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    assert held(rows, {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, sf).collect()})


def test_marks_follow_similarity():
    rnd, shared, apart = random.Random(3), [], []
    for _ in range(60):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        b = [*a[:180], *(f"w{rnd.randrange(10**6)}" for _ in range(22))]  # similarity about 0.8
        (k, s, _, p), (m, t, _, q) = (marks(WordHashes().of([w.encode() for w in x]), 5, 24, 4) for x in (a, b))
        shared.append(len(set(k) & set(m)))
        assert (np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8)).sum() >= 84
        apart.append(int(np.bitwise_count((s ^ t).view(np.uint64)).sum()))
    assert min(shared) > 0 and max(apart) <= 28 and 5 < np.mean(shared) < 15 and 7 < np.mean(apart) < 19
