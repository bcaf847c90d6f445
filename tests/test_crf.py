"""The conditional random field against sums over all label sequences."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossa.operators import crf


def sequence(rng, n):
    return [[f"w={rng.choice('abcd')}", f"x={rng.choice('ef')}", *(["rare"] if rng.random() < 0.2 else [])] for _ in range(n)]


def enumerated(chain, w, features):
    """Score of every label sequence."""
    weights, move = chain.parts(w)
    emit = [sum((weights[xxhash.xxh64_intdigest(f) % chain.buckets] for f in fs), np.zeros(chain.labels)) for fs in features]
    return {y: sum(emit[t][y[t]] for t in range(len(y))) + sum(move[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product(range(chain.labels), repeat=len(features))}


@pytest.mark.parametrize("labels", [2, 3])
def test_likelihood_gradient_and_paths_by_enumeration(labels):
    rng, gen = random.Random(labels), np.random.default_rng(labels)
    chain = crf.Chain(labels, 16)
    w = gen.normal(size=chain.size)
    sequences = [sequence(rng, n) for n in (1, 2, 5, 3, 5, 1)]
    gold = [[rng.randrange(labels) for _ in s] for s in sequences]
    batch = crf.Batch.of(sequences, chain.buckets)
    value, grad = chain.log_likelihood(w, batch, gold)
    want = 0.0
    for s, y in zip(sequences, gold, strict=True):
        scores = enumerated(chain, w, s)
        want += scores[tuple(y)] - math.log(sum(math.exp(v) for v in scores.values()))
    assert abs(value - want) < 1e-9
    for k in [*range(0, chain.size, 5), *range(chain.size - labels * labels, chain.size)]:
        step = np.zeros(chain.size)
        step[k] = 1e-5
        slope = (chain.log_likelihood(w + step, batch, gold)[0] - chain.log_likelihood(w - step, batch, gold)[0]) / 2e-5
        assert abs(slope - grad[k]) < 1e-6
    for s, path in zip(sequences, chain.best(w, batch), strict=True):
        scores = enumerated(chain, w, s)
        assert abs(scores[tuple(path)] - max(scores.values())) < 1e-9


def test_training_learns_a_chain(spark):
    """Labels that depend on the word and on the label before it; held-out sequences are labelled well, and partitions don't matter."""
    rng = random.Random(9)

    def row(k):
        words, y, label = [], [], 0
        for _ in range(rng.randint(1, 12)):
            word = rng.choice(["stay", "stay", "one", "zero"])
            label = {"stay": label, "one": 1, "zero": 0}[word]
            words.append(word)
            y.append(label)
        return k, words, y

    rows = [row(k) for k in range(400)] + [(1000, [], []), (1001, None, None)]
    df = spark.createDataFrame(rows, "id long, w array<string>, gold array<int>").withColumn("features", F.transform("w", lambda x: F.array(F.concat(F.lit("w="), x))))
    train, rest = df.filter("id < 300"), df.filter("id >= 300")
    model = crf.ConditionalRandomField(2, buckets=64, penalty=0.01).fit(train.repartition(3, "id"), steps=25)
    assert model.history[-1] < 0.6 * model.history[0] and all(b <= a for a, b in itertools.pairwise(model.history))
    other = crf.ConditionalRandomField(2, buckets=64, penalty=0.01).fit(train.repartition(40, "id"), steps=25)
    assert abs(other.history[-1] - model.history[-1]) < 1e-3 * model.history[0]
    got = {r.id: r.labels for r in model.label(rest, "id").collect()}
    gold = {k: y or [] for k, _, y in rows if k >= 300}
    assert got[1000] == got[1001] == [] and {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in gold.items()}
    # half of the words only tell that the label before stays: words alone would leave a quarter wrong
    right = sum(a == b for k in gold for a, b in zip(got[k], gold[k], strict=True))
    assert right >= 0.9 * sum(map(len, gold.values()))
    assert crf.ConditionalRandomField(2, 8).fit(df.filter("id < 0")).history == []


def test_long_sequences_and_word_features(spark):
    chain = crf.Chain(2, 32)
    w = np.random.default_rng(1).normal(size=chain.size)
    long = sequence(random.Random(2), 5000)
    value, grad = chain.log_likelihood(w, crf.Batch.of([long, long[:1]], 32), [[0] * 5000, [1]])
    assert np.isfinite(value) and value < 0 and np.isfinite(grad).all()
    assert [len(b) for b in crf._batches([([0] * 3,), ([0] * 5000,), ([0] * 2,)], 100)] == [2, 1]
    got = spark.createDataFrame([(["one", "of"],), ([],), (None,)], "w array<string>").select(crf.word_features("w").alias("f")).collect()
    assert got[0].f == [["word=one", "before=", "after=of", "end=ne", "length=3", "always"], ["word=of", "before=one", "after=", "end=of", "length=2", "always"]]
    assert got[1].f == [] and got[2].f is None
