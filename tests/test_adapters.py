"""Adaptation by a hidden Markov model against all paths."""

import itertools
import math
import random
from collections import Counter

import pytest

from glossa.operators import adapters


def test_best_of_all_paths(spark):
    rng = random.Random(1)
    vocabulary = list("abcdef")
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 6))] for _ in range(30)] + [[]]
    model = {(s, t): round(rng.random(), 4) for s in [*vocabulary, "x"] for t in vocabulary if rng.random() < 0.5}
    pairs = [(k, [rng.choice([*vocabulary, "x", "y"]) for _ in range(rng.randint(1, 5))], [rng.choice(vocabulary) for _ in range(rng.randint(0, 4))]) for k in range(25)] + [(90, [], ["a"]), (91, ["y", "y"], [])]
    got = adapters.hidden_markov(
        spark.createDataFrame(pairs, "k long, s array<string>, t array<string>"), "k", "s", "t", spark.createDataFrame([(*x, p) for x, p in model.items()], "source string, target string, p double"), spark.createDataFrame([(t,) for t in texts], "w array<string>"), "w"
    ).collect()
    assert len(got) == len(pairs)
    n = Counter(p for t in texts for p in itertools.pairwise(["", *t]))
    first = Counter(a for t in texts for a, _ in itertools.pairwise(["", *t]))
    size = len({b for _, b in n})

    def step(a, b):
        return math.log((n[a, b] + 0.1) / (first[a] + 0.1 * size)) if a in first else math.log(1 / size)

    found = {r.k: (r.adapted, r.score) for r in got}
    for k, s, t in pairs:
        states = []
        for w in s:
            emit = {c: math.log(model[w, c]) for c in set(t) if model.get((w, c), 0) > 0 and c != w} | ({w: 0.0} if w in t else {})
            states.append(emit or {w: math.log(1e-6)})
        score = lambda path: sum(states[i][c] + step(p, c) for i, (p, c) in enumerate(zip(["", *path], path, strict=False)))  # noqa: E731, B023
        best = max(map(score, itertools.product(*states))) if s else 0.0
        path, total = found[k]
        assert len(path) == len(s) and total == pytest.approx(best, abs=1e-4) and score(path) == pytest.approx(best, abs=1e-4)
