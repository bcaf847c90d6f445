"""Adaptation of a sentence to a target as a hidden Markov model (M7).

Each word of the sentence is an observation; its states are the words that may
stand for it: itself where the target has it, the target's words that the
translation model gives for it, or itself as a last resort. Emissions and
transitions are joined from tables of the corpus; the best path of each short
trellis is found in one pass over its rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.sources.storage import written

#: Emission of a word that nothing in the target stands for, added count of a transition, digits of both.
LAST_RESORT, ADDED, DIGITS = 1e-6, 0.1, 6


def transition_model(texts: DataFrame, words: str, added: float = ADDED) -> tuple[DataFrame, DataFrame, int]:
    """(a, b, log p) of adjacent words, (a, log p) for any other word after a, and how many words there are.

    p = (n(a b) + added) / (n(a) + added * words); a text begins after "".
    """
    w = texts.select(F.concat(F.array(F.lit("")), words).alias("w"))
    adjacent = w.select(F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("x")).select("x.*")
    n = written(adjacent.groupBy("a", "b").agg(F.count("*").alias("n")), "transitions")
    first = written(n.groupBy("a").agg(F.sum("n").alias("of")), "transition-starts")
    size = n.select("b").distinct().count()
    share = lambda x: F.round(F.log(x / (F.col("of") + added * size)), DIGITS)
    seen = n.join(first, "a").select("a", "b", share(F.col("n") + added).alias("step"))
    return seen, first.select("a", share(F.lit(added)).alias("other")), size


def trellis(pairs: DataFrame, key: str, source: str, target: str, model: DataFrame) -> DataFrame:
    """key, pos, cand, emit: the states of each word of ``source`` by log emission.

    model: (source, target, p). Words of the target stand for themselves with
    emission 1; others by the model, as far as the target has them.
    """
    slots = pairs.select(key, F.posexplode(source).alias("pos", "word"))
    own = pairs.select(key, F.explode(F.array_distinct(target)).alias("cand"))
    same = slots.join(own.withColumnRenamed("cand", "word"), [key, "word"]).select(key, "pos", F.col("word").alias("cand"), F.lit(0.0).alias("emit"))
    told = slots.join(model.filter("p > 0 and source <> target").select(F.col("source").alias("word"), F.col("target").alias("cand"), "p"), "word")
    told = told.join(own, [key, "cand"]).select(key, "pos", "cand", F.round(F.log("p"), DIGITS).alias("emit"))
    found = written(same.unionByName(told).groupBy(key, "pos", "cand").agg(F.max("emit").alias("emit")), "trellis")
    rest = slots.join(found.select(key, "pos").distinct(), [key, "pos"], "left_anti").select(key, "pos", F.col("word").alias("cand"), F.lit(round(math.log(LAST_RESORT), DIGITS)).alias("emit"))
    return found.unionByName(rest)


def best_path(rows: list[tuple[int, str, str, float]]) -> list[str]:
    """(pos, a, b, score) steps of a trellis, a "" at position 0 -> the words of its best path; of equal ones the least words, from the end on."""
    best: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
    by_place: dict[int, list[tuple[str, str, float]]] = {}
    for pos, *step in rows:
        by_place.setdefault(pos, []).append(tuple(step))
    for pos in sorted(by_place):
        here: dict[str, tuple[float, str]] = {}
        for a, b, s in by_place[pos]:
            if a in best:
                total = round(best[a][0] + s, DIGITS)
                if b not in here or (-total, a) < (-here[b][0], here[b][1]):
                    here[b] = (total, a)
        best = {b: (total, (best[a][1], b)) for b, (total, a) in here.items()}
    if not rows:
        return []
    _, last = min(((-total, b), path) for b, (total, path) in best.items())
    words = []
    while last:
        last, word = last
        words.append(word)
    return words[::-1]


def hidden_markov(pairs: DataFrame, key: str, source: str, target: str, model: DataFrame, texts: DataFrame, words: str) -> DataFrame:
    """key, adapted, score: ``source`` in the words of the most probable path, and its log probability.

    texts with arrays ``words`` give the transitions. One row for each pair; an
    empty source is adapted to nothing. Keys are distinct.
    """
    states = written(trellis(pairs, key, source, target, model), "states")
    seen, other, size = transition_model(texts, words)
    before = states.select(key, (F.col("pos") + 1).alias("pos"), F.col("cand").alias("a"))
    start = states.filter("pos = 0").select(key, "pos").distinct().withColumn("a", F.lit(""))
    steps = before.unionByName(start).join(states.select(key, "pos", F.col("cand").alias("b"), "emit"), [key, "pos"])
    log = F.coalesce("step", "other", F.lit(round(math.log(1 / max(size, 1)), DIGITS)))
    scored = steps.join(seen, ["a", "b"], "left").join(other, "a", "left").select(key, "pos", "a", "b", F.round(F.col("emit") + log, DIGITS).alias("score"))
    kind = pairs.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("pos", "a", "b", "score")), strict=True))
        path = best_path(rows)
        of = {(p, a, b): s for p, a, b, s in rows}
        total = sum(of[k, a, b] for k, (a, b) in enumerate(zip(["", *path], path, strict=False)))
        return pa.table({key: table[key].slice(0, 1), "adapted": pa.array([path], pa.list_(pa.string())), "score": pa.array([round(total, DIGITS)])})

    found = scored.groupBy(key).applyInArrow(run, f"`{key}` {kind}, adapted array<string>, score double")
    empty = pairs.filter(F.size(source) < 1).select(key, F.array().cast("array<string>").alias("adapted"), F.lit(0.0).alias("score"))
    return found.unionByName(empty)
