"""Word assignment, pruned search and the vector index against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import hierarchy
from glossa.operators.search import ImpactIndex
from glossa.operators.vector_index import Cells, exhaustive, fitted

# -- words on a category tree ---------------------------------------------------------------------


def test_chi_square_values():
    assert abs(hierarchy.chi_square_value(1, 0.05) - 3.841458820694124) < 1e-9
    assert abs(hierarchy.chi_square_value(1, 0.45) - 0.5706518) < 1e-6
    assert abs(hierarchy.chi_square_value(2, 0.45) + 2 * math.log(0.45)) < 1e-9
    for freedom in (4, 10, 60):  # an even number of degrees of freedom has a closed form
        x = hierarchy.chi_square_value(freedom)
        assert abs(math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2)) - 0.45) < 1e-9


def plain_assignment(docs, mode):
    """docs: (path, words) -> {(category, word): df}, a node at a time from the root."""
    nodes, children = defaultdict(list), defaultdict(set)
    for path, words in docs:
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            node = "/".join(parts[:k])
            nodes[node].append(words)
            if k > 1:
                children["/".join(parts[: k - 1])].add(node)
    df = {n: Counter(w for words in each for w in words) for n, each in nodes.items()}
    out = {}

    def visit(node, taken):
        open_ = [w for w in df[node] if w not in taken]
        kids, scores, total = sorted(children[node]), {}, len(nodes[node])
        for w in open_ if len(kids) > 1 else ():
            t, n = df[node][w], len(kids)
            if mode == "chi-square":
                x = 0.0
                for c in kids:
                    have, size = df[c][w] + 1, len(nodes[c]) + 1
                    e0 = (t + n) / (total + 2 * n) * (len(nodes[c]) + 2)
                    e1 = len(nodes[c]) + 2 - e0
                    x += (have - e0) ** 2 / e0 + (size - have - e1) ** 2 / e1
                scores[w] = x
            elif mode == "perplexity":
                scores[w] = -sum(p * math.log(p) for c in kids if (p := df[c][w] / t) > 0)
            else:
                scores[w] = -sum(len(nodes[c]) / total * math.log(df[c][w] / t + 1e-11) for c in kids)
        if not kids:
            kept = set(open_)
        elif mode == "chi-square":
            kept = {w for w, x in scores.items() if x < hierarchy.chi_square_value(len(kids) - 1)}
        elif scores:
            mean, sd = np.mean(list(scores.values())), np.std(list(scores.values()))
            kept = {w for w, x in scores.items() if (x > mean + 3 * sd if mode == "perplexity" else x < mean - 2 * sd)}
        else:
            kept = set()
        out.update({(node, w): df[node][w] for w in kept})
        for c in kids:
            visit(c, taken | kept)

    visit("Top", frozenset())
    return out


@pytest.mark.parametrize("mode", ["chi-square", "perplexity", "cross-entropy"])
def test_words_are_assigned_as_node_by_node(spark, mode):
    rng = random.Random(1)
    paths = ["Top/a/x", "Top/a/y", "Top/a/z/deep", "Top/a/z/deeper", "Top/b/only", "Top/c", "Top/d/p", "Top/d/q"]
    common, docs = [f"c{i}" for i in range(30)], []
    for k in range(160):
        path = rng.choice(paths)
        words = {rng.choice(common) for _ in range(rng.randint(0, 12))} | {f"{path[4]}{rng.randint(0, 5)}" for _ in range(3)} | {f"{path[-1]}!{rng.randint(0, 3)}"} | ({"everywhere"} if k % 20 else set())
        docs.append((path, words))
    rows = [(p, i, sorted(w)) for i, (p, w) in enumerate(docs)]
    d = spark.createDataFrame([*rows, (None, 900, ["lost"])], "path string, doc long, words array<string>")
    words = d.select("path", "doc", F.explode("words").alias("word")).unionByName(spark.createDataFrame([("Top/a/x", 0, None)], "path string, doc long, word string"))
    got = {(r.category, r.word): r.df for r in hierarchy.assign_words(d.select("path", "doc"), words, mode).collect()}
    assert got == plain_assignment(docs, mode)
    if mode == "chi-square":  # even among the children there; one a category of one child has goes below
        assert got["Top", "everywhere"] and not any(c == "Top/b" for c, _ in got)


def test_no_words(spark):
    d = spark.createDataFrame([], "path string, doc long")
    assert hierarchy.assign_words(d, d.withColumn("word", F.lit("x"))).count() == 0
    with pytest.raises(ValueError):
        hierarchy.assign_words(d, d.withColumn("word", F.lit("x")), "other")


# -- pruned search --------------------------------------------------------------------------------


def plain_search(postings, queries, rows):
    by_term, asked = defaultdict(list), defaultdict(Counter)
    for t, d, w in postings:
        if None not in (t, d, w) and w > 0:
            by_term[t].append((d, w))
    for q, t, b in queries:
        if None not in (q, t):
            asked[q][t] += b
    out = []
    for q, terms in asked.items():
        score = Counter()
        for t, b in terms.items():
            for d, w in by_term[t] if b > 0 else ():
                score[d] += b * w
        best = sorted((-round(s, 6), d) for d, s in score.items())[:rows]
        out += [(q, d, -s, k) for k, (s, d) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("weights", ["equal", "spread"])
def test_search_as_all_postings(spark, weights):
    rng = random.Random(2)
    share = {f"t{i}": min(1.0, 1.5 / (i + 1)) for i in range(60)}
    postings = [(t, d, 1.0 if weights == "equal" else round(rng.expovariate(1) ** 3 + 0.001, 4)) for t, p in share.items() for d in range(1500) if rng.random() < p]
    postings += [(None, 1, 1.0), ("t5", None, 1.0), ("zero", 3, 0.0), ("null", 3, None)]
    queries = [(q, f"t{min(59, int(rng.expovariate(0.06)))}", rng.choice([1.0, 2.0, 0.5, 3.25])) for q in range(40) for _ in range(8)]
    queries += [(100, "t0", 1.0), (101, "nowhere", 1.0), (102, "t59", 0.0), (None, "t0", 1.0), (103, None, 1.0), (104, "t3", -1.0)]
    index = ImpactIndex(spark.createDataFrame(postings, "w string, d long, x double"), "w", "d", "x", part=100)
    asked = spark.createDataFrame(queries, "id long, w string, b double")
    got = index.search(asked, "id", "w", "b", 10)
    assert got.columns == ["id", "doc", "score", "rank"]
    rounded = [(q, d, round(s, 5), k) for q, d, s, k in sorted(map(tuple, got.collect()))]
    assert rounded == [(q, d, round(s, 5), k) for q, d, s, k in plain_search(postings, queries, 10)]
    terms = index._query_terms(asked.toDF("q", "term", "boost").filter("q is not null and term is not null"), "again")
    read = index.needed(terms, 10, "again").agg(F.sum("n"), F.sum(F.when(F.col("needed"), F.col("n")))).first()
    assert read[1] < 0.6 * read[0]  # the long postings are looked up, not read


def test_search_of_nothing(spark):
    index = ImpactIndex(spark.createDataFrame([], "w string, d long, x double"), "w", "d", "x")
    assert index.search(spark.createDataFrame([(1, "a", 1.0)], "q long, w string, b double"), "q", "w", "b").count() == 0


# -- nearest vectors ------------------------------------------------------------------------------


def plain_nearest(vectors, queries, k):
    kept = [(i, np.array(v, float)) for i, v in vectors if v is not None and i is not None and any(v)]
    ids, x = [i for i, _ in kept], np.array([v / np.sqrt(v @ v) for _, v in kept])
    out = []
    for q in queries:
        if q not in ids:
            continue
        cosine = np.round(x @ x[ids.index(q)], 6)
        best = sorted((-c, i) for c, i in zip(cosine.tolist(), ids, strict=True) if i != q)[:k]
        out += [(q, i, -c, r) for r, (c, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 16))
    rows = [(i, (centres[i % 25] * (1 if i % 3 else 4) + 0.25 * rng.normal(size=16)).round(4).tolist()) for i in range(2000)]
    rows += [(3000 + i, rows[10][1]) for i in range(60)]  # equal vectors
    return [*rows, (4000, [0.0] * 16), (4001, None), (None, rows[0][1])]


def test_index_and_exhaustive_search_as_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "id long, v array<double>")
    queries = df.filter("id % 50 = 0 or id = 10")
    want = plain_nearest(vectors, [i for i, _ in vectors if i is not None and (i % 50 == 0 or i == 10)], 7)
    got = lambda x: sorted((r.q, r.id, round(r.cosine, 6), r["rank"]) for r in x.collect())
    assert got(exhaustive(queries, df, "id", "v", 7)) == want
    cells = Cells(df, "id", "v")
    assert len(cells.centroids) > 20
    assert got(cells.search(queries, 7, probes=2)) == want
    near = {(q, i) for q, i, *_ in got(cells.search(queries, 7, probes=8, exact=False))}
    assert len(near & {(q, i) for q, i, *_ in want}) >= 0.9 * len(want)
    # one cell is an exhaustive search, a small sample changes no exact result
    assert got(Cells(df, "id", "v", cells=1).search(queries, 7)) == want
    assert got(Cells(df, "id", "v", cells=40, sample=50).search(queries, 7, probes=1)) == want


def test_index_of_nothing_and_of_less_than_asked(spark):
    none = spark.createDataFrame([], "id long, v array<float>")
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<float>")
    assert Cells(none, "id", "v").search(few, 3).count() == 0
    assert [(r.q, r.id, round(r.cosine, 4)) for r in Cells(few, "id", "v").search(few, 3).orderBy("q").collect()] == [(1, 2, 0.7071), (2, 1, 0.7071)]
    assert len(fitted(np.eye(3), 10)) == 3
