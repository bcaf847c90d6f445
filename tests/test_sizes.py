"""Steps that have to hold on tables much larger than the test tables."""

import duckdb
import pytest

from glossa.operators import counts, joins, models
from glossa.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_word_of_several_parts_is_one_row_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(counts, "POSTINGS", 10)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ours = sorted(tuple(r) for r in registry.QUERIES["inverted_index"](spark, SF).select("word", "df", "prior", "part", "postings").collect())
    theirs = sorted(c.execute(f"SELECT word, df, prior, part, postings FROM ({registry.ORACLE['inverted_index']})").fetchall())
    assert any(r[1] > 10 for r in ours) and ours == theirs


def test_the_index_has_words_of_few_documents(spark, tmp_path):
    docs = [(k, "common word" + " rare" * (k == 3) + " twice" * (k in (2, 5))) for k in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["word"]: r["postings"] for r in registry.QUERIES["inverted_index"](spark, str(tmp_path)).collect()}
    assert got == {"common": "0,1,2,3,4,5", "word": "0,1,2,3,4,5", "rare": "3", "twice": "2,5"}


def test_lists_of_a_block_are_made_where_it_is(spark):
    """No shuffle of the index has rows of words in documents."""
    found = exchanged(registry.QUERIES["inverted_index"](spark, SF))
    assert any("text" in x for x in found) and not any("doc_id" in x and "text" not in x for x in found)


def test_system_pairs_are_made_once(spark):
    """Each pair is made once: nothing looks for it among the others, and equal rows count as in SQL."""
    rows = [(f"s{k:02d}", "oracle" if k % 5 == 0 else str(k % 3)) for k in range(30)] + [("s01", "1"), ("s31", None)]
    got = joins.system_pairs(spark.createDataFrame(rows, "s string, n string"), "s", "n")
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and ((x == y and x is not None) or "oracle" in (x, y)))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "Aggregate" not in plan(got)


def exchanged(df):
    """What each shuffle of the plan has for rows: the columns of the step below it."""
    out, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            waiting.append(node.inputPlan())
            continue
        if node.nodeName() == "Exchange":
            out.append([node.output().apply(i).name() for i in range(node.output().size())])
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("name", ["tfidf_topk", "relative_position", "unigram_perplexity", "hierarchical_perplexity", "centroid_summary", "inverted_index"])
def test_texts_are_dealt_instead_of_their_words(spark, name):
    """Documents are shuffled as texts; but for posting lists, no shuffle has rows of words in documents."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = exchanged(registry.QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    of_words = [x for x in found if "doc_id" in x and "text" not in x and {"word", "w", "_w"} & set(x)]
    assert any("text" in x for x in found) and len(of_words) <= (name == "inverted_index") * 2


def test_documents_are_scored_where_they_are_dealt(spark):
    """Shuffled are texts and the scores of (item, document), of which each task keeps ten an item: no pair meets all terms of its item."""
    df = registry.QUERIES["documents_of_items"](spark, SF)
    found = exchanged(df)
    assert any("text" in x for x in found) and not any("doc_id" in x and "text" not in x and "score" not in x for x in found)
    assert "WindowGroupLimit" in plan(df)


def test_topics_write_a_row_for_each_document(spark, monkeypatch):
    """No table that a step writes has rows of words in documents."""
    tables = []
    monkeypatch.setattr(models, "written", lambda df, name: tables.append(df.columns) or df)
    registry.QUERIES["labeled_topics"](spark, SF)
    assert tables and not any("doc_id" in x and {"w", "word"} & set(x) for x in tables)


def test_topics_shuffle_a_few_times_their_input(spark):
    """Texts once, and in each step some bytes for a word of a block or of a document (57 times the input before)."""
    import os

    written_so_far = lambda: (e := spark.sparkContext._jsc.sc().statusStore().executorList(False)) and sum(e.apply(k).totalShuffleWrite() for k in range(e.size()))
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        before = written_so_far()
        assert registry.QUERIES["labeled_topics"](spark, SF.replace("0.001", "0.1")).agg({"share": "sum"}).first()[0] == pytest.approx(10000, abs=0.1)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert written_so_far() - before < 8 * os.path.getsize(SF.replace("0.001", "0.1") + "/documents.parquet")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("small", [False, True])
def test_topics_of_packed_blocks(spark, monkeypatch, small):
    """As reckoned document by document, whether blocks, their pieces and parts are large or small; rows of one number are one document."""
    import random
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    from glossa.operators import blocks, topic_blocks

    if small:
        monkeypatch.setattr(blocks, "ROWS", 3)
        monkeypatch.setattr(models, "PARTS", 3)
        packed = topic_blocks.packed

        def of_few(*a):
            run = packed(*a)

            def few(batches):
                topic_blocks.TOKENS, topic_blocks.COUNTS = 9, 4
                yield from run(batches)

            return few

        monkeypatch.setattr(topic_blocks, "packed", of_few)
    rng = random.Random(2)
    rows = [(f"d{k}", rng.sample(["x", "y", "z", None], rng.randint(0, 3)), " ".join(rng.choice(["a", "b", "\u00e9\u00e9", "long" * 9, "c"]) for _ in range(rng.randint(0, 7)))) for k in range(40)]
    rows += [("d1", ["y", "w"], "a a q"), ("d2", ["v"], ""), ("d3", ["u"], "b"), (None, ["x"], "a")]
    counts, labels = defaultdict(Counter), defaultdict(set)
    for d, own, text in rows:
        if text and d:
            counts[d].update(text.split())
            labels[d] |= {x for x in own if x}
    counts = {d: c for d, c in counts.items() if labels[d]}
    p, theta, v = None, {(d, x): 1 for d in counts for x in labels[d]}, len({w for c in counts.values() for w in c})
    for _ in range(3):
        mine, per, total = Counter(), Counter(), Counter()
        for d, c in counts.items():
            for w, n in c.items():
                q = {x: theta[d, x] * (p[x, w] if p else 1) for x in labels[d]}
                for x in q:
                    g = n * q[x] / sum(q.values())
                    mine[d, x] += g
                    per[x, w] += g
                    total[x] += g
        theta = {(d, x): (mine[d, x] + 0.1) / (sum(counts[d].values()) + 0.1 * len(labels[d])) for d, x in theta}
        p = {(x, w): (c + 0.01) / (total[x] + 0.01 * v) for (x, w), c in per.items()}
    df = spark.createDataFrame(rows, "k string, l array<string>, t string")
    phi, share = models.labeled_topics(df, "k", "l", F.filter(F.split("t", " "), lambda w: w != ""))
    assert {(r[0], r[1]): r[2] for r in share.collect()} == pytest.approx(theta)
    assert {(r[0], r[1]): r[2] for r in phi.collect()} == pytest.approx(p)


@pytest.mark.parametrize(("name", "key", "text"), [("support_ranker", "page_id", "html"), ("bigram_coverage", "doc_id", "text")])
def test_references_are_scored_where_targets_are_dealt(spark, name, key, text):
    """Shuffled are whole targets: neither their tokens nor pairs of target and reference."""
    found = exchanged(registry.QUERIES[name](spark, SF))
    assert any(text in x for x in found) and not any(key in x and text not in x for x in found)


def test_features_are_read_in_slices_of_positions():
    """Of a batch, a task holds as Python objects what few rows take."""
    import pyarrow as pa

    from glossa.operators import crf

    features = [[["a", "b"]] * n for n in (40, 0, 70, 300, 10, 10)] + [None]
    batch = pa.RecordBatch.from_pydict({"features": pa.array(features, pa.list_(pa.list_(pa.string())))})
    parts = [p.column("features").to_pylist() for p in crf._slices(iter([batch]), 100)]
    assert [x for p in parts for x in p] == features
    assert [sum(len(x or []) for x in p) for p in parts] == [40, 70, 300, 20]


def test_a_task_gives_probes_of_many_cells_in_parts(spark):
    """Every query may go to every cell; no frame of a task has all of them."""
    import numpy as np
    import pandas as pd

    from glossa.operators.vector_index import ROWS, Cells

    random = np.random.default_rng(5)
    rows = [(k, random.normal(size=4).tolist()) for k in range(600)]
    cells = Cells(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", cells=40)

    class Taken:
        columns = schema = spark.createDataFrame([], "key long, vector array<double>").schema

        def mapInPandas(self, run, schema):
            return list(run(iter([pd.DataFrame({"key": [k for k, _ in rows], "vector": [np.array(v) for _, v in rows]})])))

    everywhere = lambda f, angles, radius: np.nonzero(np.ones_like(angles, bool))
    frames = cells._probes(Taken(), everywhere)
    assert max(len(f) for f in frames) <= ROWS and sum(len(f) for f in frames) == 600 * len(cells.centroids)


@pytest.mark.parametrize("mode", ["chi-square", "perplexity", "cross-entropy"])
def test_counts_of_words_are_not_joined_with_themselves(spark, mode):
    """A word's count at a node and at its children meet in one aggregation; a word that no child has gets no score."""
    import math

    from glossa.operators.hierarchy import Tree

    docs = [("T/a", 1), ("T/a", 2), ("T/b", 3), ("T/c", 4), ("T", 5)]
    words = [("T/a", 1, "x"), ("T/a", 2, "x"), ("T/b", 3, "x"), ("T/b", 3, "y"), ("T", 5, "z"), ("T", 5, "x")]
    tree = Tree(spark.createDataFrame(docs, "path string, doc long"), spark.createDataFrame(words, "path string, doc long, word string"))
    scored = tree.scored(mode)
    assert not [line for line in plan(scored).splitlines() if "Join" in line and "word#" in line]
    at = {(r["node"], r["word"]): r for r in scored.collect()}
    assert at["T", "x"]["df"] == 4 and at["T/a", "x"]["score"] is None and at["T", "z"]["score"] is None
    if mode == "perplexity":
        assert abs(at["T", "x"]["score"] + 0.5 * math.log(0.5) + 0.25 * math.log(0.25)) < 1e-12 and at["T", "y"]["score"] == 0


def test_ways_beyond_doubt_are_followed_without_a_search(monkeypatch):
    """Where one way on is cheaper than all others, the k cheapest paths of a word graph take it as it is."""
    import heapq

    from glossa.operators import wordgraph

    a = [f"w{k}" for k in range(80)]
    graph = wordgraph.WordGraph([a, [f"x{k}" if k % 7 == 3 else w for k, w in enumerate(a)]], copies=[3, 1])
    pops = []
    monkeypatch.setattr(wordgraph.heapq, "heappop", lambda heap, pop=heapq.heappop: pops.append(1) or pop(heap))
    found = wordgraph.shortest_paths(graph, graph.cohesion_cost, 50)
    assert len(found) == 50 and found[0][1] == graph.paths[0] and len(pops) < 5 * len(graph.positions)
