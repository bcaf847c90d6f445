"""Operators on small tables: edges, partition invariance, sources, streams."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from glossa.operators import clustering, counts, evaluation, filters, joins, models, retrieval, secondary, splits, summarize, wordgraph
from glossa.sources import readers, sinks
from glossa.streaming import counts as streaming


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_reject_reasons(spark):
    data = [("http://a/b", "t", "d", "c"), ("ftp://a", "t", "d", "c"), ("http://a?x", "t", "d", "c"), ("http://a b", "t", "d", "c"), ("http://a", "", "d", "c"), ("http://a", "0", None, "c"), ("http://a", "t", "d", ""), ("http://a", "t", "d", "x" * 500_000), ("http://a", "t", "d", "x" * 500_001), (None, "t", "d", "c")]
    df = spark.createDataFrame(data, "url string, title string, description string, content string")
    got = [r.x for r in df.select(filters.reject_reason("url", "title", "description", "content").alias("x")).collect()]
    assert got == [None, "scheme", "query", "space", "title", "description", "content", None, "length", "scheme"]


def test_outlier_bounds(spark):
    data = [("ok", f"h{i // 10}") for i in range(200)] + [("host", "h") for _ in range(11)] + [("all", f"g{i // 10}") for i in range(201)]
    got = filters.outlier_categories(spark.createDataFrame(data, "category string, host string"), "category", "host")
    assert {r.category for r in got.collect()} == {"ok"} and got.count() == 200


def test_merge_counts_gives_the_last_group(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, n int")
    assert rows(counts.merge_counts(df, ["k"], "n")) == [("a", 1, 1), ("b", 5, 2)]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ordinals_do_not_depend_on_partitions(spark, parts):
    df = spark.range(101).select(((F.col("id") * 37) % 101).alias("x")).repartition(parts)
    assert rows(joins.with_ordinal(df, ["x"]), "x", "ord") == sorted(((i, i + 1) for i in range(101)), key=str)


def test_splits_and_folds(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    assert [s for _, s in sorted(rows(splits.split_corpus(df, ["x"], 60, 20, 20), "x", "split"))] == ["test"] * 2 + ["dev"] * 2 + ["train"] * 6
    with pytest.raises(ValueError):
        splits.split_corpus(df, ["x"], 60, 20, 30)
    assert [f for _, f in sorted(rows(splits.folds(df, ["x"], "p", 25), "x", "fold"))] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert {f for _, f in rows(splits.folds(df, ["x"], "n", 4), "x", "fold")} == {0, 1, 2} and {f for _, f in rows(splits.folds(df, ["x"], "all", 0), "x", "fold")} == {0}


def test_explode_parallel_needs_equal_sizes(spark):
    df = spark.createDataFrame([("a", ["x", "y"], [1, 0])], "k string, t array<string>, f array<int>")
    assert rows(counts.explode_parallel(df, "k", "t", "f")) == [("a", "x")]
    with pytest.raises(Exception, match="unequal"):
        counts.explode_parallel(spark.createDataFrame([("a", ["x"], [1, 0])], df.schema), "k", "t", "f").collect()


def test_sigils(spark):
    df = spark.createDataFrame([("a", "1", "2", "x", "p"), ("a", "N/A", "4", "y", "q"), ("b", "3", "N/A", "N/A", "r")], "token string, `+n` string, `/m` string, other string, `@key` string")
    got = {r.token: (r.id, r.json) for r in counts.sigil_aggregate(df, "token").collect()}
    assert got["a"] == (0, '{"n":1.0,"n::list":[1.0],"m":3.0,"m::list":[2.0,4.0],"other::list":["x","y"]}')
    assert got["b"] == (1, '{"n":3.0,"n::list":[3.0],"m":0.0,"m::list":[],"other::list":[]}')


def test_rank_fusion_places_the_missing_last(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 1.0)], "i string, s double")
    b = spark.createDataFrame([("z", 1.0)], "i string, s double")
    assert rows(retrieval.rank_fusion([a, b], "i", "s")) == [("x", 3, 1), ("y", 4, 2), ("z", 4, 3)]


def test_threshold_sweep(spark):
    df = spark.createDataFrame([(0, 1.0), (2, 3.0), (9, 5.0)], "size int, m double")
    assert rows(evaluation.threshold_sweep(df, "size", ["m"], 3)) == [(0, 3, 3.0), (1, 2, 4.0), (2, 2, 4.0), (3, 1, 5.0)]


def test_translation_learns(spark):
    df = spark.createDataFrame([(1, ["das", "haus"], ["the", "house"]), (2, ["das", "buch"], ["the", "book"]), (3, ["ein", "buch"], ["a", "book"])], "k long, s array<string>, t array<string>")
    p = {(r.source, r.target): r.p for r in models.translation_model(df, "k", "s", "t", 12).collect()}
    assert p["das", "the"] > 0.6 and p["buch", "book"] > 0.6 and p["haus", "house"] > p["haus", "the"]
    total = {}
    for (s, _), v in p.items():
        total[s] = total.get(s, 0) + v
    assert all(v == pytest.approx(1.0, abs=1e-3) for v in total.values())


def test_posting_blocks_are_bounded(spark):
    t = spark.range(300).select((F.col("id") % 100).alias("doc"), F.lit("the").alias("w")).unionByName(spark.range(3).select(F.col("id").alias("doc"), F.lit("rare").alias("w")))
    blocks = counts.posting_blocks(t, "doc", "w", 10).collect()
    assert sorted(d for r in blocks if r.w == "the" for d in r.postings) == list(range(100)) and {r.df for r in blocks if r.w == "the"} == {100}
    assert max(len(r.postings) for r in blocks) < 30 and [r.postings for r in blocks if r.w == "rare"] == [[0, 1, 2]]


def test_alignment_and_adaptation(spark):
    df = spark.createDataFrame([(1, ["the", "cats", "ran", "zzz"], ["cat", "the", "rat"]), (2, [], ["x"])], "k long, a array<string>, b array<string>")
    assert [x[:3] for x in rows(summarize.align_words(df, "k", "a", "b"))] == [(1, "cats", "cat"), (1, "ran", "rat"), (1, "the", "the")]
    keep = spark.createDataFrame([("zzz",)], "word string")
    assert rows(summarize.adapt_references(df, "k", "a", "b", keep, "word")) == [(1, "the cat rat zzz")]


def test_alignment_takes_all_words(spark):
    words = [f"{i:03d}{'abcdefgh'[i % 8]}" for i in range(230)]
    df = spark.createDataFrame([(1, words, words[::-1])], "k long, a array<string>, b array<string>")
    assert rows(summarize.align_words(df, "k", "a", "b")) == [(1, w, w, 0.0) for w in words]


def test_iterative_query(spark):
    q = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "q long, term string, rank long")
    posts = spark.createDataFrame([(1, "x"), (2, "y"), (2, "x"), (3, "y")], "doc long, term string")
    sim = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.1)], "q long, doc long, score double")
    assert rows(retrieval.iterative_query(q, posts, sim, "q", "term", "rank", "doc")) == [(0, 1, 0.85, [1, 2])]


def test_leaks(spark):
    c = spark.createDataFrame([("u", ["a", "b", "c", "d", "x"]), ("u", ["q", "r"]), ("v", ["a", "b"])], "k string, t array<string>")
    r = spark.createDataFrame([("u", ["a", "b", "c", "d"]), ("u", ["q"])], "k string, r array<string>")
    assert rows(clustering.leaked(c, r, "k", "t", "r").select("k", F.array_join("t", " ").alias("t"))) == [("v", "a b")]


@pytest.mark.parametrize("link", ["single", "average", "all"])
def test_blocks_lose_no_pair(spark, link):
    words = {i: [f"w{i % 7}", f"x{i % 5}", f"y{i // 6}", "z" if i % 9 else f"q{i}"] for i in range(60)}
    df = spark.createDataFrame([("a" if i < 45 else "b", i, w) for i, w in words.items()], "g string, i long, w array<string>")
    groups = {"a": range(45), "b": range(45, 60)}
    score = {(g, a, b): clustering.lcs_over_max(words[a], words[b]) for g, ids in groups.items() for a in ids for b in ids if a < b}
    assert {(r.g, r.a, r.b): r.overlap for r in clustering.pair_overlaps(df, "g", "i", "w", 10).collect()} == score
    assert clustering.pair_overlaps(df, "g", "i", "w", 10).count() == len(score)
    near = {i: min((-s, b if a == i else a) for (_, a, b), s in score.items() if i in (a, b)) for i in words}
    assert {r.i: (-r.overlap, r.nearest) for r in clustering.nearest_in_group(df, "g", "i", "w", 10).collect()} == near
    for threshold in (0.25, 0.5):
        want = [(g, 0, i, c) for g, ids in groups.items() for i, c in zip(ids, clustering.agglomerate(len(ids), lambda x, y, ids=ids: clustering.lcs_over_max(words[ids[x]], words[ids[y]]), threshold, link)[0], strict=True)]
        assert rows(clustering.cluster_groups(df, "g", "i", "w", threshold, link, 10)) == sorted(want, key=str)


def test_word_graphs_take_all_sentences(spark):
    said = ["the old red fox ran over the hill", "the old red fox ran over the field", "a b"]
    df = spark.createDataFrame([("c", 3 * i + k, s.split()) for i in range(20) for k, s in enumerate(said)], "g string, i long, w array<string>")
    got = wordgraph.compress_groups(df, "g", "i", "w", least=6).collect()
    assert sum(r.n for r in got) == 60 and {r.summary for r in got if r.n != 20} <= {*said[:2]} and "" in {r.summary for r in got}
    alone, thrice = wordgraph.WordGraph([["a", "b"]] * 3 + [["a", "c"]]), wordgraph.WordGraph([["a", "b"], ["a", "c"]], copies=[3, 1])
    assert {e: alone.cohesion_cost(*e[:2]) for e in alone.edges()} == {e: thrice.cohesion_cost(*e[:2]) for e in thrice.edges()}


def test_word_graphs_grow_with_their_sentences(monkeypatch):
    """A node that all sentences share isn't gone through for each of them, and paths that can't be among the cheapest aren't looked for."""
    import random

    class Counted(dict):
        read = 0

        def __iter__(self):
            Counted.read += len(self)
            return super().__iter__()

    class Graph(wordgraph.WordGraph):
        def _place(self, *args):
            for side in (self.before, self.after):
                for n in side:
                    if not isinstance(side[n], Counted):
                        side[n] = Counted(side[n])
            return super()._place(*args)

    Graph([["hub", f"x{k}", "end"] for k in range(200)])
    assert Counted.read <= 2_000  # it was 200 * 200

    pushed, push = [], wordgraph.heapq.heappush
    monkeypatch.setattr(wordgraph.heapq, "heappush", lambda h, x: pushed.append(1) or push(h, x))
    rng = random.Random(9)
    g = wordgraph.WordGraph([[rng.choice("abcdefghij") for _ in range(12)] for _ in range(12)])
    assert len(wordgraph.shortest_paths(g, g.cohesion_cost, 50)) == 50 and len(pushed) <= 1_400  # 2803 before


def test_cheapest_paths_as_all_paths():
    import random

    def every(g, path):
        if path[-1] == (wordgraph.END, 0):
            yield path
        for n in g.after.get(path[-1], ()):
            if n not in path:
                yield from every(g, [*path, n])

    rng = random.Random(6)
    for _ in range(60):
        g = wordgraph.WordGraph([[rng.choice("abcdef") for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 5))], copies=None)
        paths = list(every(g, [(wordgraph.START, 0)]))
        costs = sorted(round(sum(g.cohesion_cost(a, b) for a, b in zip(p, p[1:], strict=False)), 9) for p in paths)
        for k in (1, 7, 50):
            found = wordgraph.shortest_paths(g, g.cohesion_cost, k)
            assert [round(c, 9) for c, _ in found] == costs[:k] and all(p in paths for _, p in found) and len({tuple(p) for _, p in found}) == len(found)


def test_word_graph_reads_every_sentence(spark, tmp_path):
    from glossa.plans.models import word_graph_fusion

    docs = [(i, f"Short one. The quick brown fox number {i} jumps over the dog. Another sentence stands here number {i} too.", "s", "en") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(r.n for r in word_graph_fusion(spark, str(tmp_path)).collect()) == 90


def test_leaks_of_any_reference(spark, tmp_path):
    import random

    from glossa.plans.further import context_filter

    rng = random.Random(3)
    refs = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 12))] for _ in range(60)]
    said = [[w for w in rng.choice(refs) if rng.random() < 0.97] + ["z"] * (k % 2) for k in range(150)] + [[]]
    want = [k for k, c in enumerate(said) if not any(clustering.lcs_length(c, r) / len(r) > 0.9 for r in refs)]
    got = clustering.leaked_any(spark.createDataFrame(list(enumerate(said)), "k long, w array<string>"), spark.createDataFrame([(r,) for r in refs], "r array<string>"), "w", "r")
    assert sorted(r.k for r in got.collect()) == want and 0 < len(want) < 150
    spark.createDataFrame([(i, f"reference number {i} has its very own words w{i} x{i} y{i}") for i in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "reference number 55 has its very own words w55 x55 y55"), (2, "nothing of that kind")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in context_filter(spark, str(tmp_path)).collect()] == [2]


def test_every_frequent_term_has_a_classifier(spark, tmp_path):
    from glossa.plans.further import per_term_classifiers

    texts = [(k, " ".join(f"often{j}" for j in range(12) if (k + j) % 2) + f" rare{k // 4}") for k in range(20)]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.term: r.n for r in per_term_classifiers(spark, str(tmp_path)).collect()} == {f"often{j}": 20 for j in range(12)}


def test_secondary(spark):
    d = spark.createDataFrame([("Dogs", "Run"), ("ROOT", "Run"), ("Dogs", "."), ("dogs", "run")], "head string, dependent string")
    assert rows(secondary.dependency_pairs(d)) == [("dogs-run", 2)]
    m = spark.createDataFrame([("s1", "PER", "Ann"), ("s1", "PER", "Ann"), ("s2", "PER", "Ann")], "segment string, type string, entity string")
    assert rows(secondary.entity_counts(m)) == [("PER", "Ann", 2)]
    t, s = spark.createDataFrame([("a", 2), ("b", 3)], "token string, n int"), spark.createDataFrame([("a", "S"), ("b", "S"), ("b", "R")], "token string, synset string")
    assert rows(secondary.synset_counts(t, s)) == [("R", 3), ("S", 5)]
    x = spark.createDataFrame([("u", "<Context><ContextElement>a</ContextElement><ContextElement>b</ContextElement></Context>"), ("v", "<Context><ContextElement>c</ContextElement></Context>")], "u string, x string")
    assert rows(secondary.contexts_from_xml(x, "x")) == [("u", 0, "a"), ("u", 1, "b"), ("v", 0, "c")]
    # any number of neighbours
    star = spark.createDataFrame([("c", "a", f"b{i:02}") for i in range(40)], "category string, a string, b string")
    assert clustering.cliques(star).count() == 40
    rng = random.Random(0)
    pairs = {tuple(sorted(rng.sample("abcdefghijklmnop", 2))) for _ in range(60)}
    want = {c for n in range(2, 8) for c in itertools.combinations("abcdefghijklmnop", n) if all(p in pairs for p in itertools.combinations(c, 2))}
    got = clustering.cliques(spark.createDataFrame([("c", *p) for p in pairs], "category string, a string, b string")).collect()
    assert sorted(tuple(r.clique.split()) for r in got) == sorted(want)


# -- sources and sinks ---------------------------------------------------------------------------


def test_tsv(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('http://a\t"q\tcat\nb\tx\n')
    assert rows(readers.tsv(spark, str(tmp_path / "x.tsv"), ["url", "title", "category"])) == [("b", "x", None), ("http://a", '"q', "cat")]
    (tmp_path / "h.tsv").write_text("a\tb\n1\t2\n")
    assert rows(readers.tsv_with_header(spark, str(tmp_path / "h.tsv"))) == [("1", "2")]
    (tmp_path / "q.csv").write_text('a,b\n"x, ""y""","line\nend"\n')
    assert rows(readers.csv_quoted(spark, str(tmp_path / "q.csv"))) == [('x, "y"', "line\nend")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ty"), ("b", None)], "k string, v string")
    sinks.write_tsv(df, f"{tmp_path}/t", gzip=True)
    assert rows(readers.tsv(spark, f"{tmp_path}/t", ["k", "v"])) == [("a", "x y"), ("b", "__EMPTY_VALUE__")]
    v = spark.createDataFrame([(1, "dog", 5, {"a": 0.5})], "id int, word string, tf long, semantic map<string,double>")
    sinks.write_vocabulary(v, f"{tmp_path}/v")
    assert readers.vocabulary(spark, f"{tmp_path}/v").first().semantic == {"a": 0.5}
    sinks.write_split(df, f"{tmp_path}/s", ["k"])
    assert sorted(p.name for p in (tmp_path / "s").glob("k=*")) == ["k=a", "k=b"]
    sinks.write_latex(df, f"{tmp_path}/l")
    assert rows(spark.read.text(f"{tmp_path}/l")) == [("a & x\ty \\\\",), ("b &  \\\\",)]
    sinks.write_mapping(spark.createDataFrame([("e", "c2"), ("e", "c1"), ("bad one", "c")], "e string, c string"), f"{tmp_path}/m", "e", "c")
    assert rows(spark.read.parquet(f"{tmp_path}/m")) == [("e", ["c1", "c2"])]
    sinks.write_batches(spark.range(10).coalesce(1), f"{tmp_path}/b", 4)
    assert len(list((tmp_path / "b").glob("*.gz"))) == 3
    (tmp_path / "base").write_text("u1\tA\nu2\tB\n")
    (tmp_path / "base.json").write_text('u1\t{"x":1}\n')
    got = readers.category_table(spark, f"{tmp_path}/base", ["json"], json={"json": "map<string,int>"})
    assert rows(got) == [("u1", "A", {"x": 1}), ("u2", "B", None)]


def test_keyed_table(spark, tmp_path):
    t = sinks.KeyedTable(spark, f"{tmp_path}/k", "k")
    assert t.read() is None
    t.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"))
    t.upsert(spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"))
    t.upsert(spark.createDataFrame([("c", 3), ("d", 3)], "k string, v int"), overwrite=False)
    assert rows(t.read()) == [("a", 1), ("b", 2), ("c", 2), ("d", 3)]
    t.upsert(spark.createDataFrame([("e", 5), ("e", 4), ("a", 9), ("a", 9)], "k string, v int"))
    assert rows(t.read()) == [("a", 9), ("b", 2), ("c", 2), ("d", 3), ("e", 5)]


def test_two_writers_of_a_keyed_table(spark, tmp_path, monkeypatch):
    """One commits while the other writes: the other merges its rows into what is there then."""
    a, b = (sinks.KeyedTable(spark, f"{tmp_path}/k", "k") for _ in range(2))
    real, met = sinks.commit, []

    def slow(*args):
        if not met:
            met.append(1)
            b.upsert(spark.createDataFrame([("x", 1)], "k string, v int"))
        return real(*args)

    monkeypatch.setattr(sinks, "commit", slow)
    a.upsert(spark.createDataFrame([("y", 2)], "k string, v int"))
    assert rows(a.read()) == rows(b.read()) == [("x", 1), ("y", 2)] and a.version() == 2


# -- streams -------------------------------------------------------------------------------------


def test_replayed_batches_count_once(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    sink = streaming.CountSink(f"{tmp_path}/out", ["k"])
    for batch in (0, 1, 1):
        sink(df, batch)
    assert rows(sink.totals(spark)) == [("a", 4, 4), ("b", 2, 2)]
    # another run keeps what is there, and a folder that was not written to the end doesn't count
    other = streaming.CountSink(f"{tmp_path}/out", ["k"], run="other")
    other(df, 0)
    df.selectExpr("k", "1L n", "1L n_rows").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_path}/out/run=0/batch=9")
    assert rows(other.totals(spark)) == [("a", 6, 6), ("b", 3, 3)]


def test_group_flush(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a",)] * 3 + [("b",)], "k string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = StructType().add("k", StringType())
    stream = streaming.stream_table(spark, f"{tmp_path}/in/*", schema)
    q = streaming.group_flush(stream, "k", 4).writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("flushed")) == [("a", 4), ("a", 4)]


def test_late_rows_fall_out_of_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:04:00", "x"), ("2024-01-01 00:06:00", "x")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in streaming.windowed(df, "ts", ["k"], "5 minutes").collect()) == [1, 2]
    assert [r.n for r in streaming.sessions(df, "ts", "k", "10 minutes").collect()] == [3]


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components_with_a_hub_and_groups(spark, monkeypatch, small):
    """A hub with most of the links, chains, self links and nulls, within groups and without; least neighbours written and not."""
    from glossa.operators import components as module
    from glossa.operators.components import components

    monkeypatch.setattr(module, "SMALL", small)
    hub = [("a", 500, i) for i in range(500)] + [("a", 499, 1000), ("a", 1000, 1001)]
    chain = [("b", i, i + 1) for i in range(20)] + [("b", 100, 100), ("b", None, 3), (None, 1, 2)]
    edges = spark.createDataFrame(hub + chain, "g string, u long, v long")
    found = {(r.g, r.node): r.root for r in components(edges, "g").collect()}
    assert {found["a", i] for i in [*range(501), 1000, 1001]} == {0}
    assert {found["b", i] for i in range(21)} == {0} and ("b", 100) not in found and len(found) >= 503 + 21
    plain = {r.node: r.root for r in components(edges.drop("g")).collect()}
    assert set(plain.values()) == {0} and len(plain) == 503
    assert components(edges.filter("u < 0")).count() == 0
