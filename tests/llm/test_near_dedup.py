import itertools
import random
import re

import pytest

from pyspark.sql import functions as F

from glossa.llm import near_dedup
from glossa.llm.hashing import Words
from glossa.llm.near_dedup import drop_near_duplicates, near_duplicates, survival, trees_for


def brute(rows, pct, k=5):
    """Every pair of rows on full sets."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= pct * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids and sets[i] else doc
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        rows.append((1000 - i, " ".join(words)))
    return rows


@pytest.mark.parametrize("pct,limit", [(85, 1024), (80, 1024), (80, 8)])
def test_as_brute_force(frame, pct, limit):
    """Also where nodes are so small that they branch and are dealt into blocks."""
    rows = corpus(pct + limit)
    df = frame(rows, "doc_id long, text string")
    assert got(near_duplicates(df, pct, node_limit=limit)) == brute(rows, pct)


def test_edges(frame):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "a b c d e"), (7, "a b c d e f"), (8, "é É é É é"), (9, "x " * 30_000), (10, "x"), (10, "y"), (11, "y"), (None, "one two"), (None, None), (12, "q r s t u v"), (12, "q r s t u v")]
    df = frame(rows, "doc_id long, text string")
    assert got(near_duplicates(df, 85)) == brute(rows, 85)


def test_ties_at_the_threshold(frame):
    """17 shared of 20 shingles is exactly 85 in 100."""
    base = [f"w{i}" for i in range(23)]
    near = [*base[:21], "x"]  # 17 of 19 + 18 - 17 = 20
    df = frame([(1, " ".join(base)), (2, " ".join(near))], "doc_id long, text string")
    assert got(near_duplicates(df, 85)) == brute([(1, " ".join(base)), (2, " ".join(near))], 85)
    assert [r[2] for r in got(near_duplicates(df, 85))] == [1, 1]


def test_empty_table(frame):
    assert got(near_duplicates(frame([], "doc_id long, text string"))) == []


def test_drop_keeps_one_of_a_group(frame):
    rows = corpus(5)
    df = frame([*rows, (None, "no id")], "doc_id long, text string")
    kept = drop_near_duplicates(df, 80)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*[d for d, _, _, keep in brute(rows, 80) if keep], None], key=str)


def test_trees_reach_the_recall():
    for s in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 1.0):
        assert (1 - survival(s)) ** trees_for(s, 0.999999) <= 1e-6
    with pytest.raises(ValueError):
        trees_for(0.3, 1 - 1e-15)


def test_survival_as_simulated():
    """A pair whose tokens agree with probability s, followed down a tree."""
    rng = random.Random(3)

    def together(s, depth):
        if depth == 0:
            return True
        children = int(1 / s) + (rng.random() < 1 / s % 1)
        return any(rng.random() < s and together(s, depth - 1) for _ in range(children))

    for s in (0.6, 0.8, 0.85):
        assert abs(sum(together(s, 4) for _ in range(20_000)) / 20_000 - survival(s)) < 0.015


def test_recall_at_the_threshold(frame):
    """5,000 pairs of similarity 80 to 83 in 100 behind one passage that all texts share: each pair is linked, nothing else."""
    rng = random.Random(11)
    shared, rows = [f"common{i}" for i in range(12)], []
    for p in range(5_000):
        words = [f"p{p}w{i}" for i in range(88)]
        other = words[: 88 - (changed := rng.randint(8, 10))] + [f"q{p}w{i}" for i in range(changed)]
        rows += [(2 * p, " ".join(shared + words)), (2 * p + 1, " ".join(shared + other))]
    df = frame(rows, "doc_id long, text string", clash=False)
    found = {r.doc_id: r.component_id for r in near_duplicates(df, 80).collect()}
    linked = sum(found[2 * p] == found[2 * p + 1] == 2 * p for p in range(5_000))
    assert linked >= 4_950
    print(f"recall at the threshold: {linked / 5_000}")


def test_recall_in_a_hard_group(frame):
    """1,000 pairs of similarity 85 to 87 in 100 among texts that are all alike at 80: nodes stay large for many branchings."""
    rng = random.Random(12)
    shared, rows = [f"common{i}" for i in range(356)], []
    for p in range(1_000):
        own = [f"p{p}w{i}" for i in range(44)]
        other = own[: 44 - (changed := rng.randint(27, 31))] + [f"q{p}w{i}" for i in range(changed)]
        rows += [(2 * p, " ".join(shared + own)), (2 * p + 1, " ".join(shared + other))]
    df = frame(rows, "doc_id long, text string", clash=False)
    found = {r.doc_id: r.component_id for r in near_duplicates(df, 85, node_limit=64).collect()}
    linked = sum(found[2 * p] == found[2 * p + 1] == 2 * p for p in range(1_000))
    print(f"recall in a hard group: {linked / 1_000}")
    assert linked >= 900 and all(found[d] in (d, d - d % 2) for d, _ in rows)


def test_strays_beside_a_large_group(frame):
    """Copies that are linked, and texts that share tokens with them: a few of these are linked to just one of the copies."""
    rng = random.Random(13)
    words, rows = [f"w{i}" for i in range(120)], []
    for d in range(300):
        mine = list(words)
        for _ in range(rng.randint(0, 3)):
            mine[rng.randrange(120)] = f"x{d}"
        rows.append((d, " ".join(mine)))
    for d in range(300, 330):
        near = rows[rng.randrange(300)][1].split()
        near[: rng.randint(8, 30)] = [f"s{d}"]
        rows.append((d, " ".join(near)))
    assert got(near_duplicates(frame(rows, "doc_id long, text string"), 85, node_limit=64)) == brute(rows, 85)


def test_a_large_group_grows_in_proportion(spark, frame):
    """Near copies of one text beyond the node limit: one component, by rows in proportion to their number."""
    made = {}
    for n in (600, 2400):
        rng = random.Random(n)
        words, rows = [f"w{i}" for i in range(200)], []
        for d in range(n):
            mine = list(words)
            for _ in range(rng.randint(1, 2)):
                mine[rng.randrange(200)] = f"x{d}"
            rows.append((d, " ".join(mine)))
        df = frame(rows, "doc_id long, text string", clash=False)
        base = df.mapInArrow(near_dedup._sketches(5), near_dedup._SKETCH)
        classes = base.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig"))
        level = near_dedup._roots(classes.withColumn("comp", F.col("cid")), range(3), 0.8)
        sized = level.join(level.groupBy("key").agg(F.count("*").alias("size")), "key")
        made[n] = near_dedup._blocks(sized, 64, near_dedup._sampled(64), F.col("size")).count(), level.count()
        assert {r.component_id for r in near_duplicates(df, 80, node_limit=64).collect()} == {0}
    assert made[2400][0] / made[2400][1] < 1.2 * made[600][0] / made[600][1] + 0.5


def test_words_are_hashed_alike_wherever_they_are():
    """Words of any length, over chunk ends and in any case, against splitting: equal hashes for equal words only."""
    rng = random.Random(5)
    words, seen = Words(near_dedup.SEPARATORS), {}
    vocabulary = ["".join(rng.choice("abé\x00\x1cẞ-9") for _ in range(rng.randint(1, 4))) for _ in range(50)] + ["ab" * 3000, "ba" * 3000, "x" * 70_000, "x" * 70_001, "y" * 4095, "y" * 4096]
    for n in (0, 1, 2, 5, 30, 300, 20_000):
        text = "".join(rng.choice(vocabulary[: 50 if n > 300 else None]) + rng.choice([" ", "\n", "\t \r", "\x0b", "\x0c"]) for _ in range(n))
        text = rng.choice(["", " "]) + (text.rstrip() if n % 2 else text)
        got, want = words(text).tolist(), text.encode().split()
        assert len(got) == len(want)
        for h, w in zip(got, want, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert words("AbC é").tolist() == words("aBc é").tolist() != words("abc É").tolist()
    assert words(None).tolist() == words("").tolist() == words(" \n").tolist() == []


def test_a_large_node_of_texts_that_are_hardly_alike_branches_once(spark):
    """One branching divides it: three at once made 1.6 rows of each, and those in between too."""
    import numpy as np

    from glossa.llm.near_dedup import PERMUTATIONS, _branched

    random = np.random.default_rng(3)
    known = spark.createDataFrame([(bytes([k // 256, k % 256]), b"c", random.integers(-(1 << 31), 1 << 31, PERMUTATIONS).tolist()) for k in range(1200)], "cid binary, comp binary, sig array<int>")
    large = known.selectExpr("cid", "5L as key", "3 as slot", "7 as stride", "0 as turn", "1200L as size")
    rows = _branched(large, known, 0.85, 64)
    assert 1200 <= rows.count() <= 2400
    assert rows.select("key", "cid").groupBy("cid").count().agg({"count": "max"}).first()[0] <= 2
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_a_class_gets_its_tokens_once_for_all_its_large_nodes(spark):
    """The join that fetches them makes a row for each class, not one for each class and node."""
    import numpy as np

    from glossa.llm.near_dedup import PERMUTATIONS, _branched

    random = np.random.default_rng(4)
    known = spark.createDataFrame([(bytes([k // 256, k % 256]), b"c", random.integers(-(1 << 31), 1 << 31, PERMUTATIONS).tolist()) for k in range(300)], "cid binary, comp binary, sig array<int>")
    nodes = spark.range(5).selectExpr("id as key", "cast(id as int) as slot", "7 as stride", "0 as turn", "300L as size")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert _branched(known.select("cid").crossJoin(nodes), known, 0.85, 64).count() >= 1500
    made, found = [], store.executionsList()
    for i in range(before, found.size()):
        values, graph = store.executionMetrics(found.apply(i).executionId()), store.planGraph(found.apply(i).executionId()).allNodes()
        for node in (graph.apply(j) for j in range(graph.size())):
            if "Join" in node.name() and "[cid" in node.desc():
                metrics = [node.metrics().apply(m) for m in range(node.metrics().size())]
                made += [int(v.get().replace(",", "")) for m in metrics if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined()]
    assert made and max(made) <= 300


def test_rows_at_nodes_are_short(spark, frame, monkeypatch):
    """A class goes to a node with a byte of each token and only those of its leaves that the node asks for."""
    from glossa.llm.near_dedup import _Join

    dealt, at_nodes = [], _Join._at_nodes
    monkeypatch.setattr(_Join, "_at_nodes", lambda self, rows: dealt.append(rows) or at_nodes(self, rows))
    rows = corpus(7)
    assert got(near_duplicates(frame(rows, "doc_id long, text string"), 80)) == brute(rows, 80)
    assert dealt and {r.schema["sig"].dataType.simpleString() for r in dealt} == {"array<tinyint>"}
    assert not any(r.filter("exists(leaves, x -> x >= node)").count() for r in dealt)


def test_rows_are_joined_with_their_nodes_once(frame, monkeypatch):
    """Children of roots that meet nobody are left before the shuffle, and below them the node's size brings all that is asked of it."""
    tables, table = {}, near_dedup.Workspace.table
    monkeypatch.setattr(near_dedup.Workspace, "table", lambda self, df, name: tables.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and table(self, df, name))
    rows = corpus(7)
    assert got(near_duplicates(frame(rows, "doc_id long, text string"), 80, node_limit=8)) == brute(rows, 80)
    deep = [name for name in tables if name.startswith("open") and int(name[4:]) > 2]
    assert deep and not any("Join" in tables[name] for name in deep)
    assert all("getbit" in tables[name] for name in ("met1", "met2"))
