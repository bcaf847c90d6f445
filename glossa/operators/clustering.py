"""Clustering and cuts within small groups.

Groups are categories or targets of any size; ``block_pairs`` makes a task of each
pair of blocks of a larger one, so that no task holds it and no pair is lost.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions.sequences import lcs_length, operations
from glossa.operators.components import components
from glossa.sources.storage import written


def agglomerate(n: int, similarity: Callable[[int, int], float], threshold: float, link: str = "single") -> tuple[list[int], list[tuple[int, float]]]:
    """Cluster numbers of n items, and the (size, score) of each merger.

    Only positive similarities count: single takes their maximum between two
    clusters, average their mean, all their minimum. The best pair merges while
    it has at least the threshold; the first of equal pairs goes first.
    """
    sims = {(i, j): s for i in range(n) for j in range(i + 1, n) if (s := similarity(i, j)) > 0}
    clusters = {i: [i] for i in range(n)}
    history = []

    def score(a: list[int], b: list[int]) -> float:
        found = [s for i in a for j in b if (s := sims.get((min(i, j), max(i, j)), 0.0)) > 0]
        return 0.0 if not found else max(found) if link == "single" else min(found) if link == "all" else sum(found) / len(found)

    between = {(a, b): s for (a, b), s in sims.items()}
    while between:
        (a, b), best = max(between.items(), key=lambda x: (x[1], -x[0][0], -x[0][1]))
        if best < threshold:
            break
        clusters[a] += clusters.pop(b)
        history.append((len(clusters[a]), best))
        between = {k: s for k, s in between.items() if b not in k and a not in k}
        for c in clusters:
            if c != a and (s := score(clusters[a], clusters[c])) > 0:
                between[min(a, c), max(a, c)] = s
    number = [0] * n
    for k, (_, members) in enumerate(sorted(clusters.items())):
        for i in members:
            number[i] = k
    return number, history


def lcs_over_max(a: list, b: list) -> float:
    m = max(len(a), len(b))
    return lcs_length(a, b) / m if m else 0.0


def block_pairs(df: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """Columns mine, lo, hi: groups above ``most`` items are cut into hashed blocks of about that size.

    A row goes to each pair of blocks that its own is part of, so that any two
    rows of a group meet in exactly one (group, lo, hi).
    """
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    cut = df.join(n, group).withColumn("_b", F.ceil(F.col("_n") / most).cast("int")).withColumn("mine", F.pmod(F.xxhash64(item), F.col("_b")).cast("int"))
    cut = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return cut.withColumn("lo", F.least("mine", "_o")).withColumn("hi", F.greatest("mine", "_o")).drop("_n", "_b", "_o")


def _pairs(f: pd.DataFrame, item: str, tokens: str) -> Iterator[tuple[object, object, float]]:
    """(a, b, overlap), a before b, of the pairs of a block with itself or with another."""
    f = f.sort_values(item)
    ids, toks, mine = f[item].tolist(), [list(x) for x in f[tokens]], f["mine"].tolist()
    within = f["lo"].iloc[0] == f["hi"].iloc[0]
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            if within or mine[i] != mine[j]:
                yield ids[i], ids[j], lcs_over_max(toks[i], toks[j])


def _kinds(df: DataFrame, *columns: str) -> list[str]:
    return [df.schema[c].dataType.simpleString() for c in columns]


def linked(df: DataFrame, group: str, item: str, tokens: str, threshold: float, most: int = 500) -> DataFrame:
    """g, u, v: a spanning forest, for each pair of blocks, of the pairs of positive similarity of at least ``threshold``."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for a, b, s in _pairs(f, item, tokens):
            if s > 0 and s >= threshold and (ra := find(a)) != (rb := find(b)):
                root[max(ra, rb)] = min(ra, rb)
        found = [(key[0], x, r) for x in root if (r := find(x)) != x]
        return pd.DataFrame(found, columns=["g", "u", "v"])

    g, i = _kinds(df, group, item)
    return block_pairs(df.select(group, item, tokens), group, item, most).groupBy(group, "lo", "hi").applyInPandas(run, f"g {g}, u {i}, v {i}")


def cluster_groups(df: DataFrame, group: str, item: str, tokens: str, threshold: float, link: str = "single", most: int = 500) -> DataFrame:
    """group, block, item, cluster by subsequence similarity of token arrays (C1); clusters are numbered by their least items.

    Single-link clusters are the components of the links of all pairs. Other
    links never merge across these, so each component, not each group, is
    agglomerated in one call. block is always 0: clusters span the whole group.
    """
    df = df.select(group, item, tokens)
    roots = components(linked(df, group, item, tokens, threshold, most), "g").select(F.col("g").alias(group), F.col("node").alias(item), "root")
    named = df.join(roots, [group, item], "left").withColumn("root", F.coalesce("root", item)).filter(F.col(group).isNotNull())
    g, i = _kinds(df, group, item)
    if link != "single":

        def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(item)
            toks = [list(x) for x in f[tokens]]
            number, _ = agglomerate(len(toks), lambda i, j: lcs_over_max(toks[i], toks[j]), threshold, link)
            ids = f[item].tolist()
            least = {c: ids[number.index(c)] for c in set(number)}
            return pd.DataFrame({group: key[0], item: ids, "root": [least[c] for c in number]})

        named = named.groupBy(group, "root").applyInPandas(run, f"`{group}` {g}, `{item}` {i}, root {i}")
    order = W.partitionBy(group).orderBy("root")
    names = named.select(group, "root").distinct().withColumn("cluster", (F.row_number().over(order) - 1).cast("int"))
    return named.join(names, [group, "root"]).select(group, F.lit(0).alias("block"), item, "cluster")


def cluster_stats(clusters: DataFrame, group: str, item: str) -> DataFrame:
    """group, n, clusters of two or more, share of items in them, share of the largest."""
    size = clusters.groupBy(group, "block", "cluster").agg(F.count("*").alias("_k"))
    big = F.when(F.col("_k") >= 2, F.col("_k"))
    return size.groupBy(group).agg(F.sum("_k").alias("n"), F.count(big).alias("n_clusters"), F.round(F.coalesce(F.sum(big), F.lit(0)) / F.sum("_k"), 6).alias("clusterable"), F.round(F.max("_k") / F.sum("_k"), 6).alias("largest"))


def pair_overlaps(df: DataFrame, group: str, item: str, tokens: str, most: int = 500) -> DataFrame:
    """group, a, b, overlap of all pairs a < b of a group (J7), LCS over the longer; each pair of blocks is a pandas call."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in _pairs(f, item, tokens)], columns=[group, "a", "b", "overlap"])

    g, i = _kinds(df, group, item)
    return block_pairs(df.select(group, item, tokens), group, item, most).groupBy(group, "lo", "hi").applyInPandas(run, f"`{group}` {g}, a {i}, b {i}, overlap double")


def nearest_in_group(df: DataFrame, group: str, item: str, tokens: str, most: int = 500) -> DataFrame:
    """item, nearest, overlap: the other of its group with the longest common subsequence (J8); the least id among equals."""
    pairs = pair_overlaps(df, group, item, tokens, most)
    both = pairs.select(F.col("a").alias(item), F.col("b").alias("o"), "overlap").unionByName(pairs.select(F.col("b").alias(item), F.col("a").alias("o"), "overlap"))
    best = both.groupBy(item).agg(F.max("overlap").alias("overlap"))
    return both.join(best, [item, "overlap"]).groupBy(item, "overlap").agg(F.min("o").alias("nearest")).select(item, "nearest", "overlap")


def leaked(contexts: DataFrame, references: DataFrame, key: str, context: str, reference: str, most: float = 0.9, least: float = 0.25) -> DataFrame:
    """Contexts without those of which a sentence holds more than ``most`` of a reference sentence.

    Both are (key, tokens) rows. Only reference sentences of at least ``least``
    of the longest's length count.
    """
    longest = references.groupBy(key).agg(F.max(F.size(reference)).alias("_m"))
    refs = references.join(longest, key).filter(F.size(reference) >= least * F.col("_m")).groupBy(key).agg(F.collect_list(reference).alias("_refs"))

    @F.pandas_udf("boolean")
    def leaks(c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([any(len(x) and lcs_length(list(t), list(x)) / len(x) > most for x in (rs if rs is not None else ())) for t, rs in zip(c, r, strict=True)])

    return contexts.join(refs, key, "left").filter(~leaks(context, "_refs")).drop("_refs")


def leaked_any(contexts: DataFrame, references: DataFrame, context: str, reference: str, most: float = 0.9) -> DataFrame:
    """Like ``leaked`` with each context held against every reference (P8), both of them token arrays.

    A common subsequence of more than ``most`` of a reference of n words has at
    least floor(most n) + 1 of them, and so one of any n - floor(most n): the
    words that are rarest among the references are its join keys, and no pair
    that leaks is missed.
    """
    refs = references.select(F.col(reference).alias("_r")).filter(F.size("_r") > 0).distinct()
    refs = refs.select(F.xxhash64("_r").alias("_id"), "_r")
    words = refs.select("_id", F.size("_r").alias("_l"), F.explode("_r").alias("_w"))
    seen = words.groupBy("_w").agg(F.count_distinct("_id").alias("_df"))
    order = W.partitionBy("_id").orderBy("_df", "_w")
    keys = words.join(seen, "_w").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= F.col("_l") - F.floor(F.lit(most) * F.col("_l"))).select("_id", "_l", "_w").distinct()

    @F.pandas_udf("boolean")
    def leaks(c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(t), list(x)) / len(x) > most for t, x in zip(c, r, strict=True)])

    # equal contexts are told by digests, so that no join deals out their words
    digest = F.unhex(F.md5(F.array_join(context, "\0")))
    said = contexts.select(digest.alias("_h"), F.col(context).alias("_c"))
    some = said.select("_h", F.size("_c").alias("_n"), F.explode(F.array_distinct("_c")).alias("_w")).join(keys, "_w")
    some = some.filter(F.col("_n") > most * F.col("_l")).select("_h", "_id").distinct()
    # the words are fetched once for each context that shares a key with some reference
    pairs = some.join(said.dropDuplicates(["_h"]), "_h").join(refs, "_id")
    bad = pairs.filter(leaks("_c", "_r")).select("_h").distinct()
    return contexts.withColumn("_h", digest).join(bad, "_h", "left_anti").drop("_h")


REACH_LEVELS = (1, 10, 20, 50, 100)  # fixed values


def reachability(ops: list[tuple[str, str, str]], known: set[str]) -> float:
    """(n + 1 + reachable) / (2n + 1): deletions are reachable, others if the new token is known."""
    ok = sum(o == "d" or new.lower() in known for o, _, new in ops)
    return (len(ops) + 1 + ok) / (2 * len(ops) + 1)


def reach_targets(pairs: DataFrame, known: str, source: str, target: str, key: list[str]) -> DataFrame:
    """key, n_ops, ratio: how far token arrays ``source`` become ``target`` with the tokens in the array ``known``."""

    @F.pandas_udf("struct<n_ops:int,ratio:double>")
    def reach(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, z in zip(a, b, k, strict=True):
            ops = operations(list(x), list(y))
            rows.append((len(ops), reachability(ops, {t.lower() for t in z})))
        return pd.DataFrame(rows, columns=["n_ops", "ratio"])

    out = pairs.withColumn("_r", reach(source, target, known))
    return out.select(*key, F.col("_r.n_ops").alias("n_ops"), F.round("_r.ratio", 6).alias("ratio"))


def reach_contingency(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """2 x 2 counts and percentages of two conditions."""
    n = df.agg(F.count("*").alias("_n"))
    c = df.groupBy(first.alias("t1"), second.alias("t2")).agg(F.count("*").alias("n")).crossJoin(n)
    return c.select("t1", "t2", "n", F.format_string("%d (%.1f%%)", F.col("n"), 100 * F.col("n") / F.col("_n")).alias("cell"))


def min_cut(edges: list[tuple[str, str, float]], source: str, sink: str) -> tuple[float, set[str]]:
    """Largest flow, and the nodes on the source's side of a least cut (C3), by shortest augmenting paths."""
    cap: dict[str, dict[str, float]] = {source: {}, sink: {}}
    for a, b, c in edges:
        cap.setdefault(a, {})[b] = cap.get(a, {}).get(b, 0.0) + c
        cap.setdefault(b, {}).setdefault(a, 0.0)
    flow = 0.0
    while True:
        parent, queue = {source: source}, deque([source])
        while queue and sink not in parent:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 1e-12 and b not in parent:
                    parent[b] = a
                    queue.append(b)
        if sink not in parent:
            return flow, set(parent)
        path, b = [], sink
        while b != source:
            path.append((parent[b], b))
            b = parent[b]
        push = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= push
            cap[b][a] += push
        flow += push


def cut_groups(edges: DataFrame, group: str, source: str = "s", sink: str = "t") -> DataFrame:
    """group, node, label: 1 on the source's side (C3), one graph a group of (src, dst, capacity)."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(f["src"], f["dst"], f["capacity"], strict=True))
        _, side = min_cut(rows, source, sink)
        nodes = sorted({x for a, b, _ in rows for x in (a, b)} - {source, sink})
        return pd.DataFrame({group: key[0], "node": nodes, "label": [int(x in side) for x in nodes]})

    return edges.groupBy(group).applyInPandas(run, f"`{group}` {edges.schema[group].dataType.simpleString()}, node string, label int")


def cliques(pairs: DataFrame) -> DataFrame:
    """Token sets of two or more that co-occur pairwise within a category (X19): (category, a, b) pairs -> (category, clique).

    Sets grow by a token at a time: two that differ in their last tokens only
    make a larger one if these two are a pair. Every step is a join that is
    written to the shared folder, so there is no bound on a token's neighbours.
    """
    e = pairs.select("category", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    e = written(e, "clique-pairs")
    level = e.select("category", F.array("a").alias("prefix"), F.col("b").alias("last"))
    found = level
    while True:
        other = level.select("category", "prefix", F.col("last").alias("b"))
        grown = level.join(other, ["category", "prefix"]).filter("last < b").join(e, (level["category"] == e["category"]) & (F.col("last") == e["a"]) & (other["b"] == e["b"]))
        level = written(grown.select(level["category"], F.concat("prefix", F.array("last")).alias("prefix"), other["b"].alias("last")), "cliques")
        if level.isEmpty():
            return found.select("category", F.array_join(F.concat("prefix", F.array("last")), " ").alias("clique"))
        found = found.unionByName(level)
