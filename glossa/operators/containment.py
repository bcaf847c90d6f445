"""Finding vocabulary terms in texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.sources.storage import written

#: Characters of vocabulary in one broadcast; more of it is searched for block by block.
BLOCK_CHARS = 4 << 20


def _automaton(terms: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def occurrences(text: str, automaton, whole_words: bool) -> list[tuple[int, int, str]]:
    out = []
    for end, t in automaton.iter(text) if len(automaton) else ():
        a, b = end - len(t) + 1, end + 1
        if not whole_words or (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()):
            out.append((a, b, t))
    return out


def greedy(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Longest terms first, then by place and spelling; what is taken can't be taken again. In the order of the text."""
    taken: list[tuple[int, int, str]] = []
    used: set[int] = set()
    for a, b, t in sorted(found, key=lambda x: (x[0] - x[1], x[0], x[2])):
        if used.isdisjoint(range(a, b)):
            used.update(range(a, b))
            taken.append((a, b, t))
    return sorted(taken)


def find_terms(df: DataFrame, key: str, text: str, vocabulary: DataFrame, term: str, whole_words: bool = True) -> DataFrame:
    """key, start, term of the terms in each text (J14): longest first, matches consumed; lower case on both sides.

    The vocabulary is read in blocks of at most BLOCK_CHARS; each adds its
    occurrences to the row, and the last step chooses among all of them.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.lower(text).alias("t"), F.array().cast("array<struct<a:int,b:int,w:string>>").alias("found"))
    block: list[str] = []
    size = 0

    def searched(rows: DataFrame, terms: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared.value)
            for b in batches:
                old = b.column("found").to_pylist()
                new = [f + [{"a": x, "b": y, "w": w} for x, y, w in occurrences(t or "", automaton, whole_words)] for t, f in zip(b.column("t").to_pylist(), old, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("t"), pa.array(new, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("w", pa.string())])))], [key, "t", "found"])

        return rows.mapInArrow(run, f"`{key}` {kind}, t string, found array<struct<a:int,b:int,w:string>>")

    for r in vocabulary.select(F.lower(term).alias("w")).filter("w <> ''").distinct().toLocalIterator():
        if block and size + len(r["w"]) > BLOCK_CHARS:
            rows, block, size = searched(rows, block), [], 0
        block.append(r["w"])
        size += len(r["w"])
    rows = searched(rows, block)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, starts, terms = [], [], []
            for k, f in zip(b.column(key).to_pylist(), b.column("found").to_pylist(), strict=True):
                for a, _, w in greedy([(x["a"], x["b"], x["w"]) for x in f]):
                    keys.append(k)
                    starts.append(a)
                    terms.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(key).type), pa.array(starts, pa.int32()), pa.array(terms, pa.string())], [key, "start", "term"])

    return rows.select(key, "found").mapInArrow(choose, f"`{key}` {kind}, start int, term string")


def find_phrases(df: DataFrame, key: str, words: str, vocabulary: DataFrame, term: str) -> DataFrame:
    """key, start, term of the vocabulary's terms in arrays of words (J14): longest first, matches consumed; lower case on both sides.

    start counts words from 0. Terms of one word or more are parted by spaces.
    Texts and vocabulary are joined on runs of words, of the lengths that terms
    have, so neither passes through the driver or one task; the vocabulary is
    written first, so that the occurrences of a frequent term are split. Only
    the matches of a text that overlap others are chosen among in one group.
    """
    v = vocabulary.select(F.trim(F.regexp_replace(F.lower(term), r"\s+", " ")).alias("_g")).filter("_g <> ''").distinct()
    v = written(v.withColumn("_m", F.size(F.split("_g", " "))), "terms")
    lengths = sorted(r["_m"] for r in v.select("_m").distinct().collect())  # as many as terms differ in length
    low = df.select(F.col(key).alias("_k"), F.transform(words, F.lower).alias("_w"))
    if not lengths:
        return df.select(key, F.lit(0).alias("start"), F.lit("").alias("term")).limit(0)

    def runs(m: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size("_w") - m), lambda i: F.struct(i.alias("start"), F.lit(m).alias("_m"), F.array_join(F.slice("_w", i + 1, m), " ").alias("_g")))
        return F.when(F.size("_w") >= m, made).otherwise(F.array().cast("array<struct<start:int,_m:int,_g:string>>"))

    each = low.withColumn("_id", F.monotonically_increasing_id()).select("_k", "_id", F.explode(F.concat(*map(runs, lengths))).alias("x")).select("_k", "_id", "x.*")
    hits = each.join(v, ["_g", "_m"]).select("_k", "_id", "start", "_m", "_g")
    if lengths == [1]:
        return hits.select(F.col("_k").alias(key), "start", F.col("_g").alias("term"))

    def chosen(rows: pa.Table) -> pa.Table:
        found = greedy([(a, a + m, g) for a, m, g in zip(*(rows[c].to_pylist() for c in ("start", "_m", "_g")), strict=True)])
        return pa.table({key: pa.array([rows["_k"][0].as_py()] * len(found), rows["_k"].type), "start": pa.array([a for a, _, _ in found], pa.int32()), "term": pa.array([g for *_, g in found], pa.string())})

    hits = written(hits, "hits")  # row numbers are given once
    return hits.groupBy("_id").applyInArrow(chosen, f"`{key}` {df.schema[key].dataType.simpleString()}, start int, term string")


def segment(word: str, dictionary: set[str]) -> list[str]:
    """A URL word cut into dictionary words: the longest from the left, character by character (T24, T25); a rest stays whole."""
    if word in dictionary:
        return [word]
    out, a = [], 0
    while a < len(word):
        b = max((b for b in range(a + 2, len(word) + 1) if word[a:b] in dictionary), default=None)
        if b is None:
            out.append(word[a:])
            break
        out.append(word[a:b])
        a = b
    return out


def segment_urls(df: DataFrame, key: str, words: str, dictionary: str) -> DataFrame:
    """key and the url words of the array ``words``, each cut by the page's own dictionary array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = []
            for ws, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                known = set(d or ())
                cut.append([p for w in ws or () for p in segment(w, known)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.list_(pa.string()))], [key, "segments"])

    return df.select(key, words, dictionary).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, segments array<string>")


def chunks(lines: list[str]) -> list[tuple[str, str, list[str]]]:
    """CoNLL lines ``token tag chunk`` -> (kind, tags, tokens) of the chunks (T38); lines outside chunks are their own, of kind O."""
    out: list[tuple[str, str, list[str]]] = []
    for line in lines:
        token, tag, chunk = (line.split() + ["O"] * 3)[:3]
        kind = chunk[2:] if chunk[1:2] == "-" else "O"
        if chunk.startswith("I-") and out and out[-1][0] == kind:
            out[-1] = (kind, f"{out[-1][1]} {tag}", [*out[-1][2], token])
        else:
            out.append((kind, tag, [token]))
    return out
