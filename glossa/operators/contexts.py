"""Contexts, chunks, entities and word distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import vectors as V

#: What stands for a link's tags in marked content.
MARK = "LINKMARK"
_ANCHOR = r"(?is)<a\s+[^>]+>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mark_links(content: Column | str) -> Column:
    """Opening link tags as a mark and their number from 0, closing ones as the mark (T21); line ends become blanks."""
    parts = F.split(F.regexp_replace(_col(content), r"\n", " "), _ANCHOR, -1)
    numbered = F.transform(parts, lambda x, i: F.when(i > 0, F.concat(F.lit(f"{MARK} "), i - 1, F.lit(" "), x)).otherwise(x))
    return F.regexp_replace(F.array_join(numbered, ""), "(?i)</a>", MARK)


def link_targets(content: Column | str) -> Column:
    """The href of each link tag by its number, "" where it has none."""
    tags = F.regexp_extract_all(F.regexp_replace(_col(content), r"\n", " "), F.lit(f"({_ANCHOR})"), 1)
    return F.transform(tags, lambda x: F.regexp_extract(x, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]*)", 1))


def unmark_links(marked: Column | str) -> Column:
    """Marked content without marks and numbers."""
    return F.regexp_replace(F.regexp_replace(_col(marked), rf"{MARK} \d+", ""), MARK, "")


def cleanse(content: Column | str) -> Column:
    """Runs of white space, line ends too, as one blank."""
    return F.regexp_replace(_col(content), r"\s+", " ")


def serialized(content: Column | str) -> Column:
    """UTF-8 text as base64 in one line."""
    return F.regexp_replace(F.base64(F.encode(_col(content), "UTF-8")), r"\s", "")


def deserialized(encoded: Column | str) -> Column:
    """Text from base64 of its UTF-8."""
    return F.decode(F.unbase64(_col(encoded)), "UTF-8")


def filtered_summaries(df: DataFrame, chunks: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each summary's chunks that a predicate holds for, all without one (P10); a summary may be left with none."""
    return df if keep is None else df.withColumn(chunks, F.filter(chunks, keep))


def word_overlap_distance(a: Column | str, b: Column | str) -> Column:
    """1 - the smaller share of distinct words that one string has in common with the other; 1 without words."""
    x, y = (F.array_distinct(T.tokens(c)) for c in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, 1 - F.size(F.array_intersect(x, y)) / most).otherwise(F.lit(1.0))


def chunk_distance(a: Column | str, b: Column | str) -> Column:
    """The least word-overlap distance of any two of the chunks' representations."""
    each = F.flatten(F.transform(_col(a), lambda x: F.transform(_col(b), lambda y: word_overlap_distance(x, y))))
    return F.coalesce(F.array_min(each), F.lit(1.0))


def merge_chunks(chunks: DataFrame, key: str, representations: str) -> DataFrame:
    """Chunks of one name merged: their distinct representations in order."""
    return chunks.select(key, F.explode(representations).alias("_r")).distinct().groupBy(key).agg(F.sort_array(F.collect_list("_r")).alias(representations))


def split_on(representation: Column | str, words: Column | str) -> Column:
    """What is left of a representation between the words of known chunks, blank pieces dropped."""
    x = T.tokens(representation)
    marked = F.array_join(F.transform(x, lambda w: F.when(F.array_contains(_col(words), w), "\t").otherwise(w)), " ")
    return F.filter(F.transform(F.split(marked, "\t"), lambda p: F.trim(p)), lambda p: p != "")


def entity_key(c: Column | str) -> Column:
    """Punctuation as blanks, lower case, trimmed."""
    return T.normalize(F.regexp_replace(_col(c), f"{T.PUNCT}+", " "))


def entity_types(strings: DataFrame, string: str, entities: DataFrame) -> DataFrame:
    """string, types of the entity whose normal form is the string's (X26), null if there is none. entities: (entity, types), distinct names."""
    known = entities.select(entity_key("entity").alias("_k"), "types").groupBy("_k").agg(F.min("types").alias("types"))
    return strings.withColumn("_k", entity_key(string)).join(known, "_k", "left").drop("_k")


def best_entities(strings: DataFrame, word: str, entities: DataFrame) -> DataFrame:
    """word, entity, types: the first entity by name that has the word as a whole word.

    Names are cut into words for an equi-join, so no string is held against all names.
    """
    each = entities.select("entity", "types", F.explode(F.array_distinct(T.tokens("entity"))).alias("_w"))
    first = each.groupBy("_w").agg(F.min(F.struct("entity", "types")).alias("_e"))
    return strings.join(first, F.lower(word) == F.col("_w")).select(word, F.col("_e.entity").alias("entity"), F.col("_e.types").alias("types"))


def semantic_similarity(instances: DataFrame, terms: DataFrame, instance: str, term: str, token: str) -> DataFrame:
    """instance, term, similarity: cosine of an instance's token counts and those of a term's text."""
    from glossa.operators.retrieval import field_ranker

    a = instances.groupBy(instance, token).agg(F.count("*").cast("double").alias("w"))
    b = terms.groupBy(term, token).agg(F.count("*").cast("double").alias("w"))
    return field_ranker(a, b, instance, term, token, "w").withColumnRenamed("score", "similarity")


def _cosine(a: Column, b: Column) -> Column:
    n = V.norm(a) * V.norm(b)
    return F.coalesce(F.when(n > 0, V.dot(a, b) / n), F.lit(0.0))


def morphological_factor(a: Column, b: Column) -> Column:
    """Ratio of the lengths times exp(-edit distance); 0 if just one of the words is a number."""
    number = [c.rlike(r"^\d") for c in (a, b)]
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    ratio = F.when(short > 0, short / long).otherwise(F.lit(1.0))
    return F.when(number[0] != number[1], F.lit(0.0)).otherwise(ratio * V.morphology(a, b))


def frequency_factor(a: Column, b: Column) -> Column:
    """Difference of two counts over the larger, 1 if both are 0."""
    return F.when(F.greatest(a, b) > 0, F.abs(a - b) / F.greatest(a, b)).otherwise(F.lit(1.0))


def composite_distance(pairs: DataFrame, a: str, b: str, words: DataFrame) -> DataFrame:
    """pairs with ``distance``: a tenth each of morphology, appearance, context and frequency, six of semantics.

    words: (word, n, meaning, appearance, context) with sparse vectors as maps;
    a word that it lacks has no count and empty vectors. It is joined to either
    side of the pairs.
    """
    empty = F.create_map().cast("map<string,double>")

    def known(side: str) -> DataFrame:
        return words.select(F.col("word").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "meaning", "appearance", "context")])

    x = pairs.join(known(a), a, "left").join(known(b), b, "left")
    cos = {c: _cosine(F.coalesce(f"{a}_{c}", empty), F.coalesce(f"{b}_{c}", empty)) for c in ("meaning", "appearance", "context")}
    n = [F.coalesce(f"{s}_n", F.lit(0)).cast("double") for s in (a, b)]
    d = V.word_distance(morphological_factor(F.col(a), F.col(b)), F.abs(cos["meaning"] - 1) / 2, 1 - cos["appearance"], 1 - cos["context"], frequency_factor(*n))
    return x.select(*pairs.columns, d.alias("distance"))
