"""Counting and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.operators.blocks import BLOCK
from glossa.operators.joins import with_ordinal


def merge_counts(df: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Sum of the counts and number of rows for each key (A1); every group is given."""
    return df.groupBy(*keys).agg(F.sum(count).alias("n"), F.count("*").alias("n_rows"))


def sigil_aggregate(df: DataFrame, key: str, missing: str = "N/A") -> DataFrame:
    """Aggregate by the first letter of the columns' names (A2).

    "/" averages over the group's rows, "+" sums, "@" is left out; every other
    value is also listed in order. Returns the key, a dense id in the order of
    the keys, and a JSON object.
    """
    plain = lambda c: F.when(F.col(f"`{c}`").cast("string") != missing, F.col(f"`{c}`"))
    fields = []
    for c in df.columns:
        if c == key or c.startswith("@"):
            continue
        v = plain(c).cast("double") if c[0] in "+/" else plain(c).cast("string")
        if c.startswith("+"):
            fields.append(F.sum(v).alias(c[1:]))
        elif c.startswith("/"):
            fields.append((F.coalesce(F.sum(v), F.lit(0.0)) / F.count("*")).alias(c[1:]))
        fields.append(F.sort_array(F.collect_list(v)).alias(c.lstrip("+/") + "::list"))
    out = df.groupBy(key).agg(*fields)
    names = [f"`{c}`" for c in out.columns if c != key]
    return with_ordinal(out, [key]).select(key, (F.col("ord") - 1).alias("id"), F.to_json(F.struct(*[F.col(n) for n in names])).alias("json"))


def group_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key and sorted distinct values."""
    return df.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def id_lists(df: DataFrame, key: str, number: str) -> DataFrame:
    """Key and its numbers in order, joined by spaces."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.col(number).cast("long"))), lambda x: x.cast("string")), " ").alias("ids"))


def explode_parallel(df: DataFrame, key: str, term: str, flag: str) -> DataFrame:
    """Zip two lists of equal size and keep the (key, term) whose flag is set (A7); unequal sizes are an error."""
    both = df.withColumn("_z", F.when(F.size(term) == F.size(flag), F.arrays_zip(F.col(term).alias("t"), F.col(flag).alias("f"))).otherwise(F.raise_error(F.lit("lists of unequal size"))))
    return both.select(key, F.explode("_z").alias("_e")).filter("_e.f > 0").select(key, F.col("_e.t").alias("term"))


def category_listing(df: DataFrame, category: str, item: str) -> DataFrame:
    """Category, size, and items in order joined by spaces."""
    return df.groupBy(category).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.col(item))), " ").alias("items"))


def column_means(df: DataFrame, columns: list[str], sep: str = " & ") -> DataFrame:
    """Means with four digits joined to one line."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return means.select(F.concat_ws(sep, *[F.format_string("%.4f", c) for c in columns]).alias("line"))


def compile_ngrams(df: DataFrame, ngram: str, count: str, least: int, form: Column) -> DataFrame:
    """Counts of a normal form summed over its surfaces, those of at least ``least``, with the commonest surface."""
    per = df.groupBy(form.alias("ngram"), F.col(ngram).alias("surface")).agg(F.sum(count).alias("n"))
    return per.groupBy("ngram").agg(F.sum("n").alias("n"), F.max_by("surface", F.struct("n", "surface")).alias("surface")).filter(F.col("n") >= least)


def vocabulary_select(counts: DataFrame, word: str, count: str, least: int, top: int, skip: int = 0) -> DataFrame:
    """id, word, n: words of at least ``least`` by falling count, without the first ``skip``, ``top`` of them.

    All others make one OOV entry, whose count is the number of dropped types.
    Ranks are taken on the ``skip + top`` best rows only.
    """
    order = [F.desc(count), F.asc(word)]
    best = counts.filter(F.col(count) >= least).orderBy(*order).limit(top + skip)
    ranked = best.withColumn("_r", F.row_number().over(W.orderBy(*order))).filter(F.col("_r") > skip)
    kept = ranked.select((F.col("_r") - skip).cast("long").alias("id"), F.col(word).alias("word"), F.col(count).cast("long").alias("n"))
    totals = counts.agg(F.count("*").alias("t")).crossJoin(best.agg(F.count("*").alias("b")))
    oov = totals.select(F.lit(0).cast("long").alias("id"), F.lit("OOV").alias("word"), (F.col("t") - F.col("b")).cast("long").alias("n"))
    return kept.unionByName(oov)


def whole_vocabulary(tokens: DataFrame, word: str) -> DataFrame:
    """word, n, id: every word by falling occurrences, ids from 1 (X3); numbered by a range sort, whatever its size."""
    n = tokens.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    return with_ordinal(n, [F.desc("n"), F.asc("word")], "id").select("word", "n", F.col("id").cast("long").alias("id"))


def mapped_pairs(pairs: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, n, source, target: sentence pairs of token arrays as lines of ids of their two vocabularies.

    n is the pair's count, 1; the vocabularies are those of ``whole_vocabulary``.
    A pair with an empty side is an empty line there.
    """

    def lines(column: str) -> DataFrame:
        each = pairs.select(key, F.posexplode(column).alias("_p", "_w"))
        ids = whole_vocabulary(each, "_w").select(F.col("word").alias("_w"), F.col("id").alias("_v"))
        lists = each.join(ids, "_w").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", "_v"))).alias("_i"))
        return lists.select(key, F.array_join(F.transform("_i", lambda x: x["_v"].cast("string")), " ").alias(column))

    out = pairs.select(key, F.lit(1).alias("n"))
    for column in (source, target):
        out = out.join(lines(column), key, "left")
    return out.fillna("", [source, target])


def map_to_ids(tokens: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """Ids of words, that of OOV for those that aren't in the vocabulary (T30, J4). A vocabulary is at most its top-n rows."""
    v = vocabulary.select(F.col("word").alias("_w"), F.col("id").alias("id"))
    return tokens.join(v, F.col(word) == F.col("_w"), "left").withColumn("id", F.coalesce("id", F.lit(0).cast("long"))).drop("_w")


#: Documents of a posting list's part, about.
POSTINGS = 100_000


def posting_blocks(tokens: DataFrame, doc: str, token: str, most: int | None = None) -> DataFrame:
    """token, df, prior = df / N, part, postings in order, of every token.

    Lists have about ``most`` documents (POSTINGS) whatever a token's frequency:
    those of a frequent token are dealt to its parts by the place of their
    number between the token's first and last, so the parts are in order.
    """
    pairs = tokens.select(token, doc).distinct()
    n = pairs.agg(F.count_distinct(doc).alias("_n"))  # shares the shuffle of the pairs
    df = pairs.groupBy(token).agg(F.count("*").alias("df"), F.min(doc).cast("double").alias("_a"), F.max(doc).cast("double").alias("_z")).crossJoin(n)
    parts = F.ceil(F.col("df") / (most or POSTINGS))
    part = F.when(F.col("_z") > F.col("_a"), F.least(F.floor((F.col(doc) - F.col("_a")) / (F.col("_z") - F.col("_a")) * parts), parts - 1)).otherwise(0).cast("int")
    dealt = pairs.join(df, token).withColumn("part", part)
    return dealt.groupBy(token, "part").agg(F.max("df").alias("df"), (F.max("df") / F.max("_n")).alias("prior"), F.sort_array(F.collect_list(doc)).alias("postings")).select(token, "df", "prior", "part", "postings")


def posting_lists(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """token, df, prior, postings: the whole list of each token as one text.

    tokens: (block, doc, token), dealt by document. A block's list of a token
    is made where the block is, so a row is shuffled for each token of a block.
    """
    each = tokens.groupBy(BLOCK, token).agg(F.collect_set(doc).alias("_d"), F.max(F.col(doc).isNull().cast("long")).alias("_none"))
    n = tokens.groupBy(BLOCK, doc).agg(F.lit(1)).agg(F.count(doc).alias("_n"))
    x = each.groupBy(token).agg((F.sum(F.size("_d")) + F.max("_none")).alias("df"), F.sort_array(F.flatten(F.collect_list("_d"))).alias("_d")).crossJoin(n)
    return x.select(token, "df", (F.col("df") / F.col("_n")).alias("prior"), F.array_join(F.col("_d").cast("array<string>"), ",").alias("postings"))


def pair_counts(items: DataFrame, group: str, item: str) -> DataFrame:
    """Undirected co-occurrence: item pairs a < b and in how many groups both are.

    The join on the group lists each group's pairs, which are the result, so
    callers keep groups small.
    """
    pairs = items.select(group, item).distinct()
    a, b = pairs.select(group, F.col(item).alias("a")), pairs.select(group, F.col(item).alias("b"))
    return a.join(b, group).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def feature_rows(features: DataFrame, row: str, feature: str, value: str, least: int = 1) -> DataFrame:
    """row and "id:value" items by id, with ids from 1 over the features of at least ``least`` rows in order."""
    kept = features.groupBy(feature).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    ids = with_ordinal(kept, [feature], "id").select(feature, "id")
    items = features.join(ids, feature).groupBy(row).agg(F.sort_array(F.collect_list(F.struct("id", F.col(value).alias("v")))).alias("_f"))
    return items.select(row, F.array_join(F.transform("_f", lambda x: F.concat_ws(":", x["id"], x["v"])), " ").alias("features"))


def rollup_paths(df: DataFrame, path: Column, measures: dict[str, Column]) -> DataFrame:
    """Measures summed for every prefix of a category path."""
    from glossa.functions.text import category_ancestors

    per = df.groupBy(path.alias("_path")).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    return per.select(F.explode(category_ancestors("_path")).alias("category"), *measures).groupBy("category").agg(*[F.sum(n).alias(n) for n in measures])


def content_distribution(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """token, tf, df, p = tf / all tokens, tfidf = p ln(D / df) (A25). Merging distributions is unioning tokens."""
    c = tokens.groupBy(token, doc).agg(F.count("*").alias("c"))
    all_ = c.agg(F.sum("c").alias("_t"), F.count_distinct(doc).alias("_d"))
    per = c.groupBy(token).agg(F.sum("c").alias("tf"), F.count("*").alias("df"))
    p = F.col("tf") / F.col("_t")
    return per.crossJoin(all_).select(token, "tf", "df", p.alias("p"), (p * F.log(F.col("_d") / F.col("df"))).alias("tfidf"))
