"""Sparse vectors as map<string,double> columns, dense ones as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, although f names it several times."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def from_tokens(toks: Column | str, binary: bool = False) -> Column:
    """Counts of the tokens (V8, V9), or with ``binary`` ones: sorted once and counted by runs, in the order of the tokens."""

    def by_runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def counted(at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s)))
            sizes = F.zip_with(at, F.slice(ends, F.lit(1), F.size(at)), lambda a, b: F.lit(1.0) if binary else (b - a).cast("double"))
            return F.map_from_arrays(F.transform(at, lambda i: F.get(s, i)), sizes)

        return _bound(starts, counted)

    return _bound(F.array_sort(_col(toks)), by_runs)


def norm(v: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(_total(F.transform(F.map_values(_col(v)), lambda x: x * x)))


def total(v: Column | str) -> Column:
    """Plain sum of the coordinates."""
    return _total(F.map_values(_col(v)))


def scale(v: Column | str, by: Column | float) -> Column:
    return F.transform_values(_col(v), lambda _, x: x * by)


def add(a: Column | str, b: Column | str) -> Column:
    return F.map_zip_with(_col(a), _col(b), lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.map_zip_with(_col(a), _col(b), lambda _, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))


def normalized(v: Column | str) -> Column:
    """Of length 1; a zero vector as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform_values(_col(v), lambda _, x: x / n)).otherwise(_col(v))


def project(v: Column | str, onto: Column | str) -> Column:
    """Products over the coordinates of ``onto`` (V3)."""
    both = F.map_zip_with(_col(v), _col(onto), lambda _, x, y: F.coalesce(x, F.lit(0.0)) * y)
    return F.map_filter(both, lambda _, x: x.isNotNull())


def dot(a: Column | str, b: Column | str, df: Column | None = None) -> Column:
    """Inner product; with document frequencies each product is divided by their square (V4)."""
    both = F.map_zip_with(_col(a), _col(b), lambda k, x, y: x * y if df is None else x * y / F.pow(F.coalesce(df[k], F.lit(1.0)), F.lit(2)))
    return _total(F.filter(F.map_values(both), lambda x: x.isNotNull()))


def cosine(a: Column | str, b: Column | str, df: Column | None = None) -> Column:
    """0 where either is empty (V5); the lengths are not damped by document frequency."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b, df) / n).otherwise(F.lit(0.0))


def shared(a: Column | str, b: Column | str) -> Column:
    """Sum of the smaller coordinates: what two vectors of counts have in common."""
    both = F.map_zip_with(_col(a), _col(b), lambda _, x, y: F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    return _total(F.map_values(both))


def jaccard_half(a: Column | str, b: Column | str) -> Column:
    """Sum of minima over sum of both, so 0.5 for equal vectors (V6 as it is used downstream)."""
    both = total(a) + total(b)
    return F.when(both > 0, shared(a, b) / both).otherwise(F.lit(0.0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Multiset Jaccard: sum of minima over sum of maxima."""
    union = total(a) + total(b) - shared(a, b)
    return F.when(union > 0, shared(a, b) / union).otherwise(F.lit(0.0))


def dimensions(v: Column | str) -> Column:
    return F.size(F.map_keys(_col(v)))


def count_filter(v: Column | str, above: float) -> Column:
    """Entries above a threshold."""
    return F.map_filter(_col(v), lambda _, x: x > above)


def overlap_prf(a: Column | str, b: Column | str) -> tuple[Column, Column, Column]:
    """Precision, recall and F of the multiset overlap: over b, over a; 1 where that side is empty."""
    both = shared(a, b)
    p = F.when(total(b) > 0, both / total(b)).otherwise(F.lit(1.0))
    r = F.when(total(a) > 0, both / total(a)).otherwise(F.lit(1.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


# -- weights -------------------------------------------------------------------------------------


def idf(n_docs: Column, count: Column) -> Column:
    """ln(N / (1 + count))."""
    return F.log(n_docs / (count + 1))


def summary_idf(count: Column) -> Column:
    """1 / (1 + ln(1 + count))."""
    return 1 / (1 + F.log(1 + count))


def token_weights(count: Column, length: Column, prior: Column, utterance: Column) -> dict[str, Column]:
    """The three token rankers' weights."""
    return {"tfidf": 1 / (1 + count), "tfidf_length": (1 / length) / (1 + count), "utterance": prior * (length / utterance)}


#: Size of the summary corpus that priors are taken over: a fixed value.
SUMMARY_CORPUS = 1_173_510


def term_prior(count: Column) -> Column:
    """min(1, count / corpus)."""
    return F.least(F.lit(1.0), count / SUMMARY_CORPUS)


def term_relevance(count: Column) -> Column:
    return 1 - term_prior(count)


# -- distributions (V25) -------------------------------------------------------------------------


def entropy(p: Column | str) -> Column:
    """Of a map event -> probability, in nats."""
    return -_total(F.transform(F.map_values(F.map_filter(_col(p), lambda _, x: x > 0)), lambda x: x * F.log(x)))


def cross_entropy(p: Column | str, q: Column | str, floor: float = 1e-12) -> Column:
    both = F.map_zip_with(_col(p), _col(q), lambda _, x, y: -F.coalesce(x, F.lit(0.0)) * F.log(F.greatest(F.coalesce(y, F.lit(0.0)), F.lit(floor))))
    return _total(F.map_values(both))


def kl(p: Column | str, q: Column | str, floor: float = 1e-12) -> Column:
    """Smoothed Kullback-Leibler divergence."""
    return cross_entropy(p, q, floor) - entropy(p)


# -- dense ---------------------------------------------------------------------------------------


def dense_dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_cosine(a: Column | str, b: Column | str) -> Column:
    """0 where the product is 0 or not a number."""
    n = F.sqrt(dense_dot(a, a) * dense_dot(b, b))
    c = F.when(n > 0, dense_dot(a, b) / n)
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c)


def analogy(a: Column, b: Column, c: Column) -> Column:
    """b - a + c."""
    return F.zip_with(F.zip_with(b, a, lambda x, y: x.cast("double") - y.cast("double")), c, lambda x, y: x + y.cast("double"))


def word_distance(morphology: Column, semantics: Column, appearance: Column, context: Column, frequency: Column) -> Column:
    """Fixed mixture of five distances."""
    return 0.1 * morphology + 0.6 * semantics + 0.1 * appearance + 0.1 * context + 0.1 * frequency


def morphology(a: Column, b: Column) -> Column:
    """exp(-edit distance)."""
    return F.exp(-F.levenshtein(a, b).cast("double"))
