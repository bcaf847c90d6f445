"""Text functions as column expressions; all run inside the JVM.

Punctuation is ASCII punctuation throughout, in Java as ``\\p{Punct}``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCT = r"\p{Punct}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- normalisers ---------------------------------------------------------------------------------


def trim_spaces(c: Column | str) -> Column:
    """Runs of white space to one space, none at either end."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def clean(c: Column | str) -> Column:
    """Control characters become spaces, which are then trimmed (T2); other characters stay."""
    return trim_spaces(F.regexp_replace(_col(c), r"\p{Cntrl}", " "))


def normalize(c: Column | str) -> Column:
    """Lower case without leading and trailing quotes, commas and semicolons."""
    return trim_spaces(F.regexp_replace(F.lower(_col(c)), r"^['\",;]+|['\",;]+$", ""))


def normalize_apostrophe(c: Column | str) -> Column:
    """The curly apostrophe as the straight one (T4)."""
    return F.translate(_col(c), "’", "'")


def similarity_form(c: Column | str) -> Column:
    """Lower case, runs of punctuation as a space, trimmed (T5)."""
    return trim_spaces(F.regexp_replace(F.lower(_col(c)), PUNCT + "+", " "))


def corpus_form(c: Column | str) -> Column:
    """Trimmed, one trailing punctuation mark less, lower case."""
    return F.lower(F.regexp_replace(trim_spaces(c), PUNCT + "$", ""))


def token_form(c: Column | str) -> Column:
    """Lower case without full stops, commas, quotes, semicolons and colons at the ends."""
    return F.regexp_replace(F.lower(_col(c)), "^[.,\"';:]+|[.,\"';:]+$", "")


def flatten_field(c: Column | str) -> Column:
    """Tabs and line ends as spaces, so that a value fits a field."""
    return F.regexp_replace(_col(c), r"[\t\r\n]", " ")


def strip_brackets(c: Column | str) -> Column:
    """Without [...] and (...) spans, trimmed."""
    return trim_spaces(F.regexp_replace(_col(c), r"\[[^\]]*\]|\([^)]*\)", " "))


# -- tokens --------------------------------------------------------------------------------------


def tokens_keep_punct(c: Column | str, lower: bool = True, number: bool = False) -> Column:
    """Words and single punctuation marks in order (T8); with ``number`` leading digits become NUM."""
    text = F.lower(_col(c)) if lower else _col(c)
    out = F.regexp_extract_all(text, F.lit(rf"([^\s{PUNCT}]+|{PUNCT})"), 1)
    return F.transform(out, lambda t: F.regexp_replace(t, r"^[0-9]+", "NUM")) if number else out


def tokens(c: Column | str, lower: bool = True) -> Column:
    """Words between white space and punctuation."""
    return F.regexp_extract_all(F.lower(_col(c)) if lower else _col(c), F.lit(rf"([^\s{PUNCT}]+)"), 1)


def gist_tokens(c: Column | str) -> Column:
    """Runs of ASCII word characters and every other visible character by itself."""
    return F.regexp_extract_all(_col(c), F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_\s])"), 1)


def words(c: Column | str) -> Column:
    """What stands between white space."""
    return F.filter(F.split(_col(c), r"\s+"), lambda t: t != "")


def sentences(c: Column | str) -> Column:
    """Sentences: cut after .!? that follow a word character and precede a capital, and at control characters; each must end visibly."""
    cut = F.split(_col(c), r"(?<=\w[.!?])\s+(?=\p{Lu})|\p{Cntrl}+")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s.rlike(r"\S$"))


def piece_count(c: Column | str) -> Column:
    """Length of a summary in pieces between white space and punctuation."""
    return F.size(F.filter(F.split(_col(c), rf"[\s{PUNCT}]+"), lambda t: t != ""))


def ngrams(toks: Column | str, n: int, pad: bool = False, edges: bool = False) -> Column:
    """n-grams joined by spaces.

    pad: n - 1 [[NULL]] on either side, so len + n - 1 of them (T26). edges: also
    the shorter prefixes before the first and the tail of n - 1 after the last
    (T27). Neither: only full n-grams.
    """
    t = _col(toks)
    if pad:
        nulls = F.array_repeat(F.lit("[[NULL]]"), n - 1)
        t = F.concat(nulls, t, nulls)
    size = F.size(t)
    full = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
    if pad:
        return F.when(F.size(_col(toks)) > 0, full).otherwise(F.array().cast("array<string>"))
    if not edges or n == 1:
        return full
    prefixes = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.when(size >= i, F.array_join(F.slice(t, 1, i), " ")))
    tail = F.when(size >= n, F.array_join(F.slice(t, size - (n - 2), n - 1), " "))
    return F.filter(F.concat(prefixes, full, F.array(tail)), lambda g: g.isNotNull())


def char_ngrams(c: Column | str, n: int) -> Column:
    """Character n-grams in order."""
    size = F.length(_col(c))
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(_col(c), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_key(c: Column | str) -> Column:
    """md5 of a surface."""
    return F.md5(_col(c))


def token_pattern(surface: str, anywhere: bool = False, plural: bool = False, capture: bool = False) -> str:
    """A pattern that finds a token: between word bounds or anywhere, maybe with a plural end, maybe captured."""
    body = "\\Q" + surface.replace("\\E", "\\E\\\\E\\Q") + "\\E" + ("(?:s|es)?" if plural else "")
    body = f"({body})" if capture else body
    return body if anywhere else rf"\b{body}\b"


def count_matches(c: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(_col(c), F.lit(("(?i)" if ignore_case else "") + pattern))


# -- token predicates (P15, P19) -----------------------------------------------------------------


def is_punctuation(t: Column | str) -> Column:
    return _col(t).rlike(rf"^{PUNCT}+$")


def is_numeric(t: Column | str) -> Column:
    return _col(t).rlike(r"^[+-]?[0-9]+([.,][0-9]+)*$")


def is_quote(t: Column | str) -> Column:
    return _col(t).isin("'", '"', "`", "``", "''")


def is_valid_token(t: Column | str) -> Column:
    """Longer than one character and not punctuation only."""
    return (F.length(_col(t)) > 1) & ~is_punctuation(t)


def has_pos(tag: Column | str, kind: str) -> Column:
    """Whether a Penn tag is of a kind: noun, adjective, adverb, verb."""
    return _col(tag).rlike({"noun": "^NN", "adjective": "^JJ", "adverb": "^RB", "verb": "^VB"}[kind])


def filter_tagged(c: Column | str) -> Column:
    """Of ``token/TAG`` items keep the pairs, but not punctuation whose tag isn't itself."""
    items = F.filter(F.split(_col(c), " "), lambda x: x.rlike(r"^.+/[^/]+$"))
    token = lambda x: F.regexp_extract(x, r"^(.+)/[^/]+$", 1)
    tag = lambda x: F.regexp_extract(x, r"/([^/]+)$", 1)
    return F.filter(items, lambda x: ~token(x).rlike(rf"^{PUNCT}+$") | (token(x) == tag(x)))


def shape(t: Column | str) -> Column:
    """Surface marker of a token."""
    t = _col(t)
    return (
        F.when(t.rlike(rf"^{PUNCT}+$"), "punctuation")
        .when(t.rlike("^[0-9]+$"), F.concat(F.lit("numeric-"), F.length(t)))
        .when(t.rlike("^[A-Z]+$"), "allcaps")
        .when(t.rlike("^[^A-Z]+$"), "nocaps")
        .when(t.rlike("^[A-Z][^A-Z]*$"), "initcap")
        .otherwise("mixed")
    )


# -- HTML ----------------------------------------------------------------------------------------


def strip_scripts(c: Column | str) -> Column:
    """Without script and style elements and comments."""
    return F.regexp_replace(_col(c), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")


def strip_before_html(c: Column | str) -> Column:
    """Without what stands before <html or <!doctype."""
    return F.regexp_replace(_col(c), r"(?is)^.*?(?=<html|<!doctype)", "")


def unescape(c: Column | str) -> Column:
    """The five named character references and the no-break space."""
    fixed = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), fixed, _col(c))


def html_text(c: Column | str) -> Column:
    """Visible text: no scripts, styles, comments, head or tags."""
    body = F.regexp_replace(strip_scripts(strip_before_html(c)), r"(?is)<head\b.*?</head\s*>", " ")
    return trim_spaces(unescape(F.regexp_replace(body, r"(?s)<[^>]*>", " ")))


def html_title(c: Column | str) -> Column:
    """Text of the title element."""
    return trim_spaces(unescape(F.regexp_extract(_col(c), r"(?is)<title[^>]*>(.*?)</title", 1)))


#: Segments that are no text: punctuation, local paths, script, unrendered markup, dumps of values, JSON. Fixed values.
JUNK_SEGMENTS = (
    rf"^(?:{PUNCT}|\s)+$",
    r"^/[^\s]+$",
    r"^<\?",
    r"^<[^\s]+>",
    r"^<[^\s]+.*>$",
    r"^<!--",
    r"=\"",
    r"string\([0-9]+\)",
    r"array\([0-9]+\)",
    r"\}\}",
    r":\{",
)


def is_junk_segment(c: Column | str) -> Column:
    """Segments that are debris of markup or code."""
    s = _col(c)
    return reduce(lambda x, p: x | s.rlike(f"(?is){p}"), JUNK_SEGMENTS, s == "")


# -- URLs and category paths ---------------------------------------------------------------------


def url_host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_depth(c: Column | str) -> Column:
    """Path segments that aren't empty."""
    return F.size(F.filter(F.split(url_path(c), "/"), lambda s: s != ""))


def url_canonical(c: Column | str) -> Column:
    """Lower-case scheme and host, no default port, fragment or trailing slash of the path."""
    scheme = F.lower(F.regexp_extract(_col(c), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(_col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*(:[0-9]+)?", 1)
    query = F.regexp_extract(_col(c), r"(\?[^#]*)", 1)
    keep_port = F.when(port.isin(":80", ":443"), "").otherwise(port)
    return F.concat(scheme, F.lit("://"), url_host(c), keep_port, F.regexp_replace(url_path(c), "/+$", ""), query)


def url_words(c: Column | str) -> Column:
    """Words of host and path."""
    return tokens(F.concat_ws(" ", url_host(c), url_path(c)))


def category_ancestors(c: Column | str) -> Column:
    """All prefixes of a slash path, itself last."""
    parts = F.split(_col(c), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def category_parent(c: Column | str, depth: int) -> Column:
    """The first ``depth`` parts of a path."""
    return F.array_join(F.slice(F.split(_col(c), "/"), 1, depth), "/")


def category_depth(c: Column | str) -> Column:
    return F.size(F.split(_col(c), "/"))


def repository_path(c: Column | str) -> Column:
    """Folder of the first four parts, and a file named by the md5 of the path with ## for slashes."""
    return F.concat_ws("/", category_parent(c, 4), F.md5(F.replace(_col(c), F.lit("/"), F.lit("##"))))
