"""Links of pages, resolved against the page's URL, with their texts (T19, T20, X14, S18): column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.joins import with_ordinal
from glossa.sources.storage import written

#: Elements that part a page's text: what stands between two of their tags is one sentence around a link.
BLOCKS = "address article aside blockquote body caption center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
_BLOCK = rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>"
_ANCHOR = r"(?is)<a\b[^>]*>.*?(?:</a\s*>|(?=<a\b)|$)"
_HREF = r"""(?is)^<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Beyond this many characters a sentence is no sentence, and a link's own text counts. Fixed value.
LONGEST_SENTENCE = 1000

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?"


def _without_dots(path: Column) -> Column:
    """A rooted path without the steps . and .. (RFC 3986, 5.2.4); other paths as they are."""
    steps = F.split(path, "/", -1)
    last = F.element_at(steps, -1)

    def step(kept: Column, x: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)
        return F.when(x == ".", kept).when(x == "..", up).otherwise(F.array_append(kept, x))

    walked = F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.array(F.lit("")), step)
    walked = F.when(last.isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    out = F.array_join(walked, "/")
    return F.when(path.startswith("/"), F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))).otherwise(path)


def resolve(base: Column | str, reference: Column | str) -> Column:
    """A reference as an absolute URL, against a page's URL (RFC 3986, 5.2.2)."""
    b, r = (F.col(c) if isinstance(c, str) else c for c in (base, reference))
    part = lambda c, k: F.regexp_extract(c, _PARTS, k)
    scheme, site, path, query, fragment = (part(r, k) for k in range(1, 6))
    b_scheme, b_site, b_path, b_query = (part(b, k) for k in range(1, 5))
    merged = F.when((b_site != "") & (b_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(b_path, r"^(.*/)?", 0), path))
    own_path = F.when(path == "", b_path).when(path.startswith("/"), _without_dots(path)).otherwise(_without_dots(merged))
    own_query = F.when((path == "") & (query == ""), b_query).otherwise(query)
    full = F.concat(scheme, F.lit(":"), site, _without_dots(path), query, fragment)
    of_site = F.concat(b_scheme, F.lit(":"), site, _without_dots(path), query, fragment)
    return F.when(scheme != "", full).when(site != "", of_site).otherwise(F.concat(b_scheme, F.lit(":"), b_site, own_path, own_query, fragment))


def page_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, block, n, url, href, target, text, sentence: the links of each page, in order.

    href is as written, without character references; target the absolute URL;
    text that of the link, sentence that of the block around it, or the link's
    where that is too long. Scripts, styles and comments have no links; a link
    that isn't closed ends at the next or with its block; a null page or one
    without links gives none.
    """
    blocks = pages.select(key, F.col(url).alias("url"), F.posexplode(F.split(T.strip_scripts(html), _BLOCK)).alias("block", "_b")).filter(F.col("_b").rlike(r"(?i)<a\b"))
    each = blocks.select(key, "block", "url", "_b", F.posexplode(F.regexp_extract_all("_b", F.lit(_ANCHOR), 0)).alias("n", "_a"))
    href = T.trim_spaces(T.unescape(F.concat(*[F.regexp_extract("_a", _HREF, k) for k in (1, 2, 3)])))
    plain = lambda c: T.trim_spaces(T.unescape(F.regexp_replace(c, r"(?s)<[^>]*>", " ")))
    x = each.filter(F.col("_a").rlike(_HREF)).withColumn("href", href).withColumn("text", plain("_a")).withColumn("_s", plain("_b"))
    sentence = F.when(F.length("_s") > LONGEST_SENTENCE, F.col("text")).otherwise(F.col("_s"))
    return x.select(key, "block", "n", "url", "href", resolve("url", "href").alias("target"), "text", sentence.alias("sentence"))


def link_texts(links: DataFrame, kind: str = "sentence", other_sites: bool = True, directories: tuple[str, ...] = ("dmoz.org",), per_host: int | None = None) -> DataFrame:
    """target, source, text: distinct texts of the links from each source to a target, by canonical URLs.

    Sources and targets have http schemes; sources in directories' domains
    don't count, nor do links within a site if ``other_sites``; of a host only
    the first ``per_host`` sources, in order of their URLs, are heard.
    """
    web = r"(?i)^https?://[^/?#]"
    x = links.filter(F.col("url").rlike(web) & F.col("target").rlike(web) & (F.col(kind) != ""))
    x = x.select(T.url_canonical(F.regexp_replace("target", "#.*$", "")).alias("target"), T.url_canonical("url").alias("source"), F.col(kind).alias("text")).distinct()
    x = x.filter(F.col("source") != F.col("target"))
    host = T.url_host("source")
    if other_sites:
        x = x.filter(host != T.url_host("target"))
    for d in directories:
        x = x.filter(~F.contains(host, F.lit(d)))
    if per_host is not None:
        sources = x.select("target", "source").distinct()
        first = sources.withColumn("_k", F.row_number().over(W.partitionBy("target", T.url_host("source")).orderBy("source"))).filter(F.col("_k") <= per_host)
        x = x.join(first.select("target", "source"), ["target", "source"], "left_semi")
    return x


def numbered_texts(texts: DataFrame) -> DataFrame:
    """target, n, source, text: the texts of each target numbered from 1, by text and source.

    A row for each text, not one cell for a target, which may have any number
    of them; the numbers come from a range sort over all targets.
    """
    ordered = written(with_ordinal(texts, ["target", "text", "source"], "_o"), "link-texts")
    first = written(ordered.groupBy("target").agg(F.min("_o").alias("_f")), "link-targets")
    return ordered.join(first, "target").select("target", (F.col("_o") - F.col("_f") + 1).cast("int").alias("n"), "source", "text")
