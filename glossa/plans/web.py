"""Links of pages and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import links
from glossa.plans.common import Registry, load
from glossa.sources import readers

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle


def _plain(c: str) -> str:
    out = f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


#: Links as the operator has them; the pages' references are rooted paths without dots.
_LINKS = rf"""s AS (SELECT page_id, url, string_split_regex(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '{links._BLOCK}') AS b FROM pages),
k AS (SELECT page_id, url, unnest(range(0, len(b))) AS block, unnest(b) AS body FROM s),
m AS (SELECT page_id, url, block, body, unnest(range(0, len(a))) AS n, unnest(a) AS a FROM (SELECT *, regexp_extract_all(body, '(?is)<a\b[^>]*>.*?</a\s*>') AS a FROM k)),
h AS (SELECT *, regexp_extract(a, '(?is)^<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1) AS href FROM m WHERE regexp_matches(a, '(?is)^<a\b[^>]*?\shref\s*=\s*"')),
links AS (SELECT page_id, block, n, url, href, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || href AS target, {_plain("a")} AS text, {_plain("body")} AS whole FROM h)"""
_SENTENCE = f"CASE WHEN length(whole) > {links.LONGEST_SENTENCE} THEN text ELSE whole END"


def _canonical(c: str) -> str:
    at = "^[A-Za-z][A-Za-z0-9+.-]*://"
    port = f"regexp_extract({c}, '{at}[^/?#:]*(:[0-9]+)?', 1)"
    return (
        f"lower(regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract({c}, '{at}([^/?#:]*)', 1))"
        rf" || CASE WHEN {port} IN (':80', ':443') THEN '' ELSE {port} END || regexp_replace(regexp_extract({c}, '{at}[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract({c}, '(\?[^#]*)', 1)"
    )


def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(load(spark, sf_dir, "pages"), "page_id", "url", "html")


@_R.query(f"WITH {_LINKS} SELECT page_id, block::INT AS block, n::INT AS n, href, target, text, {_SENTENCE} AS sentence FROM links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, resolved, with the link's text and the sentence around it."""
    return all_links(spark, sf_dir).drop("url")


@_R.query(f"WITH {_LINKS}, l AS (SELECT DISTINCT page_id, {_canonical('target')} AS dst FROM links) SELECT dst, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS sources FROM (SELECT dst, page_id, row_number() OVER (PARTITION BY dst ORDER BY page_id) AS k FROM l) WHERE k <= 5 GROUP BY dst")
def web_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-links of each link target by its canonical URL, five at most."""
    edges = all_links(spark, sf_dir).select(F.col("page_id").alias("src"), T.url_canonical("target").alias("dst"))
    return readers.in_links(edges, 5).select("dst", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@_R.query(
    f"""WITH {_LINKS}, x AS (SELECT DISTINCT {_canonical("target")} AS target, {_canonical("url")} AS source, {_SENTENCE} AS text FROM links)
SELECT target, n, source, text FROM (SELECT target, source, text, row_number() OVER (PARTITION BY target ORDER BY text, source)::INT AS n FROM x WHERE text <> '' AND source <> target)"""
)
def anchor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages say around their links to a target, a numbered row for each text (T20, T33, X14); here sites link to themselves only."""
    return links.numbered_texts(links.link_texts(all_links(spark, sf_dir), other_sites=False))
