"""Links, terms in texts, vocabularies and keyed tables against plain Python."""

import random
import uuid
from collections import Counter
from urllib.parse import urljoin

from pyspark.sql import functions as F

from glossa.operators import counts, links, retrieval
from glossa.operators.containment import find_phrases, greedy
from glossa.sources import sinks
from glossa.sources.storage import shared_dir

# The references of RFC 3986, 5.4, as fixed values.
REFERENCES = "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x mailto:x@y".split()


def test_references_are_resolved(spark):
    rows = [("http://a/b/c/d;p?q", r) for r in REFERENCES] + [("http://h", r) for r in ("x", "x/y", "../x", "?q", "/p/..")]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", links.resolve("b", "r").alias("u")).collect()
    assert [x.u for x in got] == [urljoin(x.b, x.r) for x in got]


def test_links_of_pages(spark):
    html = """<html><head><title>t <a href="/title">no</a></title></head><body><nav><a class=x href='two'>Two &amp; <b>more</b></a><p>See <a HREF="/one">the
    one</a>, <a href=three?x=1&amp;y=2>three</a> now.</p><!-- <a href="/comment">c</a> --><script>var a = '<a href="/script">s</a>';</script><a name="here">none</a><a href="//other.org/x"><img></a>
    <div><a href="open">never closed <a href="#f">in page</a></div>""" + "<p>" + "long " * 300 + '<a href="/far">far</a></p>'
    pages = spark.createDataFrame([(1, "http://site.org/dir/page?q", html), (2, "http://x.org/", None), (3, "http://x.org/", "no links"), (4, None, "<a href='x'>y</a>")], "id long, u string, h string")
    got = [(r.id, r.href, r.target, r.text, r.sentence) for r in links.page_links(pages, "id", "u", "h").orderBy("id", "block", "n").collect()]
    see = "See the one , three now."
    assert got[:-1] == [
        (1, "/title", "http://site.org/title", "no", "t no"),
        (1, "two", "http://site.org/dir/two", "Two & more", "Two & more"),
        (1, "/one", "http://site.org/one", "the one", see),
        (1, "three?x=1&y=2", "http://site.org/dir/three?x=1&y=2", "three", see),
        (1, "//other.org/x", "http://other.org/x", "", "none"),
        (1, "open", "http://site.org/dir/open", "never closed", "never closed in page"),
        (1, "#f", "http://site.org/dir/page?q#f", "in page", "never closed in page"),
        (1, "/far", "http://site.org/far", "far", "far"),
    ]
    assert got[-1][0] == 4 and got[-1][3] == "y"


def test_texts_of_links_to_a_target(spark):
    rows = [("http://a.org/1", "http://t.org/x/", "one", "S1"), ("http://a.org/1", "http://T.org:80/x#f", "one", "S1"), ("http://a.org/2", "http://t.org/x", "two", "S2"), ("http://a.org/3", "http://t.org/x", "three", "S3"),
            ("http://www.dmoz.org/d", "http://t.org/x", "dir", "D"), ("http://t.org/y", "http://t.org/x", "own", "O"), ("ftp://b.org/", "http://t.org/x", "ftp", "F"), ("http://b.org/", "mailto:x@t.org", "mail", "M"), ("http://b.org/", "http://t.org/x", "", "E"), ("http://t.org/x", "http://t.org/x#top", "self", "S")]
    df = spark.createDataFrame(rows, "url string, target string, text string, sentence string")
    got = lambda **k: sorted(map(tuple, links.numbered_texts(links.link_texts(df, **k)).select("target", "n", "text").collect()))
    assert got() == [("http://t.org/x", 1, "E"), ("http://t.org/x", 2, "S1"), ("http://t.org/x", 3, "S2"), ("http://t.org/x", 4, "S3")]
    assert [x[2] for x in got(kind="text", per_host=2)] == ["one", "two"]
    assert [x[2] for x in got(kind="text", other_sites=False, directories=())] == ["dir", "one", "own", "three", "two"]


def test_terms_are_found_as_word_by_word(spark):
    rng = random.Random(4)
    words = ["new", "york", "city", "of", "the", "É", "cat"]
    texts = [(i, [rng.choice(words) for _ in range(rng.randint(0, 25))]) for i in range(60)] + [(60, []), (61, None), (None, ["new", "york"]), (5, ["The", "CAT"])]
    df = spark.createDataFrame(texts, "id long, w array<string>")
    for terms in (["New York", "york", "new york city", "city of the", "cat cat", "É", None, "", " the  cat "], ["cat", "of"]):
        v = spark.createDataFrame([(t,) for t in terms], "t string")
        got = sorted((tuple(r) for r in find_phrases(df, "id", "w", v, "t").collect()), key=str)
        known = {" ".join(t.lower().split()) for t in terms if t and t.strip()}
        want = []
        for i, w in texts:
            low = [x.lower() for x in w or ()]
            hits = [(a, a + m, g) for m in range(1, 4) for a in range(len(low) - m + 1) if (g := " ".join(low[a : a + m])) in known]
            want += [(i, a, g) for a, _, g in greedy(hits)]
        assert got == sorted(want, key=str)
    assert find_phrases(df, "id", "w", spark.createDataFrame([], "t string"), "t").count() == 0


def test_vocabulary_and_mapped_pairs(spark):
    rows = [(1, ["b", "a", "b"], ["x"]), (2, ["c"], ["y", "x", "y"]), (3, [], ["z"]), (4, ["a"], [])]
    df = spark.createDataFrame(rows, "id long, s array<string>, t array<string>")
    v = {r.word: (r.n, r.id) for r in counts.whole_vocabulary(df.select(F.explode("s").alias("w")), "w").collect()}
    assert v == {"a": (2, 1), "b": (2, 2), "c": (1, 3)}
    assert sorted(map(tuple, counts.mapped_pairs(df, "id", "s", "t").collect())) == [(1, 1, "2 1 2", "1"), (2, 1, "3", "2 1 2"), (3, 1, "", "3"), (4, 1, "1", "")]


def test_null_keys_are_put_once(spark):
    t = sinks.KeyedTable(spark, f"{shared_dir(spark)}/nulls-{uuid.uuid4().hex}", "k")
    rows = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    for _ in range(2):
        t.upsert(rows)
    t.upsert(spark.createDataFrame([(None, "kept"), (2, "b")], "k long, v string"), overwrite=False)
    assert Counter(map(tuple, t.read().collect())) == Counter([(1, "a"), (None, "n"), (2, "b")])
    t.upsert(spark.createDataFrame([(None, "new")], "k long, v string"))
    assert (None, "new") in map(tuple, t.read().collect()) and t.read().count() == 3


def test_homogeneity_counts_all_pairs(spark):
    ranked = spark.createDataFrame([("t", f"i{k}", k) for k in range(1, 6)], "target string, item string, rank long")
    sims = [("i1", "i2", 0.5), ("i2", "i1", 0.5), ("i4", "i1", 1.0), ("i1", "i4", 1.0)]
    got = {r["rank"]: round(r.homogeneity, 6) for r in retrieval.homogeneity(ranked, spark.createDataFrame(sims, "i string, j string, score double"), "target", "item", "rank").collect()}
    assert got == {2: 0.5, 3: round(0.5 / 3, 6), 4: round(1.5 / 6, 6), 5: round(1.5 / 10, 6)}
