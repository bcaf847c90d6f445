import base64
import hashlib
import random
import uuid
import zlib
from datetime import date

import pyarrow as pa
import pytest

from glossa.llm import chat, media, token_rollup, url_lists, warc
from glossa.llm.queries import rollup_tokenizers
from glossa.llm.shared import Workspace, shared_dir, slices
from glossa.sources import storage

# -- media ---------------------------------------------------------------------------------------


def test_sequences_keep_order_and_captions():
    page = "<html><head><title>no</title></head><p>One <b>two</b></p><figure><img src='a.png' alt='alt'><img src=b.png><figcaption>The  cap</figcaption></figure>tail<img src='c.png' alt='C'><script>x</script><p>end &amp; more"
    got = [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.parse_interleaved(page)]
    assert got == [(0, "text", "One two", None), (1, "media", "a.png", "The cap"), (2, "media", "b.png", "The cap"), (3, "text", "tail", None), (4, "media", "c.png", "C"), (5, "text", "end & more", None)]
    assert media.parse_interleaved(None) == media.parse_interleaved("") == []


@pytest.mark.parametrize("text", [None, "", "a", "é" * 288, "x" * 577, "\x00\xff" * 4000])
def test_payload_round_trip(text):
    payload, n = media.payload_of(text)
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload[:n] == (text or "").encode() and set(payload[n:]) <= {255}
    image = media.png_of(payload)
    assert media.samples_of(image) == payload
    with pytest.raises(ValueError):
        media.samples_of(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def grey_samples(image):
    """A PNG reader of its own: the chunks in order, checksums, row filters 0 to 2."""
    assert image.startswith(b"\x89PNG\r\n\x1a\n")
    at, packed, seen = 8, b"", []
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        kind, data, crc = image[at + 4 : at + 8], image[at + 8 : at + 8 + n], image[at + 8 + n : at + 12 + n]
        assert zlib.crc32(kind + data) == int.from_bytes(crc, "big")
        seen.append(kind)
        if kind == b"IHDR":
            width, height = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
            assert tuple(data[8:]) == (8, 0, 0, 0, 0)
        packed += data if kind == b"IDAT" else b""
        at += 12 + n
    assert (seen[0], seen[-1]) == (b"IHDR", b"IEND")
    lines, out, above = zlib.decompress(packed), [], bytes(width)
    assert len(lines) == height * (width + 1)
    for y in range(height):
        kind, row = lines[y * (width + 1)], bytearray(lines[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            row[x] = (row[x] + (0, row[x - 1] if x else 0, above[x])[kind]) % 256
        above = bytes(row)
        out.append(above)
    return b"".join(out)


def test_document_media(spark, frame):
    """Against a PNG reader and features of the test's own."""
    docs = [(1, "a <b> & c"), (2, "a <b> & c"), (3, None), (4, ""), (None, "x"), (1, "a <b> & c"), (5, "word " * 30_000), (6, "</article><img src=x>"), (7, "first\r\nsecond"), (8, "é" * 288), (9, "é" * 300)]
    df = frame(docs, "doc_id long, text string")
    got = media.document_media(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(d), len((t or "").encode())) for d, t in docs)
    stored = {r.ref: bytes(r.media) for r in media.store_payloads(df, Workspace(spark, "test")).collect()}
    texts = {d: t for d, t in docs}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        image = stored["media:sha256/" + hashlib.sha256(payload).hexdigest()]
        assert grey_samples(image) == payload
        counts = [sum(32 * k <= x < 32 * k + 32 for x in payload) for k in range(8)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert r.feature == f"{len(payload) // 576}:{sum(payload)}:" + ",".join(map(str, counts))
    assert media.document_media(frame([], "doc_id long, text string")).collect() == []


def test_pages_of_the_tables(spark, sf):
    """Real pages: every media reference of the markup in its order, and all of the text between."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in media.interleave(pages, "page_id", "html").collect():
        assert [x.position for x in r.sequence] == list(range(len(r.sequence)))
        assert all((x.text is None) == (x.kind == "media") == (x.ref is not None) for x in r.sequence)
        assert sum(x.kind == "media" for x in r.sequence) <= (html[r.page_id] or "").lower().count("src")


def test_slices_are_bounded_by_bytes():
    texts = ["x" * n for n in (10, 10, 5000, 1, 1, 1, 900, 200)] + [None] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    cut = [p.column("text").to_pylist() for p in slices(iter([batch, batch.slice(3, 4)]), rows=4, size=1000)]
    assert sum(cut, []) == texts + texts[3:7]
    assert all(len(p) <= 4 and (len(p) == 1 or sum(len(t or "") for t in p) <= 1000) for p in cut)


def test_unknown_refs_resolve_to_nulls(frame):
    pages = frame([(1, "<img src='media:sha256/none' alt='c'>")], "page_id long, html string")
    store = frame([], "ref string, media binary", clash=False)
    got = media.resolve(media.interleave(pages, "page_id", "html"), "page_id", media.payload_features(store)).collect()
    assert [(r.page_id, r.position, r.caption, r.payload_bytes) for r in got] == [(1, 0, "c", None)]


# -- chat ----------------------------------------------------------------------------------------


def brute_collapse(turns):
    by = {}
    for c, k, role, text in {t for t in turns if t[0] is not None}:
        by.setdefault(c, []).append((k is not None, k, role or "", text or ""))
    seqs = {c: tuple((r, x) for _, _, r, x in sorted(t, key=lambda y: (y[0], y[1] or 0, y[2], y[3]))) for c, t in by.items()}
    kinds = {}
    for c, s in sorted(seqs.items()):
        kinds.setdefault(s, []).append(c)
    return {cs[0]: (len(s), len(cs), "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in s)) for s, cs in kinds.items() if not any(len(o) > len(s) and o[: len(s)] == s for o in kinds)}


def test_collapse_as_brute_force(frame):
    rng = random.Random(4)
    turns = []
    for c in range(60):
        n = rng.randint(1, 5)
        turns += [(c, k, "user" if k % 2 == 0 else "bot", f"say {rng.randint(0, 1)}") for k in range(n)]
    turns += [(70, None, "user", "first"), (70, 3, None, None), (71, 0, "a", ""), (None, 0, "user", "lost"), (72, 5, "x", "tie"), (72, 5, "x", "eit"), (73, 0, "user", "long " * 20_000)]
    turns += turns[:10]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.collapse_and_render(frame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == brute_collapse(turns)


def test_turns_without_numbers(frame):
    """Null and equal numbers, over more than a block of turns; 0 is a number, null comes before it."""
    turns = [(1, None, "u", f"t{k:03}") for k in range(300)] + [(2, 7, "u", f"t{k:03}") for k in range(299)] + [(3, 0, "a", "zero"), (3, None, "z", "null"), (3, 0, "A", "zero")]
    turns += [(4, None, "z", "null"), (4, -5, "a", "minus"), (5, None, "z", "null")] + turns[:5]
    got = {}
    for r in chat.collapse_and_render(frame(turns, "conv_id long, turn long, role string, text string")).orderBy("part").collect():
        n, copies, text = got.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        got[r.conv_id] = n, copies, text + r.rendered
    assert got == brute_collapse(turns) and set(got) == {1, 3, 4}


def test_long_conversations_cross_blocks(frame):
    turns = [(1, k, "u", f"t{k}") for k in range(700)] + [(2, k, "u", f"t{k}") for k in range(600)] + [(3, k, "u", f"t{k}") for k in range(599)] + [(3, 599, "u", "other")]
    got = chat.collapse_and_render(frame(turns, "conv_id long, turn long, role string, text string")).collect()
    parts = {(r.conv_id, r.part): r.rendered for r in got}
    assert {c for c, _ in parts} == {1, 3} and [p for c, p in sorted(parts) if c == 1] == [0, 1, 2]
    assert "".join(parts[1, p] for p in range(3)) == "".join(f"<|u|>\nt{k}\n<|end|>\n" for k in range(700))
    assert chat.collapse_and_render(frame([], "conv_id long, turn long, role string, text string")).collect() == []


# -- WARC ----------------------------------------------------------------------------------------


def test_archive_and_index(frame):
    pages = [(5, "http://b.example.com/x?q=1", "<p>one</p>"), (2, "http://a.example.com/", "<p>one</p>"), (7, "http://a.example.com/", "two é"), (8, None, None), (9, "not a url", ""), (11, "http://a.example.com/\r\nX: y", "two é"), (12, "http://é.org/ü", "x" * 300_000), (None, "http://n.org/", "two é")]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(frame(pages, "page_id long, url string, html string")).collect()}
    first = {}
    for p, _, h in sorted(pages, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(h or "", p)
    for p, _, h in pages:
        raw = (h or "").encode()
        rest = ("response", None) if first[h or ""] == p else ("revisit", first[h or ""])
        assert got[p] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *rest)
    assert warc.archive_and_read(frame([], "page_id long, url string, html string")).collect() == []


def test_lookup_by_url_over_many_blocks(spark, frame):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 50}", f"page {i % 90}") for i in range(400)]
    work = Workspace(spark, "test-warc")
    captures = work.table(warc.write_archives(frame(rows, "page_id long, url string, html string"), work.path("archives")), "captures")
    directory = warc.Directory(work.table(warc.build_index(captures, work.path("index"), block_lines=9), "directory").collect(), work.path("index"))
    assert len(directory.at) > 30
    asked = ["http://h3.example.com/3", "http://h0.example.com/0", "http://none.example.com/"]
    df = spark.createDataFrame([(warc.key_of(u) + " ",) for u in asked], "asked string")
    got = warc.lookup(df, directory, work.path("archives"), keep_payload=True).collect()
    assert sorted(r.page_id for r in got) == sorted(i for i, u, _ in rows if u in asked)
    assert all(r.payload == f"page {r.page_id % 90}".encode() for r in got if r.record_type == "response")
    few = warc.build_index(captures, work.path("index2"), block_lines=1, max_directory=40)
    assert few.count() <= 40


def test_keys_sort_by_reversed_host():
    assert warc.key_of("https://User@WWW.Example.com:443/a b?x#y") == "com,example,www)/a%20b?x"
    assert warc.key_of("http://a.org") == "org,a)/" and warc.key_of(None) == ")/"


# -- URL lists -----------------------------------------------------------------------------------


def test_lists_as_brute_force(frame):
    rng = random.Random(6)
    hosts = ["a.example.com", "b.example.com", "example.org", "c.d.example.org"]
    entries = [(rng.choice(["block", "allow"]), kind, pattern, rng.choice(["add", "add", "remove"]), date(2024, rng.randint(1, 6), rng.randint(1, 28))) for kind, pattern in [("host", h) for h in hosts] + [("domain", "example.com"), ("domain", "org"), ("path", "a.example.com/x"), ("path", "a.example.com/x/y")] for _ in range(5)]
    entries += [entries[0], ("block", "host", None, "add", date(2024, 1, 1)), ("block", "host", hosts[0], "add", None)]
    captures = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'x', 'x/y', 'x/y/z?q'])}", date(2024, rng.randint(1, 7), rng.randint(1, 28))) for i in range(200)]
    captures += [captures[0], (900, None, date(2024, 1, 1)), (901, "nohost", date(2024, 1, 1)), (902, "http://a.example.com/", None), (None, "http://a.example.com/", date(2024, 5, 5))]

    def active(kind, pattern, at):
        out = []
        for name in ("block", "allow"):
            mine = [e for e in entries if e[:3] == (name, kind, pattern) and e[4] and e[4] <= at]
            last = max((e[4] for e in mine), default=None)
            if last and all(e[3] == "add" for e in mine if e[4] == last):
                out.append(name)
        return out

    def verdict(url, at):
        host, _, rest = (url or "").partition("://")[2].partition("/")
        if not host or not at:
            return 0, "none", None
        steps = [s for s in rest.split("?")[0].split("/") if s]
        labels = host.split(".")
        keys = [("host", host)] + [("domain", ".".join(labels[i:])) for i in range(len(labels))] + [("path", "/".join([host, *steps[: i + 1]])) for i in range(len(steps))]
        hits = [(-len(p), n != "block", n, p, k) for k, p in keys for n in active(k, p, at)]
        return (len(hits), min(hits)[2], min(hits)[3]) if hits else (0, "none", None)

    got = url_lists.judge(frame(captures, "page_id long, url string, fetched date"), frame(entries, "list string, kind string, pattern string, action string, at date", clash=False)).collect()
    assert sorted((str(r.page_id), r.url, r.n_active, r.verdict, r.pattern) for r in got if r.url) == sorted((str(p), u, *verdict(u, at)) for p, u, at in captures if u)
    assert [r.verdict for r in got if not r.url] == ["none"] and len(got) == len(captures)
    none = frame([], "list string, kind string, pattern string, action string, at date", clash=False)
    assert {r.verdict for r in url_lists.judge(frame(captures, "page_id long, url string, fetched date"), none).collect()} == {"none"}


# -- token counts --------------------------------------------------------------------------------


def rollup(spark):
    return token_rollup.Rollup(spark, f"{shared_dir(spark)}/test-rollup-{uuid.uuid4().hex}")


def test_batches_commit_once(spark):
    r = rollup(spark)
    schema = "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long"
    one = spark.createDataFrame([("s", "en", "t", "insert", 10, None), ("s", "en", "t", "insert", 5, None), (None, None, "t", "insert", None, None), ("s", "en", "t", "odd", 99, None)], schema)
    two = spark.createDataFrame([("s", "en", "t", "delete", 5, None), ("s", "en", "t", "revise", 7, 10)], schema)
    assert r.totals().collect() == []
    assert r.apply("one", one) and not r.apply("one", one) and r.apply("two", two) and not r.apply("two", one)
    assert sorted((tuple(x) for x in r.totals().collect()), key=str) == [("s", "en", "t", 1, 7), (None, None, "t", 1, 0)]
    # a write that was cut short has no commit: it doesn't count, and its batch is written anew
    two.selectExpr("source", "lang", "tokenizer", "1L n_docs", "1L n_tokens").write.parquet(f"{r.root}/batches/three-cut")
    fs, empty = spark.sparkContext._jvm.org.apache.hadoop.fs, f"{r.root}/batches/three.commit"
    fs.Path(empty).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fs.Path(empty)).close()
    assert r.committed() == ["one", "two"] and r.apply("three", two) and r.committed() == ["one", "three", "two"]
    with pytest.raises(ValueError):
        r.apply("../x", one)


def test_compaction_changes_nothing(spark):
    r = rollup(spark)
    schema = "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long"
    rows = spark.createDataFrame([("s", "en", "t", "insert", 10, None), (None, "de", "t", "insert", 5, None)], schema)
    r.compact()
    for name in ("a", "b"):
        assert r.apply(name, rows)
    before = sorted(map(str, r.totals().collect()))
    r.compact()
    assert sorted(map(str, r.totals().collect())) == before and r.committed() == ["a", "b"] and not r._batches()
    assert not r.apply("a", rows) and r.apply("c", rows) and not r.apply("c", rows)
    r.compact()
    r.compact()
    assert r.committed() == ["a", "b", "c"] and {(x.lang, x.n_docs, x.n_tokens) for x in r.totals().collect()} == {("en", 3, 30), ("de", 3, 15)}
    # a batch that two drivers wrote, one of them beside the other's compaction, counts once
    storage.commit(spark, f"{r.root}/batches/a.commit", "a-late")
    assert {(x.lang, x.n_docs) for x in r.totals().collect()} == {("en", 3), ("de", 3)}


def test_a_batch_that_is_committed_during_a_compaction_counts_once(spark):
    r = rollup(spark)
    schema = "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long"
    rows = lambda n: spark.createDataFrame([("s", "en", "t", "insert", n, None)], schema)
    assert r.apply("a", rows(10))
    summed = r._sum_of

    def late(compacted, batches):
        r._sum_of = summed
        assert r.apply("b", rows(5))  # after the listing, before the sum
        return summed(compacted, batches)

    r._sum_of = late
    r.compact()
    assert r.committed() == ["a", "b"] and sorted(r._batches()) == ["b"]
    assert [(x.n_docs, x.n_tokens) for x in r.totals().collect()] == [(2, 15)]
    lazy = r.totals()
    r.compact()
    assert [(x.n_docs, x.n_tokens) for x in lazy.collect()] == [(2, 15)]  # what was listed before is still there
    assert r.apply("c", rows(1))
    r.compact()
    assert [(x.n_docs, x.n_tokens) for x in r.totals().collect()] == [(3, 16)] and r.committed() == ["a", "b", "c"]


def test_of_two_writers_one_commits(spark):
    path = f"{shared_dir(spark)}/commit-{uuid.uuid4().hex}"
    assert storage.commit(spark, path, "first") and not storage.commit(spark, path, "second")
    assert list(storage.commits(spark, path).values()) == ["first"]


def test_document_rollup_as_brute_force(spark, frame):
    docs = [(1, "a b  \n\nc", "s1", "en"), (2, "a b  \n\nc", "s2", "en"), (3, None, "s1", "de"), (4, "", None, None), (5, "hello world", "s1", "en"), (None, "hello world", "s1", "en"), (6, "word " * 20_000, "s3", "fr"), (5, "hello world", "s1", "en")]
    tok = rollup_tokenizers()
    coders = {n: token_rollup._encoding(*at) for n, at in tok.items()}
    want = {}
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, s, lang in docs:
        if d is not None and d > least[t or ""]:
            continue
        for n, c in coders.items():
            x = want.setdefault((s, lang, n), [0, 0])
            x[0] += 1
            x[1] += len(c.encode_ordinary(token_rollup.tidy(t)))
    got = token_rollup.document_rollup(frame(docs, "doc_id long, text string, source string, lang string"), tok, rollup(spark)).collect()
    assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in got} == {k: v for k, v in want.items() if v != [0, 0]}
    assert token_rollup.document_rollup(frame([], "doc_id long, text string, source string, lang string"), tok, rollup(spark)).collect() == []
