import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from glossa.llm import decontaminate as D
from glossa.llm import quality as Q
from glossa.llm import shared
from glossa.llm import toxicity as X
from glossa.llm.pieces import LONG, PieceModel, encode_and_decode
from glossa.llm.queries import PIECE_MODEL, tokenizer_path

# -- winnowing -----------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            m = min(13, len(v))
            grams = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
            for p in range(len(w) - m + 1):
                if m and tuple(w[p : p + m]) in grams:
                    hit.update(range(p, p + m))
                    found.add(str(item) if item is not None else "null")
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(3)
    v = [f"w{i}" for i in range(60)] + ["é", "ÿx", "12"]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(30)]
    items += [(30, None), (31, "..."), (None, " ".join(v[:15])), (32, items[0][1]), (32, items[0][1]), (33, "a " * 20)]
    docs = []
    for i in range(60):
        text = [rng.choice(v) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 2)):
            part = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(part) - 13))
            at = rng.randint(0, len(text))
            text[at:at] = [x.upper() for x in part[a : a + rng.randint(12, 20)]]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(100, None), (101, ""), (None, docs[0][1]), (1, docs[1][1]), (102, "a " * 50), (103, "b " * 20_000 + items[5][1])]
    return docs, items


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_winnowing_as_brute_force(frame, contaminated, monkeypatch, bits):
    """Also where the bitmaps are full, as they would be with a huge benchmark."""
    monkeypatch.setattr(shared, "FILTER_BITS", bits)
    docs, items = contaminated
    df, bench = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.contamination(df, bench).collect()), key=str)
    assert got == brute(docs, items)
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((x[0] for x in brute(docs, items) if not x[5]), key=str)


def test_winnowing_of_a_large_benchmark(frame):
    """Items beyond number take no more Python stages than a few, and texts are never shuffled."""

    def plan(n):
        items = frame([(i, " ".join(f"i{i}w{j}" for j in range(60))) for i in range(n)], "item_id long, text string", clash=False)
        docs = frame([(1, " ".join(f"i{n - 1}w{j}" for j in range(5, 50)))], "doc_id long, text string", clash=False)
        out = D.contamination(docs, items)
        assert [tuple(r)[1:4] for r in out.collect()] == [(45, 45, 1)]
        return out._jdf.queryExecution().executedPlan().toString().count("MapInArrow")

    assert plan(3) == plan(3000) <= 2


def test_winnowing_of_nothing(frame):
    none = frame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in D.contamination(frame([(1, "a b")], "doc_id long, text string"), none).collect()] == [(2, 0, 0)]
    assert D.contamination(frame([], "doc_id long, text string"), none).collect() == []


def test_every_window_has_a_fingerprint():
    rng = np.random.default_rng(0)
    for n in (8, 9, 50, 500):
        h = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        chosen = D.fingerprints(h, 8)
        assert all(chosen[i : i + 8].any() for i in range(n - 7))
        assert all(chosen[i] == any(h[i] == h[j : j + 8].min() for j in range(max(0, i - 7), min(i, n - 8) + 1)) for i in range(n))


# -- SentencePiece -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return PieceModel(tokenizer_path(PIECE_MODEL))


def test_encoding_is_the_library_s(model):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "▁", "a", "the", "ing", "é", "\x00", "\x01", "😀", "1", "12", "<s>", "中", "\t", "\r\n", ".", "...", "́", "ZZZ", "    ", "x" * LONG]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [None, "", " ", "  ", "\n", " \n ", "a ", " a", "a" * 5000, "ab" * 3000 + " ", "中" * 400, "the" * 700]
    got = model.encode_batch(texts)
    assert [ids for ids, _ in got] == model.library.encode([t or "" for t in texts])
    assert [s for _, s in got] == [",".join(map(str, ids)) for ids, _ in got]
    assert [model.decode(ids) for ids, _ in got] == [model.library.decode(ids) for ids, _ in got]


def test_both_agendas_agree(model):
    rng = random.Random(2)
    f = ["▁" + "".join(rng.choice("abcdeinorst.é12") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    assert model._agenda_table(f) == [model._agenda_heap(x) for x in f]


def test_cache_turns_over():
    m = PieceModel(tokenizer_path(PIECE_MODEL), cache_limit=20)
    texts = [f"word{i % 37} other{i % 5} thing{i}" for i in range(300)]
    assert [ids for k in range(0, 300, 10) for ids, _ in m.encode_batch(texts[k : k + 10])] == m.library.encode(texts)


def test_encode_rows(frame, model):
    rows = [(1, "The cat\nsat."), (2, None), (3, ""), (None, "x"), (1, "The cat\nsat."), (4, "é" * 2000)]
    got = encode_and_decode(frame(rows, "doc_id long, text string"), tokenizer_path(PIECE_MODEL), keep_ids=True).collect()
    for r, (doc, text) in zip(got, rows, strict=True):
        ids = model.library.encode(text or "")
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (doc, len(ids), ids, text or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_and_decode(frame([], "doc_id long, text string"), tokenizer_path(PIECE_MODEL)).collect() == []


# -- toxicity ------------------------------------------------------------------------------------


def test_held_out_toxicity(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = X.toxicity(d, lab).join(lab, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.75
    assert sum(r.predicted for r in clean) / len(clean) < 0.005


def test_toxicity_edges(frame):
    docs = [(i, ("you idiot " if i % 2 else "a fine day ") + f"w{i % 7}") for i in range(1, 200)] + [(900, None), (901, ""), (None, "idiot"), (1, "repeated idiot"), (902, "idiot " * 20_000)]
    lab = [(i, i % 2, 1) for i in range(1, 200)] + [(3, 0, 1), (5, None, 1), (None, 1, 1)]
    df = frame(docs, "doc_id long, text string")
    got = X.toxicity(df, frame(lab, "doc_id long, toxic int, quality int")).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got if r.doc_id not in (1,)}
    assert by[902].predicted == 1 and by[900].score == by[901].score and by[None].held_out
    none = X.toxicity(df, frame([], "doc_id long, toxic int, quality int")).collect()
    assert {r.predicted for r in none} == {0}
    assert X.toxicity(frame([], "doc_id long, text string"), frame(lab, "doc_id long, toxic int, quality int")).collect() == []
    kept = X.drop_toxic(df, frame(lab, "doc_id long, toxic int, quality int"))
    assert kept.columns == df.columns and kept.filter("text like '%idiot%'").count() == 0


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.r_[rng.integers(100, 50_000, 50), 7 if y else 8]).astype(np.int32), y) for y in rng.integers(0, 2, 500)]
    at, w = X.fit(rows, X.Ftrl())
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert weight[7] > 0 > weight[8] and len(at) < 2_000


# -- quality -------------------------------------------------------------------------------------


def test_quality_against_labels(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality(d).join(lab, "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) / len(good) > 0.99
    assert sum(not r.kept for r in bad) / len(bad) > 0.95


def test_label_model_finds_accuracies():
    """One labeller that is mostly right, one that is half wrong."""
    rng = random.Random(0)
    from collections import Counter

    c, truth = Counter(), Counter()
    for _ in range(20_000):
        y = rng.random() < 0.8
        v = "".join(str(Q.BAD) if not y and rng.random() < p else str(Q.NONE) for p in (0.7, 0.6, 0.5))
        v += str(Q.GOOD) if y and rng.random() < 0.95 else str(Q.NONE)
        c[v] += 1
        truth[v] += y
    q = Q.label_model(sorted(c.items()))
    assert max(abs(q[v] - truth[v] / c[v]) for v in c if c[v] > 200) < 0.1
    assert Q.label_model([]) == {}


def test_variety_does_not_depend_on_length():
    few = [f"few{i}" for i in range(40)]
    for n in (19_999, 20_000, 60_000):
        assert Q.votes(Q.measures(" ".join(few[i * i % 40] for i in range(n))))[4] == Q.BAD
    rng = random.Random(1)
    long = " ".join(f"w{int(20_000 ** rng.random())}" for _ in range(60_000))
    assert len(set(long.split())) / 60_000 < 0.35 and Q.votes(Q.measures(long))[4] == Q.NONE
    words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(50)]
    for size in (1, 7, 49, 50, 51):
        windows = [words[i : i + size] for i in range(max(1, 50 - size + 1))]
        assert Q._variety(words, size) == pytest.approx(sum(len(set(x)) / len(x) for x in windows) / len(windows))


def test_shapes_take_all_of_a_long_word():
    def seen(text):
        return dict(zip(*(x.tolist() for x in Q.features(text, Q.Shapes())), strict=True))

    a, b = "x" * 64 + "Ab1" * 20 + "y" * 64, "x" * 64 + "1bA" * 20 + "y" * 64
    assert seen(a) != seen(b) and seen("plain words Here") != seen("plain words here")


def test_quality_edges(frame):
    docs = [(i, f"The quick brown fox {i} jumps over the lazy dog again today") for i in range(50)] + [(900, None), (901, ""), (902, "SHOUT!! " * 5_000), (None, "fine words here"), (1, "repeated row of words")]
    df = frame(docs, "doc_id long, text string")
    got = Q.quality(df).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score and not by[902].kept and by[7].kept
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and 902 not in {r.doc_id for r in kept.collect()}
    assert Q.quality(frame([], "doc_id long, text string")).collect() == []


# -- bounded tables of workers -------------------------------------------------------------------


def test_long_fragments_are_not_remembered():
    model = PieceModel(tokenizer_path(PIECE_MODEL))
    rng = random.Random(9)
    held = lambda: sum(len(w) + len(ids) for half in (model.ids_of, model.older) for w, ids in half.items())
    texts = ["".join(rng.choice("abcdefgh") for _ in range(20_000)) for _ in range(12)]
    model.encode_batch(["some words first"])
    before = held()
    for t in texts:
        (ids, _), (again, _) = model.encode_batch([t, t])
        assert ids == again == model.library.encode(t)
    assert held() - before < 100
    (ids, _), *_ = model.encode_batch([texts[0] + " words first " + texts[1]])
    assert ids == model.library.encode(texts[0] + " words first " + texts[1])


def test_long_words_are_not_remembered():
    from glossa.llm.hashing import WordHashes

    hashes = WordHashes(limit=10)
    words = [b"w%d" % k for k in range(25)] + [b"x" * 1000, b"w1"]
    got = hashes.of(words).tolist()
    assert got[1] == got[-1] and len(set(got)) == 26
    assert len(hashes) <= 10 and max(map(len, hashes)) <= 64
