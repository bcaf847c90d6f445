import hashlib
import random

import pytest

from glossa.llm.byte_pairs import LONG, BytePairs, encode_and_decode_words, pack, unpack
from glossa.llm.infill import STARTS, Chunks, Plan, infill, restored
from glossa.llm.queries import BYTE_VOCABULARY, tokenizer_path

ALPHABET = ["a", "b", " ", "the", " the", "é", "漢", "😀", "\n", "\t", ".", "'s", "'re", "12", "̀", " ", "\x85", "\x1c", "͸", "<P>", "<|endoftext|>", "<|endo"]


def some_text(rng, most):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


# -- fill in the middle -------------------------------------------------------------------------


@pytest.mark.parametrize("unit", sorted(STARTS))
@pytest.mark.parametrize("size", [1, 3, 4096])
def test_chunks_find_every_unit(unit, size):
    rng = random.Random(size)
    texts = [some_text(rng, 30).encode() for _ in range(40)] + [b"", "é".encode() * 5000, b""]
    chunks = Chunks(texts, unit, size)
    for k, t in enumerate(texts):
        begins = [i for i in range(len(t)) if i == 0 or (unit == "char" and t[i] & 0xC0 != 0x80) or (unit == "word" and t[i - 1 : i].isspace() and not t[i : i + 1].isspace()) or (unit == "line" and t[i - 1] == 10)]
        blanks = {0x1C, 0x85}  # not blanks for words
        if unit == "word" and blanks & set(t):
            continue
        assert chunks.units[k] == len(begins)
        some = range(len(begins)) if len(begins) < 100 else [0, 1, 4095, len(begins) - 1]
        assert [chunks.offset(k, r) for r in some if r < len(begins)] == [begins[r] for r in some if r < len(begins)]
        assert chunks.offset(k, len(begins)) == len(t)


def plain_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text) if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text)


def test_infill_as_plain_python(frame):
    rng = random.Random(4)
    rows = [(i, some_text(rng, 60)) for i in range(200)] + [(None, "no id"), (300, None), (301, ""), (302, "a<S>b"), (5, "again"), (5, "again"), (303, "漢é" * 40_000), (304, "<S"), (305, "<"), (306, "P><M")]
    out = infill(frame(rows, "doc_id long, text string"))
    got = out.withColumn("back", restored(out["output"], out["form"])).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_infill(*r) for r in rows), key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_other_units_and_sentinels(frame):
    plan = Plan(seed=7, infill_pct=100, suffix_first_pct=50, prefix="[pre]", suffix="[suf]", middle="[mid]")
    rows = [(i, "one two\nthree  four\n" * i) for i in range(12)]
    for unit in STARTS:
        out = infill(frame(rows, "doc_id long, text string"), plan, unit, size=5)
        got = out.withColumn("back", restored(out["output"], out["form"], plan)).collect()
        assert {r["doc_id"]: r["back"] for r in got} == dict(rows)
        assert all(r["form"] != "plain" for r in got if r["doc_id"])
    with pytest.raises(ValueError):
        Plan(prefix="ab", suffix="bc", middle="x")


def test_infill_of_an_empty_table(frame):
    assert infill(frame([], "doc_id long, text string")).count() == 0


# -- byte-level BPE -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return BytePairs(tokenizer_path(BYTE_VOCABULARY))


def test_words_and_merges_as_the_library(vocabulary):
    rng = random.Random(5)
    texts = [some_text(rng, 40) for _ in range(1500)] + ["ab" * LONG, "x" * 3000, "ß" * 700, " " * 500, "\n \n" * 90]
    for text in texts:
        words = vocabulary.words(text)
        assert "".join(words) == text
        ids = [i for w in words for i in vocabulary.encode_word(w)]
        assert ids == vocabulary.library.encode(text, add_special_tokens=False).ids
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids, skip_special_tokens=False)
    assert vocabulary.decode([vocabulary.byte_id[0xE6]]) == vocabulary.library.decode([vocabulary.byte_id[0xE6]], skip_special_tokens=False)


def test_numbers_are_packed():
    numbers = [0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1]
    import numpy as np

    assert unpack(pack(np.array(numbers))).tolist() == numbers
    assert unpack(pack(np.empty(0, np.int64))).tolist() == []


@pytest.mark.parametrize("most", [None, 200])
def test_documents_as_the_library(frame, vocabulary, monkeypatch, most):
    from glossa.llm import byte_pairs

    if most:  # many slices: in the workers too, which are forked anew for another environment
        monkeypatch.setattr(byte_pairs, "SLICE", most)
    rng = random.Random(6)
    rows = [(i, some_text(rng, 50)) for i in range(150)] + [(None, "no id"), (200, None), (201, ""), (7, "again the"), (7, "again the"), (202, "the " * 20_000), (203, "z" * 50_000)]
    path = tokenizer_path(BYTE_VOCABULARY)
    docs = frame(rows, "doc_id long, text string").repartition(3)
    got = encode_and_decode_words(docs, path, keep_ids=True).collect()
    want = []
    for doc_id, text in rows:
        ids = vocabulary.library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, ids, vocabulary.library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=str) == sorted(want, key=str)
    digests = encode_and_decode_words(docs, path).collect()
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(map(tuple, digests), key=str) == sorted(((d, len(i), hexed(",".join(map(str, i))), hexed(t)) for d, i, t in want), key=str)


def test_byte_pairs_of_an_empty_table(frame):
    assert encode_and_decode_words(frame([], "doc_id long, text string"), tokenizer_path(BYTE_VOCABULARY)).count() == 0
