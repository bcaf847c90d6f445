import random
import re
from collections import Counter

import numpy as np
import pytest

from glossa.llm.collocations import BLOCK, Scan, _by_slot, _tables, collocations
from glossa.llm.perfect_hash import PerfectHash


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = rng.choice(1 << 62, n, replace=False).astype(np.uint64) * np.uint64(3)
    checks = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    made = PerfectHash(keys, checks)
    assert sorted(made.slots(keys, checks).tolist()) == list(range(n))
    assert (made.slots(keys) == made.slots(keys, checks)).all()
    assert (made.slots(keys, checks + np.uint32(1)) == -1).all()
    assert (made.slots(keys + np.uint64(1)) == -1).all()


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError):
        PerfectHash(np.array([5, 5], np.uint64), np.array([1, 2], np.uint32))


def plain_pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lowered)]


def test_scan_of_long_and_odd_texts():
    rng = random.Random(2)
    parts = ["ab", "é", "漢字", "x" * 5000, "y" * 200_000, "\x00", "Z", "-"]
    text = "".join(rng.choice(parts[:4] + parts[5:] + [" ", "\t", "  ", ",", "\n", ". "]) for _ in range(3000)) + parts[4] + " ab " + parts[4] + "," + " w" * 50_000
    scan = Scan(text.encode().lower(), _tables(0))
    want = [(k, w) for k, p in enumerate(plain_pieces(text)) for w in p]
    got = [scan.raw[a:b].decode() for a, b in zip(scan.starts.tolist(), scan.ends.tolist(), strict=True)]
    assert got == [w for _, w in want]
    assert scan.piece.tolist() == [k for k, _ in want]
    by_key, by_word = {}, {}
    for w, key, check in zip(got, scan.key.tolist(), scan.check.tolist(), strict=True):
        by_key.setdefault((key, check), set()).add(w)
        by_word.setdefault(w, set()).add((key, check))
    assert all(len(x) == 1 for x in [*by_key.values(), *by_word.values()])
    assert len(Scan(b"", _tables(0)).key) == 0 and len(Scan(b" ,. ", _tables(0)).key) == 0


def test_counts_of_several_blocks():
    rows = [{"block": b, "places": np.array([0, 7], np.uint16).tobytes(), "counts": np.array([b + 1, 9], np.int64).tobytes()} for b in (0, 2)]
    out = _by_slot(3 * BLOCK, rows)
    assert out[[0, 7, 2 * BLOCK, 2 * BLOCK + 7]].tolist() == [1, 9, 3, 9] and out.sum() == 22


def plain_collocations(rows, most, floor):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in plain_pieces(text):
            words[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        c = {p: a for p, a in f.items() if len(p) > 1 and a >= floor}
        longest = Counter()
        for p, a in c.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        found = []
        for p, a in c.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not (longest[p] and 100 * longest[p] >= 80 * a):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, words[lang], -score) for rank, (score, a, p, x, y) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    common = ["the", "of", "a", "é", "漢", "x-y", "Z"]
    rare = [f"w{i}" for i in range(40)]
    set_phrases = ["in the end of", "New York City", "la vie", "漢 é a"]
    out = []
    for i in range(400):
        text = "".join(rng.choice([rng.choice(common), rng.choice(rare), rng.choice(set_phrases)]) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randint(0, 40)))
        out.append((i, rng.choice(["en", "en", "fr", None, "und", ""]), text))
    out += [(400, "en", None), (401, None, ""), (402, "de", "eins zwei drei"), (403, "en", "the end of " * 500), (404, "en", "a " * 3000), (405, "xx", "..,\n "), (406, "en", out[0][2])]
    return out


@pytest.mark.parametrize(("slots", "most", "floor"), [(1 << 22, 2000, 5), (60, 2000, 5), (1 << 22, 7, 12), (1 << 22, 2000, 400)])
def test_collocations_as_plain_python(frame, rows, slots, most, floor):
    docs = frame(rows, "doc_id long, lang string, text string").repartition(20)
    got = collocations(docs, most=most, floor=floor, slots=slots)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")
    want = plain_collocations([r[1:] for r in rows], most, floor)
    assert sorted(map(tuple, got.collect())) == want
    if most == 7:
        assert max(Counter(r[0] for r in want).values()) == 7


def test_nothing_is_frequent(frame):
    assert collocations(frame([], "lang string, text string")).count() == 0
    assert collocations(frame([("en", "one two"), (None, None)], "lang string, text string")).count() == 0
