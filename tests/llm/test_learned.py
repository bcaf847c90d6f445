"""The two trained queries against plain re-implementations: per-row loops, dictionaries, no patterns, no arrays."""

import math
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F
from test_text_ops import words

from glossa.llm import queries

MASK = (1 << 64) - 1


def mix(x):
    x &= MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def toxic_features(text):
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words(text)]
    every = [mix(a + 1) for a in h]
    every += [mix((a + 2) * 0x9E3779B97F4A7C15 + b) for a, b in zip(h, h[1:], strict=False)]
    every += [mix(a * 0xD6E8FEB86659FD93 + b + 1) for a, b in zip(h, h[2:], strict=False)]
    return sorted({x >> 44 for x in every})


def test_op8_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64(F.lit("order"), "doc_id").alias("o")).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.toxic is not None and r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 5:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), int(r.toxic))
    alpha, beta, l1 = 4.0, 1.0, 3.0
    z, n = {}, {}

    def weight(i):
        zi, free = z.get(i, 0.0), i == "bias"
        if not free and abs(zi) <= l1:
            return 0.0
        return (math.copysign(0.0 if free else l1, zi) - zi) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha)

    rows = [([*toxic_features(text[d]), "bias"], y) for d, y in sorted(labels.items(), key=lambda x: order[x[0]])]
    for _ in range(8):
        for at, y in rows:
            w = [weight(i) for i in at]
            g = sigmoid(sum(w)) - y
            for i, wi in zip(at, w, strict=True):
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * wi
                n[i] = old + g * g
    got = queries.QUERIES["op8_toxicity_ftrl"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        score = sigmoid(sum(weight(i) for i in [*toxic_features(text[r.doc_id]), "bias"]))
        assert r.score == pytest.approx(score, abs=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5)


def plain_measures(text):
    raw = (text or "").encode()
    parts = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", raw) if w]
    visible = max(1, sum(len(w) for w in parts))
    n = max(1, len(parts))
    up, low = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    odd = sum(33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"()?-!|" for b in raw)
    windows = [parts[i : i + 1024] for i in range(max(1, len(parts) - 1023))]
    variety = sum(len(set(w)) / max(1, len(w)) for w in windows) / len(windows)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [len(parts), odd / visible, up / max(1, up + low), raw.count(b"!") / n, raw.count(b"|") / n, variety, 1 - len(set(lines)) / max(1, len(lines)), sum(a == b for a, b in zip(parts, parts[1:], strict=False)) / n, visible / n]


def plain_votes(m):
    n, odd, caps, bangs, bars, variety, lines, stutter, length = m
    long = n >= 8
    bad = [odd > 0.08, long and caps > 0.5, bangs > 0.3, long and bars > 0.15, long and variety < 0.35, long and lines > 0.4, long and stutter > 0.2, n > 0 and not 2 <= length <= 14]
    prose = n > 0 and variety > 0.5 and caps < (0.2 if long else 0.6) and stutter < 0.1 and odd < 0.04 and bars < 0.03 and bangs < 0.1 and 1.5 < length < 14
    return ["bad" if b else "-" for b in bad] + ["good" if prose else "bad" if n == 0 else "-"]


def shape(word):
    looks = "".join("a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b) for b in word + word[-4:])
    return re.sub(r"(?s)(.)\1{2,}", r"\1\1", looks).encode("latin-1")


def quality_features(text):
    m, size, x = plain_measures(text), 1 << 16, {}
    raw = (text or "").encode()
    pieces = [w[i : i + 64] for w in re.split(rb"[ \t\n\r\x0b\x0c]+", raw) if w for i in range(0, len(w), 64)]
    counts = {}
    for p in pieces:
        h = (xxhash.xxh64_intdigest(shape(p)) >> 48)
        counts[h] = counts.get(h, 0) + 1
    x = [(h % (size - 128), c / max(1, len(pieces))) for h, c in sorted(counts.items())]
    steps = [min(9, int(math.log2(1 + m[0])))] + [min(9, int(v * 10)) for v in m[1:8]] + [min(9, int(m[8] / 2))]
    return [*x, *[(size - 128 + 10 * k + s, 0.5) for k, s in enumerate(steps)], (size, 0.5)]


def test_op9_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), F.length("text")).alias("o")).collect()
    votes = {r.doc_id: plain_votes(plain_measures(r.text)) for r in rows}
    # expectation-maximisation over the documents themselves
    q = {d: 0.1 if "bad" in v else 0.9 for d, v in votes.items()}
    for _ in range(200):
        prior = (sum(q.values()) + 1) / (len(q) + 2)
        rates = []
        for j in range(9):
            for good in (False, True):
                mass = {"bad": 1.0, "-": 1.0, "good": 1.0}
                for d, v in votes.items():
                    mass[v[j]] += q[d] if good else 1 - q[d]
                rates.append({k: x / sum(mass.values()) for k, x in mass.items()})
        new = {}
        for d, v in votes.items():
            bad, good = (math.log(p) + sum(math.log(rates[2 * j + k][v[j]]) for j in range(9)) for k, p in ((0, 1 - prior), (1, prior)))
            new[d] = 1 / (1 + math.exp(min(700, max(-700, bad - good))))
        done = max(abs(new[d] - q[d]) for d in q) < 1e-9
        if done:
            break
        q = new
    w, g2 = {}, {}
    given = [(quality_features(r.text), q[r.doc_id]) for r in sorted(rows, key=lambda r: (r.o, q[r.doc_id]))]
    for _ in range(6):
        for x, y in given:
            e = sigmoid(sum(w.get(i, 0.0) * v for i, v in x)) - y
            step = {}
            for i, v in x:  # equal coordinates take the last one's step, as a vector's assignment does
                g = e * v + 1e-5 * w.get(i, 0.0)
                step[i] = g
            for i, g in step.items():
                g2[i] = g2.get(i, 1e-3) + g * g
                w[i] = w.get(i, 0.0) - 0.5 * g / math.sqrt(g2[i])
    got = queries.QUERIES["op9_weak_label_quality"](spark, sf).collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in rows}
    for r in got:
        assert r.posterior == pytest.approx(q[r.doc_id], abs=1e-6)
        assert r.score == pytest.approx(sigmoid(sum(w.get(i, 0.0) * v for i, v in quality_features(text[r.doc_id]))), abs=1e-3)
        assert r.kept == (r.score >= 0.5)
