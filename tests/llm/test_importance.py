"""Importance resampling against plain Python over whole texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tradelens.llm.importance import chunks, drawn_documents, features, resample


def found(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[k : k + m]) for k in range(len(words)) for m in range(1, n + 1) if k + m <= len(words)]


def brute(docs, target, n, buckets, percent, least):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(crc(f) for _, x in rows for f in found(x, n)[1]) for rows in (docs, target))
    size_s, size_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (size_s + buckets) / ((s[b] + 1.0) * (size_t + buckets))))
    out = []
    for i, x in docs:
        n_words, own = found(x, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(crc(f)) for f in own) // len(own) if own else 0
        out.append((i, n_words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((k for k, r in enumerate(out) if r[1] >= least), key=lambda k: (-out[k][4], out[k][0] is not None, out[k][0] or 0))
    rank = {k: p + 1 for p, k in enumerate(order[: len(order) * percent // 100])}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(k)) for k, r in enumerate(out)), key=str)


def texts():
    rng = random.Random(6)
    words = ["the", "Market", "ÜBER", "x1", "naïve", "界", "rates", "A", "b2b"]
    made = [rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(200)]
    return [None, "", "--", "a" * 5000, "market rates " * 3000, *made]


@pytest.mark.parametrize("n, size", [(1, 1 << 18), (1, 64), (3, 200)])
def test_against_python(spark, n, size):
    docs = [(i, t) for i, t in enumerate(texts())] + [(5, texts()[9]), (None, "market rates " * 20)]
    target = [(0, "the market rates rates"), (1, None), (2, "über naïve")]
    made = lambda rows: spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, weight double").repartition(3)
    got = resample(made(docs), made(target), n=n, buckets=50, percent=25, min_words=5, size=size).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target, n, 50, 25, 5)


def test_chunks_own_each_word_once():
    data = "ab cde é f1 -- ghij".encode() * 40
    for n in (1, 2, 4):
        for size in (1, 7, 50):
            cut = list(chunks(data, n, size))
            assert b"".join(d[:own] for d, own in cut) == data
            assert [f for d, own in cut for f in features(d, own, n)[1]] == features(data, len(data), n)[1]


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, "c d " * 20)], "doc_id long, text string")
    assert resample(none, some).count() == 0 and resample(some, none).count() == 2
    assert drawn_documents(some, some, percent=50).count() == 1
