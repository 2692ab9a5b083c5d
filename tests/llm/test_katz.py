"""The backoff model against a plain Python version."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from tradelens.llm import katz


def tokens(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def discounts(counter):
    """Good and Turing's estimate of each count up to 5 relative to the count, with Katz's correction for the larger ones."""
    n = Counter(counter.values())
    large = 6 * n[6] / n[1] if n[1] else 1.0
    found = {}
    for r in range(1, 6):
        if n[r] and large != 1:
            found[r] = ((r + 1) * n[r + 1] / n[r] / r - large) / (1 - large)
    return {r: found[r] if 0 < found.get(r, 1) < 1 else 1.0 for r in range(1, 6)}


def model(rows, order):
    grams = [Counter() for _ in range(order)]
    for i, t in rows:
        if not held_out(i):
            ws = ["<start>"] * (order - 1) + tokens(t)
            for k in range(order):
                grams[k].update(tuple(ws[j - k : j + 1]) for j in range(order - 1, len(ws)))
    uni, n = grams[0], sum(grams[0].values())
    d = [discounts(g) for g in grams]
    mass = sum(c * d[0].get(c, 1) for c in uni.values())
    whole = n if n - mass > 1e-9 * n else n + 1
    followed = [{} for _ in grams]
    for k in range(1, order):
        for g, r in grams[k].items():
            followed[k].setdefault(g[:-1], []).append((g[-1], r))

    def p(gram):
        k, r = len(gram) - 1, grams[len(gram) - 1][gram]
        if not k:
            return r * d[0].get(r, 1) / whole if r else 1 - mass / whole if whole else 1.0
        after = followed[k].get(gram[:-1])
        if after is None:
            return p(gram[1:])
        of, held = sum(x for _, x in after), sum(x * d[k].get(x, 1) for _, x in after)
        size = of if of - held > 1e-9 * of else of + 1
        if r:
            return r * d[k].get(r, 1) / size
        return (1 - held / size) / (1 - sum(p((*gram[1:-1], w)) for w, _ in after)) * p(gram[1:])

    return uni, n, p, followed


def rows_of(n=120):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "A", "a"]
    pick = lambda: vocabulary[min(int(rng.expovariate(0.08)), len(vocabulary) - 1)]
    return [(i, " ".join(pick() for _ in range(rng.randint(0, 40)))) for i in range(n)] + [(500, None), (501, " \n"), (502, "never seen before"), (7, "w1 w2")]


@pytest.mark.parametrize(("order", "chunk"), [(2, 4_000_000), (3, 4_000_000), (3, 300), (4, 50)])
def test_scores(spark, monkeypatch, order, chunk):
    monkeypatch.setattr(katz, "CHUNK", chunk)
    rows = rows_of()
    uni, n, p, followed = model(rows, order)
    got = sorted(map(tuple, katz.lm_scores(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3), order).collect()))
    want = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((uni[(w,)] + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in ws)
        padded = ["<start>"] * (order - 1) + ws
        score = sum(math.log10(p(tuple(padded[j - order + 1 : j + 1]))) for j in range(order - 1, len(padded)))
        want.append((i, held_out(i), len(ws), sum((w,) in uni for w in ws), n, base, score))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6
    for context in list(followed[-1])[:60]:
        assert abs(sum(p((*context, *w)) for w in uni) + p((*context, "<unknown>")) - 1) < 1e-9
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("katz_")]


def test_words_that_collide_in_polynomial_hashes(spark):
    """A word of the Thue-Morse sequence and its complement: modulo a power of two their polynomial hashes are one."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    train = next(i for i in range(99) if not held_out(i))
    other = next(i for i in range(99) if held_out(i))
    rows = {r.doc_id: r for r in katz.lm_scores(spark.createDataFrame([(train, x), (other, y)], "doc_id long, text string")).collect()}
    assert (rows[train].n_known, rows[other].n_known) == (2, 1)


def test_odd_input(spark):
    schema = "doc_id long, text string"
    assert katz.lm_scores(spark.createDataFrame([], schema)).count() == 0
    (row,) = katz.lm_scores(spark.createDataFrame([(None, None)], schema)).collect()
    assert (row.held_out, row.n_tokens, row.train_tokens) == (False, 1, 1) and row.score <= 0
    unlearnt = next(i for i in range(99) if held_out(i))
    (row,) = katz.lm_scores(spark.createDataFrame([(unlearnt, "a b")], schema)).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


def test_very_long_text(spark):
    rows = katz.lm_scores(spark.createDataFrame([(0, "a b c d " * 200_000), (2, "a b")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {0: 800_001, 2: 3} and all(r.score < 0 for r in rows)
