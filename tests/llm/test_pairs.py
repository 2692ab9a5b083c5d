"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from tradelens.llm import ngram_join as join


def brute(texts):
    """n_shingles, component and number of different texts that link, by comparing all pairs."""
    lists = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for w in lists]
    root, links = list(range(len(texts))), [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
                if lists[i] != lists[j]:
                    links[i].add(tuple(lists[j]))
                    links[j].add(tuple(lists[i]))
    return {i: (len(s), root[i], len(links[i])) for i, s in enumerate(sets)}


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 400))
    texts = [None, "", " \t\n", "one", "ONE", "a b c d", "a b c d e", "a b c d e f", "a b c d e f g", "É x", "é x"]
    passage = [word() for _ in range(60)]
    for size in (6, 7, 9, 12, 17, 18, 25, 53, 54, 90, 161, 162, 300, 900):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, size // 20, size // 10):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: len(copy) - rng.randint(0, 2)]))
    texts += [" ".join(passage + [word() for _ in range(rng.randint(0, 30))]) for _ in range(60)]
    return texts


@pytest.mark.parametrize(("frequent", "tile"), [(join.FREQUENT, join.TILE), (2, join.TILE), (2, 5)])
def test_components(spark, monkeypatch, frequent, tile):
    monkeypatch.setattr(join, "FREQUENT", frequent)
    monkeypatch.setattr(join, "TILE", tile)
    monkeypatch.setattr(join, "HOT_CLASS", 5 if tile == 5 else join.HOT_CLASS)
    texts = corpus()
    texts += [texts[20]] * 8
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_links long").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in join.ngram_join(docs).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("size", [3, 5, 7, 11, 16, 18, 30, 52, 54, 100, 161, 200, 485, 490])
def test_signatures_meet(size):
    """In every band, sets that differ as much as they may share a signature of one scheme."""
    rng = np.random.default_rng(size)
    for _ in range(300):
        y = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        extra = int(rng.integers(0, size // 3 + 1))  # smaller partner: sub-set with replacements
        x = y[: size - extra].copy()
        while True:
            swaps = int(rng.integers(0, size))
            z = x.copy()
            z[:swaps] = rng.integers(1, 1 << 63, min(swaps, len(z)), dtype=np.uint64) if swaps <= len(z) else 0
            same = len(np.intersect1d(z, y))
            if 100 * same >= 75 * (len(z) + size - same) or swaps == 0:
                break
        if 100 * same < 75 * (len(z) + size - same):
            continue
        a, b = (np.concatenate([e for _, e, _ in join.entries(np.unique(s))]) for s in (z, y))
        assert len(np.intersect1d(a, b))
        assert join.least_apart(join.sketch_of(np.unique(z)), join.sketch_of(np.unique(y))) <= len(np.setxor1d(z, y))


def test_words_that_collide_in_polynomial_hashes(spark):
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = join.ngram_join(spark.createDataFrame([(1, f"{x} p q r s {y} p q r s")], "doc_id long, text string")).collect()
    assert rows[0].n_shingles == 6


def test_empty_repeated_and_long(spark):
    schema = "doc_id long, text string"
    assert join.ngram_join(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = join.ngram_join(spark.createDataFrame([(3, "a b"), (3, "a b"), (2, "A  b"), (None, "a b"), (9, None), (10, long), (11, long + " x")], schema)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in rows) == [(2, 1, 2, 0), (3, 1, 2, 0), (3, 1, 2, 0), (9, 0, 9, 0), (10, 59_996, 10, 1), (11, 59_997, 10, 1)]
    kept = join.near_duplicates_kept(spark.createDataFrame([(3, "a b", 1), (2, "A  b", 2), (None, "a b", 3), (9, None, 4), (9, None, 5)], schema + ", n int")).collect()
    assert sorted(r.n for r in kept) == [2, 4, 5]
    words = " ".join(f"v{i}" for i in range(40))
    clash = spark.createDataFrame([(5, words, 1), (5, words + " x", 2), (5, "only here", 3), (3, words, 4), (None, "y " + words, 5), (None, "nor here", 6)], schema + ", n int")
    assert sorted(r.n for r in join.near_duplicates_kept(clash).collect()) == [3, 4, 6]
