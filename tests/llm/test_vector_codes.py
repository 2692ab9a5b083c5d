"""Vector codes against exhaustive search over all entries."""

import hashlib
import math

import numpy as np
import pytest

from tradelens.llm.vector_codes import Tree, compress, decompress, vector_codes


def brute(rows, dim, parts, size, rounds):
    """code, error and codebooks by comparing every part with every entry."""
    x = np.floor(256 * np.array([v for _, v, _ in rows], np.float64)).astype(np.int64).reshape(len(rows), parts, dim // parts)
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0], rows[k][1]))[:size]
    books = x[first].transpose(1, 0, 2).copy()
    assigned = lambda: ((x[:, :, None] - books[None]) ** 2).sum(-1)
    for _ in range(rounds):
        codes = assigned().argmin(-1)
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[codes[:, p] == e, p]
                if len(own):
                    books[p, e] = [math.floor(sum(map(int, c)) / len(own)) if len(own) == 1 else sum(map(int, c)) // len(own) for c in own.T]
    d = assigned()
    return d.argmin(-1), d.min(-1).sum(-1), books


@pytest.mark.parametrize("width, spread", [(1, 2), (1, 200), (4, 3), (4, 60), (9, 40)])
def test_tree_finds_the_nearest(width, spread):
    rng = np.random.default_rng(width * spread)
    for n in (1, 2, 7, 30, 64):
        entries, points = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-2 * spread, 2 * spread + 1, (500, width))
        at, d = Tree(entries).nearest(points)
        all_ = ((points[:, None] - entries[None]) ** 2).sum(-1)
        assert (at == all_.argmin(1)).all() and (d == all_.min(1)).all()
    same = np.ones((40, width), int)  # ties go to the lowest index
    assert set(Tree(same).nearest(points)[0]) == {0}


def test_codes(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)], int(i) % 3 or None) for i in rng.permutation(300)]
    vectors += [vectors[0], vectors[1], (7, vectors[2][1], 1)]  # repeated rows, and another vector of one id
    bad = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 1), (904, [None] * 8, 1), (905, [1.0] * 6, 1)]
    table = spark.createDataFrame([(i, v, y, "x") for i, v, y in vectors + bad], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    codes, errors, books = brute(vectors, 8, 4, 16, 2)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = {}
    for (_, _, y), e in zip(vectors, errors):
        by_label[y] = by_label.get(y, 0) + int(e)
    want = sorted((i, bytes(map(int, c)).hex(), int(e), by_label[y], digest) for (i, _, y), c, e in zip(vectors, codes, errors))
    assert sorted(map(tuple, vector_codes(table, parts=4, size=16).collect())) == want
    coded, found = compress(table, parts=4, size=16)
    assert (found == books).all()
    row = decompress(coded, found).filter("vec_id = 11").first()
    assert row.vector == [v / 256 for p, c in enumerate(row.code) for v in books[p, c].tolist()]


def test_few_and_none(spark):
    table = spark.createDataFrame([(1, [0.5] * 16, None), (None, [0.25] * 16, 2), (3, None, None)], "vec_id long, embedding array<float>, label int")
    rows = {r.vec_id: r for r in vector_codes(table).collect()}
    assert set(rows) == {1, None} and rows[1].error == 0 and rows[None].code == "00" * 16 and rows[1].code == "01" * 16
    assert vector_codes(table.filter("vec_id = 3")).count() == 0 and vector_codes(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes(spark.createDataFrame([(1, [0.5] * 15, None)], "vec_id long, embedding array<float>, label int"))
