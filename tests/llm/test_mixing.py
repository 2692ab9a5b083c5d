"""Mixing: rates meet their targets, keep their floor, and odd input has its defined result."""

import random

import numpy as np
import pytest

from tradelens.llm.mixing import FEATURES, SLICE, fit, fit_rates, mix, mixed_documents, n_tokens, shares
from tradelens.llm.shared import bounded_sample

public = pytest.importorskip("public_tokenizers")
ENCODER = (public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
WEIGHTS = {"a": 0.3, "b": 0.5, "c": 0.2}


def planted(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        k = rng.choices("abc", [6, 3, 1])[0]
        rows.append((i, " ".join(k + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 40))), "x", k))
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string, domain string")
    return docs.drop("domain"), docs.select("doc_id", "domain")


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_targets(spark, floor):
    docs, labels = planted(spark)
    rows = mix(docs, labels.filter("doc_id < 200"), WEIGHTS, ENCODER, floor).collect()
    totals = [sum(r.n_tokens * r.shares[k] * r.rate for r in rows) for k in range(3)]
    for got, want in zip(totals, WEIGHTS.values(), strict=True):
        assert abs(got / sum(totals) - want) < 0.01
    assert min(r.rate for r in rows) >= floor and all(0 <= r.copies - r.rate + 1 <= 2 for r in rows)
    right = {r.doc_id: "abc"[max(range(3), key=lambda k: r.shares[k])] for r in rows}
    truth = {r.doc_id: r.domain for r in labels.collect()}
    assert sum(right[i] == truth[i] for i in range(200, 300)) > 95


def test_documents(spark):
    docs, labels = planted(spark)
    out = mixed_documents(docs, labels, WEIGHTS, ENCODER, floor=1.0)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(range(300))
    assert {r.rate for r in out.collect()} == {"x"}


def test_odd_input(spark):
    docs, labels = planted(spark)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "b1 " * 30_000)], "doc_id long, text string")
    assert mix(odd, labels, WEIGHTS, ENCODER).count() == 3
    assert mix(odd, labels.limit(0), WEIGHTS, ENCODER).count() == 3
    assert mix(docs.limit(0), labels, WEIGHTS, ENCODER).count() == 0
    blank = odd.filter("text is null or text = ''")
    rates = fit_rates(mix(blank, labels, WEIGHTS, ENCODER).select("shares", "n_tokens"), WEIGHTS)
    assert sum(rates.targets.values()) == 0 and not rates.steps
    clash = docs.selectExpr("doc_id", "text", "'y' as n_tokens", "1 as shares", "2 as miss", "3 as copies")
    assert mix(clash, labels, WEIGHTS, ENCODER).filter("size(shares) = 3 and n_tokens > 0 and miss < 1e-3").count() == 300


@pytest.mark.parametrize("floor", [0.0, 1.0])
@pytest.mark.parametrize("part", [0.003, 0.001])
def test_scarce_domain_reaches_its_target(spark, floor, part):
    goal = [0.50, 0.14, 0.14, 0.12, 0.10]
    one_hot = [([float(k == j) for j in range(5)], int(1_000_000 * w)) for k, w in enumerate([0.7 - part, 0.1, 0.1, 0.1, part])]
    shared = spark.createDataFrame(one_hot, "shares array<double>, n_tokens long")
    rates = fit_rates(shared, dict(zip("abcde", goal, strict=True)), floor)
    rows = rates.added(shared).collect()
    assert rates.miss <= 1e-4
    for k, want in enumerate(rates.targets.values()):
        assert sum(r.n_tokens * r.shares[k] * r.rate for r in rows) == pytest.approx(want, rel=2e-4)


def test_small_posteriors_count():
    weights = np.zeros((FEATURES, 3), np.float32)
    weights[7] = [5, 0, 0]
    found = shares(weights, np.array([7]), np.array([1.0]))
    assert found.sum() == pytest.approx(1) and 0 < found[1] < 0.025


@pytest.mark.parametrize(("floor", "out_of_reach"), [(0.0, False), (0.4, False), (0.4, True)])
def test_rates_are_least_squares_ones(spark, floor, out_of_reach):
    """Against plain projected gradient steps with numpy on every document's rate."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.6, 0.4, 0.3], 60)
    if out_of_reach:  # no text has less than a half of the first domain, whose weight is under a third
        p = np.maximum(p, [0.6, 0, 0])
        p /= p.sum(axis=1, keepdims=True)
    n = rng.integers(20, 90, 60)
    shared = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(p, n, strict=True)], "shares array<double>, n_tokens long")
    rates = fit_rates(shared, WEIGHTS, floor)
    rows = rates.added(shared).collect()
    got, want = np.array([r.rate for r in rows]), np.array([*rates.targets.values()])
    own = np.array([[*r.shares, r.n_tokens] for r in rows])
    a = (own[:, :3] * own[:, 3:]).T
    square = lambda r: (((a @ r - want) / want) ** 2).sum()
    gram = a @ own[:, :3]
    longest = 1 / np.linalg.eigvalsh(gram / np.outer(want, want)).max()
    r = np.ones(60)
    for _ in range(50_000):
        r = np.maximum(floor, r - own[:, :3] @ ((a @ r - want) / want**2) * longest)
    assert got.min() >= floor and square(got) == pytest.approx(square(r), rel=5e-2, abs=1e-6 * square(np.zeros(60)))
    assert (rates.miss > 0.05) == out_of_reach


def test_domains_that_no_text_is_of(spark):
    """Shares next to nothing are not blown up to meet a target."""
    shared = spark.createDataFrame([([1 - 2e-9, 1e-9, 1e-9], 50)] * 20, "shares array<double>, n_tokens long")
    for floor in (0.0, 1.0):
        rates = fit_rates(shared, WEIGHTS, floor)
        assert rates.miss > 0.9 and max(r.rate for r in rates.added(shared).collect()) < 2


def test_tokens_of_slices():
    text = "Some words,  and 12 numbers " * 12_000
    import tiktoken

    n_tokens("", *ENCODER)
    from tradelens.llm.mixing import _ENCODERS

    assert isinstance(_ENCODERS[ENCODER], tiktoken.Encoding) and len(text) > 3 * SLICE
    assert n_tokens(text, *ENCODER) == len(_ENCODERS[ENCODER].encode_ordinary(text)) and n_tokens(None, *ENCODER) == 0


def test_sample_skips_texts_that_do_not_fit(spark):
    docs = spark.createDataFrame([(i, "x" * (300 if i == 7 else 10)) for i in range(20)], "doc_id long, text string")
    chosen = docs.selectExpr("doc_id", "'a' as domain")
    assert {r.doc_id for r in bounded_sample(docs, chosen, "domain", 200).collect()} == set(range(20)) - {7}
    assert bounded_sample(docs, chosen, "domain", 55).count() == 5 and bounded_sample(docs, chosen.limit(0), "domain").count() == 0
    assert fit(docs, chosen, ["a", "b"], max_bytes=100).shape[1] == 2
