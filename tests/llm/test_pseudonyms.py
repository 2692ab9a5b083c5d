"""Pseudonyms: valid, of the same form, linked across texts, and reversible because nothing collides."""

import random
import re

import pytest

from tradelens.llm.pseudonyms import Feistel, luhn, pseudonymise, pseudonymise_texts

CIPHER = Feistel(b"k")
VALUES = {
    "email": "jo.Doe+7@mail.example.com",
    "secret": "0123456789abcdef0123456789abcdef01234567",
    "iban": "DE89 3704 0044 0532 0130 00",
    "card": "4111 1111 1111 1111",
    "phone": "+1 (743) 555-3824",
    "ssn": "123-45-6789",
    "ip": "10.0.200.3",
    "date": "2024-02-29",
}


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 1024])
def test_permutation(size):
    assert sorted(CIPHER.permute(v, size, "t") for v in range(size)) == list(range(size))


@pytest.mark.parametrize("kind", VALUES)
def test_kinds(kind):
    value = VALUES[kind]
    text = f"é {value} and {value}, end."
    new, spans = pseudonymise(text, CIPHER)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, value.split("@")[0] + ("@" if "@" in value else ""))] * 2
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
    if kind not in ("ip", "secret"):
        assert shape(new) == shape(text)
    found = re.match("é (.*) and (.*), end.$", new)
    assert found.group(1) == found.group(2) != value
    assert [s[0] for s in pseudonymise(new, CIPHER)[1]] == [kind] * 2  # still valid
    assert pseudonymise(text, Feistel(b"other"))[0] != new


def test_left_alone():
    for text in ("4111 1111 1111 1112", "999.1.1.1", "2023-02-29", "DE00 3704 0044 0532 0130 00", "000-12-3456", "+1 ٠٠٠ ٥٥٥ ١٢٣٤", "٤١١١ 1111 1111 1111", "v1.2.3", "a@b", ""):
        assert pseudonymise(text, CIPHER) == (text, [])


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("call +1 (017) 555-7713 now", "phone", "+1 (017) 555-7713"),
        ("TOKEN 9233A8ECF7C5B09FE5949719B6B82BC439E9329B!", "secret", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"),
        ("t 9233a8ecF7c5b09fe5949719b6b82bc439e9329b!", "secret", "9233a8ecF7c5b09fe5949719b6b82bc439e9329b"),
        ("7 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
        ("4111 1111 1111 1111 12", "card", "4111 1111 1111 1111"),
        ("1234 5678 4111 1111 1111 1111 9", "card", "4111 1111 1111 1111"),
        ("12-4111-1111-1111-1111-12345-6", "card", "4111-1111-1111-1111"),
        ("DE89370400440532013000 2024", "iban", "DE89370400440532013000"),
        ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", "iban", "DE89 3704 0044 0532 0130 00"),
        ("XX12 DE89370400440532013000 2024", "iban", "DE89370400440532013000"),
        ("2024-02-29 12345", "date", "2024-02-29"),
    ],
)
def test_neighbours_and_rare_forms(text, kind, value):
    new, spans = pseudonymise(text, CIPHER)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, value)] and value not in new
    assert [s[0] for s in pseudonymise(new, CIPHER)[1]] == [kind]
    before, after = text.split(value)
    assert new.startswith(before) and new.endswith(after)


def test_every_phone_is_permuted_and_cases_are_linked():
    rng = random.Random(2)
    phones = {f"+1 ({rng.randint(0, 999):03d}) {rng.randint(0, 999):03d}-{rng.randint(0, 99):04d}" for _ in range(3000)}
    assert len({pseudonymise(x, CIPHER)[0] for x in phones}) == len(phones)
    token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    assert pseudonymise(token.upper(), CIPHER)[0] == pseudonymise(token, CIPHER)[0].upper()
    for text in ("v1.2.3", "a@b", "", "7 4111 1111 1111 1112", "DE00 3704 0044 0532 0130 00 2024"):
        assert pseudonymise(text, CIPHER) == (text, [])


def test_forms_are_linked():
    plain, spaced = (pseudonymise(t, CIPHER)[0] for t in ("4111111111111111", "4111-1111-1111-1111"))
    assert spaced.replace("-", "") == plain and luhn(plain[:-1]) == int(plain[-1])


def test_no_collisions():
    rng = random.Random(1)
    ips = {f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.1.{rng.randint(0, 9)}" for _ in range(3000)}
    assert len({pseudonymise(x, CIPHER)[0] for x in ips}) == len(ips)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, VALUES["ip"]), (2, "w " * 50_000 + VALUES["card"])], "doc_id long, text string").selectExpr("*", "1 as n_found")
    rows = pseudonymise_texts(docs, "k").collect()
    assert sorted((r.doc_id or 0, r.n_found, r.n_card) for r in rows) == [(0, 1, 0), (1, 0, 0), (1, 0, 0), (2, 1, 1)]
    assert {r.text for r in rows if r.doc_id == 1} == {None, ""}
    assert pseudonymise_texts(docs.limit(0), "k").count() == 0
