"""Secret spans against a scanner that goes character by character."""

import hashlib
import random
import string

import pytest

from tradelens.llm.secret_scan import known, masked, secret_report, secret_spans

public = pytest.importorskip("public_tokenizers")
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def assignment(text, low, a):
    """(end, length of the value) of the assignment that starts at a, by hand."""
    name = next((n for n in NAMES if low.startswith(n, a)), None)
    if name is None:
        return None
    k = a + len(name)
    k += k < len(text) and text[k] in "\"'"
    while k < len(text) and text[k] == " ":
        k += 1
    if k == len(text) or text[k] not in ":=":
        return None
    k += 1
    while k < len(text) and text[k] == " ":
        k += 1
    k += k < len(text) and text[k] in "\"'"
    end = k
    while end < len(text) and text[end] in VALUE:
        end += 1
    return (end, end - k) if end > k else None


def base(text):
    found, k = [], 0
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    while k < len(text):
        hit = assignment(text, low, k)
        if hit and hit[1] >= 12:
            found.append((k, 0, hit[0]))
        k = hit[0] if hit else k + 1
    for rank, chars, least, head in ((1, string.ascii_uppercase + string.digits, 18, "AKIA"), (2, string.digits + "abcdef", 16, "")):
        k = 0
        while k < len(text):
            end = k + len(head)
            while text.startswith(head, k) and end < len(text) and text[end] in chars:
                end += 1
            if text.startswith(head, k) and end > k + len(head):
                if end - k >= least:
                    found.append((k, rank, end))
                k = end
            else:
                k += 1
    return ",".join(f"{['assign', 'access', 'hex'][r]}:{a}:{b}" for a, r, b in sorted(found))


def texts():
    rng = random.Random(3)
    parts = [*NAMES, "TOKEN", "Api_Key", "ſecret", "toKen", "=", ":", " ", "  ", "'", '"', "é", "🙂", "\n", "AKIA", "AKIAAKIA", "A1B2C3D4", "deadbeef", "0123456789abcdef", "x.y-z/w", "abcdefghijkl", "token: token: abcdefghijklmnop", "===="]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    return [None, "", " ", "token = \"abc\"", "word " * 50_000 + "secret=abcdefghijklm" + " word" * 50_000, *made]


def scanned(docs):
    return secret_report(secret_spans(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN))


def test_forms(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id int, text string, spans string")
    rows = {r.doc_id: r for r in scanned(docs).collect()}
    assert len(rows) == len(texts())
    for i, t in enumerate(texts()):
        want = base(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), repr(t)
        assert ",".join(s for s in rows[i].spans.split(",") if not s.startswith("random")) == want
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))


def test_random_strings(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (24, 32, 40)] + ["sk-proj-" + "".join(rng.choice(string.ascii_letters + string.digits + "_") for _ in range(30))]
    plain = ["internationalization_of_names", "HttpServletRequestWrapper2", "4111-1111-1111-1111", "123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "usr/local/share/perl5", "THATHERTIONELLEEN", "éinternationalñandeñ", "2024-01-02_2024-05-06"]
    docs = spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(keys + plain)], "doc_id int, text string")
    spans = {r.doc_id: r.spans for r in scanned(docs).collect()}
    assert [spans[i] for i in range(len(keys))] == [f"random:2:{2 + len(k)}" for k in keys]
    assert all(not spans[len(keys) + i] for i in range(len(plain))), spans
    assert all(map(known, ["d41d8cd98f00b204e9800998ecf8427e", "snake_case_name", "camelCaseName"])) and not known(keys[0])


def test_masks_and_odd_rows(spark):
    key = "k9Qz7Xv2Lp4Wm8Rt6Yb3Nc5J"
    docs = spark.createDataFrame([(1, f"é {key} and token='0123456789abcdef0123' end"), (1, f"é {key} and token='0123456789abcdef0123' end"), (None, None), (2, "")], "doc_id int, text string")
    found = secret_spans(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    assert sorted((str(r.doc_id), str(r.text)) for r in masked(found).collect()) == [("1", "é *** and ***' end"), ("1", "é *** and ***' end"), ("2", ""), ("None", "None")]
    assert scanned(docs.limit(0)).count() == 0
