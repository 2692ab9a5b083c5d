"""The operators built from DataFrame functions alone, against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tradelens.llm.exact_dedup import exact_dedup
from tradelens.llm.quality_rules import host_verdicts, quality
from tradelens.llm.url_filter import filter_urls, rule_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, salt string"


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or {}).get(i, "s"), 0, "x", "y") for i, t in enumerate(texts)], DOCS)


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def texts_for_quality():
    rng = random.Random(5)
    words = ["a", "bb", "c#c", "é", "d$", "𝒳y"]
    out = [None, "", " \t\n ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x\ny\nx\nx \n\nx", "w " * 40]
    return out + [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]


def test_quality_measures(spark):
    texts = texts_for_quality()
    got = {r.doc_id: r for r in quality(frame(spark, texts), factor=float("inf")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), repr(t)
        assert r.kept == (not r.base_failed)


def test_bad_host_takes_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(30))
    texts = ["short"] * 40 + [good] * 10 + [good] * 50
    sources = {i: "bad" for i in range(50)} | {i: None for i in range(90, 100)}
    rows = quality(frame(spark, texts, sources)).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(50, 100))
    one = quality(frame(spark, [good] * 3)).collect()
    assert all(r.kept for r in one)
    assert quality(frame(spark, [])).count() == 0
    assert host_verdicts(spark.createDataFrame([], "source string, n_words long, n_repeat_words long, n_symbols long, word_chars long, n_dup_lines long, n_lines long")).count() == 0


def brute_dedup(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = {}
    for i, t in enumerate(norm):
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}


def test_exact_dedup(spark):
    rng = random.Random(3)
    long = ["".join(rng.choice("abcks é\n") for _ in range(30_000)) for _ in range(3)]
    texts = [None, "", " ", "a", "a", "a ", " a", "b\t c", "b c", "b\n\rc", "é x"] + long + [t.replace("\n", " \t") for t in long] + [long[0] + "z", "界" * 20_000, "界" * 20_000]
    for fingerprint in (lambda c: F.xxhash64(c), lambda c: F.pmod(F.xxhash64(c), F.lit(3))):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame(spark, texts), fingerprint).collect()}
        assert got == brute_dedup(texts)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_repeated_and_null_ids(spark):
    rows = exact_dedup(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(0, 0, 1, False), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


RULES = [("allow", "com/"), ("block", "b.com/x/"), ("allow", "a.b.com/x/"), ("block", "net/es/"), ("block", "b.com/"), ("block", "c.org")]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for verdict, rule in RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), rule, verdict))
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_rules(spark):
    rng = random.Random(1)
    hosts = ["com", "b.com", "a.b.com", "z.a.b.com", "xb.com", "x.net", "net", "B.Com", "c.org", "q.c.org", "", ".com", "com.", "b-c.com", "É.com", "b.com:80"]
    urls = [None, "", "no scheme", "http://", "a://b://c", "x\n://b.com/x/\ny"] + [f"{s}://{rng.choice(hosts)}{p}{q}" for s in ("http", "HTTPS") for p in ("", "/", "/x", "/x/", "/es/1", "/x/es/") for q in ("", "?a=/x/", "#f", "?://z") for _ in range(6)]
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, side int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rule_table(spark, RULES)).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert filter_urls(pages.limit(0), rule_table(spark, RULES)).count() == 0
    assert {r.verdict for r in filter_urls(pages, rule_table(spark, RULES).limit(0)).collect()} == {"allow"}


def test_rows_that_stay_are_told_apart_by_themselves(spark):
    from tradelens.llm.exact_dedup import exact_duplicates_dropped

    rows = [(3, "a", 1), (5, "a", 2), (5, "only here", 3), (7, "b", 4), (7, "b", 5), (None, "b", 6), (None, "c", 7), (None, "c", 8), (None, None, 9), (8, "", 10)]
    kept = exact_duplicates_dropped(spark.createDataFrame(rows, "doc_id long, text string, row int"))
    assert kept.columns == ["doc_id", "text", "row"]
    found = sorted(r.row for r in kept.collect())
    assert [r for r in found if r not in (4, 5, 7, 8)] == [1, 3, 10] and len(found) == 5 and len({4, 5} & {*found}) == len({7, 8} & {*found}) == 1
