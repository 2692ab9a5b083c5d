"""The corpus operators' queries, each with its production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.llm.bpe_codec import encode_texts
from tradelens.llm.bpe_count import count_tokens
from tradelens.llm.exact_dedup import exact_dedup
from tradelens.llm.importance import resample
from tradelens.llm.katz import lm_scores
from tradelens.llm.mixing import labelled_domains, mix
from tradelens.llm.ngram_join import ngram_join
from tradelens.llm.pseudonyms import pseudonymise_texts
from tradelens.llm.quality_rules import quality
from tradelens.llm.secret_scan import secret_report, secret_spans
from tradelens.llm.shared import table
from tradelens.llm.toxicity import toxicity
from tradelens.llm.url_filter import filter_urls, rule_table
from tradelens.llm.vector_codes import vector_codes

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Target shares of tokens: the languages of good documents, and documents of low quality in any language.
MIX_WEIGHTS = {"en": 0.50, "de": 0.14, "fr": 0.14, "es": 0.12, "low": 0.10}
#: A production key comes from the caller's secret store; this one makes the query's results repeatable.
PSEUDONYM_KEY = "example-key"


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, which every executor has as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder() -> tuple[str, str]:
    """The vocabulary of byte_bpe_50k as ranks, and the pattern by which it splits texts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, vocabulary("byte_bpe_50k.json"), with_ids=False).drop("text")


def op4_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


def op5_pii_pseudonyms(spark, sf_dir):
    return pseudonymise_texts(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    mixed = mix(docs.drop("lang"), labelled_domains(docs, table(spark, sf_dir, "labels")), MIX_WEIGHTS, encoder())
    return mixed.select("doc_id", "n_tokens", *[F.col("shares")[k].alias(f"share_{d}") for k, d in enumerate(MIX_WEIGHTS)], "rate", "miss", "copies")


def op9_katz_backoff(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op10_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secret_scan(spark, sf_dir):
    return secret_report(secret_spans(table(spark, sf_dir, "documents"), *encoder()))


def op12_vector_codes(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_bpe_codec, op3_quality_rules, op4_token_counts, op5_pii_pseudonyms,
        op6_mixing, op7_exact_dedup, op8_url_filter, op9_katz_backoff, op10_toxicity,
        op11_secret_scan, op12_vector_codes, op13_importance_resampling,
    )
}

OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

_RULES = ", ".join(f"('{r.split('/')[0]}', '{r[r.index('/'):]}', '{r}', '{v}')" for v, r in URL_RULES)
OP8_SQL = rf"""
WITH r(rhost, rpath, rule, verdict) AS (VALUES {_RULES}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
f AS (SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
      FROM p JOIN r ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""

_KEPT = """
kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS pos, x FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i, len(v) // 16 AS w FROM kept) c),
books0 AS MATERIALIZED (SELECT part, entry, pos, x AS y FROM cells JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) s USING (vec_id))"""


def _round(k: int) -> str:
    """Assignments to the codebooks of round k."""
    return f"""
codes{k} AS MATERIALIZED (SELECT vec_id, part, min(d * 64 + entry) % 64 AS entry, min(d) AS d FROM (
  SELECT vec_id, part, entry, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM cells JOIN books{k} USING (part, pos) GROUP BY vec_id, part, entry) c GROUP BY vec_id, part)"""


def _books(k: int) -> str:
    """The codebooks after round k: floored means; entries without parts stay."""
    return f"""
books{k} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM books{k - 1} b LEFT JOIN (
  SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM cells JOIN codes{k - 1} USING (vec_id, part) GROUP BY part, entry, pos) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""


OP12_SQL = f"""
WITH {_KEPT}, {_round(0)}, {_books(1)}, {_round(1)}, {_books(2)}, {_round(2)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM codes2 GROUP BY vec_id)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM books2) AS codebooks_sha256
FROM kept k JOIN coded USING (vec_id)
"""

# CRC-32 from its table, which its rule makes: eight steps of a shift and a division for each byte.
_STEP = "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END"
OP13_SQL = rf"""
WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(range(8), {_STEP}, n)) AS crc),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
target AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) x GROUP BY word),
used AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) x GROUP BY doc_id, word),
h AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM used UNION SELECT word FROM target) x),
hashed AS MATERIALIZED (SELECT word, xor(4294967295, list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)),
  lambda c, x: xor(crc[xor(c % 256, x) + 1], c // 256), 4294967295)) % 10000 AS bucket FROM h, t),
s AS (SELECT bucket, sum(n) AS n FROM used JOIN hashed USING (word) GROUP BY bucket), g AS (SELECT bucket, sum(n) AS n FROM target JOIN hashed USING (word) GROUP BY bucket),
gains AS MATERIALIZED (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(g.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + 10000.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * (coalesce((SELECT sum(n) FROM g), 0) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN g USING (bucket)),
w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM used JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS MATERIALIZED (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM d LEFT JOIN w USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS total FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= total * 10 // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""

ORACLES = {"op12_vector_codes": OP12_SQL, "op13_importance_resampling": OP13_SQL, "op7_exact_dedup": OP7_SQL, "op8_url_filter": OP8_SQL}
