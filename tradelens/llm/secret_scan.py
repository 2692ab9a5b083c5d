"""Secrets in texts: assignments, access keys and long hex strings by form, and random strings by how badly they compress.

A tokenizer's vocabulary gives words few tokens and random characters many, so a string with few characters for each token
is likely a key. Digests, ids and names are common and no secrets; they are left out before the ratio is taken.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The forms, in the order in which spans that start together are listed, and the characters that they must have.
FORMS = {
    "assign": (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
KINDS = [*FORMS, "random"]
#: What may be a random string: a run of the characters of keys with nothing like them beside it.
_RUN = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![\w+/=-])")
#: Lengths of the usual digests in hex: MD5, SHA-1, the Tiger and SHA-2 families.
DIGESTS = {32, 40, 48, 56, 64, 96, 128}
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Parts of names: words of one case, words run together in camel case, each with a short number behind, and numbers.
_NAME = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|(?:[A-Z]?[a-z]{2,})(?:[A-Z][a-z]{2,})+)[0-9]{0,4}|[0-9]+")
_BETWEEN = re.compile(r"[+/_=-]+")


def known(run: str) -> bool:
    """Whether a run is a digest, a UUID, a number or a name made of words and numbers."""
    if len(run) in DIGESTS and _HEX.fullmatch(run) or _UUID.fullmatch(run):
        return True
    return all(not p or _NAME.fullmatch(p) for p in _BETWEEN.split(run))


class Scanner:
    """Finds spans with the vocabulary (base64 token and rank in each line) at path."""

    def __init__(self, path: str, pattern: str, least_ratio: float):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tokens = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.least_ratio = least_ratio

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, index of the kind, end) in code points, in order; random runs that touch no span of the forms."""
        found = []
        for k, (form, group, least) in enumerate(FORMS.values()):
            found += [(m.start(), k, m.end()) for m in form.finditer(text) if m.end(group) - m.start(group) >= least]
        if runs := [m.span() for m in _RUN.finditer(text)]:
            ends = sorted((b, a) for a, _, b in found)
            # spans of one kind lie apart, so of those that end behind a run's start the next few tell
            for a, b in runs:
                k = bisect_left(ends, (a + 1, 0))
                if any(start < b for _, start in ends[k : k + len(FORMS)]):
                    continue
                run = text[a:b]
                if not known(run) and len(run) < self.least_ratio * len(self.tokens(run)):
                    found.append((a, len(FORMS), b))
        return sorted(found)


_LOADED: dict[tuple, Scanner] = {}


def _scanner(*key) -> Scanner:
    if key not in _LOADED:
        _LOADED[key] = Scanner(*key)
    return _LOADED[key]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def secret_spans(docs: DataFrame, path: str, pattern: str, least_ratio: float = 2.0) -> DataFrame:
    """doc_id, text and spans (kind, start, end in code points) of every row of docs (doc_id, text), by start and kind.

    path is the vocabulary's file, which every executor must have, and pattern how it splits texts. Random strings of 16
    characters and more have under least_ratio characters for each token. Null and empty texts have no spans. Whole texts
    are scanned, whatever their length. Rows repeat as in docs, null ids stay, more columns are left out, an empty table
    gives an empty result. Spans of different kinds may overlap, those of one kind never do.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scanner(path, pattern, least_ratio)
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in of.spans(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": batch.column("text"), "spans": pa.array(found, shape)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, spans {SPANS}")


def masked(found: DataFrame, mark: str = "***") -> DataFrame:
    """The rows of secret_spans with text in which each span, or run of spans that overlap, is the mark."""
    # pieces of text between the spans; where spans overlap the later one adds only what it reaches beyond the others
    seen = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto")),
        lambda s, x: F.when(x["start"] >= s["upto"], F.struct(F.concat(s["out"], F.substring(F.col("text"), s["upto"].cast("int") + 1, (x["start"] - s["upto"]).cast("int")), F.lit(mark)).alias("out"), x["end"].alias("upto")))
        .otherwise(F.struct(s["out"].alias("out"), F.greatest(s["upto"], x["end"]).alias("upto"))),
    )
    return found.withColumn("_s", seen).withColumn("text", F.when(F.col("text").isNotNull(), F.concat(F.col("_s.out"), F.expr("substring(text, cast(_s.upto as int) + 1)")))).drop("_s")


def secret_report(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the digest of the forms' spans and all spans as text, of the rows of secret_spans."""
    own = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(own([k])).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(own([*FORMS])).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
