"""Documents drawn by how much they resemble a target: importance weights of hashed n-grams, and Gumbel noise.

Texts that are long are cut at word boundaries into chunks that carry the n - 1 words after them. A chunk owns the places
that start in it, so each n-gram counts once, whichever chunks it lies in; chunks are dealt to all tasks, and their counts
and sums are added up by document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.shared import partitions
from tradelens.sources.staging import numbered, staged

#: Bytes of a text beyond which it is cut, and about as many in each of its chunks.
CHUNK = 1 << 18
#: Words whose features a task remembers.
ROOM = 1 << 19
# UTF-8 bytes: the digits, a-z and all that are not ASCII; whole code points, as bytes from 0x80 on never part words
_WORD, _ANY_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def chunks(data: bytes, n: int, size: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of them the chunk owns): cut after size bytes at the end of a word, with the next n - 1 words."""
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + size)
        end = gap.start() if gap else len(data)
        carried = end
        for word in islice(_ANY_WORD.finditer(data, end), n - 1):
            carried = word.end()
        yield data[start:carried], end - start
        start = end


class _Remembered(dict):
    """What a feature gives, kept while there is room."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, feature: bytes):
        if len(self) >= ROOM:
            self.clear()
        self[feature] = found = self.of(feature)
        return found


def features(data: bytes, owned: int, n: int) -> tuple[int, list[bytes]]:
    """The number of words and the runs of 1 to n words that start in the first owned bytes."""
    data = data.lower()
    if n == 1:
        words = _WORD.findall(data[:owned])
        return len(words), words
    places = [m.span() for m in _WORD.finditer(data)]
    words, own = [data[a:b] for a, b in places], sum(a < owned for a, _ in places)
    return own, [b" ".join(words[k : k + m]) for k in range(own) for m in range(1, n + 1) if k + m <= len(words)]


def _dealt(texts: DataFrame, n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows of short texts, chunks of long ones), both with part and owned; the chunks of one text share its _row."""
    long = F.octet_length("text") > size
    whole = lambda t: F.coalesce(t, F.lit("")).cast("binary")
    short = texts.filter(~F.coalesce(long, F.lit(False))).withColumn("part", whole(F.col("text"))).drop("text").withColumn("owned", F.octet_length("part").cast("long"))
    rest = texts.filter(long).withColumn("_row", F.monotonically_increasing_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != "text") + ", part binary, owned long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [k for k, name in enumerate(batch.schema.names) if name != "text"]
            for k, text in enumerate(batch.column("text")):
                for data, owned in chunks(text.as_py().encode(), n, size):
                    yield pa.RecordBatch.from_arrays([*[batch.column(j).slice(k, 1) for j in others], pa.array([data], pa.binary()), pa.array([owned], pa.int64())], [*[batch.schema.names[j] for j in others], "part", "owned"])

    return short, rest.mapInArrow(cut, schema).repartition(partitions(texts), "_row", F.xxhash64("part"))


def bucket_counts(texts: DataFrame, n: int, buckets: int, size: int = CHUNK) -> np.ndarray:
    """How many features of all texts (text) fall in each bucket; a task sends a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = _Remembered(lambda f: crc32(f) % buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for data, owned in zip(batch.column("part"), batch.column("owned")):
                _, found = features(data.as_py(), owned.as_py(), n)
                total += np.bincount(np.fromiter(map(of.__getitem__, found), np.int64, len(found)), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    short, long = _dealt(texts.select("text"), n, size)
    rows = short.select("part", "owned").unionByName(long.select("part", "owned")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets at most
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> list[int]:
    """1000 times the logarithm of how much likelier each bucket is in the target, rounded down."""
    b, t, s = len(target), float(target.sum()), float(corpus.sum())
    return [math.floor(1000 * math.log((x + 1.0) * (s + b) / ((y + 1.0) * (t + b)))) for x, y in zip(target.tolist(), corpus.tolist())]


def weights(docs: DataFrame, gain: list[int], n: int, size: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain of the features, 0 for none) of every row of docs."""
    buckets = len(gain)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sums(row: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = _Remembered(lambda f: gain[crc32(f) % buckets])
            for batch in batches:
                found = [features(d.as_py(), o.as_py(), n) for d, o in zip(batch.column("part"), batch.column("owned"))]
                out = {"doc_id": batch.column("doc_id"), "n_words": [w for w, _ in found], "n_features": [len(f) for _, f in found], "gain": [sum(map(of.__getitem__, f)) for _, f in found]}
                columns = {k: pa.array(v, pa.int64()) if isinstance(v, list) else v for k, v in out.items()}
                yield pa.RecordBatch.from_pydict(columns | ({"_row": batch.column("_row")} if row else {}))

        return run

    short, long = _dealt(docs.select("doc_id", "text"), n, size)
    numbers = f"doc_id {kind}, n_words long, n_features long, gain long"
    whole = short.mapInArrow(sums(False), numbers)
    added = long.mapInArrow(sums(True), f"{numbers}, _row long").groupBy("_row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")]).drop("_row")
    per = F.col("n_features")
    mean = F.when(per > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return whole.unionByName(added).select("doc_id", "n_words", "n_features", mean.alias("weight"))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024", size: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text); target (text) is what to resemble.

    Words are [0-9a-z] and all letters beyond ASCII, after A-Z are lower-cased; features are runs of 1 to n of them. A
    document's score is its weight plus Gumbel noise that the seed and its doc_id decide, so the highest percent of the
    documents with min_words words are a sample without replacement in proportion to the weights; rank is their order, ties
    to the smaller doc_id, and null for the others. Null texts are empty. A null doc_id takes the noise of an empty one and
    comes first in ties. Repeated rows are scored and drawn each; of equal ones any comes first. More columns are left out,
    empty tables give an empty result, and an empty target makes rare features likelier.
    """
    gain = gains(bucket_counts(target, n, buckets, size), bucket_counts(docs, n, buckets, size))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")
    scored = staged(weights(docs, gain, n, size).withColumn("score", F.col("weight") + noise), "scored")
    enough = F.col("n_words") >= min_words
    drawn = scored.filter(enough).count() * percent // 100
    placed = numbered(scored.filter(enough), F.desc("score"), F.asc("doc_id")).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.drop("place").unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that resample draws, by doc_id (unique)."""
    return docs.join(resample(docs, target, **options).filter("rank is not null").select("doc_id"), "doc_id", "left_semi")
