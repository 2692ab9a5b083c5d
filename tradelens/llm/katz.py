"""Katz backoff language model: Good-Turing discounts, backoff weights that normalise exactly, evaluated recursively.

The order is a parameter. First each word gets a number, the smaller the more frequent it is, so that n-grams take few
bytes. Counts live in a table that is partitioned by the last word of the context: a bucket has all n-grams of every order
whose context ends in its words, so all that the weights of these contexts need. Each chunk of texts sends its n-grams of
the highest order there once, packed (those of lower orders are their endings), and keeps the places they have in its
texts; only the n-grams' probabilities come back. An n-gram that was learnt has its discounted relative frequency; any other falls back to the weight of its context
times the probability of its ending, in the end to the unigram, and an unknown word to what the unigrams' discounts have
left. Over all known words and the one unknown, every context's probabilities sum to one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.shared import partitions, written
from tradelens.llm.textkit import mixed, word_hashes, words

#: Counts up to this are discounted.
TOP = 5
#: The hash of a text's end, which counts as a word.
END = np.uint64(2)
#: A chunk has at most so many tokens (or is a single text) and so many texts.
CHUNK, CHUNK_TEXTS = 1_500_000, 50_000
#: Bytes of text to a bucket, so that a bucket fits into a task however large the corpus is.
BUCKET_BYTES = 24_000_000


def good_turing(n: dict[int, int]) -> dict[int, float]:
    """The discount of each count up to TOP, from how many n-grams have each count; 1 where the formula gives none."""
    out = {}
    common = (TOP + 1) * n.get(TOP + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common) if n.get(r) and common != 1 else 1.0
        out[r] = d if 0 < d < 1 else 1.0
    return out


def _fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(-1))


def _pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, byte by byte, compressed; ascending ones as their steps."""
    x = x.astype(np.uint64)
    if ascending and len(x):
        x = np.concatenate((x[:1], x[1:] - x[:-1]))
    width = next(w for w in range(1, 9) if w == 8 or not len(x) or int(x.max()) < 1 << (8 * w))
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.compress(bytes([width]) + planes.tobytes(), 1)


def _unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    raw = zstandard.decompress(data)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    x = out.view("<u8").ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x.astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _dealt(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each hash; it ascends with them."""
    return (((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


_CHUNKS = pa.schema([
    ("part", pa.int64()), ("owner", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
    ("tokens", pa.binary()), ("words", pa.binary()), ("n", pa.binary()),
])


def _chunk(part: int, n_owners: int, ids: list, train: list[bool], texts: list[np.ndarray]) -> Iterator[dict]:
    """A chunk's documents with their tokens (owner -1), and its words with their counts in training, dealt to owners.

    tokens: the places of the tokens' words among the chunk's, which ascend by their hashes, as their owners do.
    """
    lengths = np.array([len(w) for w in texts])
    names, tokens = np.unique(np.concatenate(texts), return_inverse=True)
    n = np.bincount(tokens, np.repeat(np.array(train, float), lengths), len(names))
    blank = dict.fromkeys(_CHUNKS.names) | {"part": part}
    yield blank | {"owner": -1, "doc_ids": [None if x is None else int(x) for x in ids], "train": train, "lengths": lengths.tolist(), "tokens": _pack(tokens)}
    edges = np.searchsorted(_dealt(names, n_owners), np.arange(n_owners + 1))
    for k in np.flatnonzero(edges[1:] > edges[:-1]):
        of = slice(edges[k], edges[k + 1])
        yield blank | {"owner": int(k), "words": _pack(names[of], True), "n": _pack(n[of])}


def _chunks(docs: DataFrame, n_owners: int) -> DataFrame:
    """Chunks of docs (doc_id, train, text) of at most CHUNK tokens or a single text, as records by part and owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list] = [], [], []
        tokens = 0

        def out() -> Iterator[pa.RecordBatch]:
            for row in _chunk(part, n_owners, *held):
                yield pa.RecordBatch.from_pylist([row], schema=_CHUNKS)

        for batch in batches:
            for doc_id, train, text in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), batch.column("text"), strict=True):
                w = np.append(word_hashes(words(text.as_py())), END)
                if held[0] and (tokens + len(w) > CHUNK or len(held[0]) >= CHUNK_TEXTS):
                    yield from out()
                    part, held, tokens = part + 1, ([], [], []), 0
                for x, to in zip((doc_id, train, w), held, strict=True):
                    to.append(x)
                tokens += len(w)
        if held[0]:
            yield from out()

    return docs.mapInArrow(run, "part long, owner int, doc_ids array<long>, train array<boolean>, lengths array<long>, tokens binary, words binary, n binary")


_NUMBERED = pa.schema([("part", pa.int64()), ("owner", pa.int32()), ("number", pa.binary()), ("c", pa.binary()), ("tokens", pa.int64()), ("known", pa.int64()), ("counts", pa.list_(pa.int64()))])


def _vocabulary(rows: pa.Table, n_owners: int) -> pa.Table:
    """For each chunk the numbers of an owner's words and their counts in training, in order; and (part -1) the owner's tokens, known words and counts of counts.

    Owners hold words by their hashes, so the owner's k-th most frequent word is about the k * n_owners-th of all.
    """
    asked = rows.to_pylist()
    hashes = [_unpack(x["words"], True) for x in asked]
    names, at = np.unique(np.concatenate(hashes), return_inverse=True)
    c = np.bincount(at, np.concatenate([_unpack(x["n"]) for x in asked]), len(names)).astype(np.int64)
    owner, number = asked[0]["owner"], np.empty(len(names), np.int64)
    number[np.argsort(-c, kind="stable")] = np.arange(len(names)) * n_owners + owner + 1  # 0 is the start
    blank = dict.fromkeys(_NUMBERED.names) | {"owner": owner}
    out = [blank | {"part": -1, "tokens": int(c.sum()), "known": int((c > 0).sum()), "counts": _counts_of(c)}]
    for x, mine in zip(asked, np.split(at, np.cumsum([len(h) for h in hashes])[:-1]), strict=True):
        out.append(blank | {"part": x["part"], "number": _pack(number[mine]), "c": _pack(c[mine])})
    return pa.Table.from_pylist(out, schema=_NUMBERED)


def _counts_of(r: np.ndarray) -> list[int]:
    """How many of r are 1, 2 and so on up to TOP + 1."""
    return np.bincount(np.minimum(r, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist()


_GRAMS = pa.schema([
    ("bucket", pa.int64()), ("part", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("known", pa.binary()), ("base", pa.binary()),
    ("texts", pa.binary()), ("doc", pa.binary()), ("n", pa.binary()), ("words", pa.binary()), ("at", pa.list_(pa.binary())), ("r", pa.binary()), ("c", pa.binary()),
])


def _grams(chunk: pa.Table, numbered: pa.Table, n_buckets: int, order: int, tokens: int, vocabulary: int) -> pa.Table:
    """A chunk's documents with the places of its n-grams (bucket -1 - part), and its n-grams, dealt to buckets by the context's last word.

    texts: how many texts have each n-gram, in the order of buckets; doc, n: which ones, and how often each.
    words: the numbers of the words in a bucket's n-grams; at: for each n-gram the places in words of its context's last
    word, its own last word, and the words before, from the nearest on; r: its count in training; c: those of the last words.
    """
    row, found = chunk.to_pylist()[0], numbered.sort_by("owner").to_pylist()
    number, c = (np.append(np.concatenate([_unpack(x[k]) for x in found]), 0) for k in ("number", "c"))  # with the start at the end
    lengths, last = np.array(row["lengths"]), _unpack(row["tokens"])
    of_doc = np.repeat(np.arange(len(lengths)), lengths)
    known = np.bincount(of_doc, (c > 0)[last], len(lengths))
    base = np.bincount(of_doc, np.log10((c + 0.5) / (tokens + 0.5 * (vocabulary + 1)))[last], len(lengths))
    blank = dict.fromkeys(_GRAMS.names) | {"part": row["part"]}
    bucket = (mixed(number.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
    by_bucket, rank = np.lexsort((number, bucket)), np.empty(len(number), np.int32)
    rank[by_bucket] = np.arange(len(number))
    number, c, bucket, last, start, before = number[by_bucket], c[by_bucket], bucket[by_bucket], rank[last], rank[-1], []
    place = np.arange(len(last)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for k in range(1, order):
        x = np.full(len(last), start, np.int32)
        x[k:] = last[: len(last) - k]
        x[place < k] = start
        before.append(x)
    columns = [before[0], last, *before[1:]]
    del place, before, last
    gram = np.zeros(len(of_doc), np.int64)
    for x in columns:  # ranks of growing tuples, so any order fits into 64 bits
        _, gram = np.unique(gram * len(number) + x, return_inverse=True)
    code, n = np.unique(gram * len(lengths) + of_doc, return_counts=True)
    gram_of, doc = code // len(lengths), (code % len(lengths)).astype(np.int32)
    first = _runs(gram_of)
    del gram_of, of_doc
    r = np.add.reduceat(n * np.array(row["train"])[doc], first)
    texts = np.diff(np.append(first, len(code)))
    del code
    one = np.zeros(len(first), np.int64)
    one[gram] = np.arange(len(gram))  # a token of each n-gram
    columns = [x[one] for x in columns]
    home = {k: row[k] for k in ("doc_ids", "train", "lengths")} | {"known": _pack(known), "base": base.tobytes()}
    out = [blank | home | {"bucket": -1 - row["part"], "texts": _pack(texts), "doc": _pack(doc), "n": _pack(n)}]
    edges = np.searchsorted(bucket[columns[0]], np.arange(n_buckets + 1))
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        of = slice(edges[b], edges[b + 1])
        local = np.concatenate([x[of] for x in columns])
        used, some, at = np.unique(number[local], return_index=True, return_inverse=True)
        at = at.reshape(order, -1)
        out.append(blank | {"bucket": int(b), "words": _pack(used, True), "at": [_pack(at[0], True), *(_pack(x) for x in at[1:])], "r": _pack(r[of]), "c": _pack(c[local[some]][np.unique(at[1])])})
    return pa.Table.from_pylist(out, schema=_GRAMS)


@dataclass
class _Bucket:
    """A bucket's n-grams of all chunks.

    c: its last words' counts in training, by their places among the bucket's words. context[k], ending[k], r[k]: for each
    n-gram of order k + 2 the number of its context, the place of its ending among those of order k + 1 (words, where k
    is 0), and its count in training; of: for each chunk, its n-grams' places.
    """

    c: np.ndarray
    context: list[np.ndarray]
    ending: list[np.ndarray]
    r: list[np.ndarray]
    of: list[np.ndarray]


def _bucket(rows: list[dict]) -> _Bucket:
    own = [_unpack(x["words"], True) for x in rows]
    words_ = np.unique(np.concatenate(own))
    c, columns = np.zeros(len(words_), np.int64), [[] for _ in rows[0]["at"]]
    for x, w in zip(rows, own, strict=True):
        place = np.searchsorted(words_, w).astype(np.int32)
        at = [_unpack(y, not k).astype(np.int64) for k, y in enumerate(x["at"])]
        c[place[np.unique(at[1])]] = _unpack(x["c"])
        for to, y in zip(columns, at, strict=True):
            to.append(place[y])
    columns = [np.concatenate(x) for x in columns]
    context, gram = columns[0].astype(np.int64), columns[1].astype(np.int64)
    contexts, endings, grams = [], [], []
    for k, x in enumerate([columns[0], *columns[2:]]):
        if k:
            _, context = np.unique(context * len(words_) + x, return_inverse=True)
        before = gram
        names, gram = np.unique(gram * len(words_) + x, return_inverse=True)
        one = np.zeros(len(names), np.int64)
        one[gram] = np.arange(len(gram))
        contexts.append(context[one].astype(np.int32))
        endings.append(before[one].astype(np.int32))
        grams.append(gram)
    own_r = [_unpack(x["r"]) for x in rows]
    r = np.concatenate(own_r)
    counts = [np.bincount(g, r, len(x)).astype(np.int64) for g, x in zip(grams, contexts, strict=True)]
    return _Bucket(c, contexts, endings, counts, np.split(grams[-1].astype(np.int32), np.cumsum([len(x) for x in own_r])[:-1]))


def _counted(rows: pa.Table) -> pa.Table:
    """How many of a bucket's n-grams of each order have each count up to TOP + 1."""
    x = _bucket(rows.to_pylist())
    return pa.table({"counts": pa.array([sum(map(_counts_of, x.r), [])], pa.list_(pa.int64()))})


def _discounted(count: np.ndarray, d: dict[int, float]) -> np.ndarray:
    return count * np.array([0.0, *[d[k] for k in range(1, TOP + 1)], 1.0])[np.minimum(count, TOP + 1)]


@dataclass
class _Totals:
    """What the whole corpus gives: discounts by order, the unigrams' whole and the unknown word's probability."""

    discounts: dict[int, dict[int, float]]
    whole: float
    unknown: float


def _scored(rows: list[dict], t: _Totals) -> Iterator[dict]:
    """The log10 probabilities of a bucket's n-grams, for each chunk in its order."""
    x = _bucket(rows)
    p = np.where(x.c > 0, _discounted(x.c, t.discounts[1]) / t.whole, t.unknown)
    for k, (context, ending, r) in enumerate(zip(x.context, x.ending, x.r, strict=True)):
        held, seen = _discounted(r, t.discounts[k + 2]), r > 0
        of, mass, low = (np.bincount(context, v) for v in (r, held, np.where(seen, p[ending], 0.0)))
        whole = np.where(of - mass > 1e-9 * of, of, of + 1)
        back = np.where(of > 0, (1 - mass / whole) / np.maximum(1 - low, 1e-12), 1.0)
        p = np.where(seen, held / whole[context], back[context] * p[ending])
    p = np.log10(p)
    for row, at in zip(rows, x.of, strict=True):
        yield {"home": -1 - row["part"], "bucket": row["bucket"], "p": _pack(p[at].view(np.uint64))}


_SCORED = pa.schema([("home", pa.int64()), ("bucket", pa.int64()), ("p", pa.binary())])


def _summed(docs: pa.Table, scored: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their n-grams."""
    row = docs.to_pylist()[0]
    p = np.concatenate([_unpack(x).view(np.float64) for x in scored.sort_by("bucket").column("p").to_pylist()])
    score = np.bincount(_unpack(row["doc"]), _unpack(row["n"]) * np.repeat(p, _unpack(row["texts"])), len(row["lengths"]))
    return pa.table({
        "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array([not x for x in row["train"]], pa.bool_()), "n_tokens": pa.array(row["lengths"], pa.int64()),
        "n_known": _unpack(row["known"]), "base_score": np.frombuffer(row["base"]), "score": score,
    })


def lm_scores(docs: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text).

    order is the length of the longest n-grams, 2 or more; a text is preceded by as many starts as they need. Learnt from
    all rows but the held-out fold. A null or text without words is its end alone, one token; very long texts are chunks of
    their own. A null doc_id is learnt from. Repeated rows count each and each gets a row; more columns are left out,
    whatever their names; an empty table gives an empty result. Where nothing is learnt, all probability is the unknown
    word's: score 0. The tables of chunks and of n-grams are dropped as soon as the next step is written.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    train = _fold(F.col("doc_id")) != 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), "text")
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = partitions(docs)
    n_buckets = max(slots, -(-volume // BUCKET_BYTES))
    # Bucketed by Spark as they are written, so that each step reads its groups without a shuffle.
    name = f"katz_{uuid.uuid4().hex}"

    def bucketed(df: DataFrame, kind: str, by: str) -> DataFrame:
        df.write.bucketBy(slots, by).format("parquet").option("compression", "uncompressed").saveAsTable(f"{name}_{kind}")
        return spark.table(f"{name}_{kind}")

    chunks = bucketed(_chunks(docs, n_buckets), "chunks", "part")
    number = lambda rows: _vocabulary(rows, n_buckets)
    numbered = written(chunks.filter("owner >= 0").select("part", "owner", "words", "n").groupBy("owner").applyInArrow(number, "part long, owner int, number binary, c binary, tokens long, known long, counts array<long>"))
    summed = lambda df, n, *more: df.agg(*more, *[F.coalesce(F.sum(F.col("counts")[k]), F.lit(0)) for k in range(n)]).first()
    total, vocabulary, *of = summed(numbered.filter("part < 0"), TOP + 1, F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0)))

    deal = lambda chunk, found: _grams(chunk, found, n_buckets, order, total, vocabulary)
    own = chunks.filter("owner < 0").select("part", "doc_ids", "train", "lengths", "tokens")
    found = numbered.filter("part >= 0").select("part", "owner", "number", "c")
    fields = "bucket long, part long, doc_ids array<long>, train array<boolean>, lengths array<long>, known binary, base binary, texts binary, doc binary, n binary, words binary, at array<binary>, r binary, c binary"
    dealt = bucketed(own.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(deal, fields), "grams", "bucket")
    spark.sql(f"DROP TABLE {name}_chunks")  # nothing reads it from here on
    grams = dealt.filter("bucket >= 0").select("bucket", "part", "words", "at", "r", "c")

    of += summed(grams.groupBy("bucket").applyInArrow(_counted, "counts array<long>"), (TOP + 1) * (order - 1))
    counts = {k + 1: {r + 1: of[k * (TOP + 1) + r] for r in range(TOP + 1)} for k in range(order)}
    discounts = {k: good_turing(n) for k, n in counts.items()}
    mass = total - sum(r * counts[1][r] * (1 - d) for r, d in discounts[1].items())
    whole = total if total - mass > 1e-9 * total else total + 1  # some mass must be left for the unknown word
    totals = _Totals(discounts, float(whole or 1), float(1 - mass / whole) if whole else 1.0)

    score = lambda rows: pa.Table.from_pylist([*_scored(rows.to_pylist(), totals)], schema=_SCORED)
    scored = grams.groupBy("bucket").applyInArrow(score, "home long, bucket long, p binary")
    homes = dealt.filter("bucket < 0").select("bucket", "doc_ids", "train", "lengths", "known", "base", "texts", "doc", "n")
    sums = written(homes.groupBy("bucket").cogroup(scored.groupBy("home")).applyInArrow(_summed, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    spark.sql(f"DROP TABLE {name}_grams")
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
