"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling, in numpy.

The network is trained on a bounded sample of labelled rows. A filter's answer at a place is a sum of one number for each
word under it, so for scoring each (width, offset) becomes a table from the word's bucket to its share of the answer.
Thresholds are calibrated by language, where a text's language is told from its own frequent words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.shared import MAX_BYTES, bounded_sample
from tradelens.llm.textkit import Spans

BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 18, 8, 4, (1, 2, 3)
#: At most so many labelled rows are learnt from, those with the smallest hashes of their ids.
MAX_TRAIN = 12000
#: Passes over the texts: so many, or as many as it takes to see TEXTS texts.
EPOCHS, TEXTS, RATE, BATCH = 4, 6000, 0.01, 32
#: Frequent words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the and of to is that for with was this from",
    "de": "der die und das nicht mit ein ist den von zu",
    "fr": "le la les et des un une que pour dans est",
    "es": "el los las que y una por con para del es",
}
#: Marks and spaces of ASCII part words, A-Z are lower-cased, all other bytes stay.
_TABLE = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def token_buckets(text: str | None) -> np.ndarray:
    """The bucket of each word of the whole text."""
    data = (text or "").encode().translate(_TABLE)
    gap = np.frombuffer(b" " + data + b" ", np.uint8) == 32
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return (Spans(data).hashes(edges[::2], edges[1::2]) >> np.uint64(46)).astype(np.int32)


_LANGUAGES = [*FUNCTION_WORDS]
_LANG_OF = {int(b): k for k, ws in enumerate(FUNCTION_WORDS.values()) for b in token_buckets(ws)}
_LANG_KEYS = np.array(sorted(_LANG_OF), np.int32)
_LANG_VALUES = np.array([_LANG_OF[int(k)] for k in _LANG_KEYS])


def language(buckets: np.ndarray) -> int:
    """The place in FUNCTION_WORDS of the language whose frequent words the text has most, or their number if it has none."""
    at = np.minimum(np.searchsorted(_LANG_KEYS, buckets), len(_LANG_KEYS) - 1)
    hits = _LANG_VALUES[at[_LANG_KEYS[at] == buckets]]
    return int(np.bincount(hits, minlength=len(_LANGUAGES)).argmax()) if len(hits) else len(_LANGUAGES)


@dataclass
class Model:
    """tables[w][k]: bucket to the share of the answers of the filters of width WIDTHS[w], at offset k."""

    tables: list[list[np.ndarray]]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray

    def features(self, buckets: np.ndarray) -> np.ndarray:
        pooled = []
        for w, tables, bias in zip(WIDTHS, self.tables, self.biases, strict=True):
            n = len(buckets) - w + 1
            if n < 1:
                pooled.append(np.zeros(FILTERS, np.float32))
                continue
            total = tables[0][buckets[:n]]
            for k in range(1, w):
                total = total + tables[k][buckets[k : k + n]]
            pooled.append(np.maximum(total.max(axis=0) + bias, 0))
        return np.concatenate(pooled)

    def logit(self, buckets: np.ndarray) -> float:
        return float(self.features(buckets) @ self.out + self.out_bias)

    def score(self, buckets: np.ndarray) -> float:
        x = self.logit(buckets) - float(self.thresholds[language(buckets)])
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def train(texts: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Model:
    """texts as arrays of buckets. Without labels of both kinds every text scores just under one half."""
    rng = np.random.default_rng(seed)
    embed = np.zeros((BUCKETS, DIMS), np.float32)
    n_pos = int(toxic.sum())
    if n_pos in (0, len(toxic)):
        blank = [[np.zeros((BUCKETS, FILTERS), np.float32) for _ in range(w)] for w in WIDTHS]
        return Model(blank, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), -1e-3 if not n_pos else 1e-3, np.zeros(len(_LANGUAGES) + 1))
    # The first dimension begins as a word's shrunk log-odds in two fifths of the texts; the network is fitted to two others,
    # and thresholds are calibrated on the last fifth. Each part has its share of toxic texts.
    parts: list[list[np.ndarray]] = [[], [], []]
    for kind in (0, 1):
        mine = rng.permutation(np.flatnonzero(toxic == kind))
        for part, of in zip(parts, np.split(mine, [2 * len(mine) // 5, 4 * len(mine) // 5]), strict=True):
            part.append(of)
    first, second, last = (rng.permutation(np.concatenate(p)) for p in parts)
    seen = np.zeros((2, BUCKETS))
    for i in first:
        seen[int(toxic[i])][np.unique(texts[i])] += 1
    sizes = np.array([(toxic[first] == k).sum() for k in (0, 1)])
    odds = np.log((seen[1] + 0.5) / (sizes[1] + 1)) - np.log((seen[0] + 0.5) / (sizes[0] + 1))
    support = seen.sum(axis=0)
    known = support > 0
    embed[known] = rng.normal(0, 0.05, (int(known.sum()), DIMS))
    embed[:, 0] = np.where(support >= 4, odds * support / (support + 8), 0) / 2
    filters = [rng.normal(0, 0.1, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] += rng.uniform(0.3, 0.7, f[:, 0, :].shape) / len(f)
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out, out_bias = np.full(FILTERS * len(WIDTHS), 0.3, np.float32), -1.0
    weights = np.where(toxic == 1, len(toxic) / (2 * n_pos), len(toxic) / (2 * (len(toxic) - n_pos)))

    dense = [*filters, *biases, out, np.array([out_bias], np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    step = 0
    for _ in range(max(EPOCHS, -(-TEXTS // max(1, len(second))))):
        order = rng.permutation(second)
        for b in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in dense]
            touched: dict[int, np.ndarray] = {}
            for i in (batch := order[b : b + BATCH]):
                x, marks, feats = texts[i], [], []
                for w, f, bias in zip(WIDTHS, filters, biases, strict=True):
                    n = len(x) - w + 1
                    if n < 1:
                        marks.append(None)
                        feats.append(np.zeros(FILTERS, np.float32))
                        continue
                    total = sum(embed[x[k : k + n]] @ f[k] for k in range(w)) + bias
                    marks.append(total.argmax(axis=0))
                    feats.append(np.maximum(total[marks[-1], np.arange(FILTERS)], 0))
                pooled = np.concatenate(feats)
                p = 1 / (1 + np.exp(-np.clip(pooled @ dense[-2] + dense[-1][0], -30, 30)))
                d = (p - toxic[i]) * weights[i] / len(batch)
                grads[-2] += d * pooled
                grads[-1] += d
                back = d * dense[-2] * (pooled > 0)
                for j, (w, at) in enumerate(zip(WIDTHS, marks, strict=True)):
                    if at is None:
                        continue
                    for c in np.flatnonzero(g := back[j * FILTERS : (j + 1) * FILTERS]):
                        grads[len(WIDTHS) + j][c] += g[c]
                        for k in range(w):
                            word = int(x[at[c] + k])
                            grads[j][k, :, c] += g[c] * embed[word]
                            touched[word] = touched.get(word, 0) + g[c] * filters[j][k, :, c]
            step += 1
            for p, g, (m, v) in zip(dense, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            for word, g in touched.items():
                embed[word] -= 0.5 * g
    tables = [[(embed @ f[k]).astype(np.float32) for k in range(len(f))] for f in filters]
    model = Model(tables, biases, dense[-2], float(dense[-1][0]), np.zeros(len(_LANGUAGES) + 1))
    if toxic[last].sum() in (0, len(last)):
        last = second  # too few to spare any
    logits = np.array([model.logit(texts[i]) for i in last])
    langs = np.array([language(texts[i]) for i in last])
    common = _threshold(logits, toxic[last])
    for k in range(len(model.thresholds)):
        mine = langs == k
        enough = min(toxic[last][mine].sum(), (1 - toxic[last][mine]).sum()) >= 15
        model.thresholds[k] = _threshold(logits[mine], toxic[last][mine]) if enough else common
    return model


def _threshold(logits: np.ndarray, toxic: np.ndarray) -> float:
    """Midway in the gap between two logits that has the best F1."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(toxic.sum(), 1))
    low = np.append(logits[order][1:], logits.min() - 2)
    f1 = np.where(logits[order] > low, f1, -1)  # equal logits can't be parted
    k = int(f1.argmax())
    return float((logits[order][k] + low[k]) / 2)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model:
    """Learns toxic from labelled rows outside the held-out fold, max_train rows and max_bytes of texts at most."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # bounded by the parameter

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [token_buckets(x.as_py()).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "toxic": batch.column("toxic"), "tokens": pa.array(tokens, pa.binary())})

    sample = bounded_sample(docs, chosen, "toxic", max_bytes)
    found = sorted(sample.mapInArrow(encode, "doc_id long, toxic int, tokens binary").collect())
    return train([np.frombuffer(r.tokens, np.int32) for r in found], np.array([r.toxic for r in found], np.int64))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs (with text) and the score under name; the model has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    fields = "".join(f", `{c.name}` {c.dataType.simpleString()}" for c in docs.schema)[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(token_buckets(x.as_py())) for x in batch.column("text")]
            yield pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns, strict=True)) | {name: pa.array(scores, pa.float64())})

    return docs.mapInArrow(run, fields + f", `{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text).

    Whole texts are scored. A null or empty text has no words and gets the score of the bare bias. A null doc_id is not
    held out. Repeated rows score alike, more columns are left out, an empty table gives an empty result; without labels of
    both kinds nothing is predicted toxic. Of several label rows of a document, any toxic one counts.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, max_train, max_bytes))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    columns, name = docs.columns, "_".join(["toxicity", *docs.columns])  # a name that docs doesn't have
    return score(docs, fit(docs, labels, max_train, max_bytes), name).filter(F.col(name) < 0.5).select(*columns)
