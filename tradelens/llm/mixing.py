"""Mixing by soft membership: a classifier gives each text's share in each domain, and rates are fitted to target weights.

The rates r >= floor minimise the squares of the domains' misses: the sum of r * share * tokens against its target. The fit
is projected gradient descent, distributed: a text's rate follows from its shares and the steps so far, each of which is one
multiplier for each domain, so a step needs one sum over the texts, and neither rates nor texts come to the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.shared import MAX_BYTES, bounded_sample, cut, written
from tradelens.llm.toxicity import token_buckets

FEATURES = 1 << 15
#: At most so many labelled rows are learnt from, those with the smallest hashes of their ids.
MAX_TRAIN = 4000
EPOCHS, RATE = 12, 0.5
#: How far a domain's total may be from its target, relative to the target; the fit fails rather than take more steps.
#: LEAST is how much of the square a step must take away.
CLOSE, LEAST, MAX_STEPS = 1e-4, 1e-4, 400
#: With a floor, targets are so much above the least possible ones, of the domain that has most beyond its weight too: at
#: the least only texts wholly outside of that domain could be repeated, and posteriors are never 0.
MARGIN = 0.05
#: Characters of a text that are encoded at a time.
SLICE = 100_000
EXTRA = 5


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of the words with their weights, and the number of words. The last EXTRA buckets hold measures of form."""
    text = text or ""
    b = token_buckets(text)
    at, n = np.unique(b % (FEATURES - EXTRA), return_counts=True)
    w = np.sqrt(n)
    w = w / np.sqrt((w * w).sum()) if len(w) else w
    raw = np.frombuffer(text.encode(), np.uint8)
    size = max(1, len(raw))
    marks = (((raw > 32) & (raw < 48)) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 127))).sum()
    form = [1.0, 5 * marks / size, ((raw > 47) & (raw < 58)).sum() / size * 5, len(at) / max(1, len(b)), np.log1p(len(b)) / 8]
    return np.concatenate((at, np.arange(FEATURES - EXTRA, FEATURES))).astype(np.int64), np.concatenate((w, form)), len(b)


def train(texts: list[tuple[np.ndarray, np.ndarray, int]], domain: np.ndarray, n_domains: int, seed: int = 3) -> np.ndarray:
    """Weights (FEATURES, n_domains) of a softmax regression with adaptive steps. Without texts all domains are alike."""
    rng = np.random.default_rng(seed)
    weights, seen = np.zeros((FEATURES, n_domains)), np.full((FEATURES, n_domains), 1e-2)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            at, w, _n = texts[i]
            z = w @ weights[at]
            p = np.exp(z - z.max())
            p /= p.sum()
            p[domain[i]] -= 1
            g = w[:, None] * p
            seen[at] += g * g
            weights[at] -= RATE * g / np.sqrt(seen[at])
    return weights.astype(np.float32)


def shares(weights: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The posteriors of the domains."""
    z = w @ weights[at].astype(np.float64)
    p = np.exp(z - z.max())
    return p / p.sum()


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """Learns labels (doc_id, domain) from max_train labelled rows of max_bytes at most; rows of other domains are left out."""
    known = labels.filter(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # bounded by the parameter
    sample = bounded_sample(docs, chosen, "domain", max_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "domain": batch.column("domain"), "at": pa.array([x[0].astype(np.int32).tobytes() for x in found], pa.binary()), "w": pa.array([x[1].astype(np.float32).tobytes() for x in found], pa.binary())})

    rows = sorted(sample.mapInArrow(encode, "doc_id long, domain string, at binary, w binary").collect())
    texts = [(np.frombuffer(r.at, np.int32).astype(np.int64), np.frombuffer(r.w, np.float32).astype(np.float64), 0) for r in rows]
    return train(texts, np.array([domains.index(r.domain) for r in rows], np.int64), len(domains))


_ENCODERS: dict[tuple[str, str], object] = {}


def n_tokens(text: str | None, path: str, pattern: str) -> int:
    """Tokens of a text by the vocabulary (base64 token and rank in each line) at path.

    Slices of at most SLICE characters end before a space that parts two words where there is one, which changes no count.
    """
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encode, text, n = _ENCODERS[path, pattern].encode_ordinary, text or "", 0
    while len(text) > SLICE:
        end = text.rfind(" ", SLICE // 2, SLICE)
        while end > 0 and (text[end - 1].isspace() or text[end + 1].isspace()):
            end = text.rfind(" ", SLICE // 2, end)
        end = end if end > 0 else SLICE
        n, text = n + len(encode(text[:end])), text[end:]
    return n + len(encode(text))


def with_shares(docs: DataFrame, weights: np.ndarray, encoder: tuple[str, str]) -> DataFrame:
    """All columns of docs (with text), n_tokens and shares: array of double, which sum to 1."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop("n_tokens", "shares")
    fields = "".join(f", `{c.name}` {c.dataType.simpleString()}" for c in docs.schema)[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for text in batch.column("text"):
                text = text.as_py()
                at, w, _size = features(text)
                n.append(n_tokens(text, *encoder))
                found.append(shares(model.value, at, w).tolist())
            yield pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns, strict=True)) | {"n_tokens": pa.array(n, pa.int64()), "shares": pa.array(found, pa.list_(pa.float64()))})

    return docs.mapInArrow(run, fields + ", n_tokens long, shares array<double>")


@dataclass
class Rates:
    """What a fit gives: the steps (a multiplier for each domain), the targets and the largest relative miss of one."""

    steps: list[np.ndarray]
    floor: float
    targets: dict[str, float]
    miss: float

    def of(self, shares: np.ndarray) -> np.ndarray:
        """The rates of texts by their shares (a row each): every step moves them along the gradient and back to the floor."""
        r = np.full(len(shares), max(1.0, self.floor))
        for m in self.steps:
            r = np.maximum(self.floor, r - shares @ m)
        return r

    def added(self, shared: DataFrame) -> DataFrame:
        """shared (shares) with rate."""
        fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in shared.schema) + ", rate double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rate = pa.array(self.of(_matrix(batch.column("shares"), len(self.targets))))
                yield pa.RecordBatch.from_arrays([*batch.columns, rate], [*batch.schema.names, "rate"])

        return shared.mapInArrow(run, fields)


def _matrix(shares: pa.Array, d: int) -> np.ndarray:
    return shares.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(rows: DataFrame, rates: Rates, tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step that is tried next the domains' totals, and the sums over their pairs of the texts above the floor."""
    d = len(rates.targets)
    size = d + d * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(tried), size))
        for batch in batches:
            s, n = _matrix(batch.column("shares"), d), batch.column("n_tokens").to_numpy().astype(float)
            now = rates.of(s)
            for k, m in enumerate(tried):
                r = np.maximum(rates.floor, now - s @ m)
                out[k] += np.concatenate(((n * r) @ s, (s.T @ (s * (n * (r > rates.floor))[:, None])).ravel()))
        yield pa.RecordBatch.from_pydict({"sums": pa.array([out.ravel().tolist()], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    total = np.zeros(len(tried) * size)
    for row in parts.collect():  # as many rows as sums
        total[row.k] = row.x
    return [(x[:d], x[d:].reshape(d, d)) for x in total.reshape(len(tried), size)]


def fit_rates(shared: DataFrame, weights: dict[str, float], floor: float = 0.0) -> Rates:
    """Rates of shared (shares, n_tokens) that bring each domain's expected tokens to its target, as nearly as can be.

    The targets sum to the tokens there are, or to more where a floor needs it: as much as makes every domain's target its
    floor's tokens and MARGIN of them at least. What is minimised is the sum of the squares of the misses, each relative to its
    target, so a domain that hardly any text has a share in doesn't outweigh the others. A pass tries gradient steps of
    several lengths, the first of which never overshoots, and steps in the metrics of all texts and of those above the floor,
    and takes the best. The fit ends when every target is met within CLOSE of it, or where no step takes LEAST of the sum
    away, as when targets are out of reach: there the sum is within a few hundredths of the least, and miss tells.
    """
    goal = np.array([*weights.values()], float)
    goal = goal / goal.sum()
    rows = written(shared.select("shares", "n_tokens").filter("n_tokens > 0"))
    fitted, zero = Rates([], floor, dict.fromkeys(weights, 0.0), 0.0), np.zeros(len(goal))
    (_, whole), (totals, free) = _sums(rows, fitted, [zero - 1.0, zero])  # a step below 0 lifts all texts above the floor
    now = totals / max(1.0, floor)
    target = goal * max(now.sum(), floor * (1 + MARGIN) * (now / goal).max())
    fitted.targets = dict(zip(weights, target.tolist(), strict=True))
    if now.sum() == 0:
        return fitted
    least = np.eye(len(goal)) * 1e-9 * np.trace(whole) / len(goal)
    weight = 1 / target**2
    longest = 1 / np.linalg.eigvalsh(whole * np.sqrt(np.outer(weight, weight))).max()
    missed = lambda t: float((((t - target) / target) ** 2).sum())
    for _ in range(MAX_STEPS):
        fitted.miss = float(np.abs(totals / target - 1).max())
        if fitted.miss <= CLOSE:
            return fitted
        over = totals - target
        tried = [np.linalg.solve(m + least, over) * k for m in (free, whole) for k in (1, 0.25)] + [weight * over * longest * k for k in (1, 4, 16, 64)]
        found = _sums(rows, fitted, tried)
        best = min(range(len(tried)), key=lambda k: missed(found[k][0]))
        if missed(found[best][0]) >= (1 - LEAST) * missed(totals):
            return fitted
        fitted.steps.append(tried[best])
        totals, free = found[best]
    raise RuntimeError(f"the rates were not fitted in {MAX_STEPS} steps; the largest miss is {fitted.miss:.2e} of a target")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], encoder: tuple[str, str], floor: float = 0.0, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All columns of docs (doc_id, text), n_tokens, shares, rate, miss and copies; columns of docs with these names go.

    encoder is the vocabulary's file, which every executor must have, and the pattern by which it splits texts. rate is how
    often a text is wanted, miss how far the domain that is farthest is from its target, relative to it, and copies a whole
    number with the rate as its mean that the doc_id alone decides, so a rerun and lost executors change nothing. Null and
    empty texts have no tokens and get the rate of their shares. Repeated rows are treated alike, an empty table gives an
    empty result, and without labels all domains are equally likely. Texts with equal shares get equal rates.
    """
    docs = docs.drop("rate", "copies", "miss")
    shared = cut(with_shares(docs, fit(docs, labels, [*weights], max_train, max_bytes), encoder))
    rates = fit_rates(shared.select("shares", "n_tokens"), weights, floor)
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return rates.added(shared).withColumn("miss", F.lit(rates.miss)).withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float], encoder: tuple[str, str], floor: float = 0.0, **bounds) -> DataFrame:
    """The columns of docs with each row as often as its copies say."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = docs.select("doc_id", "text", *[F.col(c).alias(f"own_{c}") for c in rest])
    chosen = mix(inner, labels, weights, encoder, floor, **bounds).filter("copies > 0")
    repeated = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[c if c in ("doc_id", "text") else F.col(f"own_{c}").alias(c) for c in docs.columns])


def labelled_domains(docs: DataFrame, labels: DataFrame, low: str = "low") -> DataFrame:
    """(doc_id, domain) of labelled documents: low where the quality is 0, else the document's language."""
    domain = F.when(F.col("quality") == 0, low).otherwise(F.col("lang"))
    return labels.select("doc_id", "quality").join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", domain.alias("domain"))
