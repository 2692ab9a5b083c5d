"""Compression of vectors into one code byte for each of 16 parts, with a vantage-point tree over each part's entries.

The components are integers, so distances are exact. The tree is searched by branch and bound with the metric: a side is
left out only where the triangle inequality rules out an entry as near as the best so far. The radii are rounded away from
the point that decides and sides that could tie are visited, so rounding never loses an entry; the distances that decide
are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.shared import partitions

#: Entries under which a node compares all, and the vectors that a task searches at a time.
LEAF, SLICE = 6, 8192
#: Sizes of components up to which squares of differences and their sums over a vector stay within 64 bits.
LARGEST = 2**26


class Tree:
    """The entries (row for each, integers) of one part, for nearest-entry searches of many points at a time."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.root = self._node(np.arange(len(entries)))

    def _node(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids, None
        centre = self.entries[ids].mean(axis=0)
        pivot = ids[np.argmax(((self.entries[ids] - centre) ** 2).sum(axis=1))]  # one at the edge parts the others best
        rest = ids[ids != pivot]
        far = np.sqrt(((self.entries[rest] - self.entries[pivot]) ** 2).sum(axis=1).astype(np.float64))
        half = np.median(far)
        near = far <= half
        if near.all():  # no distance parts them
            near = np.arange(len(far)) < len(far) // 2
        # the inner ball's radius is rounded up, the outer shell's down
        inner, outer = np.nextafter(far[near].max(), np.inf), np.nextafter(far[~near].min(), 0.0)
        return np.array([pivot]), (inner, outer, self._node(rest[near]), self._node(rest[~near]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the index of its nearest entry, the lowest of those as near, and the squared distance."""
        points = points.astype(np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max)
        at = np.full(len(points), len(self.entries), np.int64)
        self._visit(self.root, points, np.arange(len(points)), best, at)
        return at, best

    def _visit(self, node, points: np.ndarray, who: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if not len(who):
            return
        ids, sides = node
        for i in ids:
            d = ((points[who] - self.entries[i]) ** 2).sum(axis=1)
            better = (d < best[who]) | ((d == best[who]) & (i < at[who]))
            won = who[better]
            best[won], at[won] = d[better], i
        if sides is None:
            return
        inner, outer, near, far = sides
        away = np.sqrt(d.astype(np.float64))  # of the pivot, the node's only entry
        low, high = away * (1 - 1e-12), away * (1 + 1e-12)
        first = away <= (inner + outer) / 2
        reach = lambda some: np.sqrt(best[some].astype(np.float64)) * (1 + 1e-12)
        self._visit(near, points, who[first], best, at)
        self._visit(far, points, who[~first], best, at)
        late = who[first]
        self._visit(far, points, late[outer - high[first] <= reach(late)], best, at)
        late = who[~first]
        self._visit(near, points, late[low[~first] - inner <= reach(late)], best, at)


def _whole(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Slices of a batch with their vectors as integers: floor(256 x)."""
    for k in range(0, batch.num_rows, SLICE):
        part = batch.slice(k, SLICE)
        x = np.floor(256 * part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
        if x.size and np.abs(x).max() > LARGEST:
            raise ValueError(f"components beyond {LARGEST / 256:.0f} are not supported")
        yield x.astype(np.int64), part


def _assigned(x: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vector by part) and the sums of the squared distances."""
    width = x.shape[1] // len(trees)
    found = [t.nearest(x[:, k * width : (k + 1) * width]) for k, t in enumerate(trees)]
    return np.stack([a for a, _ in found], axis=1), sum(d for _, d in found)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has as many components as most and none that is null, NaN or infinite."""
    of = F.col(column)
    sound = of.isNotNull() & (F.size(of) > 0) & ~F.exists(of, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(F.coalesce(sound, F.lit(False)))


def train(kept: DataFrame, dim: int, parts: int, size: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, position) of the rows (vec_id, vector); only sums by part and entry come to the driver."""
    seeds = kept.orderBy("vec_id", "vector").limit(size).collect()
    books = np.floor(256 * np.array([r["vector"] for r in seeds], np.float64)).astype(np.int64).reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2)

    def sums_of(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = [Tree(b) for b in books]
            n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                for x, _ in _whole(batch, dim):
                    codes, _errors = _assigned(x, trees)
                    for k in range(parts):
                        n[k] += np.bincount(codes[:, k], minlength=books.shape[1])
                        np.add.at(total[k], codes[:, k], x.reshape(len(x), parts, -1)[:, k])
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "n": n[part, entry], "total": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

        return run

    for _ in range(rounds):
        partial = kept.select("vector").mapInArrow(sums_of(books), "part long, entry long, n long, total array<long>")
        width = dim // parts
        # parts x entries rows, however many vectors there are
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[k]) for k in range(width)]).alias("total")).collect():
            books[r.part, r.entry] = np.array(r.total) // r.n
    return books


def compress(vectors: DataFrame, column: str = "embedding", parts: int = 16, size: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code binary, error) for each usable row of vectors (vec_id, column, label), and the codebooks.

    Rows whose vector is null or empty, has null, NaN or infinite components, or another number of components than most are
    dropped. With fewer usable rows than size there are as many entries as rows; of rows with one vec_id the smaller vector
    comes first. Repeated rows are coded each, null ids and labels stay, other columns are left out. Without usable rows the
    result is empty and there are no codebooks. The most usual number of components must be a multiple of parts.
    """
    if not 0 < size <= 256:
        raise ValueError("a code is one byte, so there are 1 to 256 entries")
    kept = usable(vectors.select("vec_id", F.col(column).alias("vector"), "label"), "vector")
    usual = kept.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = usual.dim if usual else parts
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    kept = kept.filter(F.size("vector") == dim)
    books = train(kept, dim, parts, size, rounds) if usual else np.zeros((parts, 0, dim // parts), np.int64)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for batch in batches:
            for x, part in _whole(batch, dim):
                codes, errors = _assigned(x, trees)
                rows = codes.astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "label": part.column("label"), "code": pa.array([r.tobytes() for r in rows], pa.binary()), "error": errors})

    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long"), books


def decompress(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """coded with vector: the entries that its code names, as numbers again."""
    table = (books / 256.0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [[v for k, c in enumerate(code) for v in table[k][c]] for code in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    return coded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema) + ", vector array<double>")


def vector_codes(vectors: DataFrame, column: str = "embedding", parts: int = 16, size: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 for the rows that compress keeps.

    The sums by label are few rows beside the vectors; each label's rows are dealt to several tasks, as one may hold most.
    """
    coded, books = compress(vectors, column, parts, size, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    salts = min(64, partitions(coded))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("label", "_label")
    own = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    joined = own.join(sums, own.label.eqNullSafe(sums._label) & (own._salt == sums._salt))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
