"""Self-join of texts on the Jaccard similarity of their shingles, exact, by partitioning the universe of shingles.

Sizes fall into bands. A band has a number of segments, and every shingle falls into one of them by its hash. Two sets of
sizes x <= y that link differ in at most H = (x + y) * (1 - J) / (1 + J) shingles. A segment that is allotted e errors is
found again by its signatures while the two differ in no more than e shingles there, so the pair meets as soon as the
allotted errors, each plus one, add up to more than H (pigeonhole). Errors are allotted by cost:

- None to an empty segment, nor to contents that very many sets share (a common passage), as long as enough others remain.
  A set that is left with too few is "short", and its frequent contents are joined apart, among short sets alone.
- In bands under DELETED, where sets are small and a few shingles are seldom theirs alone, segments are large and have one
  error each: the contents themselves and what is left after any one deletion (no deletion of a segment's only shingle).
  In the smallest band the whole set is one segment. Such a segment costs one signature for each shingle.
- In larger bands that costs more than more and smaller segments without an error: one signature each.
- A set whose shingles happen to fill too few segments is also indexed by single shingles, in the order of their
  hashes, up to H + 1.

Whoever shares a signature is a candidate. A parity sketch rules out nearly all that cannot link: of two sets' bits, one
for each bin of hashes, no more can differ than their shingles do. Candidates' components are then compared in blocks, each
text moving once for a small component, and there shingles are told apart by their words, so no hash makes a link.
Bands, signatures and n_shingles rest on 64-bit hashes that are derived from a cryptographic hash of each word: a text of a
million words has a chance of 3e-8 that two of its shingles count as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.components import components
from tradelens.llm.shared import keyed, written
from tradelens.llm.textkit import mixed, word_hashes, words

SHINGLE = 5
#: The similarity as a fraction.
NUM, DEN = 75, 100
#: The smallest sets (H = 0 or 1) are one band; from TINY on, each band spans sizes up to GROWTH times its start.
TINY, GROWTH = 6, 3
#: Bands under this have segments of about WIDE shingles with one error, others of about FILL without.
DELETED, WIDE, FILL = 3, 4.0, 2.2
#: An entry of more sets than this is frequent.
FREQUENT = 32
#: Short sets of a frequent entry, and the texts of a component, are compared in tiles of blocks of so many.
TILE = 1024
#: A block has about so many shingles at most.
BLOCK_SHINGLES = 1_000_000
#: Shingles in more of a tile's texts than this are counted by a matrix product, others pair by pair.
DENSE = 16
#: A table of ids is broadcast while it has fewer rows than this (some 40 bytes each), else joined by shuffle.
FEW_IDS = 500_000
#: A class of more documents than this is joined to its records by a broadcast of its one row.
HOT_CLASS = 50_000
_SEGMENT, _DELETED, _SINGLE = 1, 2, 3
OWN, LOWER, SINGLES, ONE_ERROR = 0, 1, 2, 4


def most_apart(x: int, y: int) -> int:
    """Shingles that linked sets of these sizes can differ in."""
    return (x + y) * (DEN - NUM) // (DEN + NUM)


def largest_partner(x: int) -> int:
    return x * DEN // NUM


def band(size: int) -> int:
    """0 for sizes under TINY, then 1, 2, ..."""
    k, start = 0, TINY
    while size >= start:
        k, start = k + 1, start * GROWTH
    return k


def band_start(k: int) -> int:
    return 1 if not k else TINY * GROWTH ** (k - 1)


def n_segments(k: int) -> int:
    return int(band_start(k + 1) / WIDE) + 1 if k < DELETED else int(band_start(k + 1) / FILL) + 4


def shingle_hashes(found: list[bytes]) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    if not found:
        return np.zeros(0, np.uint64)
    h = word_hashes(found)
    n = min(len(found), SHINGLE)
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = mixed(total * np.uint64(3) + h[k : len(h) - n + 1 + k])
    return np.unique(total)


def sketch_of(h: np.ndarray) -> bytes:
    """The parity of each bin, a power of two of them, no fewer than the shingles."""
    if not len(h):
        return b""
    size = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Shingles that sets with these sketches differ in at least: the bits that differ, of the longer one folded to the shorter."""
    if len(x) > len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(np.frombuffer(y, np.uint8).reshape(-1, len(x)), axis=0)
    return int.from_bytes(x).__xor__(int.from_bytes(folded.tobytes())).bit_count()


def _tag(k: int, kind: int, part: np.ndarray | int) -> np.ndarray:
    return mixed(np.atleast_1d(np.asarray(part, np.uint64)) * np.uint64(64) + np.uint64(4 * (k % 16) + kind))


def _segments(h: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in band k's segments, and the errors, each plus one, that they are allotted."""
    m = n_segments(k)
    at = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascends with the hashes
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    spread = mixed(h)
    total, size = np.add.reduceat(spread, first), np.diff(np.append(first, len(h)))
    whole = mixed(total + _tag(k, _SEGMENT, at[first]))
    if k >= DELETED:
        return whole, len(first)
    left = np.repeat(total, size) - spread
    return np.concatenate((whole, mixed(left + _tag(k, _SEGMENT, at))[np.repeat(size, size) > 1])), int(np.minimum(size, 2).sum())


def entries(h: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
    """What a set is indexed by: (scheme, entries, slack); slack: entries that may be frequent without the set being short."""
    s = len(h)
    if not s:
        return []
    out, k = [], band(s)
    for scheme, b in ((OWN, k), (LOWER, k - 1)):
        # the lower scheme is for partners of the band below; the largest of them has one element less than this band
        if scheme == LOWER and (b < 0 or largest_partner(band_start(k) - 1) < s):
            continue
        if b == 0:
            total = mixed(h).sum(dtype=np.uint64, keepdims=True)
            whole = mixed(total + _tag(0, _DELETED, 0))
            out.append((scheme, np.concatenate((whole, mixed(total - mixed(h) + _tag(0, _DELETED, 0)))) if s > 2 else whole, 0))
            continue
        found, n = _segments(h, b)
        need = (most_apart(s, largest_partner(s)) if scheme == OWN else most_apart(band_start(k) - 1, s)) + 1
        out.append((scheme + ONE_ERROR * (b < DELETED), found, n - need))
        if n < need:
            order = np.sort(mixed(h ^ np.uint64(0x5DEECE66D)))[:need]
            out.append((SINGLES, mixed(order + _tag(b, _SINGLE, 0)), 0))
    return out


def _arrays(sets: Iterator[tuple[int, list[tuple[int, np.ndarray, int]], int]], n_buckets: int) -> Iterator[dict]:
    """The entries of all sets of a partition, dealt to buckets as packed arrays."""
    nodes, sizes, slacks, lens, sigs = [], [], [], [], []
    for node, found, size in sets:
        for scheme, e, slack in found:
            nodes.append(node)
            sizes.append(size * 8 + scheme)
            slacks.append(max(-30_000, min(30_000, slack)))
            lens.append(len(e))
            sigs.append(e)
    if not sigs:
        return
    sig = np.concatenate(sigs)
    owner = np.repeat(np.arange(len(nodes), dtype=np.int64), lens)
    bucket = (((sig >> np.uint64(48)) * np.uint64(n_buckets)) >> np.uint64(16)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")  # within a bucket the owners stay in order
    sig, owner, bucket = sig[order], owner[order], bucket[order]
    nodes_, sizes_, slacks_ = np.array(nodes, np.uint64), np.array(sizes, np.int32), np.array(slacks, np.int16)
    edge = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for b in range(n_buckets):
        lo, hi = edge[b], edge[b + 1]
        if lo == hi:
            continue
        mine, count = np.unique(owner[lo:hi], return_counts=True)
        s = sig[lo:hi]
        # the bucket tells the highest bits, so 48 more keep entries apart; a clash makes a candidate at most
        yield {"bucket": b, "nodes": nodes_[mine].tobytes(), "sizes": sizes_[mine].tobytes(), "slacks": slacks_[mine].tobytes(), "counts": count.astype(np.int32).tobytes(),
               "low": s.astype(np.uint32).tobytes(), "high": (s >> np.uint64(32)).astype(np.uint16).tobytes()}


_INDEX = "bucket int, ids binary, n binary, digests array<binary>, sketches array<binary>, nodes binary, sizes binary, slacks binary, counts binary, low binary, high binary"
_FOUND = "kind int, a long, b long, n int, slack int, digest binary, sketch binary"
_DOC, _PAIR, _FREQUENT = 0, 1, 2


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


def _index(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Packed index entries by bucket, and the documents' own records, dealt by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, digests, sketches = [], [], [], []
        known: dict[bytes, tuple[int, bytes]] = {}

        def sets():
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    found = words(text.as_py())
                    digest = _digest(found)
                    if (seen := known.get(digest)) is None:
                        h = shingle_hashes(found)
                        seen = known[digest] = len(h), sketch_of(h)
                        yield _node(digest), entries(h), len(h)
                    ids.append(doc_id)
                    n.append(seen[0])
                    digests.append(digest)
                    sketches.append(seen[1])

        packed = {x["bucket"]: x for x in _arrays(sets(), n_buckets)}
        to = mixed(np.array(ids, np.int64).astype(np.uint64)) % np.uint64(n_buckets) if ids else np.zeros(0, np.uint64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(n_buckets + 1, dtype=np.uint64))
        for b in range(n_buckets):
            mine = order[edges[b] : edges[b + 1]]
            row = packed.pop(b, None) or {"bucket": b} | dict.fromkeys(("nodes", "sizes", "slacks", "counts", "low", "high"), b"")
            if not len(mine) and not row["nodes"]:
                continue
            row |= {"ids": np.array([ids[i] for i in mine], np.int64).tobytes(), "n": np.array([n[i] for i in mine], np.int32).tobytes(), "digests": [digests[i] for i in mine], "sketches": [sketches[i] for i in mine]}
            yield pa.RecordBatch.from_pylist([row], schema=_index_schema())

    return docs.mapInArrow(run, _INDEX)


def _index_schema() -> pa.Schema:
    lists = {"digests", "sketches"}
    return pa.schema([("bucket", pa.int32())] + [(c, pa.list_(pa.binary()) if c in lists else pa.binary()) for c in ("ids", "n", "digests", "sketches", "nodes", "sizes", "slacks", "counts", "low", "high")])


def _found_table(kind: int, a=(), b=(), n=(), slack=(), digest=None, sketch=None) -> pa.Table:
    size = len(a)
    blank = lambda t: pa.nulls(size, t)
    return pa.table({
        "kind": pa.array(np.full(size, kind, np.int32)), "a": pa.array(np.asarray(a, np.int64)), "b": pa.array(np.asarray(b, np.int64)) if len(b) else blank(pa.int64()),
        "n": pa.array(np.asarray(n, np.int32)) if len(n) else blank(pa.int32()), "slack": pa.array(np.asarray(slack, np.int32)) if len(slack) else blank(pa.int32()),
        "digest": digest if digest is not None else blank(pa.binary()), "sketch": sketch if sketch is not None else blank(pa.binary()),
    })


def _in_bucket(rows: pa.Table) -> pa.Table:
    """Documents' records; candidate pairs of entries that few sets share; the owners of frequent entries."""
    join = lambda c, t: np.frombuffer(b"".join(x.as_py() or b"" for x in rows.column(c)), t)
    ids = join("ids", np.int64)
    flat = lambda c: rows.column(c).combine_chunks().flatten()
    out = [_found_table(_DOC, ids, n=join("n", np.int32), digest=flat("digests"), sketch=flat("sketches"))] if len(ids) else []
    counts = join("counts", np.int32)
    if len(counts):
        node, size, slack = (np.repeat(join(c, t), counts) for c, t in (("nodes", np.int64), ("sizes", np.int32), ("slacks", np.int16)))
        sig = join("low", np.uint32).astype(np.uint64) | (join("high", np.uint16).astype(np.uint64) << np.uint64(32))
        order = np.lexsort((node, sig))
        sig, node, size, slack = sig[order], node[order], size[order], slack[order]
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))  # copies from other partitions
        sig, node, size, slack = sig[fresh], node[fresh], size[fresh], slack[fresh]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        length = np.diff(np.append(first, len(sig)))
        pairs = []
        for g in np.unique(length[(length > 1) & (length <= FREQUENT)]):
            i, j = np.triu_indices(int(g), 1)
            starts = first[length == g]
            for at in range(0, len(starts), step := max(1, 2_000_000 // len(i))):
                block = starts[at : at + step, None]
                x, y = (block + i).ravel(), (block + j).ravel()
                a, b = size[x] >> 3, size[y] >> 3
                near = np.minimum(a, b).astype(np.int64) * DEN >= np.maximum(a, b).astype(np.int64) * NUM
                pairs.append(np.unique(np.stack((node[x[near]], node[y[near]])), axis=1))
        if pairs and (both := np.unique(np.concatenate(pairs, axis=1), axis=1)).size:
            out.append(_found_table(_PAIR, both[0], both[1]))
        many = np.repeat(length > FREQUENT, length)
        if many.any():
            # b: the entry (its own bits and the bucket's), n: the set's size and scheme
            bucket = np.uint64(rows.column("bucket")[0].as_py())
            out.append(_found_table(_FREQUENT, node[many], mixed(sig[many] ^ (bucket << np.uint64(48))).view(np.int64), size[many], slack[many]))
    return pa.concat_tables(out) if out else _found_table(_DOC)


def shingles(found: list[bytes]) -> set[tuple[bytes, ...]]:
    if not found:
        return set()
    return {tuple(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1))}


def may_link(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of class ids without those that size and sketch rule out, so that no texts move for them."""
    of = classes.select("class_id", "n", "sketch")
    both = pairs.join(of.toDF("a", "na", "sa"), "a").join(of.toDF("b", "nb", "sb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")]
            keep = [least_apart(x, y) <= most_apart(m, n) for m, n, x, y in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    near = F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM
    return both.filter(near).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _stars(near: np.ndarray, names: np.ndarray) -> pa.Table:
    """(a, b): each name beside the smallest that it is joined to by the symmetric matrix near."""
    todo, a, b = np.ones(len(names), bool), [], []
    for root in np.argsort(names, kind="stable"):
        if not todo[root]:
            continue
        front, todo[root] = np.array([root]), False
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & todo)
            todo[front] = False
            a += [int(names[root])] * len(front)
            b += names[front].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _tile_stars(rows: pa.Table) -> pa.Table:
    """Sets of one tile of a frequent entry that may link by size and sketch, directly or in steps, as stars."""
    side, node, size = (np.asarray(rows.column(c)) for c in ("side", "node", "size"))
    sketches = rows.column("sketch").to_pylist()
    near = np.zeros((len(node), len(node)), bool)
    within = bool(rows.column("i")[0].as_py() == rows.column("j")[0].as_py())
    lengths = np.array([len(x) for x in sketches])
    bits = {w: np.frombuffer(b"".join(sketches[i] for i in np.flatnonzero(lengths == w)), np.uint64).reshape(-1, w // 8) for w in np.unique(lengths)}
    for w, x in bits.items():
        mine = np.flatnonzero(lengths == w)
        for v, y in bits.items():
            if v < w or v > 2 * w:  # larger ones are too large; each two lengths once
                continue
            theirs, folded = np.flatnonzero(lengths == v), np.bitwise_xor.reduce(y.reshape(len(y), -1, w // 8), axis=1)
            for p, own in zip(mine, x, strict=True):
                apart = np.bitwise_count(folded ^ own).sum(axis=1, dtype=np.int64)
                fits = (apart <= (size[theirs] + size[p]) * (DEN - NUM) // (DEN + NUM)) & (np.minimum(size[theirs], size[p]) * DEN >= np.maximum(size[theirs], size[p]) * NUM)
                near[p, theirs] = fits & (within | (side[theirs] != side[p]))
    near |= near.T
    np.fill_diagonal(near, False)
    return _stars(near, node)


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) pairs, each once; a shingle's number stands for its words, not for a hash."""
    names: dict[bytes, int] = {}
    short: dict[tuple[bytes, ...], int] = {}
    ids = [np.fromiter((names.setdefault(w, len(names)) for w in t), np.int64, len(t)) for t in texts]
    length = np.array([len(t) for t in texts])
    w, owner = np.concatenate(ids), np.repeat(np.arange(len(texts)), length)
    few = [(i, short.setdefault(tuple(t), len(short))) for i, t in enumerate(texts) if 0 < len(t) < SHINGLE]
    owners, numbers = np.array([i for i, _ in few], np.int64), np.array([k for _, k in few], np.int64)
    if len(w) >= SHINGLE:
        rank = lambda x: np.unique(x, return_inverse=True)[1]
        two = rank(w[:-1] * len(names) + w[1:])
        four = rank(two[:-2] * len(w) + two[2:])
        five = four[:-1] * len(names) + w[4:]
        inside = owner[:-4] == owner[4:]
        code = np.unique(owner[:-4][inside] * len(w) + rank(five[inside]))
        owners, numbers = np.concatenate((owners, code // len(w))), np.concatenate((numbers, code % len(w) + len(short)))
    return owners, numbers


def shared(owners: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each two of n texts share."""
    order = np.argsort(numbers, kind="stable")
    owners, numbers = owners[order], numbers[order]
    first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
    df = np.diff(np.append(first, len(numbers)))
    out = np.zeros(n * n, np.int64)
    for d in np.unique(df[(df > 1) & (df <= DENSE)]):
        i, j = np.triu_indices(int(d), 1)
        starts = first[df == d]
        for at in range(0, len(starts), step := max(1, 4_000_000 // len(i))):
            block = starts[at : at + step, None]
            out += np.bincount((owners[block + i] * n + owners[block + j]).ravel(), minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    many = first[df > DENSE]
    for at in range(0, len(many), 2048):
        dense = np.zeros((n, 2048), np.float32)
        for k, f in enumerate(many[at : at + 2048]):
            dense[owners[f : np.searchsorted(numbers, numbers[f], "right")], k] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    return out


def _digest(found: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(found), digest_size=16).digest()


def _verified(rows: pa.Table) -> pa.Table:
    """The links of one tile: stars (a, b), and for each class id how many of the tile's texts link with it (b null)."""
    held: dict[bytes, tuple[int, int, list[bytes]]] = {}
    for class_id, side, digest, text in zip(*(rows.column(c) for c in ("class_id", "side", "digest", "text")), strict=True):
        if digest.as_py() not in held:
            found = words(text.as_py())
            if _digest(found) == digest.as_py():  # another row may have the id, too
                held[digest.as_py()] = class_id.as_py(), side.as_py(), found
    names, side = np.array([x[0] for x in held.values()], np.int64), np.array([x[1] for x in held.values()])
    blank = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}
    if len(held) < 2:
        return pa.table(blank)
    owners, numbers = _numbered([x[2] for x in held.values()])
    size = np.bincount(owners, minlength=len(held))
    same = shared(owners, numbers, len(held))
    linked = (DEN * same >= NUM * (size[:, None] + size - same)) & (same > 0)
    if rows.column("i")[0].as_py() != rows.column("j")[0].as_py():
        linked &= side[:, None] != side
    np.fill_diagonal(linked, False)
    stars, n = _stars(linked, names), linked.sum(axis=1)
    some = n > 0
    counts = pa.table({"a": names[some], "b": pa.nulls(int(some.sum()), pa.int64()), "n": n[some].astype(np.int64)})
    return pa.concat_tables([stars.append_column("n", pa.nulls(stars.num_rows, pa.int64())), counts])


def verify(candidates: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, n): the links inside the components of candidates, as stars (a, b) and as counts n for each class id a.

    A component is dealt to blocks of bounded size, and each two blocks meet in one tile, so every pair is compared once.
    """
    comp = components(candidates).toDF("class_id", "comp")
    placed = classes.filter("n > 0").select("class_id", "digest", "n").join(comp, "class_id")
    blocks = placed.groupBy("comp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = placed.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    placed = written(placed.select(F.col("class_id").alias("doc_id"), "digest", "comp", "blocks", "block"))
    few = placed.count() <= FEW_IDS
    found = docs.join(F.broadcast(placed) if few else placed, "doc_id")
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"), F.when(F.col("block") <= k, 0).otherwise(1).alias("side")))
    tiles = found.select(F.col("doc_id").alias("class_id"), "digest", "comp", "text", F.inline(to))
    return written(tiles.groupBy("comp", "i", "j").applyInArrow(_verified, "a long, b long, n long"))


def _by_class(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of nodes as pairs of class ids. Two classes may share a node (the start of a digest): then both are meant."""
    of = classes.filter("n > 0").select("node", "class_id")
    named = pairs.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
    return named.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _frequent(held: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of nodes that join, by steps, whatever shares a frequent entry and may link.

    Each entry's sets are dealt to blocks, and each two blocks meet in a tile, so no task takes a whole group.
    """
    sketches = classes.filter("n > 0").groupBy("node").agg(F.max("sketch").alias("sketch"))
    blocks = held.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    rows = held.join(sketches, "node").join(blocks, "entry").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"), F.when(F.col("block") <= k, 0).otherwise(1).alias("side")))
    tiles = rows.select("entry", "node", "size", "sketch", F.inline(to))
    return tiles.groupBy("entry", "i", "j").applyInArrow(_tile_stars, "a long, b long").distinct()


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links, itself included; class_id the smallest doc_id with the same
    words; n_links the number of other classes that the text links with: every link between different texts counts.

    A null text, or one without words, has no shingles and links with nothing. Rows with a null doc_id are left out, as no
    id can stand for them; repeated rows count as copies and each gets a row; different texts under one doc_id are one
    document to components. More columns are left out, whatever their names; an empty table gives an empty result. A very
    long text is compared whole, in a block of its own if need be.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    n_buckets = max(8, docs.rdd.getNumPartitions())
    found = written(_index(docs, n_buckets).groupBy("bucket").applyInArrow(_in_bucket, _FOUND))

    records = found.filter(F.col("kind") == _DOC).select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), "digest", "sketch")
    classes = records.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.count(F.lit(1)).alias("size"))
    classes = written(classes.withColumn("node", _node_of(F.col("digest"))))
    twins = classes.filter("n > 0").groupBy("node").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a < b").select("a", "b")

    # Entries of few sets gave pairs at once. Frequent ones count only for short sets: those that have too few others.
    pairs = found.filter(F.col("kind") == _PAIR).select("a", "b").distinct()
    owners = found.filter(F.col("kind") == _FREQUENT).select(F.col("a").alias("node"), F.col("b").alias("entry"), F.expr("n div 8").cast("int").alias("size"), F.expr("n % 8").alias("scheme"), "slack")
    # A frequent signature of a segment with one error may take both of its units.
    one_error = F.col("scheme") >= ONE_ERROR
    lost = F.col("n") * F.when(one_error, 2).otherwise(1)
    short = owners.groupBy("node", "scheme").agg(F.count(F.lit(1)).alias("n"), F.max("slack").alias("most")).filter(lost > F.col("most"))
    short = short.select("node", "scheme", F.when(one_error, F.col("n")).otherwise(F.col("n") - F.col("most")).alias("needed"))
    # As many as the pigeonhole needs beside the others, the same first ones for all sets: those with the smallest hashes.
    place = F.row_number().over(Window.partitionBy("node", "scheme").orderBy("entry"))
    held = owners.join(short, ["node", "scheme"]).withColumn("place", place).filter("place <= needed")
    held = written(held.select("node", "entry", "size").distinct())
    stars = written(_frequent(held, classes))
    # Stars of frequent entries stand for pairs that passed already; they join candidates and need not pass themselves.
    candidates = written(may_link(_by_class(pairs, classes), classes).unionByName(twins).unionByName(_by_class(stars, classes)))
    links = verify(candidates, classes, docs)

    labels = components(links.filter("b is not null").select("a", "b")).toDF("class_id", "label")
    counts = links.filter("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n_links"))
    named = classes.select("digest", "class_id", "size").join(labels, "class_id", "left").join(counts, "class_id", "left")
    return _named(records, named.select("digest", "class_id", "size", F.coalesce("label", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))


def _named(records: DataFrame, named: DataFrame) -> DataFrame:
    """Each record with its class and component. Of the few classes that have very many documents the rows are broadcast."""
    hot = written(named.filter(F.col("size") > HOT_CLASS))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id"))  # texts without words link with nothing, not even with each other
    columns = ["doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce(own, "component_id").alias("component_id"), F.coalesce(own, "class_id").alias("class_id"), "n_links"]
    parts = [(records, named)]
    if hot.count():  # no more than one for HOT_CLASS documents
        keys = F.broadcast(hot.select("digest"))
        parts = [(records.join(keys, "digest", "left_anti"), named.filter(F.col("size") <= HOT_CLASS)), (records, F.broadcast(hot))]
    joined = [x.join(y, "digest").select(*columns) for x, y in parts]
    return joined[0] if len(joined) == 1 else joined[0].unionByName(joined[1])


def _node_of(digest):
    """The first eight bytes of a digest, little end first, as a long."""
    hexed = F.hex(digest)
    return F.conv(F.concat(*[F.substring(hexed, 2 * k + 1, 2) for k in range(7, -1, -1)]), 16, -10).cast("long")


def near_duplicates_kept(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of linked texts: the one with the smallest doc_id stays.

    Rows are told apart by a number of their own, so no text is lost where several have one doc_id, and those without an id,
    which come last, are joined as well. Rows without words link with nothing and stay.
    """
    rows, key = keyed(docs)
    joined = ngram_join(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key))
    first = joined.join(rows.select("doc_id", key), key).withColumn("own", order).groupBy("component_id").agg(F.min("own")[key].alias(key))
    gone = joined.select(key).join(first.select(key), key, "left_anti")
    return rows.join(gone, key, "left_anti").select(*docs.columns)
