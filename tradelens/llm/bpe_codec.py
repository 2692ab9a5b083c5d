"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one vocabulary token can be the last of its encoding. An automaton over the
vocabulary finds the tokens that end at each place; the one whose predecessor (the last token of the shorter prefix)
stands next to it in a real encoding is stored. Following these back gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: How a byte-level pre-tokenizer splits text, and the bytes that stand for themselves in its alphabet.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Units kept with their encodings in each worker; beyond that, units are encoded anew each time.
CACHE = 200_000
#: Bytes of text whose results are held before they are handed on; a longer text is alone.
HELD = 1 << 20
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    others = [b for b in range(256) if b not in set(PLAIN)]
    return {chr(b): b for b in PLAIN} | {chr(0x100 + i): b for i, b in enumerate(others)}


class PrefixEncoder:
    """Encodes as the tokenizer file says, which must be byte-level BPE without a normalizer."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"] or spec["post_processor"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only byte-level BPE without normalizer, post-processor and prefix space is supported")
        byte = byte_alphabet()
        raw = {t: bytes(map(byte.__getitem__, t)) for t in model["vocab"]}
        self.bytes_of = {i: raw[t] for t, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.special, self.bytes_of = special, self.bytes_of | {i: t.encode() for t, i in special.items()}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        vocab = model["vocab"]
        self.single = {raw[t][0]: i for t, i in vocab.items() if len(raw[t]) == 1}
        self.rank, self.halves = {}, {}
        for n, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = n
            self.halves.setdefault(whole, (n, *pair))
        self.find = ahocorasick.Automaton()
        for i in {*self.single.values(), *self.halves}:
            self.find.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.find.make_automaton()
        self.split = regex.compile(PIECES).findall
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}

    def _spine(self, token: int, side: int, known: dict[int, list]) -> list[tuple[int, int]]:
        """From the outermost byte up to the token: each symbol on that side, and the rank of the merge that ends it."""
        if token not in known:
            out, end, t = [], NEVER, token
            while True:
                out.append((t, end))
                if t not in self.halves:
                    break
                end, *parts = self.halves[t]
                t = parts[side]
            known[token] = out[::-1]
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether a then b is the encoding of their bytes: at no time is the pair across their border merged first."""
        xs, ys, i, j, ok = self._spine(a, 1, self.right), self._spine(b, 0, self.left), 0, 0, True
        while True:
            (x, x_end), (y, y_end) = xs[i], ys[j]
            r = self.rank.get((x, y), NEVER)
            if r < x_end and r <= y_end and r < NEVER:  # of equal ranks the leftmost pair is merged first
                ok = False
                break
            if x_end == NEVER and y_end == NEVER:
                break
            if x_end <= y_end:
                i += 1
            else:
                j += 1
        if len(self.pairs) < CACHE:
            self.pairs[a << 20 | b] = ok
        return ok

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        n = len(data)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        known, fits = self.pairs.get, self.fits
        for end, (token, long) in self.find.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                if before := end - long:
                    if (a := last[before]) < 0:
                        continue
                    if (ok := known(a << 20 | token)) is None:
                        ok = fits(a, token)
                    if not ok:
                        continue
                last[end], size[end] = token, long
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def unit(self, text: str) -> str:
        """Ids, joined by commas, of text that no piece outside reaches into. What they decode to is compared at once."""
        if (joined := self.units.get(text)) is None:
            raw = text.encode()
            alone = text[1:].isalpha() and (text[0] == " " or text[0].isalpha())  # then it is one piece
            ids = self.piece(raw) if alone else [i for p in self.split(text) for i in self.piece(p.encode())]
            joined = ",".join(map(str, ids))
            if len(self.units) < CACHE and len(text) < 64:
                self.units[text] = joined
            if (decoded := b"".join(map(self.bytes_of.__getitem__, ids))) != raw:
                self.odd[text] = decoded
        return joined

    def encode(self, text: str) -> tuple[str, int, bytes]:
        """The text's ids joined by commas, their number, and the bytes that they decode to."""
        ids, decoded = [], []
        get, unit, odd = self.units.get, self.unit, self.odd
        for k, stretch in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                ids.append(str(self.special[stretch]))
                decoded.append(self.bytes_of[self.special[stretch]])
            elif stretch:
                parts = units(stretch)
                ids += [get(u) or unit(u) for u in parts]
                decoded += [odd.get(u) or u.encode() for u in parts] if odd else [stretch.encode()]
        joined = ",".join(ids)
        return joined, joined.count(",") + 1 if joined else 0, b"".join(decoded)


_BESIDE = re.compile(r" \s|\s ")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """The text cut before every space between two characters that are not white space: no piece crosses such a place."""
    if _BESIDE.search(text) or text[0] == " " or text[-1] == " ":
        first, *rest = _SINGLE.split(text)
    else:
        first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


_LOADED: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    if path not in _LOADED:
        _LOADED[path] = PrefixEncoder(path)
    return _LOADED[path]


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's rows in slices of at most HELD bytes of text, or of one row."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")]
    begin = total = 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > HELD:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += size
    if batch.num_rows > begin:
        yield batch.slice(begin)


def encode_texts(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """All columns of docs but those named here, and ids (array of int, if asked for), n_tokens, ids_sha256, decoded_sha256.

    docs has text; a null text counts as empty and has no tokens. Whole texts are encoded, whatever their length. Special
    tokens' strings in a text are those tokens, as the tokenizers library has it. decoded_sha256 is of what the ids
    decode to (their bytes, as UTF-8 with replacement of what is invalid). Rows repeat as they do in docs; an empty table
    gives an empty result. path is the tokenizer's file, which every executor must have.
    """
    new = ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = docs.drop(*new)
    fields = "".join(f", `{c.name}` {c.dataType.simpleString()}" for c in docs.schema)[2:]
    schema = fields + (", ids array<int>" if with_ids else "") + ", n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in _bounded(batch):
                n, ids, hashed, decoded = [], [], [], []
                for text in part.column("text"):
                    joined, count, raw = coder.encode(text.as_py() or "")
                    n.append(count)
                    hashed.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                    if with_ids:
                        ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
                out = dict(zip(part.schema.names, part.columns, strict=True))
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate(ids))
                yield pa.RecordBatch.from_pydict(out | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(hashed, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return docs.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (ids: array of int; other columns pass) with text decoded from the ids; null ids give a null text."""
    rest = encoded.drop("text")
    fields = "".join(f", `{c.name}` {c.dataType.simpleString()}" for c in rest.schema)[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path).bytes_of
        for batch in batches:
            texts = [None if x is None else b"".join(map(known.__getitem__, x)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(texts, pa.string())})

    return rest.mapInArrow(run, fields + ", text string")
