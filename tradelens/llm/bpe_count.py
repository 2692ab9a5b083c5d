"""Token counts by byte-pair merging with a heap and a linked list, without making any ids.

A piece's symbols are a linked list. A heap holds the adjacent pairs that can be merged; the best (lowest rank, then
leftmost) is merged again and again. The count is the symbols at the start minus the merges, where a symbol that the
vocabulary lacks counts as its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

#: Units kept with their counts in each worker; beyond that, units are counted anew each time.
CACHE = 600_000
MARK = "▁"
_UNIT = re.compile(" +[^ ]*")


class PieceCounter:
    """Counts as the sentencepiece model at path does, which must be BPE with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("  ﬁ Å\t é ") != f"{MARK * 3}ﬁ{MARK}Å\t{MARK}é{MARK}":
            raise ValueError("only models with a dummy prefix and no normalisation are supported")
        n = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(n)) or not any(sp.is_byte(i) for i in range(n)):
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        pieces = {sp.id_to_piece(i).replace(MARK, " "): sp.get_score(i) for i in plain}
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("only models whose pieces have their spaces in front are supported")
        # The pieces' scores in order give the ranks; equal scores have one rank.
        order = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in pieces.items()}
        self.units: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """Tokens of a unit: a run of spaces and what follows up to the next space."""
        rank = self.rank
        symbols: list[str | None] = list(text)
        n = len(symbols)
        total = sum([1 if c in rank else len(c.encode()) for c in symbols])
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, len(p)) for i in range(n - 1) if (r := rank.get(p := symbols[i] + symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i, size = heappop(heap)
            a = symbols[i]
            if a is None or (j := after[i]) < 0:
                continue
            pair = a + symbols[j]
            if len(pair) != size:  # one of the two has been merged meanwhile
                continue
            total -= 1
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(p := pair + symbols[k])) is not None:
                    heappush(heap, (r, i, len(p)))
            if (h := before[i]) >= 0 and (r := rank.get(p := symbols[h] + pair)) is not None:
                heappush(heap, (r, h, len(p)))
        return total

    def unit(self, text: str) -> int:
        if (known := self.units.get(text)) is None:
            known = self.merged(text)
            if len(self.units) < CACHE and len(text) < 64:
                self.units[text] = known
        return known

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        get, unit = self.units.get, self.unit
        if "  " in text or text[0] == " " or text[-1] == " ":
            found = _UNIT.findall(" " + text)
        else:
            found = [" " + x for x in text.split(" ")]
        return sum([known if (known := get(x)) is not None else unit(x) for x in found])


_LOADED: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) for every row of docs (doc_id, text).

    A null text counts as empty and has no tokens. Whole texts are counted, whatever their length. Rows repeat as they do
    in docs, more columns are left out, an empty table gives an empty result. path is the model's file, which every
    executor must have.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            n = [of.count(t) for t in texts]
            out = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([k > limit for k in n], pa.bool_())}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
