"""The two BPE operators against the libraries whose files they read."""

import hashlib
import random

import pytest

from tradelens.llm.bpe_codec import decode_ids, encode_texts
from tradelens.llm.bpe_count import count_tokens

tokenizers_at = pytest.importorskip("public_tokenizers")


def texts():
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "don't", "é", "界", "🙂", "123", "4", "!!", "<|endoftext|>", "<s>", "▁", " ", " ", "ﬁ", "aaaaaaa", "Über", "\x00", "\r\n"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return [None, "", " ", "<|endoftext|>", "x" * 30_000, "ab " * 20_000, *made]


def frame(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts())], "doc_id long, text string, n_tokens long")


def test_codec(spark):
    from tokenizers import Tokenizer

    path = tokenizers_at.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoded = encode_texts(frame(spark), path)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = {r.doc_id: r for r in encoded.collect()}
    back = {r.doc_id: r.text for r in decode_ids(encoded, path).collect()}
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (rows[i]["ids"], rows[i]["n_tokens"]) == (ids, len(ids)), repr(t)
        assert (rows[i]["ids_sha256"], rows[i]["decoded_sha256"], back[i]) == (sha(",".join(map(str, ids))), sha(decoded), decoded)
    assert encode_texts(frame(spark).limit(0), path).count() == 0


def test_counts(spark):
    import sentencepiece

    path = tokenizers_at.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r.doc_id: r for r in count_tokens(frame(spark), path).collect()}
    for i, t in enumerate(texts()):
        n = len(library.encode(t or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 4096), repr(t)
    assert count_tokens(frame(spark).limit(0), path).count() == 0
