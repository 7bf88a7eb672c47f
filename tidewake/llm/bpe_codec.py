"""BPE encoding and decoding by speculate and verify."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .batches import map_batches, whole_texts


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of each whole text.

    Greedy longest match proposes the tokens of each pre-token, a vectorised test checks every pair of
    neighbours, and only words with a failing pair are merged exactly. No shuffle.

    A null text is encoded as empty (no ids, decoded ''). Special strings become their token, as the
    tokenizer's default has it, and are decoded, not skipped. A null doc_id and repeated rows come
    through as they are; other columns are ignored; an empty table gives an empty result.
    """

    def encode(ids, texts):
        codec = bpe.codec(tokenizer_path)
        tokens = codec.encode([t or "" for t in texts])
        return ids, tokens, list(map(codec.decode, tokens))

    return map_batches(whole_texts(docs), encode, "doc_id long, ids array<int>, decoded string")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of rows with doc_id, ids (null ids: a null text)."""

    def decode(doc_ids, ids):
        codec = bpe.codec(tokenizer_path)
        return doc_ids, [None if x is None else codec.decode(x) for x in ids]

    return map_batches(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), decode, "doc_id long, text string")


def encoding_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """encode_documents reduced, inside the same pass, to doc_id, n_tokens, ids_sha256, decoded_sha256:
    ids and texts do not travel back to the JVM. Null and empty texts and repeated rows as there."""

    def digest(doc_ids, texts):
        codec = bpe.codec(tokenizer_path)
        tokens = codec.encode([t or "" for t in texts])
        name = codec.decimal.__getitem__
        hashed = [hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest() for ids in tokens]
        decoded = [hashlib.sha256(codec.decode(ids).encode()).hexdigest() for ids in tokens]
        return doc_ids, list(map(len, tokens)), hashed, decoded

    return map_batches(whole_texts(docs), digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
