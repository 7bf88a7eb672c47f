"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import bpe
from .batches import map_batches, whole_texts


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each whole text.

    Once for each Python worker exact merging proves which vocabulary strings encode alone as one
    token; pre-tokens among them count as one by a lookup, only the rest are merged. No shuffle.

    A null text counts as empty (0 bytes, 0 tokens). Special strings inside a text are one token, as
    the tokenizer's default has it. A null doc_id and repeated rows come through as they are; columns
    other than doc_id and text are ignored; an empty table gives an empty result. Texts of any length
    are counted whole.

    tokenizer_path must be readable on every executor (it is a file of an installed package).
    """

    def count(ids, texts):
        texts = [t or "" for t in texts]
        n = bpe.token_counts(tokenizer_path).of(texts)
        return ids, [len(t.encode()) for t in texts], n, [x > limit for x in n]

    return map_batches(whole_texts(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
