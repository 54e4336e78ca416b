"""Token counts by a public tokenizer; its file is a parameter and is read on the executors."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
import xxhash
from pyspark.sql import DataFrame, functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this kind cut text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens, cluster)`` of ``(doc_id, text, source)``.

    ``source`` is trimmed and in lower case. ``cluster`` is the same for equal texts but for
    white space. Null and empty texts have 0 tokens. Rows with a null doc_id are left out.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            texts = [t or "" for t in batch.text]
            yield pd.DataFrame({
                "doc_id": batch.doc_id, "source": batch.source, "n_tokens": [len(encode(t)) for t in texts],
                "cluster": [xxhash.xxh3_64_intdigest(" ".join(t.split())) - (1 << 63) for t in texts],
            })

    picked = docs.filter("doc_id is not null").select("doc_id", "text", F.lower(F.trim("source")).alias("source"))
    return picked.mapInPandas(rows, "doc_id long, source string, n_tokens long, cluster long")
