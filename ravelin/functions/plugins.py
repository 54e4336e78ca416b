"""Interfaces for models, with deterministic defaults that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from ravelin.functions.text import bm25_tokens


@dataclass(frozen=True)
class EngineConfig:
    """All settings, passed explicitly."""

    segment_tokens: int = 4000
    parent_tokens: int = 2500
    chunk_tokens: int = 400
    overlap_sentences: int = 2
    dim: int = 64
    top_k_dense: int = 20
    top_k_bm25: int = 20
    top_k_rrf: int = 15
    top_k_rerank: int = 5
    max_contexts: int = 5
    rrf_k: int = 60
    max_context_tokens: int = 32000
    rerank_enabled: bool = True


def hash_encoder(dim: int):
    """Text to a unit vector: hashed words with signs. Equal texts have equal vectors; an Arrow UDF, one call a batch."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            words = [(text or "").lower().split() for text in texts]
            rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
            vectors = np.zeros((len(words), dim), np.float32)
            if len(rows):
                hashes = pd.util.hash_array(np.array([w for part in words for w in part], object))
                np.add.at(vectors, (rows, (hashes % np.uint64(dim)).astype(int)), np.where(hashes >> np.uint64(40) & np.uint64(1), 1.0, -1.0).astype(np.float32))
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list(vectors / np.where(norms > 0, norms, 1)))

    return encode


def overlap_reranker(query: Column, chunk: Column) -> Column:
    """Share of the query's words that the chunk has."""
    words = F.array_distinct(bm25_tokens(query))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, F.array_distinct(bm25_tokens(chunk)))) / F.size(words))


class Reranker(Protocol):
    """Columns in, a column out: the score of a chunk for a query."""

    def __call__(self, query: Column, chunk: Column) -> Column: ...


class Ocr(Protocol):
    """Reads the text of a page's picture."""

    def read(self, picture: bytes) -> str: ...


def ocr_parser(pictures: Callable[[bytes], list[bytes]], ocr: Ocr) -> Callable[[bytes], dict]:
    """A parser for ``sources.files.parse`` that renders a file to pictures of its pages and reads these."""
    def parse(content: bytes) -> dict:
        pages = pictures(content)
        return {"full_text": "\n".join(ocr.read(p) for p in pages), "structure_tier": 3, "title_source": "none", "page_count": len(pages), "ocr_used": True, "parser_used": "ocr"}

    return parse


class Rewriter(Protocol):
    def rewrite(self, query: str) -> str: ...


class NoRewriter:
    """Gives the query alone."""

    def rewrite(self, query: str) -> str:
        return "[]"


class LanguageModel(Protocol):
    name: str

    def answer(self, system: str, prompt: str) -> str: ...


class EchoModel:
    """Answers with the first line of the context, for tests."""

    name = "echo"

    def answer(self, system: str, prompt: str) -> str:
        blocks = system.split("\n\n", 1)[-1]
        return next((line for line in blocks.splitlines() if line.strip() and not line.startswith("[")), "")


RULES = "Answer from the documents below only. Name the document you rely on. If they do not hold the answer, say so."
REFUSAL = "No document of this knowledge base answers the question."


def prompt_for(query: str, blocks: list[str]) -> tuple[str, str]:
    return f"{RULES}\n\n{''.join(blocks)}", f"User Query: {query}"


def generate(query: str, blocks: list[str], sources: list[tuple[str, str]], models: list[LanguageModel]) -> dict:
    """The answer with its sources; models are tried in turn, without contexts there is a refusal."""
    if not blocks:
        return {"answer": REFUSAL, "sources": [], "model_used": "none"}
    system, prompt = prompt_for(query, blocks)
    for model in models:
        try:
            return {"answer": model.answer(system, prompt), "sources": sources, "model_used": model.name}
        except Exception:  # noqa: BLE001 - the next model is asked
            continue
    return {"answer": REFUSAL, "sources": sources, "model_used": "none"}
