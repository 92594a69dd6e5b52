"""What the parts that a caller can replace have to look like."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame


class Retriever(Protocol):
    """(corpus, queries, k) to hits: qid, id, text, score, source, pos, rank."""

    def __call__(self, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


class Reranker(Protocol):
    """(hits, queries, k) to hits in a new order."""

    def __call__(self, hits: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


class Embedder(Protocol):
    """A column of texts to a column of vectors."""

    def __call__(self, text: Column) -> Column: ...


class TextModel(Protocol):
    """A column of prompts to a column of replies; null where the model fails."""

    def __call__(self, prompt: Column) -> Column: ...


class AnswerModel(Protocol):
    """Columns of a query and its chunks to struct(answer, reasoning, sources, confidence)."""

    def __call__(self, query: Column, chunks: Column) -> Column: ...


class SentenceModel(Protocol):
    """A model of a worker: texts to vectors."""

    def encode(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...
