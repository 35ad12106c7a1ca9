"""Extension points: embedding, entity recognition and reranking by functions the user supplies.

Each takes plain Python callables over lists and runs them batch by batch; the stand-ins here are for tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Spans = list[tuple[str, str, int, int, float]]


def embed(rows: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(doi, embedding) of rows (doi, text). An empty text is an error, as is a wrong number of vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.text.tolist()
            if any(not (t or "").strip() for t in texts):
                raise ValueError("cannot embed an empty text")
            vectors = embed_fn(texts) if texts else []
            if len(vectors) != len(texts):
                raise ValueError("the embedder returned another number of vectors")
            yield pd.DataFrame({"doi": b.doi, "embedding": [np.asarray(v, dtype="float32") for v in vectors]})

    return rows.select("doi", "text").mapInPandas(run, "doi string, embedding array<float>")


def hashing_embedder(dim: int = 32) -> Callable[[list[str]], list[list[float]]]:
    """Signed counts of hashed words, unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()

    return run


def recognise(rows: DataFrame, ner_fn: Callable[[list[str]], list[Spans]]) -> DataFrame:
    """(doi, text, label, start, end, confidence) of the spans found in rows (doi, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = ner_fn([t or "" for t in b.text])
            rows = [(doi, *span) for doi, spans in zip(b.doi, found, strict=True) for span in spans]
            yield pd.DataFrame(rows, columns=["doi", "text", "label", "start", "end", "confidence"])

    return rows.select("doi", "text").mapInPandas(run, "doi string, text string, label string, start int, end int, confidence double")


def word_recogniser(words: dict[str, str]) -> Callable[[list[str]], list[Spans]]:
    """Marks given lower-case words with their labels."""
    import re

    pattern = re.compile(r"\w+")

    def run(texts: list[str]) -> list[Spans]:
        return [[(m.group(), words[m.group().lower()], m.start(), m.end(), 0.9) for m in pattern.finditer(t) if m.group().lower() in words] for t in texts]

    return run


def reranker(score_fn: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A column function (query, document) -> score for ``vectors.two_stage``."""

    @F.pandas_udf("double")
    def score(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(score_fn(q.fillna("").tolist(), d.fillna("").tolist()), dtype=float)

    return score
