"""Text to vectors by a pluggable provider, and exact nearest vectors by Euclidean distance."""

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 384
#: Tokens embedded at once; longer texts are embedded in parts whose mean counts.
CHUNK = 256


class EmbeddingProvider(Protocol):
    """Token vectors of one chunk of tokens: an array (tokens, dimension)."""

    dimension: int

    def token_vectors(self, tokens: Sequence[str]) -> np.ndarray: ...


def tokenize(text: str) -> list[str]:
    """Tokens as text between single blanks."""
    return text.split(" ")


class HashingProvider:
    """Deterministic vectors without a model: each word and its letter triples fall on coordinates with a sign."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self._known: dict[str, np.ndarray] = {}

    def _word(self, token: str) -> np.ndarray:
        got = self._known.get(token)
        if got is None:
            got = np.zeros(self.dimension)
            word = re.sub(r"\W+", "", token.lower())
            padded = f"^{word}$"
            for piece in {word, *(padded[i : i + 3] for i in range(len(padded) - 2))} - {""}:
                h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "big")
                got[h % self.dimension] += 1.0 if h >> 63 else -1.0
            if len(self._known) < 100_000:
                self._known[token] = got
        return got

    def token_vectors(self, tokens: Sequence[str]) -> np.ndarray:
        return np.array([self._word(t) for t in tokens]) if tokens else np.zeros((0, self.dimension))


def mean_pool(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the vectors whose mask is set (by weight); the divisor is at least 1e-9."""
    return (vectors * mask[:, None]).sum(axis=0) / max(float(mask.sum()), 1e-9)


def normalize(v: np.ndarray) -> np.ndarray:
    """v at length one; a zero vector as it is."""
    n = float(np.sqrt((v * v).sum()))
    return v / n if n > 0 else v


def embed_text(text: str, provider: EmbeddingProvider, chunk: int = CHUNK) -> np.ndarray:
    """Chunks are pooled one by one; their mean, at length one, is the text's vector."""
    tokens = tokenize(text)
    parts = [tokens[i : i + chunk] for i in range(0, len(tokens), chunk)]
    pooled = [mean_pool(provider.token_vectors(p), np.ones(len(p))) for p in parts]
    return normalize(np.mean(pooled, axis=0)).astype(np.float32)


def embed(texts: DataFrame, text: str = "Text", provider: EmbeddingProvider | None = None, truncate: bool = False) -> DataFrame:
    """`texts` with Embedding, in Arrow batches; null for null and empty texts. `truncate`: only the first chunk counts."""
    provider = provider or HashingProvider()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            one = lambda t: embed_text(" ".join(tokenize(t)[:CHUNK]) if truncate else t, provider)
            yield pd.Series([one(t) if t else None for t in s])

    return texts.withColumn("Embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def l2_distance(column: Column, query: Sequence[float]) -> Column:
    """Euclidean distance to a vector, in double precision."""
    q = F.array(*[F.lit(float(x)) for x in query])
    square = F.zip_with(column, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def nearest_l2(vectors: DataFrame, query: Sequence[float], k: int = 1, ident: str = "EntityId", column: str = "Embedding") -> DataFrame:
    """ident, distance of the k nearest vectors of the query's length, by distance and ident. Others are left out.

    Only (ident, distance) of each task's best k travel: a limit below the sort.
    """
    if k < 1:
        return vectors.select(ident, F.lit(0.0).alias("distance")).limit(0)
    same = vectors.where(F.size(column) == len(query))
    return same.select(ident, l2_distance(F.col(column), query).alias("distance")).where("distance IS NOT NULL AND NOT isnan(distance)").orderBy("distance", ident).limit(k)


def put_vectors(index: DataFrame, new: DataFrame, ident: str = "EntityId", column: str = "Embedding", dimension: int = DIMENSION) -> DataFrame:
    """The index with vectors added, those of the same ident replaced. A vector of another length raises when read."""
    checked = new.withColumn(column, F.when(F.size(column) == dimension, F.col(column)).otherwise(F.raise_error(F.lit(f"a vector must have {dimension} entries")).cast("array<float>")))
    return index.join(new.select(ident), ident, "left_anti").unionByName(checked)


def remove_vectors(index: DataFrame, idents: DataFrame, ident: str = "EntityId") -> DataFrame:
    """The index without the given idents; unknown ones change nothing."""
    return index.join(idents.select(ident), ident, "left_anti")


def search(entities: DataFrame, key: str, vectors: DataFrame, query: Sequence[float], k: int = 1, compat: bool = False) -> DataFrame:
    """The entities of the k nearest vectors with their distance, nearest first; with `compat` Score 1.0 in place of it."""
    hits = F.broadcast(nearest_l2(vectors, query, k))  # k rows
    found = entities.join(hits, F.col(f"`{key}`").cast("string") == hits["EntityId"]).drop(hits["EntityId"])
    if compat:
        return found.drop("distance").withColumn("Score", F.lit(1.0).cast("float"))
    return found.orderBy("distance", key)
