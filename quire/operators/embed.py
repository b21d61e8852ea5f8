"""The embedding job: find chunks without a vector, embed them, append."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.extract import chunk_paragraphs, verse_chunks
from quire.operators.upsert import insert_if_absent
from quire.schemas import EMBEDDED_SOURCES

CHUNK_KEYS = ["source_type", "source_id", "layer"]
DOC_KEYS = ["source_type", "source_id"]
EmbedFn = Callable[[list[str]], list]

_EMBEDDED = T.StructType(
    [
        T.StructField("source_type", T.StringType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("layer", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("model", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

_WORD = re.compile(r"[^\W_]+")


def _slot(token: str, dim: int) -> tuple[int, int]:
    digest = hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:7], 16) % dim, 1 if int(digest[7], 16) < 8 else -1


def hashing_embedder(dim: int = 64) -> EmbedFn:
    """Offline stand-in for an embedding model: signed feature hashing of the words."""

    def embed(texts: list[str]) -> list:
        words = [_WORD.findall(text.lower()) for text in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        codes, distinct = pd.factorize(np.array([t for w in words for t in w], dtype=object))
        slots = np.array([_slot(t, dim) for t in distinct], dtype=np.int64).reshape(-1, 2)[codes]
        sums = np.bincount(owner * dim + slots[:, 0], weights=slots[:, 1], minlength=len(texts) * dim)
        sums = sums.reshape(len(texts), dim)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return list((sums / np.where(norms == 0, 1, norms)).astype(np.float32))

    return embed


def all_chunks(tables: dict[str, DataFrame], sources: tuple[str, ...] = EMBEDDED_SOURCES) -> DataFrame:
    """Every chunk that should have a vector: verses whole, other sources by paragraph."""
    parts = []
    for name in sources:
        if name == "scriptures":
            parts.append(verse_chunks(tables[name]))
        else:
            rows = tables[name].filter(F.length("content") > 0)
            parts.append(
                chunk_paragraphs(
                    rows.select(F.lit(name).alias("source_type"), F.col("id").alias("source_id"), "content")
                )
            )
    chunks = parts[0]
    for part in parts[1:]:
        chunks = chunks.unionByName(part)
    return chunks


def pending_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks whose (source_type, source_id, layer) has no stored vector yet."""
    return chunks.join(embeddings.select(*CHUNK_KEYS), CHUNK_KEYS, "left_anti")


def document_digests(tables: dict[str, DataFrame], sources: tuple[str, ...] = EMBEDDED_SOURCES) -> DataFrame:
    """(source_type, source_id, digest) of every document with text to embed; nothing is chunked."""
    parts = []
    for name in sources:
        text = F.col("text" if name == "scriptures" else "content")
        rows = tables[name].filter(F.length(text) > 0)
        parts.append(rows.select(F.lit(name).alias("source_type"), F.col("id").alias("source_id"), F.md5(text).alias("digest")))
    return reduce(DataFrame.unionByName, parts)


def document_changes(digests: DataFrame, known: DataFrame, model: str) -> DataFrame:
    """(source_type, source_id, digest, status) of documents to embed again.

    ``known`` is (source_type, source_id, digest, model) of the documents embedded before. A document
    is ``new``, ``changed`` (its text, or the model) or ``vanished``; unchanged ones drop out.
    """
    before = known.select(*DOC_KEYS, F.col("digest").alias("_digest"), F.col("model").alias("_model"))
    status = (
        F.when(F.col("_digest").isNull(), "new")
        .when(F.col("digest").isNull(), "vanished")
        .when((F.col("digest") != F.col("_digest")) | ~F.col("_model").eqNullSafe(F.lit(model)), "changed")
    )
    both = digests.join(before, DOC_KEYS, "full_outer").withColumn("status", status)
    return both.filter(F.col("status").isNotNull()).select(*DOC_KEYS, "digest", "status")


def reusable(chunks: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Chunks whose place, text and model have a stored vector, with it. Repeated vectors count once."""
    same = [*CHUNK_KEYS, "content"]
    vectors = stored.filter(F.col("model") == model).select(*same, "embedding", "model").dropDuplicates(same)
    return chunks.select(same).join(vectors, same)


def _embed_batch(texts: list[str], embed_fn: EmbedFn, dim: int | None, zero: bool = False) -> tuple[list, list]:
    """Vectors and error messages; a batch that fails is retried text by text. With ``zero`` a zero vector is no error."""
    try:
        vectors = list(embed_fn(texts))
        if len(vectors) != len(texts):
            raise ValueError("the embedder returned a different number of vectors")
        errors: list = [None] * len(texts)
    except Exception as failure:
        if len(texts) == 1:
            return [None], [f"{type(failure).__name__}: {failure}"]
        pairs = [_embed_batch([text], embed_fn, dim, zero) for text in texts]
        return [v[0] for v, _ in pairs], [e[0] for _, e in pairs]
    for i, vector in enumerate(vectors):
        if vector is None or len(vector) == 0:
            vectors[i], errors[i] = None, "no vector"
        elif dim is not None and len(vector) != dim:
            vectors[i], errors[i] = None, f"dimension {len(vector)} instead of {dim}"
        elif not zero and not np.any(vector):
            vectors[i], errors[i] = None, "zero vector"
    return vectors, errors


def embed_chunks(
    chunks: DataFrame, embed_fn: EmbedFn, model: str, dim: int | None = None, batch: int = 256, zero: bool = False
) -> DataFrame:
    """Add ``embedding``, ``model`` and ``error``; a failed chunk has an error and no vector.

    A zero vector, which matches nothing, counts as failed unless ``zero`` is set.

    ``embed_fn`` takes a list of texts and runs inside the tasks, in small batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors, errors = [], []
            texts = frame["content"].tolist()
            for start in range(0, len(texts), batch):
                v, e = _embed_batch(texts[start : start + batch], embed_fn, dim, zero)
                vectors += v
                errors += e
            yield frame.assign(embedding=vectors, model=model, error=errors)

    return chunks.select(*CHUNK_KEYS, "content").mapInPandas(run, _EMBEDDED)


def embedded(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNull()).drop("error")


def embedding_failures(rows: DataFrame) -> DataFrame:
    """Quarantine rows of the chunks that could not be embedded; they stay pending."""
    return rows.filter(F.col("error").isNotNull()).drop("embedding")


def new_embeddings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: a stored vector is never replaced."""
    return insert_if_absent(existing, incoming, CHUNK_KEYS, "content")


def embed_queries(queries: DataFrame, embed_fn: EmbedFn) -> DataFrame:
    """Add ``vector`` to (query_id, query, ...); null where the embedder fails."""
    schema = T.StructType(
        [*queries.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(vector=_embed_batch(frame["query"].tolist(), embed_fn, None)[0])

    return queries.mapInPandas(run, schema)


