"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's features are its hashed byte trigrams, damped by log and weighted by inverse
document frequency; a truncated SVD of a bounded labelled sample (``SAMPLE_ROWS``
documents, ``SAMPLE_BYTES`` of features) gives the latent directions. The labelled vectors
are broadcast (a fixed bound: ``SAMPLE_ROWS`` x ``RANK`` numbers). Every document's exact
cosines to all of them are one blocked matrix product, and its nearest ``NEIGHBOURS`` vote,
weighted by similarity.

Cases: an empty or null text has the zero vector and gets the labels' mean, as does a text
without similarity to any labelled one; without usable labels every score is 0.5; null ids
and repeated rows are scored like any row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.llm.common import pieces, raw, sliced
from rosterproof.llm.sample import labelled_features

SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 128 << 20
BUCKETS = 1 << 12
RANK = 64
NEIGHBOURS = 25
#: Similarities are sharpened before the vote, so that near neighbours decide.
SHARPNESS = 4
BLOCK = 256


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed trigram counts, a row per text. Bytes beyond a block of text add up."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, j in pieces(texts, 1 << 21):
        cut = [(k, t[a : a + (1 << 22) + 2]) for k, t in enumerate(texts[i:j], i) for a in range(0, max(1, len(t) - 2), 1 << 22)]
        for k, part in cut:
            if len(part) >= 3:
                d = np.frombuffer(part, np.uint8).astype(np.uint32)
                h = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA6B)) ^ (d[2:] * np.uint32(0xC2B2AE35))
                out[k] += np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=BUCKETS)
    return out


def encode(text: str) -> bytes:
    c = counts([text.encode()])[0]
    at = np.flatnonzero(c)
    return at.astype(np.uint16).tobytes() + c[at].tobytes()


def decode(x: bytes) -> np.ndarray:
    n = len(x) // 6
    out = np.zeros(BUCKETS, np.float32)
    out[np.frombuffer(x[: 2 * n], np.uint16)] = np.frombuffer(x[2 * n :], np.float32)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


class Model:
    def __init__(self, idf=None, directions=None, vectors=None, labels=None):
        self.idf, self.directions, self.vectors, self.labels = idf, directions, vectors, labels

    def latent(self, c: np.ndarray) -> np.ndarray:
        return unit(unit(np.log1p(c) * self.idf) @ self.directions)

    def score(self, c: np.ndarray) -> np.ndarray:
        """Share of the similarity-weighted votes for label 1."""
        if self.labels is None:
            return np.full(len(c), 0.5)
        out = np.empty(len(c))
        mean = self.labels.mean()
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(c), BLOCK):
            cosine = self.latent(c[a : a + BLOCK]) @ self.vectors.T
            top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            near = np.maximum(np.take_along_axis(cosine, top, 1), 0).astype(float) ** SHARPNESS
            weight = near.sum(1)
            votes = (near * self.labels[top]).sum(1)
            out[a : a + BLOCK] = np.where(weight > 1e-9, votes / np.maximum(weight, 1e-9), mean)
        return np.clip(out, 0, 1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each trigram bucket, over all of ``docs``.

    A task adds up what it reads; the driver gets one number a bucket.
    """
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        found = np.zeros(BUCKETS + 1, np.int64)
        for b in sliced(batches):
            texts = raw(b.column("text"))
            for a in range(0, len(texts), BLOCK):
                found[:-1] += (counts(texts[a : a + BLOCK]) > 0).sum(0)
            found[-1] += len(texts)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], schema=schema)

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1)
    for r in rows.collect():
        out[r.bucket] = r.n
    return int(out[-1]), out[:-1]


def fit(sample, frequencies: tuple[int, np.ndarray]) -> Model:
    """Directions and labelled vectors of (features, label) pairs.

    ``frequencies``: of all documents, as ``document_frequencies`` gives them.
    """
    rows, labels = [], []
    for x, y in sample:
        rows.append(x)
        labels.append(y)
    if not labels:
        return Model()
    n = len(labels)
    of_all, df = frequencies
    idf = np.log((of_all + 1) / (df + 1)).astype(np.float32)
    # The Gram matrix of the features is small; its main eigenvectors are the directions.
    gram = np.zeros((BUCKETS, BUCKETS), np.float32)
    for a in range(0, n, 512):
        m = unit(np.log1p(np.stack([decode(x) for x in rows[a : a + 512]])) * idf)
        gram += m.T @ m
    rng = np.random.default_rng(7)
    basis = rng.standard_normal((BUCKETS, RANK + 16)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(gram @ basis)
    small = basis.T @ gram @ basis
    _, turn = np.linalg.eigh(small)
    directions = (basis @ turn[:, ::-1][:, :RANK]).astype(np.float32)
    model = Model(idf, directions, None, np.array(labels, float))
    model.vectors = np.concatenate(
        [model.latent(np.stack([decode(x) for x in rows[a : a + 512]])) for a in range(0, n, 512)]
    )
    return model


def fit_documents(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    sample = labelled_features(docs, labels, "quality", train, SAMPLE_ROWS, SAMPLE_BYTES, encode)
    return fit(sample, document_frequencies(docs))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches):
            texts = raw(b.column("text"))
            got = [held.value.score(counts(texts[a : a + BLOCK])) for a in range(0, len(texts), BLOCK)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "score": pa.array(np.concatenate(got) if got else [], pa.float64()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double")
