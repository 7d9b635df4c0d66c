"""Toxicity by multiple-instance learning.

Only whole documents carry labels. A sentence is a bag of words with probability
p = sigmoid(w . x + b), and a document is toxic if any sentence is, or by a leak L common
to all (noisy-or): P = 1 - (1 - L) * prod(1 - p). The weights are fitted by gradient ascent
on the document labels of a bounded sample (``SAMPLE_ROWS`` documents, ``SAMPLE_BYTES`` of
features); every document is then scored and its offending sentences are located.

Cases: an empty or null text has no sentence and scores the leak; null ids and repeated
rows are scored like any row; without usable labels every score is 0; a text of any length
is read in parts cut at sentence ends.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.llm.common import sliced
from rosterproof.llm.sample import labelled_features

SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 32 << 20
#: Words are known by their CRC-32; this value stands for a sentence end.
END = 0xFFFFFFFF
#: A word must occur in this many documents of the sample to get a weight.
MIN_DOCS = 5
PART = 1 << 20
#: A document of the sample of this Jaccard similarity to another is its copy.
COPY = 0.8
_ODD = [np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % (1 << 64) | 1) for k in range(16)]
#: A sentence at or above this probability is reported as offending.
OFFENDING = 0.5

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_END = re.compile(r"[.!?\n]")


class _Words(dict):
    """Feature of a token. Bounded: emptied when it gets large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        f = END if token in ".!?\n" else min(zlib.crc32(token.encode()), END - 1)
        self[token] = f
        return f


def text_parts(text: str, size: int = PART):
    """(start, part) of a text, cut behind the first sentence end from ``size`` on."""
    at = 0
    while len(text) - at > size:
        m = _END.search(text, at + size)
        if not m:
            break
        yield at, text[at : m.end()]
        at = m.end()
    if at < len(text):
        yield at, text[at:]


def features(text: str, words: _Words) -> np.ndarray:
    """Features of a text's words and sentence ends, in order."""
    return np.array([words[t] for t in _TOKEN.findall(text.lower())], np.uint32)


def encode(text: str) -> bytes:
    words = _Words()
    return b"".join(features(p, words).tobytes() for _, p in text_parts(text))


class Model:
    """Words with a weight, a sentence's bias, and the leak of a document."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float, leak: float):
        order = np.argsort(words)
        self.words, self.weights = words[order].astype(np.uint32), weights[order].astype(float)
        self.bias, self.leak = bias, leak

    def weigh(self, f: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(f))
        at = np.minimum(np.searchsorted(self.words, f), len(self.words) - 1)
        return np.where(self.words[at] == f, self.weights[at], 0.0)

    def sentences(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each sentence that has a word, and its number among all."""
        end = f == END
        number = np.cumsum(end)
        there = np.flatnonzero(np.bincount(number[~end]))
        z = np.bincount(number, np.where(end, 0.0, self.weigh(f)))[there] + self.bias
        return np.where(z < -700, 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 40)))), there


def _shingles(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of a document's three-word shingles, of the whole if it is shorter."""
    if len(words) < 3:
        return np.unique(words + np.uint64(len(words) << 32))
    shingles = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1] * np.uint64(
        0xC2B2AE3D27D4EB4F
    )
    shingles = (shingles ^ (shingles >> np.uint64(29))) + words[2:] * np.uint64(0x165667B19E3779F9)
    shingles ^= shingles >> np.uint64(32)
    return np.unique(shingles)


class _Kept:
    """Documents without near copies: a new one is a copy of one and the same kept document.

    Candidates share at least half of the min-hashes with it (at Jaccard similarity 0.8 all
    but 1 in 600 do); the similarity itself decides.
    """

    def __init__(self):
        self.sets: list[np.ndarray] = []
        self.marks: dict[tuple[int, int], list[int]] = defaultdict(list)

    def add(self, words: np.ndarray) -> bool:
        """Keep a document unless it is a copy; whether it was kept."""
        x = _shingles(words)
        marks = [(k, int((x * m).min())) for k, m in enumerate(_ODD)] if len(x) else [(-1, 0)]
        shared = Counter(i for m in marks for i in self.marks.get(m, ()))
        for i, n in shared.items():
            if 2 * n >= len(marks):
                both = len(np.intersect1d(x, self.sets[i], assume_unique=True))
                if both >= COPY * (len(x) + len(self.sets[i]) - both):
                    return False
        for m in marks:
            self.marks[m].append(len(self.sets))
        self.sets.append(x)
        return True


class _Sample:
    """A sample's words as flat arrays, the words numbered by ``words``."""

    def __init__(self, sample):
        # Copies would count a label, right or wrong, as often as there are copies.
        docs, labels, kept = [], [], _Kept()
        for x, y in sample:
            f = np.frombuffer(x, np.uint32)
            if kept.add(f[f != END].astype(np.uint64)):
                docs.append(f)
                labels.append(y)
        self.y = np.array(labels, float)
        if not docs:
            return
        flat = np.concatenate(docs)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        number = np.cumsum(flat == END) + doc  # differs between documents
        word = flat != END
        doc, number = doc[word], number[word]
        self.words, self.flat = np.unique(flat[word], return_inverse=True)
        pair = np.unique(doc.astype(np.int64) * len(self.words) + self.flat)
        at, of = pair % max(1, len(self.words)), pair // max(1, len(self.words))
        self.df = np.bincount(at, minlength=len(self.words))
        self.with1 = np.bincount(at, self.y[of], len(self.words))
        _, first, self.sentence = np.unique(number, return_index=True, return_inverse=True)
        self.doc = doc[first]


def fit(sample, steps: int = 200, rate: float = 0.1, evidence: float = 0.07, sure: float = 5.0) -> Model:
    """Noisy-or maximum likelihood on (features, label) pairs, by Adam over the sample.

    A document has a leak besides its sentences: the share labelled 1 for no reason in
    the text, which would else fall to long documents. First a weight is penalised by its
    size times ``evidence`` * sqrt(sample) documents, so that only words for which more
    documents speak than chance would have keep one. Then the words of weight 1 or more
    are fitted again without penalty, and with them those that another word of the same
    documents had stood in for: whose documents are labelled 1 more often than usual by
    ``sure`` standard deviations.
    """
    s = _Sample(sample)
    y = s.y
    none = np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model(none, none, -np.inf, float(len(y) > 0 and y.max() == 1))
    share = y.mean()
    enough = np.flatnonzero(s.df >= MIN_DOCS)
    odds = np.log((s.with1 + share) / (s.df - s.with1 + 1 - share)) - np.log(share / (1 - share))
    start = np.clip(odds, -2, 4)
    spread = (s.with1 - s.df * share) / np.sqrt(s.df * share * (1 - share))
    params = _ascend(
        s, enough, np.r_[start[enough], -7.0, -3.0], steps, rate, evidence * np.sqrt(len(y))
    )
    kept = (np.abs(params[:-2]) >= 1) | (spread[enough] >= sure)
    known = enough[kept]
    first = np.where(np.abs(params[:-2]) >= 1, params[:-2], start[enough])[kept]
    params = _ascend(s, known, np.r_[first, params[-2:]], steps, rate, 0.0)
    leak = float(1 / (1 + np.exp(-params[-1])))
    return Model(s.words[known], params[:-2], float(params[-2]), leak)


def _ascend(s: _Sample, known: np.ndarray, params: np.ndarray, steps: int, rate: float, penalty: float):
    """Adam steps on (weights of the known words, bias, leak)."""
    y, n = s.y, len(s.doc)
    column = np.full(len(s.words), -1)
    column[known] = np.arange(len(known))
    use = column[s.flat] >= 0
    col, row = column[s.flat[use]], s.sentence[use]
    m = v = np.zeros(len(params))
    for t in range(1, steps + 1):
        z = np.bincount(row, params[col], n) + params[-2]
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 1e-12, 1 - 1e-9)
        leak = 1 / (1 + np.exp(-params[-1]))
        clean = (1 - leak) * np.exp(np.bincount(s.doc, np.log1p(-p), len(y)))
        each = np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)
        up = each[s.doc] * p
        g = np.r_[np.bincount(col, up[row], len(known)), up.sum(), each.sum() * leak] / len(y)
        g[:-2] -= penalty / len(y) * np.sign(params[:-2])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (1 - t / (steps + 1))
        old = params[:-2]
        params = params + step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        if penalty:
            params[:-2][old * params[:-2] < 0] = 0  # a weight rests at zero before it changes sign
    return params


def fit_documents(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    return fit(
        labelled_features(docs, labels, "toxic", train, SAMPLE_ROWS, SAMPLE_BYTES, encode)
    )


def judge(model: Model, text: str, words: _Words) -> tuple[float, int, list[int]]:
    """(score, sentences, numbers of the offending sentences) of a text."""
    log_clean, count, bad = float(np.log1p(-min(model.leak, 1 - 1e-12))), 0, []
    for _, part in text_parts(text):
        f = features(part, words)
        p, number = model.sentences(f)
        bad += (number[p >= OFFENDING] + count).tolist()
        log_clean += float(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
        count += int((f == END).sum())
    return max(0.0, float(-np.expm1(log_clean))), count, bad


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score, offending (sentence numbers from 0).

    A sentence's number is the count of ends (. ! ? or line end) before it.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words = _Words()
        for b in sliced(batches):
            out = [judge(held.value, t or "", words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "score": pa.array([x[0] for x in out], pa.float64()),
                    "offending": pa.array([x[2] for x in out], pa.list_(pa.int64())),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, offending array<long>")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored at or above ``limit``; columns as given."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        words = _Words()
        for b in sliced(batches, at):
            keep = [judge(held.value, t or "", words)[0] < limit for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
