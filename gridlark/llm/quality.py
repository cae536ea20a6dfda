"""Quality scores by nearest-neighbour voting over labelled latent-semantic vectors.

Terms are pairs of neighbouring characters by class, and counts of how words repeat. Root frequencies times inverse document
frequency are projected on the leading singular vectors of a labelled sample; every document is compared with every
labelled vector by exact cosine, in blocks, and the nearest ones vote with a power of their similarity.

The fit uses at most `FIT_DOCS` labelled documents for the singular vectors and at most `VOTERS` labelled vectors, both drawn
by the hash of the id, so what is broadcast has a fixed size at any corpus size. Every document is scored over its whole text.

Cases: null and empty texts get the neutral vector and the vote of their nearest neighbours like any other; without labels
every score is `NO_LABELS`; several label rows of one id count as their maximum; rows with a null id are scored and never
held out; of the rows that share a labelled id the least text is the one to learn from; equal texts get equal scores; extra columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import held_out, text_of

FIT_DOCS = 2048
VOTERS = 8192
RANK = 48
NEIGHBOURS = 15
POWER = 16
THRESHOLD = 0.3
NO_LABELS = 1.0
BLOCK = 256

_N_CLASS = 64
_REPEATS = 8
N_TERMS = _N_CLASS * _N_CLASS + _REPEATS


def _classes() -> np.ndarray:
    """A class below 64 for each byte: letters by themselves, upper case, digits and bytes beyond ASCII as one class each."""
    out = np.zeros(256, dtype=np.int32)
    marks = iter(range(32, _N_CLASS))
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c.isupper():
            out[b] = 3
        elif c.islower():
            out[b] = 4 + b - ord("a")
        elif c == "\n":
            out[b] = 30
        elif c.isspace():
            out[b] = 31
        elif 33 <= b < 127:
            out[b] = next(marks, _N_CLASS - 1)
    return out


_CLASS = _classes()


def term_counts(text: str) -> np.ndarray:
    """How often each term occurs in the whole text."""
    out = np.zeros(N_TERMS, dtype=np.float32)
    raw = _CLASS[np.frombuffer(text.encode(), dtype=np.uint8)]
    if len(raw) > 1:
        out[: _N_CLASS * _N_CLASS] = np.bincount(raw[:-1] * _N_CLASS + raw[1:], minlength=_N_CLASS * _N_CLASS)
    words = text.split()
    if words:
        lines = text.split("\n")
        out[-8:] = (
            sum(map(eq, words, words[1:])), sum(map(eq, words, words[2:])), sum(map(eq, words, words[4:])), len(words) - len(set(words)),
            len(lines) - len(set(lines)), sum(map(str.isupper, words)), sum(not w.isalpha() for w in words), len(words),
        )
    return out


def sparse(counts: np.ndarray) -> bytes:
    """The terms that occur, as 16-bit places and 32-bit counts: a few kilobytes where the whole row takes sixteen."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes()


def dense(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), N_TERMS), dtype=np.float32)
    for k, row in enumerate(rows):
        n = len(row) // 6
        out[k, np.frombuffer(row, "<u2", n)] = np.frombuffer(row, "<f4", n, 2 * n)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of root term frequency times idf; the character pairs and the repeats are scaled each to their own total."""
    x = np.array(counts, dtype=np.float32)
    for part, total in ((x[:, :-_REPEATS], x[:, :-_REPEATS].sum(1, keepdims=True)), (x[:, -_REPEATS:], x[:, -1:].copy())):
        part /= np.maximum(total, 1)
        np.sqrt(part, out=part)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def fit(rows: list[bytes], rank: int = RANK, sweeps: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """(idf, projection) from the sparse counts of a labelled sample.

    The leading right singular vectors come from block power iteration: the sample is read in blocks again and again, so that
    neither it nor a square matrix of its size is ever held dense.
    """
    blocks = [rows[at : at + BLOCK] for at in range(0, len(rows), BLOCK)]
    seen = sum((dense(b) > 0).sum(0) for b in blocks)
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    wide = min(rank + 16, len(rows))
    axes = np.linalg.qr(np.random.default_rng(5).normal(size=(N_TERMS, wide)))[0]
    for _ in range(sweeps):
        image = sum(x.T @ (x @ axes.astype(np.float32)) for x in (weighted(dense(b), idf) for b in blocks)).astype(np.float64)
        axes, _ = np.linalg.qr(image)
    small = sum((y := weighted(dense(b), idf) @ axes).T @ y for b in blocks)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-6 * max(values.max(), 1e-30)]
    return idf, (axes @ turn[:, keep]).astype(np.float32)


def project(counts: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    v = weighted(counts, idf) @ axes
    return (v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
    """Share of label 1 among the k nearest known vectors, each weighted by a power of its cosine; ties go by place."""
    out = np.empty(len(vectors))
    k = min(k, len(known))
    for at in range(0, len(vectors), BLOCK):
        cos = vectors[at : at + BLOCK] @ known.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(cos), 1))
        w = np.clip(np.take_along_axis(cos, near, axis=1), 1e-6, 1).astype(np.float64) ** power
        out[at : at + BLOCK] = (w * labels[near]).sum(1) / w.sum(1)
    return out


def _sparse_counts(text_col: str):
    @F.pandas_udf("binary")
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series([sparse(term_counts(t)) for t in texts], dtype=object)

    return counts(F.col(text_col))


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `most` labelled documents that aren't held out, drawn by the hash of the id, one text each: (_id, _text, _label)."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    found = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(known), "_id")  # `most` rows
    # An id may repeat in any number of rows: its least text counts, so that the sample stays bounded.
    return found.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))


class QualityModel:
    """What is broadcast: idf, projection and the labelled vectors, a few MB whatever the corpus."""

    def __init__(self, idf, axes, known, labels):
        self.idf, self.axes, self.known, self.labels = idf, axes, known, labels

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.known):
            return np.full(len(texts), NO_LABELS)
        out = np.empty(len(texts))
        for at in range(0, len(texts), BLOCK):
            some = texts[at : at + BLOCK]
            out[at : at + len(some)] = vote(project(np.stack([term_counts(t) for t in some]), self.idf, self.axes), self.known, self.labels)
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fits on bounded samples: sparse term counts of FIT_DOCS rows and projected vectors of VOTERS rows come to the driver."""
    some = sampled(docs, labels, label, FIT_DOCS, id_col, text_col).select("_id", _sparse_counts("_text").alias("c")).orderBy("_id").toPandas()
    if not len(some):
        return QualityModel(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    idf, axes = fit(some["c"].to_list())
    shipped = docs.sparkSession.sparkContext.broadcast((idf, axes))

    @F.pandas_udf("binary")
    def vectors(texts: pd.Series) -> pd.Series:
        rows = []
        for at in range(0, len(texts), BLOCK):
            rows += [v.astype("<f4").tobytes() for v in project(np.stack([term_counts(t) for t in texts.iloc[at : at + BLOCK]]), *shipped.value)]
        return pd.Series(rows, dtype=object)

    known = sampled(docs, labels, label, VOTERS, id_col, text_col).select("_id", "_label", vectors("_text").alias("v")).orderBy("_id").toPandas()
    shipped.destroy()
    return QualityModel(idf, axes, np.frombuffer(b"".join(known["v"]), "<f4").reshape(len(known), axes.shape[1]), known["_label"].to_numpy(np.float64))


def scores(docs: DataFrame, model: QualityModel, text_col: str = "text"):
    """Column expression: the score of each whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shipped.value.score(texts.to_list()))

    return score(text_of(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = train(docs, labels, "quality", id_col, text_col)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scores(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
