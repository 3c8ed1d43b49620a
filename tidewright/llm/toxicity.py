"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text and their first 4 to 7 bytes, hashed to 32 bits.  The model has one weight vector and
ordered thresholds: P(grade >= k) = sigmoid(w.x - threshold_k).  It is fitted on the driver, on a sample of labelled texts of at
most ``per_class`` toxic and as many other ones (a documented bound; taken in the order of a hash of the id), whose features are
made on the executors.  Features are screened there by a two-sample z-score.  Every document is then scored where it lies.

The labels only tell toxic from not; ``severity_grades`` makes ordered grades of them: 0 not toxic, 1 toxic, 2 toxic with more distinct
marker features than the median toxic text.  ``fit`` itself takes any grades 0..K.

Defined results: a null or empty text has no features and the score of a text without markers; without labelled texts of both
kinds no text is toxic; repeated rows are scored alike; columns of the input travel in ``row`` and cannot clash.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import opened, share
from .tokens import Words, chunks, free_buffers

STARTS = (4, 5, 6, 7)


@dataclass
class Ordinal:
    features: np.ndarray  # sorted uint32
    weights: np.ndarray
    thresholds: np.ndarray  # increasing; one less than there are grades


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of all words and word starts, with repeats."""
    w = Words(texts)
    found, owner = [w.hashes(salt=1)], [w.doc]
    for k in STARTS:
        long = np.flatnonzero(w.size >= k)
        found.append(w.hashes(w.start[long], k, salt=10 + k))
        owner.append(w.doc[long])
    return (np.concatenate(found) >> np.uint64(32)).astype(np.uint32), np.concatenate(owner)


def labelled_features(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and feature sets of the bounded sample.  Only ids are ordered; the sample's ids are broadcast (2 * per_class rows)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("lid"), (F.col(label_col) > 0).alias("y"))
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("lid"), "lid").limit(per_class) for y in (True, False)]
    rows = (docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("body"))
            .join(F.broadcast(picked[0].unionByName(picked[1])), "lid").select("y", "body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "body"):
                f, d = features(texts)
                key = np.unique((d.astype(np.uint64) << np.uint64(32)) | f)
                at = np.searchsorted(key >> np.uint64(32), np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("y"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((key & np.uint64(2**32 - 1)).astype(np.uint32).view(np.int32)))],
                    names=["y", "f"])

    got = rows.mapInArrow(run, "y boolean, f array<int>").toArrow()
    column = got.column("f").combine_chunks()
    flat, at = column.flatten().to_numpy().view(np.uint32), np.r_[0, np.cumsum(np.diff(column.offsets.to_numpy()))] if len(column) else np.zeros(1, np.int64)
    sets = {}
    for k, y in enumerate(got.column("y").to_pylist()):  # equal texts teach once
        sets.setdefault((y, flat[at[k] : at[k + 1]].tobytes()), flat[at[k] : at[k + 1]])
    return np.array([y for y, _ in sets], bool), list(sets.values())


def screen(y: np.ndarray, sets: list[np.ndarray], least_z: float, least_n: int) -> np.ndarray:
    """Sorted features that toxic texts have clearly more often."""
    if not y.any() or y.all():
        return np.zeros(0, np.uint32)
    pos, a = np.unique(np.concatenate([s for s, t in zip(sets, y) if t]), return_counts=True)
    other, n = np.unique(np.concatenate([s for s, t in zip(sets, y) if not t]), return_counts=True)
    at = np.minimum(np.searchsorted(other, pos), max(other.size - 1, 0))
    b = np.where(other[at] == pos, n[at], 0) if other.size else np.zeros(pos.size)
    n1, n0 = y.sum(), (~y).sum()
    p = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    return pos[(z >= least_z) & (a >= least_n)]


def severity_grades(y: np.ndarray, sets: list[np.ndarray], markers: np.ndarray) -> np.ndarray:
    n = np.array([np.isin(s, markers, assume_unique=True).sum() for s in sets])
    return np.where(y, 1 + (n > np.median(n[y])), 0) if y.any() else np.zeros(y.size, int)


def fit(grades: np.ndarray, sets: list[np.ndarray], names: np.ndarray, toxic_share: float = 0.5, l2: float = 1e-6, steps: int = 600, rate: float = 0.1) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood; thresholds are a first one and positive steps.

    The rows of grades above 0 weigh ``toxic_share`` together, however the sample was drawn."""
    cuts = max(int(grades.max(initial=0)), 1)
    if not names.size:
        return Ordinal(names, np.zeros(0), 20.0 + np.arange(cuts))
    hits = [np.searchsorted(names, np.intersect1d(s, names, assume_unique=True)) for s in sets]
    row, col = np.repeat(np.arange(len(hits)), [h.size for h in hits]), np.concatenate(hits)
    weight = np.where(grades > 0, toxic_share / max((grades > 0).sum(), 1), (1 - toxic_share) / max((grades == 0).sum(), 1))
    p = np.concatenate([np.zeros(names.size), [0.0], np.zeros(cuts - 1)])
    m = v = np.zeros(p.size)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, steps + 1):
        w, theta = p[: names.size], np.cumsum(np.r_[p[names.size], np.exp(p[names.size + 1 :])])
        x = np.bincount(row, w[col], len(hits))
        above = sigmoid(x[:, None] - theta)  # P(grade > k)
        upper = np.c_[np.ones(len(hits)), above][np.arange(len(hits)), grades]
        lower = np.c_[above, np.zeros(len(hits))][np.arange(len(hits)), grades]
        prob = np.maximum(upper - lower, 1e-12)
        du, dl = weight * upper * (1 - upper) / prob, weight * lower * (1 - lower) / prob  # upper 1 and lower 0 have no slope
        gx = du - dl
        gt = np.array([(dl * (grades == k)).sum() - (du * (grades == k + 1)).sum() for k in range(cuts)])
        tail = np.cumsum(gt[::-1])[::-1]
        grad = -np.concatenate([np.bincount(col, gx[row], names.size), [tail[0]], tail[1:] * np.exp(p[names.size + 1 :])])
        grad[: names.size] += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Ordinal(names, p[: names.size], np.cumsum(np.r_[p[names.size], np.exp(p[names.size + 1 :])]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          least_z: float = 5.0, least_n: int = 5) -> Ordinal:
    y, sets = labelled_features(docs, labels, per_class, id_col, text_col, label_col)
    names = screen(y, sets, least_z, least_n)
    n = labels.agg(F.count_if(F.col(label_col) > 0).alias("toxic"), F.count(label_col).alias("all")).first()
    return fit(severity_grades(y, sets, names), sets, names, (n["toxic"] + 1) / (n["all"] + 2))


def linear_scores(model: Ordinal, texts: list[str | None]) -> np.ndarray:
    f, d = features(texts)
    gate = np.zeros(1 << 16, bool)
    gate[model.features & np.uint32(0xFFFF)] = True
    near = np.flatnonzero(gate[f & np.uint32(0xFFFF)])
    f, d = f[near], d[near]
    at = np.minimum(np.searchsorted(model.features, f), max(model.features.size - 1, 0))
    hit = model.features[at] == f if model.features.size else np.zeros(f.size, bool)
    key = np.unique(d[hit] * model.features.size + at[hit])
    return np.bincount(key // max(model.features.size, 1), model.weights[key % max(model.features.size, 1)], len(texts))


def score(docs: DataFrame, model: Ordinal, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns: row (the input row or its ``carry`` columns), p_toxic (grade 1 or more), expected_severity, grade, toxic."""
    rows = docs.select(F.struct(*(carry or ["*"])).alias("row"), F.col(text_col).alias("body"))
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared)
        for batch in batches:
            for part, texts in chunks(batch, "body"):
                above = 1 / (1 + np.exp(-np.clip(linear_scores(m, texts)[:, None] - m.thresholds, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32)),
                                                  pa.array(above[:, 0] >= 0.5)], names=["row", "p_toxic", "expected_severity", "grade", "toxic"])
            free_buffers()

    return rows.mapInArrow(run, T.StructType([rows.schema["row"]]).add("p_toxic", "double").add("expected_severity", "double").add("grade", "integer").add("toxic", "boolean"))
