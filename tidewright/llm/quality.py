"""Document quality by co-training of two views.

One logistic classifier sees the text (shares of character kinds, of each punctuation mark and of hashed words, word length, share of
distinct words and lines), the other the metadata (hashed values of text columns, size of number columns).  Each starts from the
labelled sample.  In every round both views score all unlabelled documents where they lie; the ``named`` surest of both kinds, a
distributed top-k over the whole corpus, are the pseudo-labels that go to the other view's training set.  Both views are then
calibrated on held-out labelled documents, and their log-odds add up (less one prior).

Bounds: at most ``per_class`` labelled documents of each kind (in the order of a hash of the id) and ``named`` documents a view and round reach
the driver, as feature rows of fixed width.  Features of all unlabelled documents are computed once, into a table.

Defined results: a null or empty text has zero features; a null metadata value is a value of its own; without labels of both kinds the score is 0.5 and
everything is kept; repeated rows are scored alike, and of equally sure documents those with the smaller hash of id and text are named
first.  Input columns travel as one struct.  A very long text is handled whole, by its own task.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, broadcast_counted, opened, share, stored, text_key
from .tokens import Words, chunks, free_buffers

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HASHED = 256
WORD_PLACES = 128
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 above ASCII, then each mark
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9]], _KIND[[10, 13]], _KIND[128:] = 1, 2, 3, 4, 5, 6
_KIND[list(MARKS)] = 7 + np.arange(len(MARKS))
KINDS = 7 + len(MARKS)


def text_features(texts: list[str | None]) -> np.ndarray:
    raw = [(t or "").encode() for t in texts]
    size = np.array([len(r) for r in raw])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw)), size)
    share = np.bincount(doc * KINDS + _KIND[buf], minlength=len(raw) * KINDS).reshape(-1, KINDS) / np.maximum(size, 1)[:, None]
    w = Words(texts)
    n = np.diff(w.offsets)
    key = np.unique(w.hashes() + w.doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), return_index=True)[1]
    distinct = np.bincount(w.doc[key], minlength=len(raw)) / np.maximum(n, 1)
    mean = np.bincount(w.doc, w.size, len(raw)) / np.maximum(n, 1)
    place = np.bincount(w.doc * WORD_PLACES + (w.hashes(salt=3) % np.uint64(WORD_PLACES)).astype(np.int64), minlength=len(raw) * WORD_PLACES).reshape(-1, WORD_PLACES)
    words = np.sqrt(place / np.maximum(n, 1)[:, None])
    lines = np.array([len(set(s)) / len(s) for s in ((t or "").split("\n") for t in texts)])
    return np.c_[np.sqrt(share), distinct, distinct * np.sqrt(np.maximum(n, 1)), np.log1p(n), np.minimum(mean, 30) / 10, lines, share[:, 2] / np.maximum(share[:, 1] + share[:, 2], 1e-9), words]


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights[:-1] + self.weights[-1]) + self.offset


@dataclass
class CoTrained:
    text: View | None
    metadata: View | None
    prior: float
    hashed: list[str] = field(default_factory=list)
    sized: list[str] = field(default_factory=list)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights and a bias by full-batch Adam, on columns already brought to one scale; both kinds weigh the same."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    p = np.zeros(x.shape[1])
    m = v = np.zeros_like(p)
    for step in range(1, steps + 1):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ p, -40, 40))) - y)
        grad = x.T @ g + l2 * np.r_[p[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return p


def view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    return View(mean, scale, logistic(np.clip((x - mean) / scale, -6, 6), y))


def calibrate(v: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on held-out rows, at their own share of kinds."""
    z = v.logit(x)
    spread = max(z.std(), 1e-6)
    t = np.c_[z / spread, np.ones(len(z))]
    p = np.zeros(2)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(t @ p, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-6)
        p = p - np.linalg.solve((t * w[:, None]).T @ t / len(z) + 1e-3 * np.eye(2), t.T @ (q - y) / len(z) + 1e-3 * p)
    v.slope, v.offset = p[0] / spread, p[1]


#: What a round takes: for each view (fitted on its set) the feature rows of the surest unlabelled documents, (xa, xb, label).
Surest = Callable[[list["View"], int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def co_train(xa: np.ndarray, xb: np.ndarray, y: np.ndarray, surest: Surest | None, rounds: int = 4, named: int = 100) -> CoTrained:
    """``xa``, ``xb``: both views of labelled rows; every fourth row is held out for calibration."""
    if not y.any() or y.all() or min(y[1::4].sum(), (~y[1::4]).sum()) < 1:
        return CoTrained(None, None, 0.0)
    held = np.arange(len(y)) % 4 == 1
    train = ~held
    if not y[train].any() or y[train].all():
        return CoTrained(None, None, 0.0)
    sets = [[xa[train], y[train]], [xb[train], y[train]]]
    odds = np.log(y.mean() / (1 - y.mean()))
    good = max(1, round(named * y.mean()))
    for _ in range(rounds if surest else 0):
        found = surest([view(x, t) for x, t in sets], good, max(1, named - good))
        for i, (a, b, label) in enumerate(found):  # what one view is sure of goes to the other
            if not len(label):
                continue
            other = 1 - i
            sets[other][0] = np.concatenate([sets[other][0], (a, b)[other]])
            sets[other][1] = np.r_[sets[other][1], label]
        if not any(len(label) for _, _, label in found):
            break
    a, b = (view(x, t) for x, t in sets)
    calibrate(a, xa[held], y[held])
    calibrate(b, xb[held], y[held])
    return CoTrained(a, b, float(odds))


def metadata_columns(docs: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(columns whose values are hashed, columns whose size counts), of those that the table has."""
    kinds = {f.name: f.dataType for f in docs.schema if f.name in columns}
    return [c for c, t in kinds.items() if isinstance(t, (T.StringType, T.BooleanType))], [c for c, t in kinds.items() if isinstance(t, T.NumericType)]


def metadata_features(places: list, sizes: list, n_hashed: int) -> np.ndarray:
    flat = np.zeros((len(places), max(n_hashed, 1) * HASHED), np.float32)
    for k in range(n_hashed):
        flat[np.arange(len(places)), k * HASHED + np.array([p[k] for p in places])] = 1
    size = np.array([[np.nan if x is None else x for x in s] for s in sizes], float).reshape(len(places), -1)
    known = np.isfinite(size)
    log = np.log1p(np.abs(np.where(known, size, 0)))
    return np.c_[flat, log, log**2, ~known]


def featured(docs: DataFrame, text_col: str, hashed: list[str], sized: list[str], others: list) -> DataFrame:
    places = F.array(*[F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))), F.lit(HASHED)).cast("int") for c in hashed]).cast("array<int>")
    sizes = F.array(*[F.col(c).cast("double") for c in sized]).cast("array<double>")
    return docs.select(*others, F.col(text_col).alias("body"), places.alias("places"), sizes.alias("sizes"))


def feature_table(docs: DataFrame, text_col: str, id_col: str, hashed: list[str], sized: list[str]) -> DataFrame:
    """(lid, key, f, places, sizes) of every document."""
    rows = featured(docs, text_col, hashed, sized, [F.col(id_col).alias("lid"), text_key(F.col(text_col)).alias("key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "body"):
                x = text_features(texts).astype(np.float32)
                f = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("lid"), part.column("key"), f, part.column("places"), part.column("sizes")], names=["lid", "key", "f", "places", "sizes"])
            free_buffers()

    return rows.mapInArrow(run, T.StructType([rows.schema["lid"], rows.schema["key"], T.StructField("f", T.ArrayType(T.FloatType())), rows.schema["places"], rows.schema["sizes"]]))


def in_memory(rows: DataFrame, n_hashed: int):
    """A bounded table as (lid, key, xa, xb, frame) in the order of id and text."""
    got = rows.toPandas().sort_values(["lid", "key"], kind="stable")
    xa = np.stack(got["f"].to_list()).astype(float) if len(got) else np.zeros((0, 0))
    return got, xa, metadata_features(got["places"].tolist(), got["sizes"].tolist(), n_hashed) if len(got) else np.zeros((0, 0))


def named_by(rest: DataFrame, n_hashed: int) -> Surest:
    """Rounds over a table of unlabelled documents; a document is named once, whichever view names it."""
    spark, taken = rest.sparkSession, []

    def surest(views: list[View], good: int, bad: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        shared = spark.sparkContext.broadcast(([(v.mean, v.scale, v.weights) for v in views], list(taken)))
        kinds = [(i, sign, k) for i in (0, 1) for sign, k in ((1, good), (-1, bad))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (fits, gone), best = shared.value, [None] * len(kinds)
            gone = set(gone)
            for batch in batches:
                free = np.array([x not in gone for x in batch.column("h").to_pylist()], bool)
                batch = batch.filter(pa.array(free))
                if not batch.num_rows:
                    continue
                xs = (batch.column("f").flatten().to_numpy().reshape(batch.num_rows, -1), metadata_features(batch.column("places").to_pylist(), batch.column("sizes").to_pylist(), n_hashed))
                z = [np.clip((x - m) / s, -6, 6) @ w[:-1] + w[-1] for x, (m, s, w) in zip(xs, fits)]
                h = batch.column("h").to_numpy()
                for n, (i, sign, k) in enumerate(kinds):
                    score = sign * z[i]
                    at = np.lexsort((h, -score))[:k]
                    at = at[score[at] > 1]  # only what this view is sure of
                    part = batch.take(pa.array(at)).append_column("z", pa.array(score[at])).append_column("kind", pa.array(np.full(at.size, n), pa.int32()))
                    if best[n] is not None and best[n].num_rows:
                        part = pa.Table.from_batches([best[n], part]).combine_chunks().to_batches()[0]
                    keep = np.lexsort((part.column("h").to_numpy(), -part.column("z").to_numpy()))[:k]
                    best[n] = part.take(pa.array(keep))
            yield from (b for b in best if b is not None and b.num_rows)

        schema = T.StructType([*rest.schema.fields, T.StructField("z", T.DoubleType()), T.StructField("kind", T.IntegerType())])
        firsts = stored(rest.mapInArrow(run, schema), "surest")  # at most k rows of a kind from each task
        out, seen = [], set()
        for i in (0, 1):
            parts = []
            for n, (view_, sign, k) in enumerate(kinds):
                if view_ == i:
                    got, xa, xb = in_memory(firsts.filter(F.col("kind") == n).orderBy(F.col("z").desc(), "h").limit(k), n_hashed)
                    parts.append((xa, xb, np.full(len(got), sign > 0)))
                    seen.update(got["h"].tolist())
            parts = [p for p in parts if len(p[2])]
            out.append(tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0, bool)))
        taken.extend(seen)
        return out

    return surest


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, named: int = 100, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          metadata: tuple[str, ...] = ("lang", "source", "n_chars")) -> CoTrained:
    """A model of both views.  The labelled sample is bounded; the unlabelled documents are all that have no label."""
    hashed, sized = metadata_columns(docs, list(metadata))
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("lid"), (F.col(label_col) > 0).alias("y"))
    order = [F.xxhash64("lid"), F.col("lid")]
    picked = [known.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (True, False)]
    table = stored(feature_table(docs, text_col, id_col, hashed, sized), "features")
    sample = table.join(F.broadcast(picked[0].unionByName(picked[1])), "lid")  # at most twice ``per_class`` rows of labels
    got, xa, xb = in_memory(sample, len(hashed))
    if not len(got):
        return CoTrained(None, None, 0.0, hashed, sized)
    ids = known.select("lid").distinct()
    n_ids = ids.count()
    rest = table.join(broadcast_counted(ids, n_ids), "lid", "left_anti").withColumn("h", F.xxhash64("lid", "key"))
    rest = rest if n_ids <= BROADCAST_ROWS else stored(rest, "unlabelled")  # else every round would shuffle
    model = co_train(xa, xb, got["y"].astype(bool).to_numpy(), named_by(rest, len(hashed)), rounds, named)
    # both kinds were sampled alike; the corpus has its own share of good documents
    n = known.agg(F.count_if("y").alias("good"), F.count_if(~F.col("y")).alias("bad")).first()
    if model.text is not None:
        shift = np.log(n["good"] / n["bad"]) - model.prior
        model.text.offset += shift
        model.metadata.offset += shift
        model.prior += shift
    model.hashed, model.sized = hashed, sized
    return model


def score(docs: DataFrame, model: CoTrained, text_col: str = "text", keep_at: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Columns: row (the input row or its ``carry`` columns), p_text, p_metadata, quality (both views), keep."""
    rows = featured(docs, text_col, model.hashed, model.sized, [F.struct(*(carry or ["*"])).alias("row")])
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        for batch in batches:
            for part, texts in chunks(batch, "body"):
                if m.text is None:
                    a = b = np.zeros(len(texts))
                else:
                    a = m.text.logit(text_features(texts))
                    b = m.metadata.logit(metadata_features(part.column("places").to_pylist(), part.column("sizes").to_pylist(), len(m.hashed)))
                both = sigmoid(a + b - m.prior)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sigmoid(a)), pa.array(sigmoid(b)), pa.array(both), pa.array(both >= keep_at)],
                                                 names=["row", "p_text", "p_metadata", "quality", "keep"])
            free_buffers()

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *[T.StructField(c, T.DoubleType()) for c in ("p_text", "p_metadata", "quality")], T.StructField("keep", T.BooleanType())]))
