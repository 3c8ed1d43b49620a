"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into parts of nearly one size; a softmax classifier learns, from a vector, how its
neighbours spread over the parts.  Every row is stored in its most probable part.  A query goes to its ``probes`` most probable parts
and all rows there are ranked again by exact cosine in double precision.  ``probes`` is the least number that finds ``target`` of
the true neighbours within the sample (where neighbours lie farther apart than among all rows, so the choice is a careful one).

Equal vectors are one point: only its ``k + 1`` smallest ids can be among a query's ``k`` nearest, so a vector that a third of all rows
share costs one point, found with a per-key limit before the shuffle.  Points of a part are dealt into blocks of about ``BLOCK`` rows
and queries into blocks likewise; a task multiplies one block by another and returns the best few of each query, and a last
aggregate merges them.

Bounds: ``SAMPLE`` vectors fit graph and classifier (on the driver, 2 MB at 64 dimensions); the number of parts follows the number of points up to
``MOST_PARTS``.  Vectors that are null, zero, of another size than most, or hold null or non-finite values take no part.  Defined results: ties
in score go to the smaller id; fewer candidates than ``k`` are all returned if the probed parts hold them (all parts are probed when there
are few points); a query's own id is never its neighbour; an empty table gives no rows; a repeated id counts once.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import opened, share, stored

SAMPLE = 4000
MOST_PARTS = 32
PART_ROWS = 1000
BLOCK = 1024


@dataclass
class Router:
    weights: np.ndarray
    bias: np.ndarray
    probes: int = 1

    def log_odds(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.weights + self.bias


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int, step: int = 1000) -> np.ndarray:
    """The ``k`` nearest other rows of each row."""
    out = np.empty((x.shape[0], k), np.int64)
    for s in range(0, x.shape[0], step):
        sim = x[s : s + step] @ x.T
        sim[np.arange(sim.shape[0]), np.arange(s, s + sim.shape[0])] = -np.inf
        out[s : s + step] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.15, sweeps: int = 12, seed: int = 7) -> np.ndarray:
    """Parts of at most ``slack`` times the mean size: seeded by nearest centres with capacity, then moved along the graph's edges."""
    rng, n = np.random.default_rng(seed), x.shape[0]
    room = int(np.ceil(slack * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        near = np.argmax(x @ centres.T, axis=1)
        for p in range(parts):
            if (near == p).any():
                centres[p] = x[near == p].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    sim = x @ centres.T
    part, size = np.full(n, -1), np.zeros(parts, int)
    choice = np.argsort(-sim, axis=1)
    for i in np.argsort(-sim.max(1)):
        p = next(c for c in choice[i] if size[c] < room)
        part[i], size[p] = p, size[p] + 1
    back = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    ties = [np.array(row + b) for row, b in zip(graph.tolist(), back)]
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[ties[i]], minlength=parts)
            best = int(np.argmax(np.where((size < room) | (np.arange(parts) == part[i]), votes, -1)))
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, steps: int = 400, rate: float = 0.05) -> Router:
    """Softmax regression on the share of a row's neighbours (and itself) in each part."""
    target = np.zeros((x.shape[0], parts))
    np.add.at(target, (np.repeat(np.arange(x.shape[0]), graph.shape[1]), part[graph].ravel()), 1.0)
    target[np.arange(x.shape[0]), part] += 2
    target /= target.sum(1, keepdims=True)
    p = np.zeros((x.shape[1] + 1, parts))
    features = np.c_[x, np.ones(x.shape[0])]
    m = v = np.zeros_like(p)
    for step in range(1, steps + 1):
        z = features @ p
        z = np.exp(z - z.max(1, keepdims=True))
        grad = features.T @ (z / z.sum(1, keepdims=True) - target) / x.shape[0] + 1e-6 * p
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Router(p[:-1], p[-1])


def fit(sample: np.ndarray, parts: int, k: int = 5, target: float = 0.97) -> Router:
    """A router for unit vectors, with its number of probes."""
    x = unit_rows(sample.astype(np.float64))
    parts = max(1, min(parts, x.shape[0]))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1))
    graph = neighbour_graph(x, min(10, x.shape[0] - 1))
    router = fit_router(x, graph, balanced_parts(x, graph, parts), parts)
    odds = router.log_odds(x)
    place = np.argsort(np.argsort(-odds, axis=1), axis=1)  # place of each part in a row's order
    home = odds.argmax(1)
    near = graph[:, : min(k, graph.shape[1])] if graph.shape[1] <= k else np.take_along_axis(
        graph, np.argsort(-np.einsum("id,ijd->ij", x, x[graph]), axis=1)[:, :k], 1)
    found = np.sort(place[np.arange(x.shape[0])[:, None], home[near]].ravel())
    router.probes = int(found[min(found.size - 1, int(np.ceil(target * found.size)) - 1)]) + 1
    return router


def points_of(rows: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(usable rows (id, h1, h2, vec), points (h1, h2, vec, ids)): a point has its vector's ``k + 1`` smallest ids."""
    finite = F.forall(F.col("vec"), lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    vec = F.transform(F.col(vector_col), lambda c: c.cast("double") + F.lit(0.0))
    named = rows.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    named = named.filter(finite & F.exists("vec", lambda c: c != 0))
    sizes = named.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    named = named.filter(F.size("vec") == (sizes["d"] if sizes else -1)).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("vec"), "vec")})
    w = Window.partitionBy("h1", "h2").orderBy("id")
    few = named.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k + 1)
    return named, few.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("ids"))


def routed(points: DataFrame, router: Router, probes: int) -> DataFrame:
    """Adds ``parts``, the ``probes`` most probable ones, best first."""
    schema = points.schema
    shared = share(points.sparkSession, router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router_ = opened(shared)
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1))
                odds = router_.log_odds(x)
                best = np.argsort(-odds, axis=1, kind="stable")[:, :probes].astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=[*batch.schema.names, "parts"])

    return points.mapInArrow(run, T.StructType([*schema, T.StructField("parts", T.ArrayType(T.IntegerType()))]))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", target: float = 0.97) -> DataFrame:
    """(query_id, rank, id, score): for each id of ``queries`` (column ``id``) its ``k`` nearest other rows found."""
    spark = rows.sparkSession
    named, points = points_of(rows, k, id_col, vector_col)
    points = stored(points, "points")
    asked = named.join(queries.select("id").distinct(), "id").select("id", "h1", "h2").distinct()
    n = points.count()
    sample = points.orderBy("h1", "h2").limit(SAMPLE).select("vec").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    router = fit(np.stack(sample["vec"].to_list()), min(MOST_PARTS, max(1, n // PART_ROWS)), k, target)
    index = stored(routed(points, router, 1).withColumn("part", F.col("parts")[0]).drop("parts"), "index")
    askers = stored(routed(points.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi"), router, router.probes)
                    .select("h1", "h2", "vec", F.explode("parts").alias("part")), "askers")
    blocks = lambda df: {r["part"]: -(-r["count"] // BLOCK) for r in df.groupBy("part").count().collect()}  # noqa: E731  at most MOST_PARTS rows
    of_rows, of_queries = blocks(index), blocks(askers)
    dealt = lambda by: F.element_at(F.create_map(*[F.lit(int(x)) for item in by.items() for x in item]), F.col("part")) if by else F.lit(1)
    many = lambda c: F.coalesce(c, F.lit(0))
    own = lambda by: F.pmod(F.xxhash64("h2", "h1"), dealt(by)).cast("int")
    left = index.select("part", own(of_rows).alias("block"), F.explode(F.sequence(F.lit(1), F.greatest(many(F.try_element_at(F.create_map(
        *[F.lit(int(x)) for item in of_queries.items() for x in item]), F.col("part"))), F.lit(1)))).alias("qblock"), "vec", "ids") if of_queries else None
    if left is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    right = askers.filter(F.col("part").isin(list(of_rows))).select(
        "part", F.explode(F.sequence(F.lit(0), dealt(of_rows) - 1)).alias("block"), (own(of_queries) + 1).alias("qblock"), "vec", "h1", "h2")

    def match(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if have.empty or want.empty:
            return pd.DataFrame({"h1": [], "h2": [], "id": [], "score": []}).astype({"h1": "int64", "h2": "int64", "id": "int64", "score": "float64"})
        x, q = np.stack(have["vec"].to_list()), np.stack(want["vec"].to_list())
        score = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
        lens = have["ids"].map(len).to_numpy()
        ids = np.concatenate(have["ids"].to_list())
        out = []
        for i in range(len(q)):
            s = score[i]
            cut = np.partition(s, -(k + 1))[-(k + 1)] if s.size > k + 1 else -np.inf
            near = np.repeat(s >= cut, lens)
            ss, ii = np.repeat(s, lens)[near], ids[near]
            top = np.lexsort((ii, -ss))[: k + 1]
            out.append((np.full(top.size, i), ii[top], ss[top]))
        at = np.concatenate([o[0] for o in out])
        return pd.DataFrame({"h1": want["h1"].to_numpy()[at], "h2": want["h2"].to_numpy()[at],
                             "id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    keys = ["part", "block", "qblock"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(match, "h1 long, h2 long, id long, score double")
    order = [F.desc("score"), F.asc("id")]
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*order))).filter(F.col("nth") <= k + 1)
    each = asked.withColumnRenamed("id", "query_id").join(best, ["h1", "h2"]).filter("id <> query_id")
    return (each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
