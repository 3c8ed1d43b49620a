"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

Rules and the split of a URL are column expressions.  The classifier learns from a small labelled URL table (host, path, label), of which
at most ``ROWS`` distinct ones, in the order of a hash, reach the driver.  ``rule_labels`` makes such a table of the URLs that rules
decide.  Features are all 3- to 5-grams of bytes of the host and of the path, marked by field, hashed to 2^16 places.

Defined results: a null URL or one without ``://`` has an empty host and path and is judged by the classifier's base score; with labels of one kind
only, that kind is the verdict, with none it is allow; repeated rows get equal verdicts.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, opened, share
from .tokens import mix

BITS = 16
ROWS = 4000
GRAMS = (3, 4, 5)
_STEP = np.uint64(0xD1B54A32D192ED03)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits host (or a domain above it) and the path's start; null if none does."""
    name = verdict = None
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def judged_by_rules(df: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """Columns: row (the input row), host, path, rule, rule_verdict."""
    split = df.select(F.struct("*").alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return split.select("row", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))


def rule_labels(judged: DataFrame) -> DataFrame:
    """(host, path, label): 1 for a blocked URL, 0 for an allowed one."""
    return judged.filter(F.col("rule_verdict").isNotNull()).select("host", "path", (F.col("rule_verdict") == "block").cast("int").alias("label"))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of every n-gram, once a row; a field's ends are marked, so short fields have grams too."""
    found, owner, n = [], [], len(hosts)
    for field, texts in ((1, hosts), (2, paths)):
        raw = [b"^" + t.encode() + b"$\n\n" for t in texts]
        buf = np.frombuffer(b"".join(raw) + b"\n" * 4, np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(n), [len(r) for r in raw])
        h = np.zeros(row.size, np.uint64)
        for k in range(max(GRAMS)):
            h = h * _STEP + buf[k : k + row.size] + np.uint64(1)
            if k + 1 in GRAMS:
                inside = buf[k : k + row.size] != 10
                found.append((mix(h[inside] + np.uint64(field * 10 + k)) >> np.uint64(64 - BITS)).astype(np.int64))
                owner.append(row[inside])
    key = np.unique(np.concatenate(owner) << BITS | np.concatenate(found))
    return key & ((1 << BITS) - 1), key >> BITS


def fit(hosts: list[str], paths: list[str], labels: np.ndarray, l2: float = 1e-4, steps: int = 300, rate: float = 0.05) -> UrlModel:
    """Full-batch Adam; both kinds weigh the same."""
    if not len(labels) or labels.min() == labels.max():
        return UrlModel(np.zeros(1 << BITS), 10.0 if len(labels) and labels[0] else -10.0)
    at, row = grams(hosts, paths)
    used, col = np.unique(at, return_inverse=True)
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(labels)))
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    p = np.zeros(used.size + 1)
    m = v = np.zeros_like(p)
    for step in range(1, steps + 1):
        z = np.bincount(row, p[col] * scale[row], len(labels)) + p[-1]
        g = weight * (1 / (1 + np.exp(-z)) - labels)
        grad = np.r_[np.bincount(col, (g * scale)[row], used.size) + l2 * p[:-1], g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(1 << BITS)
    weights[used] = p[:-1]
    return UrlModel(weights, float(p[-1]))


def train(labelled: DataFrame, rows: int = ROWS) -> UrlModel:
    sample = labelled.select("host", "path", "label").distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(rows).toPandas()
    return fit(sample["host"].tolist(), sample["path"].tolist(), sample["label"].to_numpy())


def predict(m: UrlModel, hosts: list[str], paths: list[str]) -> np.ndarray:
    at, row = grams(hosts, paths)
    n = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-np.clip(np.bincount(row, m.weights[at], len(hosts)) / np.sqrt(n) + m.bias, -40, 40)))


def filter_urls(judged: DataFrame, model: UrlModel) -> DataFrame:
    """Adds p_block and verdict (allow or block: the rule's, else the classifier's) to what ``judged_by_rules`` gives."""
    shared = share(judged.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = opened(shared)
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                p = predict(model_, part.column("host").to_pylist(), part.column("path").to_pylist())
                says = [r or ("block" if x >= 0.5 else "allow") for r, x in zip(part.column("rule_verdict").to_pylist(), p)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array(says, pa.string())], names=[*part.schema.names, "p_block", "verdict"])

    return judged.mapInArrow(run, T.StructType([*judged.schema, T.StructField("p_block", T.DoubleType()), T.StructField("verdict", T.StringType())]))
