"""Ordered operators that stay bounded when one key holds a large share of all rows.

A plain ``partitionBy(key)`` window sends every row of a key to one task.  Here a table above the size limit is
first cut into blocks along the ordering columns by a range shuffle of the *whole* table, so a block holds about
``tidewright.block.rows`` rows no matter how the keys are skewed and however large the table is; windows then run inside
``(key, block)`` and a block summary (a few rows per key) carries ranks, sums or last values across blocks.
All ordering columns, of any type, take part in the cut, so an instant that many rows share is cut by the next column; only rows
equal in all of them stay together.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import BLOCK_ROWS_KEY, SMALL_BYTES_KEY, broadcast_if_small, cut_lineage, is_bounded, is_small, plan_bytes, setting

BLK = "__blk"


def with_blocks(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """Add the block column, which grows along ``order``; returns the frame and whether more than one block exists.

    An estimate of compressed columns says little about rows, so of a table that looks small the rows of the largest key are counted.
    The cut points are sampled anew by every run of a range shuffle, so the blocks are kept by a reliable checkpoint."""
    limit = setting(df.sparkSession, BLOCK_ROWS_KEY)
    if plan_bytes(df) <= min(limit, setting(df.sparkSession, SMALL_BYTES_KEY)):     # a row takes a byte or more
        return df, False
    if is_small(df):
        if (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0) <= limit:
            return df, False
    elif is_bounded(df):
        return df, False
    n = df.count()
    if n <= limit:
        return df, False
    cut = df.repartitionByRange(math.ceil(n / limit), *_order(order)).withColumn(BLK, F.spark_partition_id().cast("long"))
    return cut_lineage(cut), True


def _order(order: Sequence[str], desc: bool = False) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c in order]


def _attach(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(broadcast_if_small(side), [*keys, BLK], "left")


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos",
                 total: str | None = None) -> DataFrame:
    """1-based position of each row inside its key, and optionally the key's row count."""
    keys, order = list(keys), list(order)
    df, many = with_blocks(df, order, keys)
    if not many:
        df = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*_order(order))).cast("long"))
        return df if total is None else df.withColumn(total, F.count(F.lit(1)).over(W.partitionBy(*keys)))
    sizes = df.groupBy(*keys, BLK).agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*keys).orderBy(BLK)
    sizes = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.withColumn("__tot", F.sum("__n").over(W.partitionBy(*keys))).drop("__n")
    df = _attach(df, sizes, keys)
    local = F.row_number().over(W.partitionBy(*keys, BLK).orderBy(*_order(order)))
    df = df.withColumn(out, (local + F.col("__off")).cast("long"))
    if total is not None:
        df = df.withColumn(total, F.col("__tot"))
    return df.drop("__off", "__tot", BLK)


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, str],
              step: int = -1) -> DataFrame:
    """Columns of the previous (``step=-1``) or next (``step=1``) row of the same key."""
    keys, order = list(keys), list(order)
    df, many = with_blocks(df, order, keys)
    pack = F.struct(*[F.col(src).alias(dst) for dst, src in cols.items()])
    shift = F.lag if step < 0 else F.lead
    w = W.partitionBy(*keys, *([BLK] if many else [])).orderBy(*_order(order))
    df = df.withColumn("__nb", shift(pack, 1).over(w))
    if many:
        pick = F.max_by if step < 0 else F.min_by
        edge = df.groupBy(*keys, BLK).agg(pick(pack, F.struct(*order)).alias("__e"))
        edge = edge.withColumn("__e", shift(F.col("__e"), 1).over(W.partitionBy(*keys).orderBy(BLK)))
        df = _attach(df, edge, keys).withColumn("__nb", F.coalesce(F.col("__nb"), F.col("__e"))).drop("__e", BLK)
    for dst in cols:
        df = df.withColumn(dst, F.col("__nb")[dst])
    return df.drop("__nb")


def known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
          forward: bool = False, inclusive: bool = True) -> DataFrame:
    """Last (or, with ``forward``, next) non-null ``value`` seen from each row."""
    keys, order = list(keys), list(order)
    df, many = with_blocks(df, order, keys)
    # Looking ahead is looking back along the reversed order: a frame that grows costs one pass, one that shrinks is quadratic.
    w = W.partitionBy(*keys, *([BLK] if many else [])).orderBy(*_order(order, forward))
    frame = w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    df = df.withColumn(out, F.last(F.col(value), ignorenulls=True).over(frame))
    if many:
        best = F.min_by if forward else F.max_by
        seen = F.when(F.col(value).isNotNull(), F.struct(*order))
        edge = df.groupBy(*keys, BLK).agg(best(F.col(value), seen).alias("__e"))
        wb = W.partitionBy(*keys).orderBy(F.col(BLK).desc() if forward else F.col(BLK).asc())
        edge = edge.withColumn("__e", F.last(F.col("__e"), ignorenulls=True).over(wb.rowsBetween(W.unboundedPreceding, -1)))
        df = _attach(df, edge, keys).withColumn(out, F.coalesce(F.col(out), F.col("__e"))).drop("__e", BLK)
    return df


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                reverse: bool = False) -> DataFrame:
    """Inclusive running sum along the order."""
    keys, order = list(keys), list(order)
    df, many = with_blocks(df, order, keys)
    df = df.withColumn(out, value)
    w = W.partitionBy(*keys, *([BLK] if many else [])).orderBy(*_order(order, reverse))
    frame = w.rowsBetween(W.unboundedPreceding, 0)
    if not many:
        return df.withColumn(out, F.sum(out).over(frame))
    part = df.groupBy(*keys, BLK).agg(F.sum(out).alias("__s"))
    wb = W.partitionBy(*keys).orderBy(F.col(BLK).desc() if reverse else F.col(BLK).asc())
    part = part.withColumn("__s", F.coalesce(F.sum("__s").over(wb.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return _attach(df, part, keys).withColumn(out, F.sum(out).over(frame) + F.col("__s")).drop("__s", BLK)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], times: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per key; a row counts as often as the column ``times`` says (once without)."""
    keys = list(keys)
    often = (F.lit(1) if times is None else F.col(times)).cast("long")
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), often.alias("__m"))
    if is_bounded(src):
        arr = src.groupBy(*keys).agg(F.percentile("__v", [float(p) for p in probs.values()], F.col("__m")).alias("__q"))
        return arr.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(probs)])
    few = _few_groups(src, keys, probs)
    if few is not None:
        return few
    counts = cut_lineage(src.groupBy(*keys, "__v").agg(F.sum("__m").alias("__c")))
    cum = running_sum(counts, keys, ["__v"], F.col("__c"), "__cum")
    total = counts.groupBy(*keys).agg(F.sum("__c").alias("__tot"))
    if keys:
        cum = cum.join(broadcast_if_small(total), keys)
    else:
        n = total.first()["__tot"]
        cum = cum.withColumn("__tot", F.lit(n))
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("__tot") - 1)
        picks += [F.min(F.when(F.col("__cum") > F.floor(at), F.col("__v"))).alias(f"{name}__lo"),
                  F.min(F.when(F.col("__cum") > F.ceil(at), F.col("__v"))).alias(f"{name}__hi"),
                  F.max(at - F.floor(at)).alias(f"{name}__f")]
    got = cum.groupBy(*keys).agg(*picks)
    return got.select(*keys, *[
        (F.col(f"{n}__lo") + (F.col(f"{n}__hi") - F.col(f"{n}__lo")) * F.col(f"{n}__f")).alias(n) for n in probs])


def _few_groups(src: DataFrame, keys: list[str], probs: Mapping[str, float], most: int = 10_000, whole: int = 5000) -> DataFrame | None:
    """Quantiles of few groups of many rows (``__v``, times ``__m``), or None: an approximate quantile a little below and one a little above leave few rows whose ranks are
    counted exactly; a group of up to ``whole`` rows keeps all.  None as well if a rank is not found between them, so the result is always exact."""
    sizes = src.groupBy(*keys).agg(F.sum("__m").alias("__tot"), F.max("__m").alias("__most"), F.count_if(F.isnan("__v")).alias("__nan"))
    sizes = cut_lineage(sizes)
    top = sizes.agg(F.count(F.lit(1)).alias("n"), F.max("__most").alias("m"), F.max("__nan").alias("nan"), F.count_if(reduce(or_, [F.col(k).isNull() for k in keys], F.lit(False))).alias("null")).first()
    if top.n > most or top.m != 1 or top.nan or top.null:
        return None
    out = sizes.select(*keys)
    for name, p in probs.items():
        near = src.groupBy(*keys).agg(F.percentile_approx("__v", [max(0.0, p - 1e-3), min(1.0, p + 1e-3)], 2000).alias("__b"))
        large = F.col("__tot") > whole
        at = F.lit(float(p)) * (F.col("__tot") - 1)
        near = near.join(F.broadcast(sizes), keys) if keys else near.crossJoin(F.broadcast(sizes))
        near = cut_lineage(near.select(*keys, F.when(large, F.col("__b")[0]).alias("__l"), F.when(large, F.col("__b")[1]).alias("__h"), at.alias("__at")))
        rows = src.join(F.broadcast(near), keys) if keys else src.crossJoin(F.broadcast(near))
        under = F.coalesce(F.col("__v") < F.col("__l"), F.lit(False))
        inner = F.when(~under & F.coalesce(F.col("__v") <= F.col("__h"), F.lit(True)), F.col("__v"))
        c = rows.groupBy(*keys, inner.alias("__v")).agg(F.count_if(under).alias("__u"), F.count(F.lit(1)).alias("__c"))
        c = cut_lineage(c)
        under = c.groupBy(*keys).agg(F.sum("__u").alias("__u"))
        cum = running_sum(c.where("__v is not null").drop("__u"), keys, ["__v"], F.col("__c"), "__cum")
        side = F.broadcast(under.join(near.select(*keys, "__at"), keys) if keys else under.crossJoin(near.select("__at")))
        cum = (cum.join(side, keys) if keys else cum.crossJoin(side)).withColumn("__cum", F.col("__cum") + F.col("__u"))
        pick = lambda r: F.min(F.when(F.col("__cum") > r, F.col("__v")))
        lo, hi = pick(F.floor("__at")), pick(F.ceil("__at"))
        ok = (F.max("__u") <= F.floor(F.max("__at"))) & hi.isNotNull()
        got = cut_lineage(cum.groupBy(*keys).agg(lo.alias("__lo"), hi.alias("__hi"), F.max(F.col("__at") - F.floor("__at")).alias("__f"), ok.alias("__ok")))
        if got.where("__ok").count() != top.n:
            return None
        got = got.select(*keys, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias(name))
        out = out.join(F.broadcast(got), keys) if keys else out.crossJoin(got)
    return out.select(*keys, *probs)


def summarise(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column] | None = None,
              quants: Mapping[str, tuple[str, float]] | None = None, times: str | None = None) -> DataFrame:
    """One summary row per key: ordinary aggregates plus exact quantiles ``{name: (column, p)}``, of rows that count ``times`` each."""
    keys, aggs, quants = list(keys), dict(aggs or {}), dict(quants or {})
    if not quants or is_bounded(df):
        both = [c.alias(n) for n, c in aggs.items()]
        cols = list(dict.fromkeys(v for v, _ in quants.values()))      # one value map per column, not per quantile
        at = {v: [p for u, p in quants.values() if u == v] for v in cols}
        often = 1 if times is None else F.col(times).cast("long")
        both += [F.percentile(F.col(v).cast("double"), [float(p) for p in at[v]], often).alias(f"__q_{v}") for v in cols]
        picks = [F.col(f"__q_{v}")[at[v].index(p)].alias(n) for n, (v, p) in quants.items()]
        return df.groupBy(*keys).agg(*both).select(*keys, *aggs, *picks)
    parts = [df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])] if aggs else []
    for col in dict.fromkeys(v for v, _ in quants.values()):
        parts.append(quantiles(df, keys, col, {n: p for n, (v, p) in quants.items() if v == col}, times))
    out = parts[0]
    for nxt in parts[1:]:
        if keys:
            out = out.join(nxt, keys, "left")
        else:                                   # two one-row frames
            out = out.withColumn("__one", F.lit(1)).join(nxt.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return out


def attach_median(df: DataFrame, keys: Sequence[str], value: str, out: str, times: str | None = None) -> DataFrame:
    """Each row with the median of ``value`` of its key (whole-partition frame, no per-key task)."""
    med = quantiles(df, keys, value, {out: 0.5}, times)
    if not keys:
        return df.withColumn("__one", F.lit(1)).join(
            F.broadcast(med.withColumn("__one", F.lit(1))), "__one").drop("__one")
    return df.join(broadcast_if_small(med), list(keys), "left")


def tied_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, total: str | None = None) -> DataFrame:
    """Average rank of ties, 1-based; ranks are taken on distinct values so that a repeated value is one row."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    counts = running_sum(counts, keys, [value], F.col("__c"), "__cum")
    counts = counts.withColumn(out, F.col("__cum") - (F.col("__c") - 1) / 2.0)
    cols = [*keys, value, out]
    if total is not None:
        tot = counts.groupBy(*keys).agg(F.sum("__c").alias(total))
        counts = counts.join(broadcast_if_small(tot), keys) if keys else counts.withColumn(
            total, F.lit(counts.agg(F.sum("__c")).first()[0]))
        cols.append(total)
    return df.join(broadcast_if_small(counts.select(*cols)), [*keys, value], "left")
