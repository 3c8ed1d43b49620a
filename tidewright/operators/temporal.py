"""Alignment in time: as-of, brackets, spines, runs and regimes.  All forms use ordered passes over the union of
both series (never a cross join), and the passes are block-safe for hot stations."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B


def _sec(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp")) / 1e6


def bracket(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, value: str,
            left_id: str, same_counts: bool = True) -> DataFrame:
    """For each left row the right rows just before and just after it: ``before_t, before_v, after_t, after_v``.

    ``left_on``/``right_on`` are numeric (or any ordered) columns of the same type.  A right row at the same
    instant counts as both unless ``same_counts`` is off.
    """
    by = list(by)
    side_l, side_r = (1, 0) if same_counts else (0, 1)
    lt = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.col(left_id).alias("__id"),
                     F.lit(None).cast("double").alias("__v"))
    rt = right.select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"),
                      F.lit(None).cast(dict(left.dtypes)[left_id]).alias("__id"), F.col(value).cast("double").alias("__v"))
    both = lt.unionByName(rt).withColumn("__pt", F.when(F.col("__side") == 0, F.struct("__t", "__v")))
    both = both.withColumn("__o1", F.when(F.col("__side") == 1, side_l).otherwise(side_r))
    both = both.withColumn("__o2", F.when(F.col("__side") == 1, 1 - side_l).otherwise(1 - side_r))
    both = B.known(both, by, ["__t", "__o1", "__id"], "__pt", "__before")
    both = B.known(both, by, ["__t", "__o2", "__id"], "__pt", "__after", forward=True)
    got = both.where("__side = 1").select(
        F.col("__id").alias(left_id), F.col("__before")["__t"].alias("before_t"),
        F.col("__before")["__v"].alias("before_v"), F.col("__after")["__t"].alias("after_t"),
        F.col("__after")["__v"].alias("after_v"))
    return left.join(got, left_id, "left")


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, value: str,
                 left_id: str, tolerance: float | None = None) -> DataFrame:
    """Nearest right value in either direction; ties go to the earlier one; beyond the tolerance is NULL."""
    br = bracket(left, right, by, left_on, right_on, value, left_id)
    db, da = F.col(left_on) - F.col("before_t"), F.col("after_t") - F.col(left_on)
    back = F.col("before_t").isNotNull() & (F.col("after_t").isNull() | (db <= da))
    gap = F.when(back, db).otherwise(da)
    ok = gap.isNotNull() if tolerance is None else gap <= tolerance
    return br.select(*left.columns, F.when(ok, F.when(back, F.col("before_v")).otherwise(F.col("after_v"))).alias("match"),
                     F.when(ok, gap).alias("gap"))


def linear(br: DataFrame, at: str, out: str, max_gap: float | None = None) -> DataFrame:
    """Linear value between the brackets of ``bracket``; NULL outside them or when they are too far apart."""
    span = F.col("after_t") - F.col("before_t")
    value = F.when(span == 0, F.col("before_v")).otherwise(
        F.col("before_v") + (F.col("after_v") - F.col("before_v")) * (F.col(at) - F.col("before_t")) / span)
    ok = span.isNotNull() if max_gap is None else span <= max_gap
    return br.withColumn(out, F.when(ok, value))


def flat_linear(br: DataFrame, at: str, out: str) -> DataFrame:
    """As ``linear`` but flat beyond the first and last knot, with an extrapolation flag."""
    br = linear(br, at, out)
    br = br.withColumn(out, F.coalesce(F.col(out), F.col("before_v"), F.col("after_v")))
    return br.withColumn("extrapolated", F.col("before_t").isNull() | F.col("after_t").isNull())


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, run: str = "run") -> DataFrame:
    """Id of each run of identical values; a missing value is a run of its own kind."""
    df = B.neighbour(df, keys, order, {"__prev": value, "__first": order[0]})
    start = F.col("__first").isNull() | ~F.col("__prev").eqNullSafe(F.col(value))
    return B.running_sum(df, keys, order, start.cast("int"), run).drop("__prev", "__first")


def flag_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, at_least: int, out: str) -> DataFrame:
    """True where a value repeats for at least n consecutive rows.  Runs are counted by aggregate and joined back."""
    keys = list(keys)
    df = runs(df, keys, order, value)
    size = df.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("run_len")).where(F.col("run_len") >= at_least)
    df = df.join(B.broadcast_if_small(size), [*keys, "run"], "left")
    return df.withColumn(out, F.col("run_len").isNotNull() & F.col(value).isNotNull()).drop("run_len")


def daily_spine(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Every calendar day between each key's first and last."""
    ends = df.groupBy(*keys).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    return ends.select(*keys, F.explode(F.sequence("__a", "__b")).alias(day))


def regimes(daily: DataFrame, keys: Sequence[str], day: str, level: str, onset: str, max_gap_days: int = 3,
            rate: float = 0.20, loss: float = 0.50, flat_run: int = 4) -> DataFrame:
    """Hydraulic regime of each station day.

    Before the onset date the reservoir is impounded.  After it a fall faster than ``rate`` per day is active
    drawdown until the record first breaks for more than ``max_gap_days``; once ``loss`` metres are gone a pause is
    a transition if the next days stay flat (up to three are examined), else unresolved.  Long runs of one value
    are unresolved because a stuck float cannot be told from a floor.
    """
    keys = list(keys)
    order = [day]
    df = B.neighbour(daily, keys, order, {"p_day": day, "p_level": level})
    df = df.withColumn("gap", F.coalesce(F.datediff(day, "p_day"), F.lit(1)))
    df = df.withColumn("step", F.col(level) - F.col("p_level"))
    after = F.col(day) > F.to_date(F.lit(onset))
    df = B.running_sum(df, keys, order, (after & (F.col("gap") > max_gap_days)).cast("int"), "breaks")
    falling = after & (F.col("breaks") == 0) & F.coalesce(F.col("step") < -rate, F.lit(False))
    df = B.running_sum(df, keys, order, F.when(falling, -F.col("step")).otherwise(0.0), "lost")
    for i in (1, 2, 3):
        src = {f"n{i}_level": level, f"n{i}_gap": "gap"} if i == 1 else {
            f"n{i}_level": f"n{i-1}_level", f"n{i}_gap": f"n{i-1}_gap"}
        df = B.neighbour(df, keys, order, src, step=1)
    calm = F.lit(True)
    for i in (1, 2, 3):
        ok = (F.abs(F.col(f"n{i}_level") - F.col(level)) < rate) & (F.col(f"n{i}_gap") <= max_gap_days)
        calm = calm & F.when(F.col(f"n{i}_level").isNull(), F.lit(i > 2)).otherwise(ok)
    spent = F.col("lost") >= loss
    state = (
        F.when(F.col(day) < F.to_date(F.lit(onset)), "PREBREACH_IMPOUNDED")
        .when(F.col(day) == F.to_date(F.lit(onset)), "BREACH_ONSET")
        .when(F.col("gap") > max_gap_days, "REGIME_UNRESOLVED")
        .when(falling, "ACTIVE_DRAWDOWN")
        .when((F.col("breaks") == 0) & spent, F.when(calm, "POSTBREACH_TRANSITION").otherwise("REGIME_UNRESOLVED"))
        .when(spent, "POSTBREACH_TRANSITION")
        .otherwise("REGIME_UNRESOLVED"))
    df = df.withColumn("regime", state).withColumn("flat", F.coalesce(F.col("step") == 0, F.lit(False)).cast("int"))
    df = runs(df, keys, order, "flat")
    long = df.where("flat = 1").groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("__len")).where(
        F.col("__len") >= flat_run)
    df = df.join(B.broadcast_if_small(long), [*keys, "run"], "left")
    df = df.withColumn("regime", F.when(F.col("__len").isNotNull() & (F.col("flat") == 1), "REGIME_UNRESOLVED")
                       .otherwise(F.col("regime")))
    return df.select(*keys, day, level, F.col("step").alias("rate"), "lost", "regime")


def split_at_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], along: str, gap: float) -> DataFrame:
    """Piece number that grows at each step longer than ``gap``, and the step itself."""
    df = B.neighbour(df, keys, order, {"__p": along})
    df = df.withColumn("step", F.coalesce(F.abs(F.col(along) - F.col("__p")), F.lit(0.0)))
    df = B.running_sum(df, keys, order, (F.col("step") > gap).cast("int"), "piece")
    return df.withColumn("step", F.when(F.col("step") > gap, 0.0).otherwise(F.col("step"))).drop("__p")
