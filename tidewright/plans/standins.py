"""Stand-ins: each reference input derived from the given tables by integer arithmetic, once for Spark and once as a SQL
text for the twin.  All rows are used."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frame import METRIC, in_frame
from .registry import Tables

r6 = lambda c: F.round(c, 6)


def levels(t: Tables) -> DataFrame:
    """Timed level readings: 25 stations, centimetres and metres."""
    ts = F.col("ts").cast("timestamp")
    return t.events.select(
        "event_id", (F.col("user_id") % 25).alias("station"), "user_id", "event_type", F.unix_micros(ts).alias("us"),
        F.to_date(ts).alias("day"), F.hour(ts).alias("hr"), F.col("value").alias("cm"), (F.col("value") / 100).alias("m"))


LEVELS = """lv AS (SELECT event_id, user_id % 25 AS station, user_id, event_type, epoch_us(ts) AS us, CAST(ts AS DATE) AS day,
 hour(ts) AS hr, value AS cm, value / 100 AS m FROM events)"""


def daily(t: Tables, of: str = "station") -> DataFrame:
    """Station-day mean level, rounded to the printed precision (millimetres) as a yearbook is.

    ``of="user_id"`` takes every observer as a station of its own: such a series has days without a reading."""
    return levels(t).groupBy(F.col(of).alias("station"), "day").agg(
        F.sum(F.round(F.col("cm") * 100).cast("long")).alias("s"), F.count(F.lit(1)).alias("n")).select(
        "station", "day", (F.floor(F.col("s") / F.col("n") / 10 + 0.5) / 10).alias("cm"), "n")


DAILY = "dl AS (SELECT station, day, floor(sum(CAST(round(cm*100) AS BIGINT)) / count(*) / 10 + 0.5) / 10 AS cm, count(*) AS n FROM lv GROUP BY 1, 2)"


OBSERVER_DAILY = DAILY.replace("SELECT station, day", "SELECT user_id AS station, day")


def points(t: Tables) -> DataFrame:
    """Profile points: overpass = day, chainage 0..239.9 km, height in metres, track, season half."""
    return levels(t).select("event_id", "day", (F.col("event_id") * 7 % 2400 / 10).alias("chain"), (F.col("cm") / 100).alias("h"),
                            (F.dayofmonth("day") % 9).alias("track"),
                            F.when(F.col("day") < F.to_date(F.lit("2024-01-16")), 0).otherwise(1).alias("post"))


POINTS = """pt AS (SELECT event_id, day, (event_id * 7 % 2400) / 10 AS chain, cm / 100 AS h, dayofmonth(day) % 9 AS track,
 CASE WHEN day < DATE '2024-01-16' THEN 0 ELSE 1 END AS post FROM lv)"""


def sensor(t: Tables, kind: str, prefix: str) -> DataFrame:
    """Altimeter A (views) or B (clicks): metric position, time in days, height."""
    e = levels(t).where(F.col("event_type") == kind)
    e = e.select(F.col("event_id").alias(f"{prefix}id"), (F.col("event_id") * 7919 % 100000).cast("double").alias(f"{prefix}x"),
                    (F.col("event_id") * 104729 % 100000).cast("double").alias(f"{prefix}y"), F.col("us").alias(f"{prefix}us"),
                    F.col("m").alias(f"{prefix}h"), F.col("day").alias(f"{prefix}day"))
    return in_frame(e, METRIC, f"{prefix}x", f"{prefix}y")


SENSORS = """sa AS (SELECT event_id AS aid, CAST(event_id * 7919 % 100000 AS DOUBLE) AS ax, CAST(event_id * 104729 % 100000 AS DOUBLE) AS ay,
 us AS aus, m AS ah, day AS aday FROM lv WHERE event_type = 'view'),
 sb AS (SELECT event_id AS bid, CAST(event_id * 7919 % 100000 AS DOUBLE) AS bx, CAST(event_id * 104729 % 100000 AS DOUBLE) AS by_,
 us AS bus, m AS bh, day AS bday FROM lv WHERE event_type = 'click')"""


def cells(t: Tables) -> DataFrame:
    """Dated cell table: a long strip, part along it and supplier across; class is the line number, unseen where the
    return flag is N; bands are scaled prices, so every index varies."""
    l = t.lineitem
    seen = F.col("l_returnflag") != "N"
    ts = F.col("l_shipdate").cast("timestamp")
    return l.select(
        F.col("l_partkey").alias("row"), (F.col("l_suppkey") % 10).alias("col"), F.to_date(ts).alias("day"),
        F.year(ts).alias("year"), F.when(seen, F.col("l_linenumber")).alias("cls"),
        F.when(seen, (F.col("l_linestatus") == "O").cast("int")).alias("water"),
        (F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(12))).cast("int").alias("scl"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("qty"),
        "l_orderkey", "l_linenumber")


CELLS = """cl AS (SELECT l_partkey AS row, l_suppkey % 10 AS col, CAST(l_shipdate AS DATE) AS day, year(l_shipdate) AS year,
 CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS cls,
 CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END END AS water,
 CAST((l_orderkey + l_linenumber) % 12 AS INTEGER) AS scl, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
 CAST(l_quantity AS BIGINT) AS qty, l_orderkey, l_linenumber FROM lineitem)"""


def bands(t: Tables) -> DataFrame:
    """Reflectances between 0 and 1 by integer remainders of the price in cents."""
    c = cells(t)
    b = lambda m, k: (F.pmod(F.col("cents") + k * F.col("qty"), F.lit(m)) / F.lit(1000.0))
    return c.withColumn("b02", b(211, 1)).withColumn("b03", b(307, 3)).withColumn("b04", b(401, 5)).withColumn(
        "b08", b(503, 7)).withColumn("b11", b(601, 11)).withColumn("b12", b(701, 13))


BANDS = CELLS + """, bd AS (SELECT *, (cents + qty) % 211 / 1000.0::DOUBLE AS b02, (cents + 3 * qty) % 307 / 1000.0::DOUBLE AS b03,
 (cents + 5 * qty) % 401 / 1000.0::DOUBLE AS b04, (cents + 7 * qty) % 503 / 1000.0::DOUBLE AS b08,
 (cents + 11 * qty) % 601 / 1000.0::DOUBLE AS b11, (cents + 13 * qty) % 701 / 1000.0::DOUBLE AS b12 FROM cl)"""


def mask(t: Tables) -> DataFrame:
    """One wet mask over the strip: cells whose observed dates are mostly water."""
    g = cells(t).groupBy("row", "col").agg(F.count("water").alias("n"), F.sum("water").alias("w"))
    return g.where("w * 2 > n").select("row", "col")


MASK = CELLS + ", mk AS MATERIALIZED (SELECT row, col FROM cl GROUP BY 1, 2 HAVING sum(water) * 2 > count(water))"


def assets(t: Tables) -> DataFrame:
    """Image assets: order = asset, seven orbits, order status as the pass direction."""
    ts = F.col("o_orderdate").cast("timestamp")
    return t.orders.select("o_orderkey", F.to_date(ts).alias("day"), (F.col("o_custkey") % 7).alias("orbit"),
                           F.col("o_orderstatus").alias("state"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
                           F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"))


ASSETS = """ast AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_custkey % 7 AS orbit, o_orderstatus AS state,
 CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio FROM orders)"""


def axis(t: Tables) -> DataFrame:
    """River axis: one node per part, 100 m apart along x, swinging between 0 and 10 km in y."""
    k = F.col("p_partkey")
    a = t.part.select(k.alias("node_id"), (k * 100 % 100000).cast("double").alias("bx"),
                         (F.abs(F.pmod(k * 37, F.lit(20000)) - 10000)).cast("double").alias("by"), (k / 10).alias("chain"))
    return in_frame(a, METRIC, "bx", "by")


AXIS = """ax AS (SELECT p_partkey AS node_id, CAST(p_partkey * 100 % 100000 AS DOUBLE) AS bx,
 CAST(abs(p_partkey * 37 % 20000 - 10000) AS DOUBLE) AS by_, p_partkey / 10 AS chain FROM part)"""


def soundings(t: Tables) -> DataFrame:
    """Depth points: spread positions in metres and a depth from the quantity."""
    l = t.lineitem
    u = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    d = l.select(u.alias("sid"), "l_orderkey", "l_linenumber", (F.col("l_partkey") * 7919 % 50021).cast("double").alias("x"),
                    ((F.col("l_suppkey") * 104729 + F.col("l_partkey") * 31) % 50021).cast("double").alias("y"),
                    F.col("l_quantity").alias("z"), F.round(F.col("l_tax") * 100).cast("long").alias("src"))
    return in_frame(d, METRIC, "x", "y")


SOUNDINGS = """sd AS (SELECT l_orderkey * 8 + l_linenumber AS sid, l_orderkey, l_linenumber, CAST(l_partkey * 7919 % 50021 AS DOUBLE) AS x,
 CAST((l_suppkey * 104729 + l_partkey * 31) % 50021 AS DOUBLE) AS y, l_quantity AS z, CAST(round(l_tax * 100) AS BIGINT) AS src FROM lineitem)"""


def zone_rings(t: Tables) -> DataFrame:
    """One rectangle per region, 20 km wide and disjoint, plus a notch that makes region 0 an L."""
    k = F.col("r_regionkey")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lo, hi = k * 20000, k * 20000 + 15000
    rect = F.array(corner(lo, F.lit(0)), corner(hi, F.lit(0)), corner(hi, F.lit(60000)), corner(lo, F.lit(60000)))
    ell = F.array(corner(lo, F.lit(0)), corner(hi, F.lit(0)), corner(hi, F.lit(30000)), corner(lo + 7000, F.lit(30000)),
                  corner(lo + 7000, F.lit(60000)), corner(lo, F.lit(60000)))
    d = t.region.select(k.alias("domain"), F.posexplode(F.when(k == 0, ell).otherwise(rect)).alias("seq", "v"))
    return in_frame(d.select("domain", F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq", "v.x", "v.y"), METRIC, "x", "y")


# The same zones as half-open tests, for the twin: no point of the fixture lies on a border except at x or y = 0.
ZONE_OF = """CASE WHEN {x} >= 0 AND {y} >= 0 AND {y} < 60000 THEN CASE WHEN {x} < 20000 THEN
 CASE WHEN ({y} < 30000 AND {x} < 15000) OR {x} < 7000 THEN 0 END ELSE
 CASE WHEN CAST({x} AS BIGINT) % 20000 < 15000 AND {x} < 100000 THEN CAST({x} AS BIGINT) // 20000 END END END"""
