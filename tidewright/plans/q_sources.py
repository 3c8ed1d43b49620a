"""Sources and sinks: each query writes a table derived from the given ones to the shared folder and reads it back, or
parses text and JSON built from whole rows."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import work_path
from ..sources import readers as R
from ..sources import sinks as K
from . import standins as S
from .registry import Tables, query
from .standins import r6


@query("src_column_scan", "SRC-01", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders")
def _(t: Tables):
    return R.scan(t.spark, [f"{t.folder}/orders.parquet"], ["o_orderkey", "o_custkey", "o_totalprice"]).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))


@query("src_partitioned_scan", "SRC-02", f"WITH {S.LEVELS} SELECT event_id, cm FROM lv WHERE station = 7")
def _(t: Tables):
    p = work_path(t.spark, "levels")
    S.levels(t).select("event_id", "cm", "station").write.partitionBy("station").parquet(p)
    return R.scan_partitioned(t.spark, p, station=7).select("event_id", "cm")


@query("src_csv_scan", "SRC-03", f"WITH {S.LEVELS}, {S.DAILY} SELECT station, strftime(day, '%Y-%m-%d') AS d, cm FROM dl WHERE n % 3 > 0")
def _(t: Tables):
    p = work_path(t.spark, "daily-csv")
    S.daily(t).select("station", "day", F.when(F.col("n") % 3 > 0, "daily").otherwise("month").alias("stat_type"), "cm").write.option("header", True).csv(p)
    sch = T.StructType([T.StructField("station", T.LongType()), T.StructField("day", T.DateType()), T.StructField("stat_type", T.StringType()), T.StructField("cm", T.DoubleType())])
    return R.scan_csv(t.spark, p, sch, ("stat_type", "daily")).select("station", F.date_format("day", "yyyy-MM-dd").alias("d"), "cm")


#: Words of links that this query's configuration refuses; the third is in capitals and so meets no lower-cased link.
REFUSED = ("opendap", "mirror.example.org/old", "CITING")


def _pages(t: Tables):
    """Catalogue answers: one JSON document per ten orders, links of several kinds per entry."""
    k = F.col("o_orderkey").cast("string")
    link = lambda h, r: F.struct(h.alias("href"), r.alias("rel"))
    base = F.concat(F.lit("https://data.example.org/"), k)
    links = F.array(link(F.concat(base, F.lit(".log")), F.lit("http://x/data#")), link(F.concat(base, F.lit(".zip?x=1")), F.when(F.col("o_custkey") % 2 == 0, "http://x/data#").otherwise("http://x/browse#")),
                    link(F.when(F.col("o_custkey") % 3 == 0, F.concat(base, F.lit(".NC"))).otherwise(F.concat(F.lit("http://plain/"), k, F.lit(".nc"))), F.when(F.col("o_custkey") % 5 == 0, "http://x/data#").otherwise("x")),
                    link(F.concat(F.lit("https://data.example.org/opendap/"), k, F.lit(".nc")), F.lit("http://x/data#")),
                    link(F.concat(F.lit("https://Mirror.example.org/OLD/"), k, F.lit(".nc4")), F.lit("http://x/data#")),
                    link(F.when(F.col("o_custkey") % 11 == 0, F.concat(F.lit("https://data.example.org/citing/"), k, F.lit(".nc4"))).otherwise(F.lit("ftp://x")), F.lit("http://x/data#")))
    e = F.struct(F.concat(F.lit("G_20"), F.date_format("o_orderdate", "yyMMdd"), F.lit("T1_"), k).alias("title"), k.alias("producer_granule_id"),
                 F.when(F.col("o_orderkey") % 4 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")).alias("time_start"), F.when(F.col("o_custkey") % 7 > 0, links).alias("links"))
    return t.orders.groupBy(F.floor(F.col("o_orderkey") / 10).alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(e).alias("entry")).alias("feed"))).alias("doc"))


_URL = """CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 11 = 0 AND NOT (o_custkey % 3 = 0 AND o_custkey % 5 = 0) THEN 'https://data.example.org/citing/' || o_orderkey || '.nc4' WHEN o_custkey % 3 = 0 AND o_custkey % 5 = 0 THEN 'https://data.example.org/' || o_orderkey || '.NC' WHEN o_custkey % 2 = 0 THEN 'https://data.example.org/' || o_orderkey || '.zip?x=1'
 WHEN o_custkey % 3 = 0 THEN 'https://data.example.org/' || o_orderkey || '.NC' ELSE 'https://data.example.org/' || o_orderkey || '.zip?x=1' END"""


@query("src_catalogue_links", "SRC-04 SRC-05 SRC-09 M14", f"""SELECT CAST(o_orderkey AS VARCHAR) AS gid, {_URL} AS url, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y') ELSE '20' || strftime(o_orderdate, '%y') END AS yr, strftime(o_orderdate, '%m') AS mo FROM orders""")
def _(t: Tables):
    docs = _pages(t).select(F.from_json("doc", R.PAGE_SCHEMA).alias("p")).select("p.*")
    e = R.explode_pages(docs)
    y, m = X.year_month(F.col("time_start"), F.col("title"))
    u = R.best_link(e, "producer_granule_id", REFUSED)
    return e.select("producer_granule_id", y.alias("yr"), m.alias("mo")).join(u, "producer_granule_id").select(F.col("producer_granule_id").alias("gid"), F.coalesce("download_url", F.lit("")).alias("url"), "yr", "mo")


@query("src_catalogue_files", "SRC-04", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def _(t: Tables):
    p = work_path(t.spark, "pages")
    _pages(t).select(F.col("doc").alias("value")).repartition(4).write.text(p)
    e = R.explode_pages(t.spark.read.schema(R.PAGE_SCHEMA).json(p))
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("producer_granule_id").cast("long")).alias("keys"))


@query("src_area_rings", "SRC-06 SRC-07 M10", """SELECT r_regionkey AS domain, 5 AS n, CAST(r_regionkey * 20 AS DOUBLE) AS w, 0.0::DOUBLE AS s, CAST(r_regionkey * 20 + 15 AS DOUBLE) AS e, 60.0::DOUBLE AS nn FROM region""")
def _(t: Tables):
    lo = F.col("r_regionkey") * 20
    pt = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    ring = F.array(pt(lo, F.lit(0)), pt(lo + 15, F.lit(0)), pt(lo + 15, F.lit(60)), pt(lo, F.lit(60)), pt(lo, F.lit(0)))
    single, multi = F.to_json(F.array(ring)), F.to_json(F.array(F.array(ring)))
    kind = F.when(F.col("r_regionkey") % 2 == 0, "Polygon").otherwise("MultiPolygon")
    geom = F.struct(kind.alias("type"), F.when(F.col("r_regionkey") % 2 == 0, single).otherwise(multi).alias("coordinates"))
    doc = F.to_json(F.struct(F.array(F.struct(geom.alias("geometry"))).alias("features")))
    r = R.rings(t.region.select("r_regionkey", doc.alias("doc")), "doc", "r_regionkey")
    return R.bbox(r).join(r.groupBy("domain").agg(F.count(F.lit(1)).cast("int").alias("cnt")), "domain").select("domain", F.col("cnt").alias("n"), "w", "s", "e", F.col("n").alias("nn"))


@query("src_yearbook_block", "SRC-10 SRC-11", f"WITH {S.LEVELS}, {S.DAILY} SELECT station, 1 AS month, CAST(dayofmonth(day) AS INTEGER) AS day, cm AS value FROM dl")
def _(t: Tables):
    d = S.daily(t).withColumn("dd", F.dayofmonth("day"))
    rows = d.select("station", (F.col("dd") + 1).alias("line"), F.array(F.col("dd").cast("string"), F.lit(""), F.translate(F.format_string("%.1f", "cm"), ".", ","), F.lit("-")).alias("cols"))
    st = d.select("station").distinct()
    head = st.select("station", F.lit(1).alias("line"), F.array(F.lit("Day"), F.lit(""), F.lit("I"), F.lit("II")).alias("cols"))
    tail = st.select("station", F.explode(F.array(F.lit(40), F.lit(41))).alias("line"), F.array(F.lit("decade"), F.lit(""), F.lit("1"), F.lit("2")).alias("cols"))
    x = R.unpivot_block(head.unionByName(rows).unionByName(tail), "station", "I", "Day", {"I": 1, "II": 2}, "decade")
    return x.where("value is not null").select("station", "month", "day", "value")


@query("src_printed_page", "SRC-12 SRC-13", f"WITH {S.LEVELS}, {S.DAILY} SELECT station, CAST(dayofmonth(day) AS INTEGER) AS day, cm AS value, CASE WHEN n % 4 = 0 THEN 'i' ELSE '' END AS flag FROM dl")
def _(t: Tables):
    d = S.daily(t).withColumn("dd", F.dayofmonth("day")).withColumn("mon", F.when(F.col("station") % 2 == 0, 1).otherwise(2))
    cell = F.concat(F.translate(F.format_string("%.1f", "cm"), ".", ","), F.when(F.col("n") % 4 == 0, "i").otherwise(""))
    line = F.concat(F.lpad("dd", 4, " "), F.when(F.col("mon") == 1, F.lpad(cell, 12, " ")).otherwise(F.lpad(cell, 24, " ")))
    body = d.select("station", F.col("dd").alias("line"), line.alias("text"))
    head = d.select("station").distinct().select("station", F.lit(0).alias("line"), F.concat(F.lpad(F.lit("D"), 4, " "), F.lpad(F.lit("M1"), 11, " "), F.lpad(F.lit("M2"), 12, " ")).alias("text"))
    g = R.page_grid(head.unionByName(body), "station", "text", "^(D|M1|M2)$")
    return g.where("head <> 'D'").select("station", F.col("line").alias("day"), "value", "flag")


@query("src_page_check", "SRC-13", f"WITH {S.LEVELS}, {S.DAILY}, m AS (SELECT station, avg(cm) AS a, max(cm) AS hi, min(cm) AS lo FROM dl GROUP BY 1) SELECT station, CASE WHEN station % 4 = 0 THEN 'mean' ELSE '' END AS problems FROM m")
def _(t: Tables):
    m = S.daily(t).groupBy("station").agg(F.avg("cm").alias("a"), F.max("cm").alias("hi"), F.min("cm").alias("lo"))
    printed = m.select("station", (F.col("a") + F.when(F.col("station") % 4 == 0, 3).otherwise(0)).alias("pa"), F.col("hi").alias("ph"), F.col("lo").alias("pl"))
    from ..functions.rules import reasons
    j = m.join(printed, "station")
    bad = reasons({"mean": F.abs(F.col("a") - F.col("pa")) > 1, "max": F.abs(F.col("hi") - F.col("ph")) > 0.5, "min": F.abs(F.col("lo") - F.col("pl")) > 0.5})
    return j.select("station", F.array_join(bad, "|").alias("problems"))


@query("src_whitespace_records", "SRC-14", f"WITH {S.LEVELS} SELECT event_id, strftime(day, '%Y/%m/%d') AS d, CAST(cm AS VARCHAR) AS h FROM lv WHERE event_id % 6 <> 0 AND event_id % 5 <> 0")
def _(t: Tables):
    d = S.levels(t)
    e = F.col("event_id")
    day = F.when(e % 6 == 0, "9999/99/99").otherwise(F.date_format("day", "yyyy/MM/dd"))
    line = F.concat(F.lit("  "), day, F.lit("   "), F.date_format(F.timestamp_micros("us"), "HH:mm"), F.when(e % 5 != 0, F.concat(F.lit(" \t"), F.col("cm").cast("string"))).otherwise(""))
    return R.whitespace_records(d.select("event_id", line.alias("line")), "line", ["d", "hm", "h"], "9999").select("event_id", "d", "h")


@query("src_file_inventory", "SRC-16 AGG-51 SNK-04", None)
def _(t: Tables):
    p = work_path(t.spark, "inventory")
    # a language's texts are dealt over several files, so that the largest one is not a single task's
    t.documents.select(F.col("text").alias("value"), "lang", "doc_id").repartition("lang", F.pmod(F.xxhash64("doc_id"), F.lit(8))).drop("doc_id").write.partitionBy("lang").text(p)
    inv = R.inventory(t.spark, p, {"lang=en": "english", "lang=": "other_language"}, 64 * 1024 * 1024)
    return inv.select("family", "length", F.length("sha").alias("hash_digits")).where("length > 0")


@query("src_missing_granules", "SRC-18", """SELECT doc_id FROM documents WHERE doc_id % 5 IN (0, 1, 2)""")
def _(t: Tables):
    d = t.documents.select("doc_id", "n_chars")
    stem = F.concat(F.lit("g"), F.col("doc_id").cast("string"))
    e = F.col("doc_id") % 5
    tail = F.when(e == 0, ".log").when(e == 1, ".shp:Zone.Identifier").otherwise(".nc")
    files = d.select(F.concat(F.lit("/x/"), stem, tail).alias("path"), F.when(e == 2, 0).otherwise(F.col("n_chars")).alias("length"))
    return R.missing_granules(d.select("doc_id", stem.alias("stem")), files).select("doc_id")


@query("snk_replace_slice", "SNK-01 SNK-02", """WITH old AS (SELECT o_custkey % 10 AS area, o_orderkey AS title, 0 AS gen FROM orders WHERE o_orderkey % 3 > 0), new AS (SELECT o_custkey % 10 AS area, o_orderkey AS title, 1 AS gen FROM orders WHERE o_custkey % 10 < 3) SELECT * FROM new UNION ALL SELECT * FROM old WHERE area NOT IN (SELECT area FROM new)""")
def _(t: Tables):
    base = t.orders.select((F.col("o_custkey") % 10).alias("area"), F.col("o_orderkey").alias("title"))
    return K.replace_slice(base.where("title % 3 > 0").withColumn("gen", F.lit(0)), base.where("area < 3").withColumn("gen", F.lit(1)), ["area"])


@query("snk_written_slices", "SNK-01", """WITH old AS (SELECT o_custkey % 10 AS area, o_orderkey AS title, 0 AS gen FROM orders WHERE o_orderkey % 3 > 0), new AS (SELECT o_custkey % 10 AS area, o_orderkey AS title, 1 AS gen FROM orders WHERE o_custkey % 10 < 3) SELECT CAST(area AS INTEGER) AS area, title, gen FROM new UNION ALL SELECT CAST(area AS INTEGER), title, gen FROM old WHERE area NOT IN (SELECT area FROM new)""")
def _(t: Tables):
    p = work_path(t.spark, "index")
    base = t.orders.select((F.col("o_custkey") % 10).alias("area"), F.col("o_orderkey").alias("title"))
    K.write_slices(base.where("title % 3 > 0").withColumn("gen", F.lit(0)), p, ["area"], p + "-csv")
    for _ in range(2):        # a replay changes nothing
        K.write_slices(base.where("area < 3").withColumn("gen", F.lit(1)), p, ["area"], p + "-csv")
    return t.spark.read.parquet(p).select("area", "title", "gen")


@query("snk_index_rows", "SNK-02", """SELECT o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS downloaded, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 10 END, -1) AS bytes, coalesce(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'HTTP 403' END, '') AS error FROM orders""")
def _(t: Tables):
    k = F.col("o_orderkey")
    res = t.orders.where(k % 3 == 0).select(k.alias("title"), (k % 2 == 0).alias("ok"), F.lit("/x").alias("local_path"), (F.col("o_custkey") * 10).alias("bytes"), F.lit(200).alias("http_status"), F.when(k % 2 == 1, "HTTP 403").alias("error"))
    i = K.index_rows(t.orders.select(k.alias("title")), res, "title")
    return i.select("title", F.col("downloaded").cast("int").alias("downloaded"), F.coalesce("bytes", F.lit(-1)).alias("bytes"), F.coalesce("error", F.lit("")).alias("error"))


@query("snk_manifest", "SNK-03", None)
def _(t: Tables):
    return K.manifest(S.daily(t), source="events", rule="station-day mean")
