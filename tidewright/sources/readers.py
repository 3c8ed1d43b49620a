"""Scans with declared schemas and pruned columns, and the readers of text and JSON layouts."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schema import clean_doubles, conform


def scan(spark: SparkSession, paths: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Parquet files read as one table; only ``cols`` reach the scan; NaN becomes NULL."""
    df = spark.read.parquet(*paths)
    return clean_doubles(df.select(*cols) if cols else df)


def scan_partitioned(spark: SparkSession, root: str, **equal) -> DataFrame:
    """Hive-style partitions ``key=value``; equality on partition columns prunes directories."""
    df = spark.read.parquet(root)
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    return clean_doubles(df)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, row_type: tuple[str, str] | None = None,
             date_format: str = "yyyy-MM-dd") -> DataFrame:
    df = spark.read.csv(path, schema=schema, header=True, dateFormat=date_format, mode="PERMISSIVE")
    return df.where(F.col(row_type[0]) == row_type[1]) if row_type else df


ENTRY_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("producer_granule_id", T.StringType()),
    T.StructField("time_start", T.StringType()), T.StructField("time_end", T.StringType()),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("rel", T.StringType())]))),
    T.StructField("polygons", T.ArrayType(T.ArrayType(T.StringType()))),
])
PAGE_SCHEMA = T.StructType([T.StructField("feed", T.StructType([T.StructField("entry", T.ArrayType(ENTRY_SCHEMA))]))])


def catalogue_pages(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue answer pages, one document per file, to one row per entry."""
    return explode_pages(spark.read.schema(PAGE_SCHEMA).json(path, multiLine=True))


def explode_pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("feed.entry").alias("e")).select("e.*")


def best_link(entries: DataFrame, key: str, refused: Sequence[str]) -> DataFrame:
    """Highest positive link score per entry, first one on ties; entries without a data link keep NULL.  ``refused``: words that rule a link out."""
    e = entries.select(key, F.posexplode_outer("links").alias("i", "l"))
    s = e.withColumn("score", F.when(F.col("l").isNotNull(), X.link_score(F.col("l.href"), F.col("l.rel"), refused)))
    good = F.when(F.col("score") > 0, F.struct("score", -F.col("i")))
    return s.groupBy(key).agg(F.max_by("l.href", good).alias("download_url"))


GEOMETRY_SCHEMA = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"


def rings(docs: DataFrame, json_col: str, domain: str) -> DataFrame:
    """GeoJSON text to ring vertices ``domain, part, ring, seq, x, y``; an empty area is an error."""
    d = docs.select(domain, F.from_json(json_col, GEOMETRY_SCHEMA).alias("g"))
    d = d.withColumn("f", F.explode(F.when(F.size("g.features") > 0, F.col("g.features")).otherwise(
        F.raise_error(F.concat(F.lit("area file has no feature: "), F.col(domain).cast("string"))))))
    geom = F.col("f.geometry.coordinates")
    multi = F.from_json(geom, "array<array<array<array<double>>>>")
    single = F.array(F.from_json(geom, "array<array<array<double>>>"))
    d = d.withColumn("parts", F.when(F.col("f.geometry.type") == "MultiPolygon", multi).otherwise(single))
    d = d.select(domain, F.posexplode("parts").alias("part", "p")).select(domain, "part", F.posexplode("p").alias("ring", "r"))
    return d.select(F.col(domain).alias("domain"), "part", "ring", F.posexplode("r").alias("seq", "v")).select(
        "domain", "part", "ring", "seq", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def bbox(ring_df: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    return ring_df.groupBy(*keys).agg(F.min("x").alias("w"), F.min("y").alias("s"), F.max("x").alias("e"), F.max("y").alias("n"))


def whitespace_records(lines: DataFrame, col: str, names: Sequence[str], sentinel: str) -> DataFrame:
    """Whitespace-separated records; short lines and sentinel dates are dropped."""
    p = F.split(F.trim(col), r"\s+")
    d = lines.withColumn("__p", p).where((F.size("__p") >= len(names)) & ~F.col("__p")[0].startswith(sentinel))
    return d.select(*[c for c in lines.columns if c != col], *[F.col("__p")[i].alias(n) for i, n in enumerate(names)])


def unpivot_block(cells: DataFrame, doc: str, header: str, day: str, months: Mapping[str, int], stop: str) -> DataFrame:
    """Yearbook block: a header line places the months, day lines follow in order until the summary line.

    ``cells`` has ``doc, line, cols`` (array of cell texts).  The header's column of each month is found by name, so
    both printed layouts read the same."""
    names = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])
    c = cells.withColumn("is_head", F.array_contains("cols", header)).withColumn("is_stop", F.col("cols")[0].startswith(stop))
    span = c.groupBy(doc).agg(F.min(F.when(F.col("is_head"), F.col("line"))).alias("h"),
                              F.min(F.when(F.col("is_stop"), F.col("line"))).alias("e"),
                              F.min_by("cols", F.when(F.col("is_head"), F.col("line"))).alias("heads"))
    rows = c.join(span, doc).where((F.col("line") > F.col("h")) & (F.col("line") < F.coalesce("e", F.lit(2**31 - 1))))
    rows = rows.withColumn("day", F.regexp_extract(F.col("cols")[0], r"^(\d{1,2})$", 1).try_cast("int")).where("day is not null")
    x = rows.select(doc, "day", "heads", F.posexplode("cols").alias("i", "raw"))
    x = x.withColumn("month", F.try_element_at(names, F.try_element_at(F.col("heads"), F.col("i") + 1)))
    num, flag = X.locale_number(F.col("raw"))
    return x.where("month is not null").select(doc, "month", "day", num.alias("value"), flag.alias("flag"))


def page_grid(lines: DataFrame, doc: str, col: str, header_rule: str) -> DataFrame:
    """Printed page: tokens go to the header whose centre is nearest, if within half the header spacing.

    ``lines`` has ``doc, line, text``.  Token offsets come from the running length of the pieces of a split."""
    split = F.regexp_extract_all(F.col(col), F.lit(r"(\s*\S+)"), 1)
    t = lines.select(doc, "line", F.posexplode(split).alias("i", "piece"), split.alias("all"))
    before = F.aggregate(F.slice("all", F.lit(1), F.col("i")), F.lit(0), lambda a, s: a + F.length(s))
    tok = F.trim(F.col("piece"))
    t = t.select(doc, "line", tok.alias("token"), (before + F.length("piece") - F.length(tok) / 2.0).alias("centre"))
    is_head = F.col("token").rlike(header_rule)
    heads = t.where(is_head).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("centre", "token"))).alias("hs"))
    body = t.where(~is_head).join(heads, doc)
    gap = (F.element_at("hs", -1)["centre"] - F.element_at("hs", 1)["centre"]) / F.greatest(F.size("hs") - 1, F.lit(1))
    near = F.array_min(F.transform("hs", lambda h: F.struct(F.abs(h["centre"] - F.col("centre")).alias("d"), h["token"].alias("t"))))
    body = body.withColumn("near", near).withColumn("gap", gap)
    num, flag = X.locale_number(F.col("token"))
    return body.where(F.col("near.d") <= F.col("gap") / 2).select(doc, "line", F.col("near.t").alias("head"), num.alias("value"), flag.alias("flag"))


def inventory(spark: SparkSession, root: str, families: Mapping[str, str], hash_cap: int) -> DataFrame:
    """File list with family by path rule, size, and content hash up to a size cap.

    Files above the cap are listed without reading their bytes."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    fam = F.lit("other")
    for rule, name in reversed(list(families.items())):
        fam = F.when(F.col("path").rlike(rule), name).otherwise(fam)
    listed = meta.select("path", "length", fam.alias("family"))
    hashed = meta.where(F.col("length") <= hash_cap).select("path", F.sha2("content", 256).alias("sha"))
    return listed.join(hashed, "path", "left")


def freeze(inv: DataFrame) -> DataFrame:
    return inv.select("path", F.substring("sha", 1, 16).alias("sha16"), "length")


def missing_granules(granules: DataFrame, files: DataFrame) -> DataFrame:
    """Granules whose stem has no non-empty product file; sidecar names do not count."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))
    ok = (F.col("length") > 0) & ~F.contains(name, F.lit(":")) & suffix.isin(*X.PRODUCT_ENDINGS)
    have = files.where(ok).select(F.substring_index(name, ".", 1).alias("stem")).distinct()
    return granules.join(have, "stem", "left_anti")


__all__ = ["scan", "scan_partitioned", "scan_csv", "catalogue_pages", "explode_pages", "best_link", "rings", "bbox",
           "whitespace_records", "unpivot_block", "page_grid", "inventory", "freeze", "missing_granules", "conform", "Column"]
