"""Line deduplication: lines found in many documents go, the others are put together again in their places.

Every line is normalised (ASCII white space stripped, A-Z lower-cased) and hashed to 128 bits.  Distinct documents per hash are
counted in two aggregates with map-side sums, so a line that stands in a third of all documents costs each task a few partial
rows.  The frequent hashes are broadcast if their count is within the bound; beyond it the join splits a frequent hash's places.  Only hashes and positions are shuffled for the decision; a text moves once, to meet the list of its own dropped places.

Defined results: a null or empty text is one empty line; an empty key is never dropped unless ``min_chars`` is 0; rows with one
id count as one document (null ids together as one), yet each row gets its own result; an empty table gives an empty table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, broadcast_counted, stored, text_key

STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, tkey, dropped) for each document that loses lines; ``dropped`` holds their positions from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = line_key(F.col("line"))
    lines = (docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tkey"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
             .select("id", "tkey", "pos", key.alias("key")).filter(F.length("key") >= min_chars)
             .select("id", "tkey", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(UPPER), "key").alias("h2")))
    frequent = (lines.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs).select("h1", "h2"))
    # a table of its own: were it still partitioned by its keys, the join would take that over and a line's places could not be split
    frequent = stored(frequent, "frequent-lines")
    found = lines.join(broadcast_counted(frequent, frequent.count()), ["h1", "h2"])
    return found.groupBy("id", "tkey").agg(F.collect_set("pos").alias("dropped"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: ``row`` (the input row as a struct), ``n_lines``, ``n_dropped``, ``kept`` (the text that stays)."""
    drops = repeated_lines(docs, min_docs, min_chars, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("whole"),
                       text_key(F.col(text_col)).alias("rkey"))
    met = rows.join(drops, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rkey") == F.col("tkey")), "left")
    cut = met.select("row", "whole", "dropped", F.split("whole", "\n").alias("lines"))
    places = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")))
    kept = F.array_join(F.transform(places, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")
    return cut.select("row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.when(F.col("dropped").isNull(), F.col("whole")).otherwise(kept).alias("kept"))
