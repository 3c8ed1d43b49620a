"""A training-data pipeline: five stages over ``documents``, each a written table that the next one reads.

1. toxicity: documents that the ordinal model grades toxic go.
2. line_dedup: lines found in ten documents or more go from every text; ``n_chars`` follows.
3. near_dedup: of each class of near copies the row with the least id stays.
4. decontamination: documents that hold too much of a benchmark go.
5. sentencepiece: token ids (end id last), their number and the decoded text are added, in place of columns of those names.

All stages but the last return the columns of their input.  Null texts pass every stage; an empty table passes as one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import prepare, stored, table
from tidewright.llm.decontaminate import decontaminate
from tidewright.llm.line_dedup import drop_repeated_lines
from tidewright.llm.order_minhash import first_of_each
from tidewright.llm.queries import piece_model
from tidewright.llm.sentencepiece import encode_decode
from tidewright.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score(docs, train(docs, table(spark, sf_dir, "labels"), per_class=3000)).filter("not toxic").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    kept = drop_repeated_lines(docs, min_docs=10, min_chars=1)
    return kept.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return first_of_each(docs, k=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13, share=20).filter("not contaminated").select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    coded = encode_decode(docs, piece_model())
    new = {"token_ids": F.col("ids"), "n_tokens": F.size("ids").cast("long"), "decoded_text": F.col("decoded")}
    return coded.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()])


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]
#: A trained model, sketches and merge rounds have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
