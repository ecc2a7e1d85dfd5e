"""A training-data pipeline over `documents`: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

1. toxicity: documents that the model rejects (score of 0.7 or more) go.
2. near-dedup: one document of each group of near copies stays (5-word shingles, similarity 0.8), the smallest doc_id.
3. PII: entities and the terms that disclose them are replaced in the text.
4. mixing: documents are repeated to the sources' target weights and shuffled.
5. packing: documents are tokenised, cut and packed into sequences of 4096 tokens.

All but the last return the columns of `documents`. After mixing, copies share a doc_id; packing treats them alike.
Rows of equal doc_id and text count as one document in stages 1 and 2. Stages take tables with extra columns and keep
them; null texts, null ids and empty tables are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.llm import mixing, neardup, packing, pii, toxicity
from ethogrid.llm.common import released, spread, stored
from ethogrid.llm.spans import PERSONAL


def _rows(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, whatever their names), id and th (hash of the text)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.select("row", F.col("row.doc_id").alias("id"), F.xxhash64(F.col("row.text")).alias("th"))


def _keep(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose id and text hash are in rejected."""
    gone = rejected.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & F.col("th").eqNullSafe(F.col("gone_th"))
    return _rows(docs).join(gone, same, "left_anti").select("row.*")


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.7").select("row.*")


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs, shingle=5, similarity=(80, 100))
    return _keep(docs, stored(found.where("NOT kept").select("id", "th").distinct(), "copies"))


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.sanitise(docs).select(F.col("id").alias("found_id"), F.col("th").alias("found_th"), "islands")
    rows = _rows(docs).withColumn("th", F.xxhash64(F.coalesce("row.text", F.lit(""))))  # as sanitise counts a null text
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("th") == F.col("found_th")), "left")
    text = pii.replaced(F.col("row.text"), F.col("islands"), [k.name for k in PERSONAL])
    rows = rows.select("row", "islands", text.alias("clean"))
    chars = F.when(F.col("islands").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast("long"))
    new = {"text": F.col("clean"), "n_chars": chars}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = []
    for name in ("copy", "shuffle_key"):  # beside the columns of docs, whatever their names
        while name in docs.columns:
            name += "_"
        added.append(name)
    return mixing.mix(docs, added=tuple(added)).select(*docs.columns)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs, keep_ids=False)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near-dedup", near_dedup_stage),
    ("PII", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # a trained network decides in the first stage


def run(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        was, docs = docs, stored(stage(spark, docs, sf_dir), name)
        released(was)
    return STAGES[-1][1](spark, docs, sf_dir)
