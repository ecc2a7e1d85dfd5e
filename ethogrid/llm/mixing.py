"""Mixing sources to target weights: Poisson replication.

A source of n documents and weight w is due w / sum(w) * total documents, so each of its documents is repeated with mean
rate w / sum(w) * total / n. The number of copies inverts the Poisson distribution of that rate at a uniform number
seeded by the hash of the id, so it doesn't depend on partitions or retries. Copies are then shuffled globally: they are
dealt by ranges of a hash of (id, copy) and sorted by it.

Weights: given ones, or n ** temper (temper 1: as it is; 0: all sources alike). Sources without a given weight get 0.

Defined results. A null source is a source. Null ids all draw the same number; rows with equal ids draw the same number
too, each row being replicated. Null and empty texts count as documents. An empty table gives an empty result. Two columns
are added, `copy` and `shuffle_key` unless other names are given; a column of such a name in the input is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, spread, stored


def _hash(*parts, digits: int):
    """The first hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, group_col: str, weights: dict | None, total: float | None, temper: float) -> DataFrame:
    """group, n, rate, cdf (of 0, 1, 2, ... repetitions)."""
    n = stored(docs.groupBy(F.col(group_col).alias("group")).agg(F.count("*").alias("n")), "sources")
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temper))
    else:
        table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
        weight = F.coalesce(F.try_element_at(table, F.col("group")), F.lit(0.0))
    n = n.withColumn("w", weight)
    every = n.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    due = float(total if total is not None else every["n"] or 0)
    rate = n.select("group", "n", (F.col("w") / F.lit(every["w"] or 1.0) * F.lit(due) / F.col("n")).alias("rate"))
    most = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = rate.withColumn("k", F.explode(F.sequence(F.lit(0), most)))
    so_far = Window.partitionBy("group").orderBy("k")
    steps = steps.withColumn("ln_k", F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(so_far))
    mass = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("ln_k"))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    steps = steps.withColumn("cdf", F.sum(mass).over(so_far))
    return steps.groupBy("group", "n", "rate").agg(F.sort_array(F.collect_list("cdf")).alias("cdf"))


def mix(docs: DataFrame, weights: dict | None = None, total: float | None = None, temper: float = 0.5, seed: int = 17, id_col: str = "doc_id", group_col: str = "source", added: tuple[str, str] = ("copy", "shuffle_key")) -> DataFrame:
    """docs' columns with copy (from 1) and shuffle_key (or the names in added), one row per copy, by shuffle_key."""
    rate = bounded_broadcast(stored(rates(docs, group_col, weights, total, temper).select("group", "cdf"), "rates"), 100_000)
    columns = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*columns).alias("row"))
    rows = rows.join(rate, F.col(f"row.{group_col}").eqNullSafe(F.col("group")))
    u = _hash(F.lit(str(seed)), F.col(f"row.{id_col}").cast("string"), digits=13) / F.lit(2.0**52)
    rows = rows.select("row", "cdf", u.alias("u"))
    copies = rows.select("row", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("n")).where("n > 0")
    copies = copies.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy"))
    key = _hash(F.lit(str(seed)), F.col(f"row.{id_col}").cast("string"), F.col("_copy").cast("string"), digits=15)
    copies = copies.select("row.*", F.col("_copy").alias(added[0]), key.alias(added[1]))
    return copies.repartitionByRange(added[1], added[0]).sortWithinPartitions(added[1], added[0], id_col)


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op8_sql() -> str:
    """DuckDB."""
    return """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, n, pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM n) * (SELECT sum(n)::DOUBLE FROM n) / n AS rate FROM n),
s AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
l AS (SELECT *, sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k) AS ln_k FROM s),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - ln_k)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM l),
d AS (SELECT *, ('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT / pow(2.0, 52) AS u FROM documents),
m AS (SELECT d.doc_id, count(*) AS copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u GROUP BY d.doc_id),
x AS (SELECT documents.*, unnest(range(1, copies + 1))::INT AS copy FROM documents JOIN m USING (doc_id))
SELECT *, ('0x' || substr(md5('17|' || doc_id || '|' || copy), 1, 15))::BIGINT AS shuffle_key FROM x"""
