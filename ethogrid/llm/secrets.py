"""Secret scans: an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds (blob, rule version, findings);
a scan looks only at blobs that the ledger doesn't hold under the current rule version, each once however many paths and
versions carry it, appends what it found, and joins the ledger back to all paths.

Defined results. Null text: the empty text. Null ids, repeated rows: one result row each. Rules and positions: spans.py.
Extra columns are ignored. Empty tables give empty results. Copies leave a task once, as the distinct blobs are formed
before the shuffle.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored
from .spans import SECRETS, Kind, counted, located, sql_located, written


def rule_version(kinds: tuple[Kind, ...]) -> str:
    """A hash of all that decides a match: names, patterns, and conditions as the expressions that Spark gets, constants
    included (the numbers that Spark gives to lambda variables are left out)."""
    rules = [f"{k.name} {k.pattern} {k.hint} " + re.sub(r"\b([a-z]+)_\d+\b", r"\1", str(k.ok(F.col("match")))) for k in kinds]
    return hashlib.sha256("\n".join(rules).encode()).hexdigest()[:16]


NONE = "array<struct<start:bigint,kind:int,stop:bigint>>"


def scan(versions: DataFrame, ledger: DataFrame | None = None, kinds: tuple[Kind, ...] = SECRETS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every path and version: id, blob, spans array<struct<start,kind,stop>>; the ledger with the rows of
    the newly scanned blobs: blob, rule_version, spans)."""
    paths, whole = _scanned(versions, ledger, kinds, id_col, text_col)
    return joined_back(paths, whole, kinds), whole


def _scanned(versions: DataFrame, ledger: DataFrame | None, kinds: tuple[Kind, ...], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    version = rule_version(kinds)
    text = F.coalesce(F.col(text_col), F.lit(""))
    blob = F.unhex(F.sha2(text, 256)).alias("blob")
    paths = stored(versions.select(F.col(id_col).alias("id"), blob), "paths")
    unseen = paths.select("blob").distinct()
    texts = versions.select(blob, text.alias("text")).dropDuplicates(["blob"])
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == version).select("blob")
        unseen, texts = unseen.join(known, "blob", "left_anti"), texts.join(known, "blob", "left_anti")
    found = located(texts, ["blob"], kinds, unique=True).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))
    new = stored(unseen.join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", F.array().cast(NONE)).alias("spans")), "ledger")
    return paths, new if ledger is None else ledger.select(*new.columns).unionByName(new)


class Ledger:
    """A stored ledger: a Parquet table in a folder that driver and executors share, partitioned by rule version."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        """blob, rule_version, spans; None while nothing has been stored. A row a blob and version, as an append that was
        killed half-way may have left some behind."""
        try:
            held = self.spark.read.schema(f"blob binary, spans {NONE}, rule_version string").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return held.dropDuplicates(["blob", "rule_version"]).select("blob", "rule_version", "spans")

    def append(self, new: DataFrame) -> None:
        new.select("blob", "spans", "rule_version").write.mode("append").partitionBy("rule_version").parquet(self.path)


def scan_stored(versions: DataFrame, ledger: Ledger, kinds: tuple[Kind, ...] = SECRETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan's findings; blobs that the stored ledger holds under these rules are not scanned, and the others are appended."""
    known = ledger.rows()
    paths, whole = _scanned(versions, known, kinds, id_col, text_col)
    new = whole if known is None else whole.join(known.select("blob", "rule_version"), ["blob", "rule_version"], "left_anti")
    ledger.append(new)
    return joined_back(paths, stored(ledger.rows(), "ledger"), kinds)


def joined_back(paths: DataFrame, ledger: DataFrame, kinds: tuple[Kind, ...] = SECRETS) -> DataFrame:
    """id, blob, spans of all paths (id, blob), from the ledger's rows of the current rules."""
    current = ledger.where((F.col("rule_version") == rule_version(kinds)) & (F.size("spans") > 0)).select("blob", "spans")
    return paths.join(current, "blob", "left").select("id", "blob", F.coalesce("spans", F.array().cast(NONE)).alias("spans"))


def scan_deliveries(versions: DataFrame, deliveries: int = 2, kinds: tuple[Kind, ...] = SECRETS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """As scan of all versions, which come in deliveries (by the hash of their id): each is scanned with the ledger of those
    before, so a blob that came before is not scanned again, and the last ledger is joined back to the paths of all."""
    part = F.pmod(F.xxhash64(id_col), F.lit(deliveries))
    ledger, every = None, None
    for k in range(deliveries):
        paths, ledger = _scanned(versions.where(part == k), ledger, kinds, id_col, text_col)
        every = paths if every is None else every.unionByName(paths)
    return joined_back(every, ledger, kinds), ledger


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found, _ = scan_deliveries(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    names = [k.name for k in SECRETS]
    spans = written(F.col("spans"), names)
    counts = counted(F.col("spans"), names)
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op2_sql() -> str:
    """DuckDB."""
    p = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", p, f"length(regexp_extract(m, '{p}', 1)) >= 12"), ("access", "AKIA[A-Z0-9]+", "length(m) >= 18"), ("hex", "[0-9a-f]+", "length(m) >= 16")]
    return f"""WITH {sql_located(kinds)},
s AS (SELECT doc_id, count_if(k = 0) AS a, count_if(k = 1) AS b, count_if(k = 2) AS c, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN s USING (doc_id)"""
