"""Quality rules: cross-document line frequency beside per-document rules, with DataFrame functions only.

Lines are normalised (lower case; runs of white space and digits become one space) and hashed. A line is boilerplate of
a host if more than `limit` distinct documents of the host hold it, in hosts of every size alike. Boilerplate lines are
removed, and documents that keep fewer than `least_words` words, or less than `least_share` of their words, are depleted
and rejected. Documents carry their host in `source`; a document is an id (without one, a text).

Base rules: fewer than 20 words, or more than 30 % of the words in 8-word windows that occur twice in the text.

How it runs. One scan measures the texts and writes the measures and the lines' hashes; lines are counted and looked up
from there. Texts are read again, and shuffled, only by `cleaned`, which returns them without the removed lines.

Defined results. Null text: no words (fails). A null host is a host. Null ids and repeated rows: one
result row each; rows with equal id, host and text get equal results. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, bounded_broadcast, spread, stored

SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _repeated_words(windows: Column, width: int) -> Column:
    """Positions covered by windows whose hash occurs twice or more."""
    order = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def twin(order: Column) -> Column:
        return F.sort_array(F.transform(F.filter(order, lambda s, j: (s["x"] == F.get(order, j - 1)["x"]) | (s["x"] == F.get(order, j + 1)["x"])), lambda s: s["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda i, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - i, F.lit(width)))), F.lit(0), lambda a, x: a + x)

    # one-element arrays bind the intermediate values, so that each is computed once
    at = F.transform(F.array(order), twin)
    return F.get(F.transform(at, covered), 0)


def measured(rows: DataFrame, window: int = 8) -> DataFrame:
    """id, th, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines (pos among all lines of the
    text, hash, words) of rows (id, th, host, text)."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09-\x0D0-9]+", " "))
    r = rows.withColumn("words", _words(F.col("text")))
    every = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    lines = F.filter(every, lambda s: s["x"].rlike(WORD))
    r = r.select("id", "th", "host", F.size("words").alias("n"), F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"), (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    hashed = F.transform("lines", lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(norm(s["x"])).alias("line"), F.size(_words(s["x"])).alias("n")))
    r = r.select("id", "th", "host", "n", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct(F.transform("lines", lambda s: s["x"])))).cast("long").alias("n_dup_lines"), F.when(F.col("n") >= window, F.transform(F.sequence(F.lit(1), F.col("n") - window + 1), lambda i: F.xxhash64(F.slice("h", i, window)))).otherwise(F.array().cast("array<bigint>")).alias("win"), hashed.alias("lines"))
    repeat = F.when(F.size("win") == F.size(F.array_distinct("win")), 0).otherwise(_repeated_words(F.col("win"), window))
    return r.select("id", "th", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat.cast("long").alias("n_repeat_words"), "lines")


def boilerplate(lines: DataFrame, limit: int) -> DataFrame:
    """host, line of the lines (id, th, host, line) that more than limit distinct documents of the host hold."""
    held = lines.select("host", "line", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), F.col("th"))).alias("doc")).distinct()
    return held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("host", "line")


def without(text: Column, gone: Column) -> Column:
    """The text without its lines at the positions gone (null: the text)."""
    kept = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i))
    return F.when(gone.isNull(), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n")), lambda ls: F.array_join(kept(ls), "\n")), 0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = 5, least_words: int = 20, least_share: float = 0.3) -> DataFrame:
    """id, th (hash of the text), the measures, n_boilerplate (words in removed lines), base_failed, kept, removed
    (positions of the removed lines, or null) and host; cleaned() makes the texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    out = stored(measured(rows.withColumn("text", F.coalesce("text", F.lit("")))), "measured")
    each = out.select("id", "th", "host", F.explode("lines").alias("x")).select("id", "th", "host", "x.*")
    bad = bounded_broadcast(stored(boilerplate(each, limit), "boilerplate"), 1_000_000)
    gone = each.join(bad, (each["line"] == bad["line"]) & each["host"].eqNullSafe(bad["host"])).select(each["id"], "th", each["host"], "pos", "n").distinct()
    gone = gone.groupBy("id", "th", "host").agg(F.sum("n").alias("n_boilerplate"), F.collect_list("pos").alias("gone"))
    out = _matched(out.drop("lines"), gone).withColumn("n_boilerplate", F.coalesce("n_boilerplate", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate")
    depleted = (left < least_words) | (left < least_share * F.col("n_words"))
    return out.select("id", "th", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.sort_array("gone").alias("removed"))


def cleaned(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs whose result is kept, their texts without boilerplate lines; found: quality_rules(docs)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.select("row", F.col(f"row.{id_col}").alias("id"), F.xxhash64(f"row.{text_col}").alias("th"), F.col(f"row.{host_col}").alias("host"))
    kept = found.where("kept").select("id", "th", "host", "removed").dropDuplicates(["id", "th", "host"]).withColumn("kept", F.lit(True))
    rows = _matched(rows, kept).where("kept")
    text = without(F.col(f"row.{text_col}"), F.col("removed"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns])


def _matched(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the columns of found, by id, th and host, null or not."""
    found = found.select(*[F.col(c).alias("_" + c) if c in ("id", "th", "host") else F.col(c) for c in found.columns])
    same = F.lit(True)
    for c in ("id", "th", "host"):
        same = same & rows[c].eqNullSafe(F.col("_" + c))
    return rows.join(found, same, "left").drop("_id", "_th", "_host")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    r = quality_rules(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return r.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate")


def op10_sql() -> str:
    """DuckDB."""
    return r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(0, len(ws) - 7)) AS p, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, hash(array_to_string(ws[p + 1 : p + 8], ' '))) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS i FROM h WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS x FROM d),
n AS (SELECT doc_id, source, trim(regexp_replace(lower(x), '[\x20\x09-\x0D0-9]+', ' ', 'g'), ' ') AS line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS k FROM l),
bad AS (SELECT source, line FROM n GROUP BY ALL HAVING count(DISTINCT doc_id) > 5),
gone AS (SELECT doc_id, sum(k) AS g FROM n JOIN bad USING (source, line) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(g, 0)::BIGINT AS n_boilerplate
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - n_boilerplate < 20 OR n_words - n_boilerplate < 0.3 * n_words) AS kept FROM m"""
