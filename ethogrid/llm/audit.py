"""Filter interaction audit: what each of five filters removes in every order, by a Gray-code walk over their subsets.

A document fails a set of filters, its mask. All that an order of filters does follows from how many documents have each
mask, so Spark counts documents by part and mask, at most 32 cells a part, and each part's cells are walked once: the 32
subsets of filters come in Gray-code order, so that one filter is toggled at a time. Each cell keeps how many active
filters it fails; as that count leaves or reaches 0 the cell's documents leave or join the running survivors. The
survivors of all 32 subsets are stored, and a step of an order is the difference of two of them.

Filters (words: runs without ASCII white space): A fewer than `least_words` words; B distinct words below 80 % of the
words; C capitals A-Z above 10 % of the code points; D any of `#$%&*|`; E the text of a smaller id, removed or not.

How it runs. One scan measures texts and writes their masks; texts are told apart by SHA-256 and are never shuffled.
Smallest ids are aggregated with partial sums; only digests of two or more rows join back. Labels are one row per id
before they join.

Defined results. Null text: empty (fails A; E like other empty texts). A null part counts as the empty string. Null ids:
never a smaller id, never fail E. Repeated rows count each; equal ids with equal texts are not repeats of a smaller id.
Labels: a document is good (toxic) if any label row of its id says so; without one it is neither. Parts without documents
have no rows; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, spread, stored

FILTERS = "ABCDE"
COUNTED = ("n", "good", "toxic")


def failures(text: Column, least_words: int = 100) -> Column:
    """The bits of A to D of a text."""

    def of(t: Column) -> Column:
        words = lambda ws: F.struct(F.size(ws).cast("long").alias("n"), F.size(F.array_distinct(ws)).cast("long").alias("distinct"))
        # one-element arrays bind the intermediate values, so that each is computed once
        w = F.get(F.transform(F.transform(F.array(F.split(t, GAP)), lambda ws: F.filter(ws, lambda x: x != "")), words), 0)
        capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
        tests = lambda w: (w["n"] < least_words, 100 * w["distinct"] < 80 * w["n"], 100 * capitals.cast("long") > 10 * F.length(t), t.rlike(r"[#$%&*|]"))
        return F.get(F.transform(F.array(w), lambda w: sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(tests(w))), F.lit(0))), 0)

    return of(F.coalesce(text, F.lit("")))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", least_words: int = 100) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and by the filters that they fail (bit 0: A)."""
    digest = F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), digest.alias("digest"), failures(F.col(text_col), least_words).alias("mask"))
    rows = stored(rows, "masks")
    # as a table, so that a text of many rows can be split where they join
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("digest", "first")
    first = stored(first, "first")
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    repeat = F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    rows = rows.join(first, "digest", "left").select("id", "part", (F.col("mask") + repeat).alias("mask"))
    sums = [F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTED[1:]]]
    return rows.join(marks, "id", "left").groupBy("part", "mask").agg(*sums)


def survivors(cells: dict[int, tuple[int, ...]]) -> list[tuple[int, ...]]:
    """What is left of each count under each of the 32 subsets of filters (by the subset's bits); cells: counts by mask."""
    running = [sum(c[k] for c in cells.values()) for k in range(len(COUNTED))]
    active = dict.fromkeys(cells, 0)
    states: list[tuple[int, ...]] = [()] * (1 << len(FILTERS))
    states[0] = tuple(running)
    subset = 0
    for step in range(1, 1 << len(FILTERS)):
        toggled = step & -step  # the bit in which Gray codes of step - 1 and step differ
        subset ^= toggled
        by = 1 if subset & toggled else -1
        for mask, counts in cells.items():
            if mask & toggled:
                active[mask] += by
                if active[mask] == (by > 0):  # its first active failure came, or its last went
                    running = [r - by * c for r, c in zip(running, counts)]
        states[subset] = tuple(running)
    return states


def steps(cells: dict[int, tuple[int, ...]]):
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of all 120 orders."""
    n, states = len(FILTERS), survivors(cells)
    fails = [sum(c[0] for m, c in cells.items() if m >> k & 1) for k in range(n)]
    only = [cells.get(1 << k, (0,))[0] for k in range(n)]
    # a filter comes right after the subset s in |s|! (n - 1 - |s|)! orders
    shapley = [sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * (states[s][0] - states[s | 1 << k][0]) for s in range(1 << n) if not s >> k & 1) for k in range(n)]
    for order in permutations(range(n)):
        name, subset = "".join(FILTERS[k] for k in order), 0
        for at, k in enumerate(order, 1):
            was, now = states[subset], states[subset | 1 << k]
            subset |= 1 << k
            removed, good, toxic = (a - b for a, b in zip(was, now))
            yield name, at, now[0], removed, fails[k] - removed, only[k], good, toxic, shapley[k]


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(cells: DataFrame) -> DataFrame:
    """Every step of every order, by part; cells: masks()."""

    def of(key, pdf):
        import pandas as pd

        held = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in pdf.itertuples()}
        return pd.DataFrame([(key[0], *r) for r in steps(held)], columns=[c.split()[0] for c in RESULT.split(", ")])

    return cells.groupBy("part").applyInPandas(of, RESULT)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return audit(masks(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_sql() -> str:
    """DuckDB: every document against every order."""
    return r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
f AS (SELECT doc_id, part, len(ws) < 100 AS "A", 100 * len(list_distinct(ws)) < 80 * len(ws) AS "B", 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS "C",
  regexp_matches(t, '[#$%&*|]') AS "D", coalesce(doc_id > first, false) AS "E" FROM w),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, "A", "B", "C", "D", "E", coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT DISTINCT part FROM d),
m AS (SELECT part, good, toxic, (CASE WHEN "A" THEN 'A' ELSE '' END) || (CASE WHEN "B" THEN 'B' ELSE '' END) || (CASE WHEN "C" THEN 'C' ELSE '' END) || (CASE WHEN "D" THEN 'D' ELSE '' END) || (CASE WHEN "E" THEN 'E' ELSE '' END) AS failed FROM d),
g AS (SELECT part, failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
y AS (SELECT part, filter_order, failed, n, good, toxic, list_min(list_transform(range(1, 6), lambda k: CASE WHEN contains(failed, filter_order[k]) THEN k ELSE 6 END)) AS gone FROM g, o),
s AS (SELECT part, filter_order, k::INT AS step, filter_order[k] AS f FROM p, o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone < step AND contains(failed, f)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM s JOIN y USING (part, filter_order) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
