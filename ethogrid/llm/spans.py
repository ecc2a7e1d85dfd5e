"""Where patterns match in texts, with DataFrame functions only.

Spark gives a pattern's matches and the pieces between them; the running sum of their lengths is where each match starts
and ends. Positions are code points, ends exclusive. The patterns below are possessive or guarded by lookbehinds where
that leaves the matches as they are, so that long runs cost linear time and no deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    ok: Callable[[Column], Column] = lambda m: F.lit(True)
    hint: str = ""  # a string that each match holds


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)

    def add(total, i):
        v = F.ascii(F.substring(d, -i, F.lit(1))) - F.lit(48)
        return total + F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.length(d).between(12, 19) & (F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0)


def _byte_parts(m: Column) -> Column:
    def small(x):
        x = F.regexp_replace(x, "^0+(?=.)", "")
        return (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))

    return F.forall(F.split(m, "[.]"), small)


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
SECRETS = (
    Kind("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
    Kind("access", r"AKIA[A-Z0-9]{14,}+", hint="AKIA"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+"),
)
PERSONAL = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", hint="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _byte_parts),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", _luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), hint="+"),
)


def present(kind: Kind, text: Column) -> Column:
    """Whether the text holds a match of the kind."""
    some = F.exists(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), kind.ok)
    return F.when(text.contains(kind.hint) & text.rlike(kind.pattern), some).otherwise(F.lit(False))


def located(df: DataFrame, keys: list[str], kinds: tuple[Kind, ...], unique: bool = False) -> DataFrame:
    """keys, kind (its number), start, stop, one row per match; df has keys and text. Rows with equal keys must have equal
    texts; they count once. unique: there are none."""
    some = [F.when(F.col("text").contains(k.hint) & F.col("text").rlike(k.pattern), F.struct(F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias("m"), F.split("text", k.pattern, -1).alias("s"))).alias(f"_{i}") for i, k in enumerate(kinds)]
    hits = df.select(*keys, *some)

    def pieces(i: int, k: Kind) -> Column:
        gaps = F.transform(F.col(f"_{i}.s"), lambda g: F.length(g))
        return F.zip_with(F.col(f"_{i}.m"), gaps, lambda m, g: F.when(m.isNotNull(), F.struct(F.lit(i).alias("kind"), g.alias("gap"), F.length(m).alias("n"), k.ok(m).alias("ok"))))

    each = F.array_compact(F.flatten(F.array_compact(F.array(*[pieces(i, k) for i, k in enumerate(kinds)]))))
    rows = hits.select(*keys, F.posexplode(each).alias("pos", "x"))
    return summed(rows.select(*keys, "pos", "x.*"), keys, [*keys, "kind"], unique).where("ok").select(*keys, "kind", "start", "stop")


def summed(rows: DataFrame, keys: list[str], by: list[str], unique: bool = False) -> DataFrame:
    """rows (keys, pos, gap before the match, its length n, others) with start and stop, by running sums in order of pos
    within `by`; rows of equal keys and pos count once. unique: there are none."""
    if not unique:
        rows = rows.repartition(*keys).dropDuplicates([*keys, "pos"])
    stop = F.sum(F.col("gap").cast("long") + F.col("n")).over(Window.partitionBy(*by).orderBy("pos"))
    return rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("n"))


def counted(spans: Column, names: list[str]) -> list[Column]:
    """n_<name> of each kind."""

    def one(i: int) -> Column:
        return F.array_size(F.filter(spans, lambda s: s["kind"] == i)).cast("long").alias(f"n_{names[i]}")

    return [one(i) for i in range(len(names))]


def written(spans: Column, names: list[str]) -> Column:
    """An array of (start, kind, stop) in order, as kind:start:end joined by commas."""
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["stop"])), ",")


def sql_located(kinds: list[tuple[str, str, str]], table: str = "documents") -> str:
    """DuckDB: doc_id, k, kind, start, stop of all matches; kinds: name, pattern, condition on the match m."""
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS k, '{name}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i,
      unnest(regexp_split_to_array(t, '{p}')[1 : len(regexp_extract_all(t, '{p}'))]) AS gap FROM src WHERE regexp_matches(t, '{p}')"""
        for i, (name, p, _) in enumerate(kinds)
    )
    ok = " ".join(f"WHEN {i} THEN {c}" for i, (_, _, c) in enumerate(kinds))
    return f"""src AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}), hit AS ({each}),
placed AS (SELECT doc_id, k, kind, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM hit),
found AS (SELECT doc_id, k, kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE CASE k {ok} END)"""
