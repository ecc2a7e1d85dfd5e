"""PII: information-theoretic sanitisation, with DataFrame functions only.

Patterns find the protected entities (e-mail, IP, card, phone). The corpus then says how strongly each term reveals the
kind of entity: with N documents, n(k) that hold kind k, n(t) that hold term t and n(k, t) that hold both, anywhere in
their texts, the term discloses

    PMI(k; t) / IC(k) = log(N n(k, t) / (n(k) n(t))) / log(N / n(k))

of the kind's information: 1 if no document without the kind holds t. What a term discloses most, of any kind, counts.
Terms are generalised (from `generalise` on) or removed (from `remove` on) wherever they stand, in all documents, as are
the entities themselves. Terms that fewer than `support` documents of a kind hold are left alone.

How it runs. One scan explodes the distinct terms of each document with its kinds; partial sums leave the tasks. A second
scan joins the documents' terms with the told ones, which are counted and broadcast up to a million, and only documents
that hold such terms are read again to place them.

Defined results. Null text: empty. Null ids and repeated rows: one result row each (rows are documents in all counts).
Overlapping entities are all reported and replaced once, under the first one's label; terms inside or across entities are
no spans of their own. A kind that every document holds discloses nothing. Empty tables give empty results. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, spread, stored
from .spans import PERSONAL, Kind, counted, located, present, sql_located, summed, written

TERM = r"\p{L}{3,}+"
SPANS = "array<struct<start:bigint,kind:int,stop:bigint,disclosed:double>>"


def placed_terms(texts: DataFrame, told: DataFrame) -> DataFrame:
    """id, th, start, stop, disclosed of every told term (term, disclosed) in texts (id, th, text); equal rows count once.

    A term is a whole run of letters, so the forms of told terms that a document holds make a pattern of its own."""
    forms = texts.select("id", "th", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("form"))
    held = forms.join(told.select("term"), F.lower("form") == F.col("term")).groupBy(F.col("id").alias("i"), F.col("th").alias("t")).agg(F.sort_array(F.collect_set("form")).alias("forms"))
    rows = texts.join(stored(held, "holders"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("forms", "|"), F.lit(r")(?!\p{L})"))
    found = rows.select("id", "th", F.regexp_extract_all("text", pattern, F.lit(0)).alias("m"), F.transform(F.split("text", pattern, -1), lambda g: F.length(g)).alias("g"))
    parts = F.zip_with("m", "g", lambda m, g: F.when(m.isNotNull(), F.struct(g.alias("gap"), F.length(m).alias("n"), F.lower(m).alias("term"))))
    at = summed(found.select("id", "th", F.posexplode(F.array_compact(parts)).alias("pos", "x")).select("id", "th", "pos", "x.*"), ["id", "th"], ["id", "th"])
    return at.join(told, "term").select("id", "th", "start", "stop", "disclosed")


def disclosure(texts: DataFrame, kinds: tuple[Kind, ...], support: int) -> DataFrame:
    """term, disclosed of the terms that enough documents of a kind hold."""
    held = [present(k, F.col("text")).alias(f"k{i}") for i, k in enumerate(kinds)]
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    # every document holds the empty term: its counts are N and n(k)
    said = texts.select(*held, terms.alias("terms")).select(*[f"k{i}" for i in range(len(kinds))], F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    counts = said.groupBy("term").agg(F.count("*").alias("n"), *[F.count_if(f"k{i}").alias(f"n{i}") for i in range(len(kinds))])
    counts = stored(counts.where((F.col("term") == "") | (F.greatest(*[f"n{i}" for i in range(len(kinds))], F.lit(0)) >= support)), "terms")
    every = counts.where("term = ''").first()
    if every is None:
        return counts.select("term", F.lit(None).cast("double").alias("disclosed")).limit(0)
    n, each = float(every["n"]), []
    for i in range(len(kinds)):
        if 0 < every[f"n{i}"] < n:
            part = F.ln(F.lit(n) * F.col(f"n{i}") / (F.lit(float(every[f"n{i}"])) * F.col("n"))) / F.ln(F.lit(n / every[f"n{i}"]))
            each.append(F.when(F.col(f"n{i}") >= support, part))
    most = F.greatest(*each, F.lit(None).cast("double"), F.lit(None).cast("double")) if each else F.lit(None).cast("double")
    return counts.where("term <> ''").select("term", most.alias("disclosed"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = PERSONAL, support: int = 20, generalise: float = 0.8) -> DataFrame:
    """id, th (hash of the text), spans (start, kind, stop, disclosed; kind len(kinds) is a term) and islands (merged
    spans to replace) of the documents that hold entities or telling terms."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = bounded_broadcast(stored(disclosure(texts, kinds, support).where(F.col("disclosed") >= generalise), "told"), 1_000_000)
    term = placed_terms(texts, told)
    none = F.lit(None).cast("double")
    base = located(texts, ["id", "th"], kinds).select("id", "th", "start", "kind", "stop", none.alias("disclosed"))
    every = base.unionByName(term.withColumn("kind", F.lit(len(kinds))))
    doc = Window.partitionBy("id", "th").orderBy("start", "kind", "stop")
    entity = F.col("kind") < len(kinds)
    held = F.max(F.when(entity, F.col("stop"))).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(entity, F.col("start"))).over(doc.rowsBetween(1, Window.unboundedFollowing))
    free = entity | ((F.coalesce(held, F.lit(-1)) <= F.col("start")) & (F.coalesce(coming, F.col("stop")) >= F.col("stop")))
    every = every.withColumn("free", free).where("free").drop("free")
    so_far = F.max("stop").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("new", F.coalesce(F.col("start") >= so_far, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    island = every.groupBy("id", "th", "island").agg(F.min(F.struct("start", "kind", "disclosed")).alias("x"), F.max("stop").alias("end"), F.collect_list(F.struct("start", "kind", "stop", "disclosed")).alias("part"))
    whole = F.struct(F.col("x.start").alias("start"), F.col("x.kind").alias("kind"), F.col("end").alias("stop"), F.col("x.disclosed").alias("disclosed"))
    return island.groupBy("id", "th").agg(F.sort_array(F.flatten(F.collect_list("part"))).cast(SPANS).alias("spans"), F.sort_array(F.collect_list(whole)).cast(SPANS).alias("islands"))


def replaced(text: Column, islands: Column, names: list[str], remove: float = 0.95) -> Column:
    """The text with entities as [NAME], generalised terms as [TERM], and terms that disclose more gone."""
    labels = F.array(*[F.lit(f"[{n.upper()}]") for n in names], F.lit("[TERM]"))

    def put(x, i):
        done = F.coalesce(F.get(islands, i - 1)["stop"], F.lit(0)).cast("int")
        label = F.when(x["disclosed"] >= remove, F.lit("")).otherwise(F.get(labels, x["kind"]))
        return F.concat(F.substring(text, done + 1, x["start"].cast("int") - done), label)

    end = F.get(islands, F.size(islands) - 1)["stop"].cast("int")
    return F.when(F.coalesce(F.size(islands), F.lit(0)) == 0, text).otherwise(F.concat(F.array_join(F.transform(islands, put), ""), F.substring(text, end + 1, F.length(text))))


def op3_pii_sanitise(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = sanitise(docs)
    names = [k.name for k in PERSONAL]
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left")
    spans = F.coalesce("spans", F.array().cast(SPANS))
    base = written(F.filter(spans, lambda s: s["kind"] < len(names)), names)
    return rows.select("doc_id", *counted(spans, names), F.sha2(base, 256).alias("base_sha256"), written(spans, [*names, "term"]).alias("spans"))


def op3_sql() -> str:
    """DuckDB."""
    luhn = "list_sum(list_transform(range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN regexp_replace(m, '[^0-9]', '', 'g')[-i]::INT ELSE (2 * regexp_replace(m, '[^0-9]', '', 'g')[-i]::INT) // 10 + (2 * regexp_replace(m, '[^0-9]', '', 'g')[-i]::INT) % 10 END)) % 10 = 0"
    n = "length(regexp_replace(m, '[^0-9]', '', 'g'))"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: x::HUGEINT > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"{n} BETWEEN 12 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{n} BETWEEN 9 AND 15"),
    ]
    term = r"\p{L}{3,}"
    return f"""WITH {sql_located(kinds)},
own AS (SELECT doc_id, list_distinct(list(k)) AS ks FROM found GROUP BY doc_id),
say AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(t), '{term}'))) AS term FROM src),
nt AS (SELECT term, count(*) AS nt FROM say GROUP BY term),
nkt AS (SELECT term, k, count(*) AS n FROM (SELECT doc_id, unnest(ks) AS k FROM own) JOIN say USING (doc_id) GROUP BY ALL HAVING count(*) >= 20),
nk AS (SELECT k, count(*)::DOUBLE AS nk FROM (SELECT unnest(ks) AS k FROM own) GROUP BY k),
told AS (SELECT DISTINCT term FROM nkt JOIN nt USING (term) JOIN nk USING (k), (SELECT count(*)::DOUBLE AS big FROM src) WHERE nk < big AND ln(big * n / (nk * nt)) / ln(big / nk) >= 0.8),
tok AS (SELECT doc_id, unnest(regexp_extract_all(t, '{term}')) AS m, unnest(regexp_split_to_array(t, '{term}')[1 : len(regexp_extract_all(t, '{term}'))]) AS g, unnest(range(1, len(regexp_extract_all(t, '{term}')) + 1)) AS j FROM src),
tp AS (SELECT doc_id, lower(m) AS term, length(m) AS n, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY j) AS e FROM tok),
ts AS (SELECT doc_id, (e - n)::BIGINT AS ts, e::BIGINT AS te FROM tp JOIN told USING (term)),
free AS (SELECT * FROM ts WHERE NOT EXISTS (SELECT 1 FROM found AS f WHERE f.doc_id = ts.doc_id AND f.start < ts.te AND ts.ts < f.stop)),
al AS (SELECT doc_id, k, kind, start, stop FROM found UNION ALL SELECT doc_id, 4, 'term', ts, te FROM free),
s AS (SELECT doc_id, count_if(k = 0) AS a, count_if(k = 1) AS b, count_if(k = 2) AS c, count_if(k = 3) AS d,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE k < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM al GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_email, coalesce(b, 0)::BIGINT AS n_ip, coalesce(c, 0)::BIGINT AS n_card, coalesce(d, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN s USING (doc_id)"""
