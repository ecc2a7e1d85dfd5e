"""MinHash near-dedup: SuperMinHash signatures with early stopping, banding, verification on full sets, union-find.

A document's set holds the distinct `shingle`-word sequences of its text with A-Z lowered; with fewer words, the whole
sequence is the one element. Documents with equal sets form a class, and only the class's smallest id goes on. Signatures
of `bands` x `rows` slots put it into one bucket per band. Buckets with the same members are looked at once. Each bucket
compares all its members on their full sets, inside tasks: a large bucket is dealt in blocks, and each pair of blocks is
one unit of work, so no pair of a bucket is left out, none is emitted, and no task holds more than two blocks. A task
reports its links as a spanning forest (a local union-find), and alternating large-star and small-star rounds join the
forests into components.

A pair of similarity s shares a bucket with probability 1 - (1 - s**rows)**bands: for the default 24 x 4 it is missed
with probability 2e-8 at 0.85 and 5e-10 at 0.88.

Defined results. Null or wordless text: an empty set (n_shingles 0), linked with nothing. Null id: component null, linked
with nothing, kept. Rows that share an id are one document: all of its sets link to each other. Ties cannot occur: the
smallest id stands for a component. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_words, chunks, mix, released, rolling, spread, stored

BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of a document's set."""
    return np.unique(rolling(words, min(width, len(words)))) if len(words) else np.empty(0, np.uint64)


def superminhash(x: np.ndarray, m: int) -> np.ndarray:
    """m slots; in round j each element draws the j-th entry of its own permutation of the slots (a Fisher-Yates shuffle,
    one step a round) and offers j + a uniform number there. Once each slot is below j + 1, later rounds change nothing."""
    h = np.full(m, np.inf)
    at = np.arange(len(x))
    order = None
    for j in range(m):
        r = mix(x + np.arange(j + 1, j + 2, dtype=np.uint64) * _STEP)
        k = j + (mix(r) % np.uint64(m - j)).astype(np.int64)
        if order is None:
            slot = k
            if j == 0 and len(x) < 12 * m:
                order = np.broadcast_to(np.arange(m, dtype=np.int16), (len(x), m)).copy()
                order[at, k] = 0
        else:
            slot = order[at, k]
            order[at, k] = order[at, j]
        np.minimum.at(h, slot, j + (r >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        if h.max() < j + 1:
            break
        if order is None:  # a large set that has left a slot empty
            order = np.broadcast_to(np.arange(m, dtype=np.int16), (len(x), m)).copy()
            order[at, k] = 0
    return h


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = mix(h.view(np.uint64) + np.arange(len(h), dtype=np.uint64) * _STEP).reshape(bands, rows)
    return mix(v.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)


def _sign(width: int, bands: int, rows: int):
    def of(batches):
        for batch in batches:
            for first, data in chunks(batch.column(2).to_pylist(), 1 << 22):
                words, at = chunk_words(data, lower=True)
                n, s1, s2, keys = [], [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    x = shingles(words[a:b], width)
                    n.append(len(x))
                    s1.append(int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(x) else None)
                    s2.append(int(mix(x ^ _STEP).sum(dtype=np.uint64).view(np.int64)) if len(x) else None)
                    keys.append(band_keys(superminhash(x, bands * rows), bands, rows) if len(x) else None)
                part = slice(first, first + len(data))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([len(d) for d in data], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "th", "n", "s1", "s2", "size", "keys"])

    return of


def _squeeze(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack((t or "").encode()) for t in b.column(2).to_pylist()], pa.binary())], names=["id", "th", "z"])


def forest(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(id, smallest id of its component) among these sets, for ids that aren't the smallest; all pairs are compared."""
    n = np.array([len(s) for s in sets], np.int64)
    if len(ids) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        a, b = sorted(ids)
        return [(b, a)] if a != b and den * both >= num * (n.sum() - both) else []
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    keep = count[code] > 1
    new = np.cumsum(count > 1) - 1
    code, owner = new[code[keep]], owner[keep]
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        a, b = np.searchsorted(code, [start, start + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[a:b], code[a:b] - start] = 1
        both += part @ part.T
    link = den * both.astype(np.float64) >= num * (n[:, None] + n[None, :] - both.astype(np.float64))
    at = np.argsort(np.array(ids), kind="stable")
    link, label = link[at][:, at], np.arange(len(ids))
    while True:
        least = np.where(link, label[None, :], len(ids)).min(axis=1)
        least = np.minimum(least, label)
        least = least[least]
        if (least == label).all():
            break
        label = least
    own = [ids[i] for i in at]
    return [(own[i], own[k]) for i, k in enumerate(label.tolist()) if own[i] != own[k]]


def _links(width: int, num: int, den: int):
    """Rows in order of (key, i, j): each such group is compared as it passes."""

    def solve(group):
        unpack = zstandard.ZstdDecompressor().decompress
        data = [unpack(z) for _, z in group]
        words, at = chunk_words(data, lower=True)
        return forest([i for i, _ in group], [shingles(words[a:b], width) for a, b in zip(at[:-1], at[1:])], num, den)

    def of(batches):
        now, group = None, []
        for b in batches:
            out = []
            for key, i, j, node, z in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (key, i, j) != now:
                    if len(group) > 1:
                        out += solve(group)
                    now, group = (key, i, j), []
                group.append((node, z))
            yield pairs(out)
        if len(group) > 1:
            yield pairs(solve(group))

    def pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return of


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node of the edges but the smallest of its component, with that smallest. Large-star and small-star
    rounds; each ends in the shared folder. A hub's edges meet only in sums and in joins that Spark can split."""
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        was = e
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct()
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        released(was)
        if now == mark:
            return e
        mark = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), bands: int = 24, rows: int = 4) -> DataFrame:
    """One row per row of docs: id, th (hash of the text), n_shingles, component (smallest id reachable), kept."""
    num, den = similarity
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = stored(d.mapInArrow(_sign(shingle, bands, rows), "id long, th long, n long, s1 long, s2 long, size long, keys array<long>"), "signatures")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "th", "size", "keys")).alias("x")).select("s1", "s2", "n", "x.*")
    classes = stored(classes, "classes")
    entries = classes.select("id", "th", "size", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("id", "th")).alias("x1"), F.bit_xor(F.xxhash64("th", "id")).alias("x2")).where("members > 1")
    buckets = buckets.groupBy("members", "bytes", "x1", "x2").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("int")
    members = stored(entries.select("id", "th", "key").join(buckets.select("key", blocks.alias("g")), "key"), "members")
    # repeated rows would meet in every bucket of their document: one stays, the others don't leave their tasks
    texts = d.mapInArrow(_squeeze, "id long, th long, z binary").groupBy("id", "th").agg(F.first("z").alias("z"))
    # a document is in `bands` buckets at most
    wanted = members.groupBy("id", "th").agg(F.collect_list(F.struct("key", "g")).alias("keys"))
    dealt = texts.join(wanted, ["id", "th"]).select("id", "th", "z", F.explode("keys").alias("x")).select("id", "th", "z", "x.*")
    mine = F.pmod(F.xxhash64("id", "th"), F.col("g").cast("long")).cast("int")
    dealt = dealt.withColumn("b", mine)
    dealt = dealt.withColumn("o", F.explode(F.when(F.col("g") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda k: k != F.col("b")))))
    dealt = dealt.select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "id", "z")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links(shingle, num, den), "u long, v long")
    # rows that share an id are one document, whatever classes they fall into
    own = signed.where("id IS NOT NULL").select("id", "s1", "s2", "n")
    several = own.groupBy("id").agg(F.min(F.struct("s1", "s2", "n")).alias("a"), F.max(F.struct("s1", "s2", "n")).alias("b")).where("a <> b").select("id")
    shared = own.where("n > 0").join(several, "id", "left_semi").join(classes.select("s1", "s2", "n", F.col("id").alias("v")), ["s1", "s2", "n"])
    roots = components(found.unionByName(shared.select(F.col("id").alias("u"), "v")))
    named = classes.select("s1", "s2", "n", F.col("id").alias("u")).join(roots, "u", "left").select("s1", "s2", "n", F.coalesce("v", "u").alias("root"))
    out = signed.where("n > 0").drop("keys", "size").join(named, ["s1", "s2", "n"], "left").select("id", "th", "n", "root")
    empty = signed.where("n = 0").select("id", "th", "n").join(roots.toDF("u", "root"), F.col("id") == F.col("u"), "left").select("id", "th", "n", "root")
    out = out.unionByName(empty)
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select("id", "th", F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op5_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    r = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), shingle=3, similarity=(85, 100))
    return r.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op5_sql() -> str:
    """DuckDB; all pairs that share a shingle, and a recursive closure."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN m ON d = doc_id LEFT JOIN n USING (doc_id)"""
