"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted in Spark; repeated windows merge into
maximal removal intervals.

How it runs. One task hashes all windows of its documents. Among its own rows it keeps, for each hash, only the document
with the smallest id and reports the others' windows at once, so a passage that a third of all rows share leaves a task
once. What is left goes, as packed arrays, to a bucket chosen by the window's rarest inner 8-gram (its minimum hash), so
that runs of windows stay together; a bucket finds the smallest document of each hash. Buckets are counted before, in a
pass of its own, and one that is too large is dealt to slots by the windows' hashes, so that a group stays bounded
however many documents share a line. The removed runs and the texts then meet by document.

Defined results. Null text: no words. Null id: such a row is kept whole and is no earlier document of any other. Rows
with equal ids and equal texts get equal results, one row each; rows with equal ids and other texts are judged apart and
never remove words of each other. Texts of fewer than `window` words are kept whole. Other columns are ignored. An empty
table gives an empty result. Two different windows are taken as equal if their 64-bit hashes and their buckets agree,
which follow from separate hashes: about n*n / 2**65 / buckets such pairs among n windows in as many buckets as 4 MB of
text each make, that is below one pair in 100 TB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_words, chunks, input_chars, mix, rolling, spread, word_spans

INNER = 8
FLUSH = 1_000_000


def _planes(x: np.ndarray) -> bytes:
    """32-bit integers as four byte planes; the high ones are mostly zero and compress away."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _firsts(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where a window's hash also occurs in a document with a smaller id."""
    if not len(h):
        return np.zeros(0, bool)
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    least = np.minimum.reduceat(doc[order], new)
    out = np.empty(len(h), bool)
    out[order] = doc[order] > np.repeat(least, np.diff(np.r_[new, len(h)]))
    return out


def _runs(doc: np.ndarray, th: np.ndarray, pos: np.ndarray):
    """(id, text hash, starts) of each document; the rows are in order of document and position."""
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]) if len(doc) else []
    for a, b in zip(cut, np.r_[cut[1:], len(doc)] if len(doc) else []):
        yield int(doc[a]), int(th[a]), pos[a:b].astype("<i4").tobytes()


def _slots(bucket: np.ndarray, h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The bucket itself, or, where it is hot, one of its slots by the window's hash. hot: (bucket, number of slots, first
    slot) by rising bucket. Equal windows have equal buckets and hashes, so they still meet."""
    slot = bucket.astype(np.int64)
    if len(hot):
        i = np.minimum(np.searchsorted(hot[:, 0], slot), len(hot) - 1)
        hit = np.flatnonzero(hot[i, 0] == slot)
        n, first = hot[i[hit], 1], hot[i[hit], 2]
        slot[hit] = first + (h[hit] % n.astype(np.uint64)).astype(np.int64)
    return slot


def _hash_windows(window: int, buckets: int, hot: np.ndarray | None = None):
    """Batches of (id, text hash, text) to rows: bucket -1 holds starts that are known to go, others packed windows.
    Without hot: to (bucket, number of windows that would leave the task)."""

    def of(batches):
        held: list[tuple] = []
        n = 0
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for first, data in chunks(batch.column(2).to_pylist()):
                words, at = chunk_words(data)
                if len(words) < window:
                    continue
                h = rolling(words, window)
                inner = _sliding_min(rolling(words, INNER), window - INNER + 1)
                doc = np.repeat(np.arange(len(data)), np.diff(at))
                whole = np.flatnonzero(doc[: len(h)] == doc[window - 1 :])
                d = doc[whole]
                held.append((h[whole], mix(inner[whole]) % np.uint64(buckets), ids[first + d], ths[first + d], (whole - at[d]).astype(np.int64)))
                n += len(whole)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        h, bucket, doc, th, pos = (np.concatenate(x) for x in zip(*held))
        gone = _firsts(h, doc)
        left = np.flatnonzero(~gone)
        if hot is None:
            b, n = np.unique(bucket[left], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(n)], names=["bucket", "n"])
            return
        rows = [(-1, d, t, s, None) for d, t, s in _runs(doc[gone], th[gone], pos[gone])]
        bucket = _slots(bucket, h, hot)
        left = left[np.argsort(bucket[left].astype(np.uint32), kind="stable")]
        b = bucket[left]
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
        for a, z in zip(cut, np.r_[cut[1:], len(b)] if len(b) else []):
            at = left[a:z]
            new = np.flatnonzero(np.r_[True, (doc[at][1:] != doc[at][:-1]) | (th[at][1:] != th[at][:-1])])
            head = np.stack([doc[at][new], th[at][new], np.diff(np.r_[new, len(at)])]).astype("<i8").tobytes()
            rows.append((int(b[a]), None, None, head + _planes(np.diff(pos[at], prepend=0)), h[at].astype("<u8").tobytes()))
        for i in range(0, len(rows), 2000):
            part = list(zip(*rows[i : i + 2000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.binary()), pa.array(part[4], pa.binary())], names=["bucket", "id", "th", "packed", "hashes"])

    return of


def _repeats(key, pdf):
    """One bucket: the starts whose window is also in a document with a smaller id."""
    import pandas as pd

    hs, docs, ths, poss = [], [], [], []
    for packed, hashes in zip(pdf["packed"], pdf["hashes"]):
        h = np.frombuffer(hashes, "<u8")
        cut = len(packed) - 4 * len(h)
        doc, th, n = np.frombuffer(packed[:cut], "<i8").reshape(3, -1)
        hs.append(h)
        docs.append(np.repeat(doc, n))
        ths.append(np.repeat(th, n))
        poss.append(np.cumsum(_unplanes(packed[cut:])))
    h, doc, th, pos = map(np.concatenate, (hs, docs, ths, poss))
    at = np.flatnonzero(_firsts(h, doc))
    at = at[np.lexsort((pos[at], th[at], doc[at]))]
    return pd.DataFrame(list(_runs(doc[at], th[at], pos[at])), columns=["id", "th", "packed"])


def _squeeze(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if t is None else pack(t.encode()) for t in b.column(2).to_pylist()], pa.binary())], names=["id", "th", "z"])


def _cut(window: int):
    """Batches of (id, packed text, lists of starts) to the operator's rows."""

    def of(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for i, z, gone in zip(*(b.column(k).to_pylist() for k in range(3))):
                text = unpack(z) if z is not None else b""
                buf = np.frombuffer(text, np.uint8)
                starts, ends = word_spans(buf, np.array([0, len(buf)]))
                n, removed, spans = len(starts), 0, []
                words = [text[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
                if gone:
                    at = np.frombuffer(b"".join(gone), "<i4")
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, np.minimum(at + window, n), -1)
                    cover = np.cumsum(step[:n]) > 0
                    removed = int(cover.sum())
                    edge = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(np.int8)))
                    spans = [{"first": a, "stop": z} for a, z in edge.reshape(-1, 2).tolist()]
                    words = [w for w, c in zip(words, cover.tolist()) if not c]
                out.append((i, n, removed, spans, b" ".join(words).decode()))
            part = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))), pa.array(part[4], pa.string())], names=["id", "n_words", "n_removed", "removed", "kept_text"])

    return of


def packed_windows(rows: DataFrame, window: int, buckets: int, hot_windows: int) -> DataFrame:
    """bucket, id, th, packed, hashes of rows (id, th, text). Buckets are counted first; those of more than hot_windows
    windows are dealt to slots by the windows' hashes. The driver gets one row per hot bucket."""
    n = rows.mapInArrow(_hash_windows(window, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > hot_windows)
    hot = np.array(sorted((r["bucket"], -(-r["n"] // hot_windows)) for r in n.collect()), np.int64).reshape(-1, 2)
    hot = np.c_[hot, buckets + np.cumsum(hot[:, 1]) - hot[:, 1]]
    return rows.mapInArrow(_hash_windows(window, buckets, hot), "bucket int, id long, th long, packed binary, hashes binary")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, bucket_chars: int = 4 << 20, least_buckets: int = 256, hot_windows: int = 1 << 20, part_chars: int = 8 << 20) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, removed (maximal intervals of word positions), kept_text."""
    if window < INNER:
        raise ValueError(f"window must be {INNER} words at least")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    size = input_chars(docs, text_col)
    buckets = max(least_buckets, size // bucket_chars)
    found = packed_windows(d.where(F.col("id").isNotNull() & F.col("text").isNotNull()), window, buckets, hot_windows)
    # what a task already knows rides along under a salt, so that no group holds it all
    group = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(-1 - F.pmod(F.xxhash64("id", "th"), F.lit(buckets)))

    def repeats(key, pdf):
        return _repeats(key, pdf) if key[0] >= 0 else pdf[["id", "th", "packed"]].astype({"id": "int64", "th": "int64"})

    # shuffled in parts of about `part_chars` characters of text, however few partitions the session has set
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // part_chars, 100_000))
    gone = found.withColumn("g", group).repartition(parts, "g").groupBy("g").applyInPandas(repeats, "id long, th long, packed binary")
    gone = gone.groupBy("id", "th").agg(F.collect_list("packed").alias("gone"))
    texts = d.mapInArrow(_squeeze, "id long, th long, z binary")
    return texts.join(gone, ["id", "th"], "left").select("id", "z", "gone").mapInArrow(_cut(window), "id long, n_words long, n_removed long, removed array<struct<first:int,stop:int>>, kept_text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    r = substring_dedup(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["first"], x["stop"])), ",").alias("removed"))


def op1_sql() -> str:
    """DuckDB; windows as lists of words, no hashes."""
    return r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(0, len(ws) - 49)) AS p, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(ws[p + 1 : p + 50], ' ')) AS k FROM win),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS f FROM h) WHERE f < doc_id),
cover AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM gone),
word AS (SELECT doc_id, unnest(ws) AS t, unnest(range(0, len(ws))) AS i FROM w),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS s FROM word ANTI JOIN cover USING (doc_id, i) GROUP BY doc_id),
mark AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cover),
run AS (SELECT doc_id, string_agg(a || ':' || z, ',' ORDER BY a) AS removed
  FROM (SELECT doc_id, min(i) AS a, max(i) + 1 AS z FROM mark GROUP BY doc_id, g) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM cover GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256,
  coalesce(removed, '') AS removed
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN run USING (doc_id) LEFT JOIN n USING (doc_id)"""
