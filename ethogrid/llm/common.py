"""Shared pieces: the shared folder, counted broadcasts, and vectorised word hashing for Arrow tasks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder as shared_dir

#: Java and Spark SQL form of the word pattern `[^\x20\x09-\x0D]+`, and of its complement.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores if its scan has fewer partitions than those, and 64 at most (a table of few files, whose
    row groups may even leave some of them empty; some gigabytes to shuffle); else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 65) else df


def released(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more; a later read fails."""
    path = getattr(df, "_stored_at", None)
    if path:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of a stored df if it has at most max_rows rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def input_chars(df: DataFrame, text: str) -> int:
    """Bytes of text in all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("n")).first()["n"]


# ---- vectorised text -------------------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95  # 5 modulo 8: its powers differ by little powers of two only
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        x = np.full(size, base, np.uint64)
        x[0] = 1
        _powers[base] = have = np.multiply.accumulate(x)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int, base: int = _WORD_BASE) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of all windows of `width` consecutive values."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(inverse(base), n - width + 1) + np.uint64(width))


def word_spans(buf: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; bounds: where each document starts, and the end. Words never cross a bound."""
    word = ~space[buf]
    before, after = np.empty_like(word), np.empty_like(word)
    if len(buf):
        before[0], before[1:] = True, ~word[:-1]
        after[-1], after[:-1] = True, ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < len(buf))]
        before[inner] = True
        after[inner - 1] = True
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, len(buf)), out=total[1:])
    back = powers(inverse(_BYTE_BASE), len(buf) + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: list, size: int = 1 << 20):
    """Ranges of texts of about `size` bytes, with their bytes; None counts as empty."""
    first, held, data = 0, 0, []
    for i, t in enumerate(texts):
        b = t.encode() if isinstance(t, str) else (t or b"")
        data.append(b)
        held += len(b)
        if held >= size:
            yield first, data
            first, held, data = i + 1, 0, []
    if data:
        yield first, data


def chunk_words(data: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of the documents in data: hashes of their words, in order, and where each document's words start (and the end)."""
    bounds = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(b) for b in data], out=bounds[1:])
    buf = np.frombuffer(b"".join(data), np.uint8)
    if lower:
        buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    starts, ends = word_spans(buf, bounds)
    return word_hashes(buf, starts, ends), np.searchsorted(starts, bounds)
