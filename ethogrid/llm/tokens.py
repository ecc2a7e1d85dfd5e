"""Token counts through a digest cache: stored counts are joined by content and tokenizer version, misses encoded once.

The cache is a Parquet table of (content, n_tokens), partitioned by tokenizer. `content` is the SHA-256 of a text after a
normalisation that cannot change its count; `tokenizer` is the SHA-256 of the tokenizer's file, the library and its
version, and the normalisation. A run joins its documents to the counts of its tokenizer, encodes each content that has
none once, however many documents carry it, and appends those counts; the next run finds them.

Normalisation: a tokenizer that works word by word in lower case (`packing.fitting_tokenizer`) sees no case of ASCII
letters and no difference between runs of ASCII white space, so those are folded; texts that hold `<|`, as special strings
do, keep their case. Other tokenizers (.json of other kinds, .model) count each text as it is.

How it runs. Documents give their digests in one scan. The texts of unknown contents are made distinct before the shuffle
(copies leave a task once) and encoded in Arrow batches. Counts join back by digest; a digest that many rows share is a
skewed key of small rows, which AQE splits. A lost executor repeats its tasks alone; an append that was killed half-way may
leave rows behind, so the cache is read one row per content.

Defined results. Null text: empty, 0 bytes, 0 tokens. Null ids and repeated rows: one result row each. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, shared_dir, spread, stored
from .packing import fitting_tokenizer, tokenizer_path, word_ids

CACHE = "content binary, n_tokens long, tokenizer string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache
def by_words(path: str) -> bool:
    """Whether the tokenizer works word by word in lower case."""
    try:
        return path.endswith(".json") and bool(fitting_tokenizer(path))
    except ValueError:
        return False


def tokenizer_version(path: str) -> str:
    """A hash of all that decides a count."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library} {'folded' if by_words(path) else 'exact'}".encode()).hexdigest()


def normalised(text: Column, folded: bool) -> Column:
    """The text with what its tokenizer cannot see taken out; null: empty."""
    text = F.coalesce(text, F.lit(""))
    if not folded:
        return text
    text = F.trim(F.regexp_replace(text, GAP, " "))
    return F.when(F.instr(text, "<|") > 0, text).otherwise(F.translate(text, UPPER, LOWER))


def token_counter(path: str, words: bool):
    """A function from a list of texts to their numbers of tokens, as the library of the file's kind gives them; words: the
    tokenizer works word by word."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if words:
        ids = word_ids(path)
        return lambda texts: [len(ids(t.encode())) // 4 for t in texts]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.no_truncation()
    plain.no_padding()
    return lambda texts: [len(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """content, n_tokens of texts (content, text)."""
    words = by_words(path)

    def of(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = token_counter(path, words)
        for b in batches:
            counts, held, chars = [], [], 0
            for t in b.column(1).to_pylist():
                held.append(t)
                chars += len(t)
                if chars > 1 << 20:  # a few long texts at a time
                    counts += count(held)
                    held, chars = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts + count(held), pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(of, "content binary, n_tokens long")


class Cache:
    """Stored counts in a folder that driver and executors share."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def counts(self, version: str) -> DataFrame:
        """content, n_tokens of one tokenizer; none while nothing has been stored."""
        try:
            held = self.spark.read.schema(CACHE).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            held = self.spark.createDataFrame([], CACHE)
        return held.where(F.col("tokenizer") == version).select("content", "n_tokens").dropDuplicates(["content"])

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select("content", "n_tokens", F.lit(version).alias("tokenizer")).write.mode("append").partitionBy("tokenizer").parquet(self.path)


def token_counts(docs: DataFrame, cache: Cache, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every row of docs; the cache gains the contents that it lacked."""
    return _counted(_remembered(docs, cache, path or tokenizer_path(), id_col, text_col), cache, path or tokenizer_path())


def _remembered(docs: DataFrame, cache: Cache, path: str, id_col: str, text_col: str) -> DataFrame:
    """id, n_bytes, content of docs; afterwards the cache holds all of their contents."""
    version, folded = tokenizer_version(path), by_words(path)
    text = normalised(F.col(text_col), folded)
    content = F.unhex(F.sha2(text, 256)).alias("content")
    rows = stored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), content), "digests")
    # a normalised text has the count of the text itself, so that is what goes to the tokenizer
    misses = docs.select(content, text.alias("text")).dropDuplicates(["content"]).join(cache.counts(version), "content", "left_anti")
    cache.append(encoded(misses, path), version)
    return rows


def _counted(rows: DataFrame, cache: Cache, path: str) -> DataFrame:
    counts = stored(cache.counts(tokenizer_version(path)), "counts")  # as a table, so that a content of many rows can be split
    return rows.join(counts, "content").select("id", "n_bytes", "n_tokens")


def count_deliveries(docs: DataFrame, cache: Cache, deliveries: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As token_counts of all docs, which come in deliveries (by the hash of their id): each encodes only what neither the
    cache nor a delivery before it held."""
    path, part, every = path or tokenizer_path(), F.pmod(F.xxhash64(id_col), F.lit(deliveries)), None
    for k in range(deliveries):
        rows = _remembered(docs.where(part == k), cache, path, id_col, text_col)
        every = rows if every is None else every.unionByName(rows)
    return _counted(every, cache, path)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """With a cache of its own, in two deliveries; over_limit: more than 2048 tokens."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = count_deliveries(docs, Cache(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
