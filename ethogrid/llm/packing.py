"""Best-fit packing: token ids cut into pieces of a sequence's length at most, packed best-fit decreasing.

Tokens: a public tokenizer file whose vocabulary is lower case and drops white space, so no token crosses ASCII white
space and each distinct run of other characters is tokenised once per task (a bounded cache). After a document's ids
comes the end id. Only documents longer than `capacity` are cut.

Packing: pieces are dealt by hash to groups of about `group_rows` rows, each packed by one task from the longest piece
down into the open sequence with the least sufficient room. A segment tree over the rooms 0 .. capacity counts the open
sequences of each room and finds that sequence in O(log capacity). A group leaves about one sequence part empty.

Defined results. Null text: empty, one piece with the end id alone. Null ids and repeated rows: packed like others, each
row once. Ties: smaller id, then smaller piece first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

CACHE_WORDS = 1_200_000
LATIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Byte-level models write the bytes that have no printable Latin-1 character as characters from 256 on.
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_ids(path: str):
    """A function from texts (bytes) to their ids as little-endian 32-bit bytes.

    Words are cached as they are in lower case; a new one is looked up as its stem and its closing punctuation, which are
    tokens of their own after an ASCII letter, so that only stems reach the tokenizer, many in one call."""
    import struct

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize = tokenizer.model.tokenize

    def pack(*ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    cache: dict[bytes, bytes] = {}
    stems: dict[bytes, bytes] = {}

    def encode(new: list[bytes]) -> None:
        for i in range(0, len(new), 2000):
            texts = [w.decode() for w in new[i : i + 2000]]
            e = tokenizer.encode(" ".join(texts), add_special_tokens=False)
            raw = np.array(e.ids, "<u4").tobytes()
            starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
            cut = (4 * np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), starts)).tolist() + [len(raw)]
            stems.update((w, raw[a:b]) for w, a, b in zip(new[i : i + 2000], cut[:-1], cut[1:]))

    def parts(w: bytes) -> tuple[bytes, bytes]:
        stem = w.rstrip(b".,;:!?#*$%&")
        return (stem, w[len(stem) :]) if stem[-1:].isalpha() and b"<|" not in w else (w, b"")

    def of(text: bytes) -> bytes:
        # bytes: lower() and split() know ASCII only; the strings of special tokens are left as they are
        words = text.lower().split() if b"<|" not in text else [w if b"<|" in w else w.lower() for w in text.split()]
        got = list(map(cache.get, words))
        try:
            return b"".join(got)
        except TypeError:  # some are new
            pass
        if len(cache) > CACHE_WORDS:
            cache.clear()
        if len(stems) > CACHE_WORDS:
            stems.clear()
        split = {w: parts(w) for w, i in zip(words, got) if i is None}
        odd = []
        for x in dict.fromkeys(y for p in split.values() for y in p if y):
            if x not in stems:
                letters = x if x.isalpha() else LATIN.fullmatch(t := x.decode()) and t.lower().encode()
                if letters:  # one piece for the model, in its alphabet of bytes
                    stems[x] = pack(*[t.id for t in tokenize(letters.decode("latin-1").translate(BYTE_LETTERS))])
                else:
                    odd.append(x)
        encode(odd)
        stems[b""] = b""
        new = {w: stems[stem] + stems[end] for w, (stem, end) in split.items()}
        cache.update(new)
        return b"".join([new[w] if i is None else i for w, i in zip(words, got)])

    return of


def fitting_tokenizer(path: str) -> str:
    """path, if word_ids gives that tokenizer's ids: it lowers texts, drops white space and splits as word_ids does."""
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(path), word_ids(path)
    for text in ("It's A Test, of words! don't", "\tTwo  spaces\r\n", "a.b #c d's 12.5 \u00c9t\u00e9 e\u0301 \u65e5\u672c", "x" * 40 + " !?.;: 'll", ""):
        if ours(text.encode()) != b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids):
            raise ValueError(f"{path}: a tokenizer that does not work word by word, in lower case")
    return path


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """id, piece, start, length, ids_crc32 and (keep_ids) ids, little-endian unsigned 32-bit."""
    path, end = fitting_tokenizer(path or tokenizer_path()), end_id.to_bytes(4, "little")
    names = ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def of(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = word_ids(path)
        for b in batches:
            rows, held = [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = ids_of((text or "").encode()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
                held += len(ids)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(of, "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length, in the order given; each goes to the open sequence with the least room."""
    size = 1 << capacity.bit_length()
    tree = [0] * (2 * size)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = [], [], 0

    def count(room: int, by: int) -> None:
        i = room + size
        while i:
            tree[i] += by
            i >>= 1

    for n in lengths:
        i = n + size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up to the first right neighbour that holds some
                i >>= 1
            if i > 1:
                i += 1
                while i < size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
        if i > 1:
            room = i - size
            at = open_at[room].pop()
            count(room, -1)
        else:
            room, at = capacity, made
            made += 1
        sequence.append(at)
        offset.append(capacity - room)
        if room > n:
            open_at[room - n].append(at)
            count(room - n, 1)
    return sequence, offset


def pack(parts: DataFrame, capacity: int = 4096, group_rows: int = 20_000) -> DataFrame:
    """parts' columns with sequence_id and offset; parts: id, piece, start, length of at most capacity, others."""
    groups = max(1, -(-parts.select("id").count() // group_rows))
    return _packed(parts, capacity, groups)


def _packed(parts: DataFrame, capacity: int, groups: int) -> DataFrame:
    columns = parts.columns

    def of(key, pdf):
        pdf = pdf.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = best_fit(pdf["length"].tolist(), capacity)
        return pdf[columns].assign(sequence_id=[(int(key[0]) << 32) + s for s in sequence], offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return parts.withColumn("_g", F.pmod(F.xxhash64("id", "piece", "length"), F.lit(groups))).groupBy("_g").applyInPandas(of, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, group_rows: int = 20_000, keep_ids: bool = True, **tokens) -> DataFrame:
    """The pieces of docs in sequences; keep_ids: with their ids, else with the CRC-32 of the ids alone."""
    docs = docs.select(id_col, text_col)
    n = docs.agg(F.count("*").alias("docs"), F.sum(F.octet_length(text_col).cast("long")).alias("bytes")).first()
    # about the number of pieces: a document has one, and one more per capacity of tokens
    groups = max(1, -(-(n["docs"] + (n["bytes"] or 0) // (4 * capacity)) // group_rows))
    return _packed(pieces(docs, id_col, text_col, capacity, keep_ids=keep_ids, **tokens), capacity, groups)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    r = pack_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), keep_ids=False)
    return r.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
