"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained in
numpy, scoring all overlapping windows of every text.

Words are runs of letters (ASCII letters lowered, and all bytes from 128 on). A word's input joins a word part (hashed
embedding, and the class log-odds of the word among the training documents) and a character part (mean embedding of its
hashed character 3- to 5-grams with word ends, and their mean and largest log-odds). Windows are `WIDTH` words long and
start every `WIDTH // 2` words, to the end of the text. A window's hidden states are pooled by attention to one logit; a
document's score is its largest window logit, calibrated.

Training: at most `sample` labelled documents of each class (smallest hashes of the id), on the driver. As a label says
that some window is toxic, not which, each round trains on the windows of toxic documents that score highest so far, and
on random and highest ones of the others.

Defined results. Null, empty or wordless text: the score of an empty window. Without labels of both classes the score is
the labels' share (0 if none). Null and repeated ids: one result row each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, inverse, mix, powers, spread, word_hashes, word_spans

WIDTH, HIDDEN = 32, 8
WORDS, GRAMS = 1 << 16, 1 << 16
WORD_DIM, GRAM_DIM = 6, 6
INPUT = WORD_DIM + GRAM_DIM + 3
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def tokens(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Index of each word among the distinct ones, where documents' words start, hashes of the distinct words, and their
    hashed grams, in order of the word that each belongs to (one at least)."""
    bounds = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(b) for b in data], out=bounds[1:])
    buf = np.frombuffer(b"".join(data), np.uint8)
    buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    starts, ends = word_spans(buf, bounds, NOT_LETTER)
    hashes, first, index = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    size = ends[first] - starts[first]
    padded = np.zeros(int(size.sum()) + len(size) + 1, np.uint64)  # a zero before, between and after words
    at = np.cumsum(np.r_[1, size[:-1] + 1]) if len(size) else np.empty(0, np.int64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    padded[np.repeat(at, size) + inside] = buf[np.repeat(starts[first], size) + inside]
    owner = np.repeat(np.arange(len(size)), size + 1)  # of the position before each letter and of the last letter
    base = 0x9E3779B97F4A7C15 | 1
    total = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum((padded + np.uint64(1)) * powers(base, len(padded)), out=total[1:])
    back = powers(inverse(base), len(padded) + 1)
    room = np.repeat(size + 2, size + 1) - (np.arange(len(owner)) - np.repeat(at - 1, size + 1))  # letters and ends from here
    grams, fits = np.zeros((len(owner), 3), np.uint64), np.zeros((len(owner), 3), bool)
    for k, n in enumerate((3, 4, 5)):
        here = np.flatnonzero(room >= n)
        grams[here, k] = mix((total[here + n] - total[here]) * back[here] + np.uint64(n))
        fits[here, k] = True
    return index, np.searchsorted(starts, bounds), hashes, grams[fits], np.repeat(owner, 3).reshape(-1, 3)[fits]


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and document of each window; a document without words has one empty window."""
    n = np.diff(at)
    half = WIDTH // 2
    count = np.maximum(1, -(-(n - half) // half))
    doc = np.repeat(np.arange(len(n)), count)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * half
    return at[doc] + first, np.minimum(WIDTH, n[doc] - first), doc


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def start(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
    return {"word": d(WORDS, WORD_DIM) * 0.1, "gram": d(GRAMS, GRAM_DIM) * 0.1, "in": d(INPUT, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, np.float32), "turn": d(2, HIDDEN, 3 * HIDDEN), "look": d(2 * HIDDEN), "out": d(2 * HIDDEN), "level": np.full(1, -1, np.float32)}


def inputs(p: dict, prior: dict, hashes: np.ndarray, grams: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The input vector of each distinct word."""
    if not len(hashes):
        return np.zeros((0, INPUT), np.float32)
    w, g = (hashes % np.uint64(WORDS)).astype(np.int64), (grams % np.uint64(GRAMS)).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    count = np.diff(np.r_[begin, len(owners)])[:, None].astype(np.float32)
    odds = prior["gram"][g]
    mean, part = np.add.reduceat(p["gram"][g], begin, axis=0) / count, np.add.reduceat(odds, begin)[:, None] / count
    return np.concatenate([p["word"][w], prior["word"][w, None], mean, part, np.maximum(np.maximum.reduceat(odds, begin), 0)[:, None]], axis=1).astype(np.float32)


def forward(p: dict, fed: np.ndarray, index: np.ndarray, length: np.ndarray, keep: bool = False):
    """Logits of windows; fed: inputs through the input weights, with a row of zeros at the end; index: (windows, WIDTH)."""
    n, h = len(index), HIDDEN
    mask = np.arange(WIDTH)[:, None] < length[None, :]
    states = np.zeros((2, WIDTH + 1, n, h), np.float32)
    tape = []
    for way in (0, 1):
        part = np.ascontiguousarray(fed[:, 3 * h * way : 3 * h * (way + 1)])
        turn = p["turn"][way]
        now = states[way, 0]
        for k in range(WIDTH):
            t = k if way == 0 else WIDTH - 1 - k
            x = part[index[:, t]]
            a = now @ turn
            gate = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
            z, r = gate[:, :h], gate[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
            if keep:
                tape.append((now, z, r, new, a[:, 2 * h :]))
            now = np.where(mask[t][:, None], new + z * (now - new), now)
            states[way, k + 1] = now
    both = np.concatenate([states[0, 1:], states[1, :0:-1]], axis=2)  # (WIDTH, n, 2h)
    look = np.where(mask, both @ p["look"], -np.inf)
    top = np.where(length > 0, look.max(axis=0), 0)
    e = np.where(mask, np.exp(look - top), 0)
    share = e / np.maximum(e.sum(axis=0), 1e-30)
    pooled = (share[:, :, None] * both).sum(axis=0)
    logit = pooled @ p["out"] + p["level"][0]
    return (logit, (mask, tape, both, share, pooled)) if keep else logit


def backward(p: dict, fed_rows: int, index: np.ndarray, kept, d_logit: np.ndarray):
    """Gradients of turn, look, out, level and of the fed inputs."""
    mask, tape, both, share, pooled = kept
    h, n = HIDDEN, len(index)
    g = {"out": pooled.T @ d_logit, "level": d_logit.sum(keepdims=True)}
    d_pool = d_logit[:, None] * p["out"]
    d_share = (both * d_pool).sum(axis=2)
    d_look = share * (d_share - (share * d_share).sum(axis=0))
    g["look"] = np.einsum("tn,tnk->k", d_look, both)
    d_both = share[:, :, None] * d_pool + d_look[:, :, None] * p["look"]
    g["turn"] = np.zeros_like(p["turn"])
    d_fed = np.zeros((fed_rows, 6 * h), np.float32)
    for way in (0, 1):
        carry = np.zeros((n, h), np.float32)
        turn = p["turn"][way]
        steps = np.empty((WIDTH, n, 3 * h), np.float32)
        for k in range(WIDTH - 1, -1, -1):
            t = k if way == 0 else WIDTH - 1 - k
            now, z, r, new, an = tape[way * WIDTH + k]
            m = mask[t][:, None]
            d = carry + d_both[t][:, way * h : (way + 1) * h]
            on = np.where(m, d, 0)
            d_new = on * (1 - z) * (1 - new * new)
            d_z = on * (now - new) * z * (1 - z)
            d_r = d_new * an * r * (1 - r)
            steps[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_a = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g["turn"][way] += now.T @ d_a
            carry = np.where(m, on * z, d) + d_a @ turn.T
        for c in range(3 * h):
            d_fed[:, 3 * h * way + c] = np.bincount(index.T.ravel(), steps[:, :, c].ravel(), fed_rows)
    return g, d_fed


def log_odds(buckets, y: np.ndarray, size: int, least: int = 4) -> np.ndarray:
    """Smoothed class log-odds of buckets by the documents that hold them (buckets: of each document in turn); 0 for
    those in few documents."""
    held = np.zeros((2, size), np.int64)
    for b, c in zip(buckets, y.astype(int)):
        held[c, np.unique(b)] += 1
    odds = np.log((held[1] + 0.5) / (y.sum() + 1)) - np.log((held[0] + 0.5) / (len(y) - y.sum() + 1))
    return np.where(held.sum(axis=0) >= least, np.clip(odds, -4, 4) / 2, 0).astype(np.float32)


def spans(begin: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions begin .. begin + size of each entry in at, one after the other."""
    n = size[at]
    return np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def merged_tokens(texts: list) -> tuple:
    """tokens() of all texts, chunk by chunk; owners come in order."""
    index, sizes, grams, owners, known = [], [], [], [], np.empty(0, np.uint64)
    hashes = []  # of the words in order of their first chunk
    for _, data in chunks(texts, 1 << 18):
        i, at, h, g, o = tokens(data)
        new = ~np.isin(h, known)
        number = np.cumsum(new) - 1 + len(known)
        mine = new[o]
        grams.append(g[mine])
        owners.append(number[o[mine]])
        hashes.append(h[new])
        known = np.concatenate([known, h[new]])
        order = np.argsort(known, kind="stable")
        index.append(order[np.searchsorted(known, h, sorter=order)][i].astype(np.int32))
        sizes.append(np.diff(at))
    return np.concatenate(index), np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(hashes), np.concatenate(grams), np.concatenate(owners)


def _index(index: np.ndarray, first: np.ndarray, length: np.ndarray, empty: int) -> np.ndarray:
    pos = first[:, None] + np.arange(WIDTH)
    inside = np.arange(WIDTH) < length[:, None]
    return np.where(inside, np.append(index, empty)[np.where(inside, pos, len(index))], empty)


def logits(model: dict, data: list[bytes]) -> np.ndarray:
    """Largest window logit of each document."""
    p = model["p"]
    index, at, hashes, grams, owners = tokens(data)
    fed = np.concatenate([inputs(p, model["prior"], hashes, grams, owners) @ p["in"] + p["bias"], np.zeros((1, 6 * HIDDEN), np.float32)]).astype(np.float32)
    first, length, doc = windows(at)
    out = np.empty(len(doc), np.float32)
    for i in range(0, len(doc), 4096):
        part = slice(i, i + 4096)
        out[part] = forward(p, fed, _index(index, first[part], length[part], len(hashes)), length[part])
    return np.maximum.reduceat(out, np.searchsorted(doc, np.arange(len(data)))) if len(data) else out


def train(texts: list[str], y: np.ndarray, steps: int = 240, batch: int = 256, rate: float = 0.01, seed: int = 5, odds: float | None = None) -> dict:
    """odds: of label 1 among all labelled documents, where the texts over- or underdraw it."""
    y = np.asarray(y, np.float32)
    if not len(y) or y.min() == y.max():
        return {"share": float(y.mean()) if len(y) else 0.0}
    rng, p = np.random.default_rng(seed), start(seed)
    index, at, hashes, grams, owners = merged_tokens(texts)
    w, g = (hashes % np.uint64(WORDS)).astype(np.int64), (grams % np.uint64(GRAMS)).astype(np.int32)
    n_grams = np.bincount(owners, minlength=len(hashes))
    begin = np.cumsum(n_grams) - n_grams
    prior = {"word": log_odds((w[np.unique(index[a:b])] for a, b in zip(at[:-1], at[1:])), y, WORDS), "gram": log_odds((g[spans(begin, n_grams, np.unique(index[a:b]))] for a, b in zip(at[:-1], at[1:])), y, GRAMS)}
    first, length, doc = windows(at)
    every = _index(index, first, length, len(hashes)).astype(np.int32)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}

    def by_block(of, width: int) -> np.ndarray:
        """of(inputs) of all words, some at a time, and a row of zeros."""
        out = np.zeros((len(hashes) + 1, width), np.float32)
        for i in range(0, len(hashes), 8192):
            at = np.arange(i, min(i + 8192, len(hashes)))
            out[at] = of(inputs(p, prior, hashes[at], grams[spans(begin, n_grams, at)], np.repeat(at, n_grams[at])))
        return out

    hint = by_block(lambda x: x[:, [WORD_DIM]] + x[:, [-1]], 1)[:, 0]
    score = hint[every].max(axis=1)
    toxic, step = y[doc] == 1, 0
    about = y.sum() + np.minimum(np.bincount(doc), 4)[y == 0].sum()
    rounds = int(np.clip(steps * batch / max(about, 1), 4, 24))
    for turn in range(rounds):
        order = np.lexsort((-score, doc))
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc)) - np.searchsorted(doc, doc[order])
        drawn = rng.random(len(doc)) < 3 / np.maximum(np.bincount(doc)[doc], 3)
        chosen = np.flatnonzero((toxic & (rank < 1)) | (~toxic & ((rank < 1) | drawn)))
        weight = np.where(toxic[chosen], (~toxic[chosen]).sum() / max(toxic[chosen].sum(), 1), 1).clip(1, 4)
        shuffled = rng.permutation(len(chosen))
        for i in range(0, len(shuffled), batch):
            mine = chosen[shuffled[i : i + batch]]
            words, local = np.unique(every[mine], return_inverse=True)
            local = local.reshape(len(mine), WIDTH)
            real = words[words < len(hashes)]
            take = spans(begin, n_grams, real)
            own = np.repeat(np.arange(len(real)), n_grams[real])
            x = inputs(p, prior, hashes[real], grams[take], own)
            fed = np.zeros((len(words), 6 * HIDDEN), np.float32)
            fed[: len(real)] = x @ p["in"] + p["bias"]
            logit, kept = forward(p, fed, local, length[mine], keep=True)
            d = (weight[shuffled[i : i + batch]] * (_sigmoid(logit) - y[doc[mine]]) / len(mine)).astype(np.float32)
            grad, d_fed = backward(p, len(words), local, kept, d)
            d_fed = d_fed[: len(real)]
            grad["in"], grad["bias"] = x.T @ d_fed, d_fed.sum(axis=0)
            d_x = d_fed @ p["in"].T
            step += 1
            now = rate * (1 - 0.9 * turn / rounds)
            for k, gk in grad.items():
                a, b = m[k]
                a += 0.1 * (gk - a)
                b += 0.01 * (gk * gk - b)
                p[k] -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            share = -5 * now * d_x / np.maximum(n_grams[real], 1)[:, None]
            for c in range(WORD_DIM):
                p["word"][:, c] -= np.bincount(w[real], 5 * now * d_x[:, c], WORDS).astype(np.float32)
            for c in range(GRAM_DIM):
                p["gram"][:, c] += np.bincount(g[take], share[own, WORD_DIM + 1 + c], GRAMS).astype(np.float32)
        if turn % 3 == 2 or turn == rounds - 1:
            fed = by_block(lambda x: x @ p["in"] + p["bias"], 6 * HIDDEN)
            for i in range(0, len(doc), 4096):
                score[i : i + 4096] = forward(p, fed, every[i : i + 4096], length[i : i + 4096])
    most = np.maximum.reduceat(score, np.searchsorted(doc, np.arange(len(y)))).astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt scaling with smoothed targets
        q = _sigmoid(a * most + b)
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        s = q * (1 - q) + 1e-6
        hess = np.array([[(s * most * most).sum() + 1e-3, (s * most).sum()], [(s * most).sum(), s.sum() + 1e-3]])
        delta = np.linalg.solve(hess, [((q - t) * most).sum(), (q - t).sum()])
        a, b = a - np.clip(delta[0], -1, 1), b - np.clip(delta[1], -1, 1)
    if odds:
        b += float(np.log(odds * (len(y) - y.sum()) / y.sum()))
    return {"p": {k: v.astype(np.float32) for k, v in p.items()}, "prior": prior, "a": float(max(a, 1e-3)), "b": float(b)}


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 800, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The model from `sample` labelled rows of each class at most (the smallest hashes), none of them held out."""
    known = labels.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    parts = [known.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)]
    ids = parts[0].union(parts[1]).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    drawn = [rows.where(F.col("y") == c).orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(sample) for c in (0, 1)]  # where ids repeat
    got = drawn[0].union(drawn[1]).toPandas()
    n1, n0 = known.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    return train(got["text"].tolist(), got["y"].to_numpy(), odds=n1 / n0 if n1 and n0 else None)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and row (all of docs' columns, passed through), one row per row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches):
        m = held.value
        for b in batches:
            got = []
            for _, data in chunks(b.column(1).to_pylist(), 1 << 20):
                if "p" in m:
                    got.append(_sigmoid(m["a"] * logits(m, data).astype(np.float64) + m["b"]))
                else:
                    got.append(np.full(len(data), m["share"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(got) if got else np.empty(0), pa.float64()), b.column(2)], names=["id", "score", "row"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.mapInArrow(of, f"id long, score double, row {rows.schema['row'].dataType.simpleString()}")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/labels.parquet")
    r = score(docs, learn(docs, labels)).select(F.col("id").alias("doc_id"), "score")
    return r.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
