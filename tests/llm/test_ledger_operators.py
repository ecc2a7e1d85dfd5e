"""Token counts, filter audit and Merkle manifest against brute force, and on odd rows."""

import hashlib
import random
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ethogrid.llm import audit, merkle, tokens
from ethogrid.llm.packing import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, content int, mask string, tree int, part int, digest int, first int, path int"


def table(spark, rows):
    """rows: (doc_id, text, lang, source); other columns have names that the operators use inside."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, "m", 2, 3, 4, 5, 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["alpha", "Beta", "GAMMA", "don't", "x1", "é", "Ñandú", "12.5", "<|endoftext|>", "a<|STARTOFTEXT|>b", "日本", "👍🏽", "ﬁ", "é", "I'LL", "#", " ", " x", "&", "A"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 150))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None, ""])) for i in range(120)]
    copy = "One Two  three\nfour " * 40
    out += [(i, copy if i % 2 else copy.lower().replace("  ", "\t"), "en", "hot") for i in range(200, 700)]
    out += [(800, None, "en", "a"), (801, "", "", "a"), (802, " \n ", None, None), (None, "no id A", "de", "b"), (None, None, None, None), (803, copy, "de", "lone"), (803, copy, "de", "lone"), (804, "w " * 30000, "de", "b")]
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, rows, tmp_path, name):
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        want = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    every = rows if name.startswith("word") else rows[:150] + rows[-8:-1]
    cache = tokens.Cache(spark, f"{tmp_path}/cache")
    got = tokens.token_counts(table(spark, every), cache, path).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, len((t or "").encode()), want(t or "")) for i, t, *_ in every), key=repr)


def test_token_cache_is_joined_and_appended(spark, rows, tmp_path):
    path = tokenizer_path()
    cache, version = tokens.Cache(spark, f"{tmp_path}/cache"), tokens.tokenizer_version(path)
    assert cache.counts(version).count() == 0
    assert tokens.token_counts(table(spark, []).limit(0), cache).count() == 0
    first = tokens.token_counts(table(spark, rows[:100]), cache).collect()
    held = cache.counts(version).count()
    assert 0 < held <= len({t for _, t, *_ in rows[:100]})
    stored = spark.read.parquet(cache.path)
    stored.withColumn("n_tokens", F.lit(7).cast("long")).write.parquet(f"{tmp_path}/other", partitionBy="tokenizer")
    assert {r.n_tokens for r in tokens.token_counts(table(spark, rows[:100]), tokens.Cache(spark, f"{tmp_path}/other")).collect()} == {7}  # found, not encoded
    again = tokens.token_counts(table(spark, rows), cache).where("id < 100").collect()
    assert sorted(again) == sorted(first)
    copies = tokens.Cache(spark, f"{tmp_path}/copies")
    tokens.token_counts(table(spark, rows[120:620]), copies)
    assert spark.read.parquet(copies.path).count() == 1  # case and white space apart, one text
    cache.append(cache.counts(version).limit(5), version)  # as an append that was run twice would
    assert tokens.token_counts(table(spark, rows), cache).count() == len(rows)
    parts = tokens.count_deliveries(table(spark, rows), tokens.Cache(spark, f"{tmp_path}/parts"), 3).collect()
    assert sorted(parts, key=repr) == sorted(tokens.token_counts(table(spark, rows), cache).collect(), key=repr)
    assert tokens.tokenizer_version(tokenizer_path("byte_bpe_50k.json")) != version and cache.counts("other").count() == 0


def brute_audit(rows, labels):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    first, out = {}, {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang, _ in rows:
        t = t or ""
        ws = word.findall(t)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    for part in {d[0] for d in docs}:
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in docs if d[0] == part)
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit(spark, rows):
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(range(900), 400)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.audit(audit.masks(table(spark, rows), marks)).collect())
    assert got == brute_audit(rows, labels)
    assert any(r[5] for r in got) and any(r[6] for r in got) and audit.audit(audit.masks(table(spark, []).limit(0), marks)).count() == 0
    assert audit.audit(audit.masks(table(spark, rows), marks.limit(0))).agg(F.max("good_lost")).first()[0] == 0


def test_gray_code_walk_visits_all_subsets():
    rng = random.Random(4)
    cells = {m: (rng.randint(1, 50), rng.randint(0, 9), rng.randint(0, 9)) for m in rng.sample(range(32), 20)}
    for subset, state in enumerate(audit.survivors(cells)):
        assert state == tuple(sum(c[k] for m, c in cells.items() if not m & subset) for k in range(3))
    assert audit.survivors({}) == [(0, 0, 0)] * 32


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_manifest(rows):
    def leaf(i, t, lang, source, n):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)])

    def grown(level):
        levels = [level]
        while len(level) > 1:
            level = [sha(*level[i : i + 16]) for i in range(0, len(level), 16)]
            levels.append(level)
        return levels

    def siblings(levels, at):
        for level in levels[:-1]:
            run = at - at % 16
            yield level[run:at], level[at + 1 : run + 16]
            at //= 16

    by = {}
    for i, t, lang, source in rows:
        n = None if t is None else len(t)
        bad = i is not None and t is not None and zlib.crc32(str(i).encode()) % 5 == 0
        low = t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        by.setdefault(source, []).append(((i is not None, i or 0), leaf(i, t, lang, source, n), i, leaf(i, low, lang, source, n) if bad else None))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([r[1] for r in sorted(by[s], key=lambda r: r[:2])]) for s in sources}
    top = grown([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, h, i, changed) in enumerate(sorted(by[s], key=lambda r: r[:2])):
            path = [*siblings(trees[s], at), *siblings(top, k)]
            to = changed or h
            for a, b in path:
                to = sha(*a, to, *b)
            out.append((i, h, trees[s][-1][0], top[-1][0], sha(*[x for a, b in path for x in a + b]), to, to == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest(spark, rows, levels):
    every = rows + [(2000 + i, f"T{i}", "en", f"s{i % 40}") for i in range(90)]
    got = sorted(map(tuple, merkle.manifest(table(spark, every), levels=levels).collect()), key=repr)
    assert got == brute_manifest(every)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4 and len({r[3] for r in got}) == 1


def test_manifest_of_few_rows(spark):
    for few in ([], [(1, "A b", "en", "s")], [(1, "x", "en", "s"), (2, "y", "en", "t")], [(1 << 60, "x", "en", "s"), (None, "y", "en", "s"), ((1 << 60) + 1, "z", "en", "s")], [(7, "Same", "en", "s")] * 300, [(i, "x", None, None) for i in range(257)]):
        df = table(spark, few) if few else table(spark, []).limit(0)
        assert sorted(map(tuple, merkle.manifest(df, levels=1).collect()), key=repr) == brute_manifest(few)
        assert merkle.manifest(df, tampered=lambda i: F.lit(False)).where("NOT verified").count() == 0
