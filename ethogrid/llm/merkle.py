"""Merkle dataset manifest: a root over all rows, a proof for every row, and its check, by a cogrouped subtree exchange.

Leaves are SHA-256 hashes of rows. Per source they stand in the order of doc_id, and level by level every `FAN` = 16
consecutive nodes (the last run: fewer, even one) become the hash of their concatenated hexadecimal digests, until one is
left, the subroot. Subroots in the order of sources (null first, bytewise) likewise give the root.

How it runs. One scan hashes the rows; texts are never shuffled. Leaves are dealt by ranges of (source, id, leaf) and
written in order; a leaf's position is its row number in its partition plus the counts of earlier partitions, so no task
holds a source. A superblock is FAN ** `levels` aligned leaves of a source (4096). Each superblock is reduced to its top
node; above them the tree is small, and is built by level with aggregates of 16 nodes, whose siblings go down again to the
superblocks as their required outer nodes. Leaves and outer nodes are then cogrouped by superblock: one applyInPandas call
repeats the local reduction, joins local and outer siblings into proofs, and folds each leaf up to the root. Groups are
bounded by the superblock's size, whatever the source's.

A proof is the siblings of the path, level by level up to the root, left to right; its digest is returned. `folded_root`
folds the row as it is found now (tampered, if `tampered` says so) with the siblings of the manifest.

Defined results. A null field is `-`, and a null source a source of its own, before the empty one. Ties of doc_id (null
ids first) are ordered by their leaves; equal rows have equal leaves, and each gets a place and a proof of its own.
Tampering of rows without an id or with a null text changes nothing. A source of one row has its leaf as subroot; one
source alone has its subroot as root. An empty table gives an empty result. Columns beyond the five are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, spread, stored
from .tokens import LOWER, UPPER

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon, and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def every_fifth(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the id in decimals."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered=every_fifth) -> DataFrame:
    """source, doc_id, leaf, found (the leaf of the row as it is found now) and row (a number of its own)."""
    ids, text = F.col(fields[0]), F.col(fields[-1])
    columns = [F.col(c) for c in fields]
    changed = F.when(tampered(ids) & text.isNotNull(), leaf([*columns[:-1], F.translate(text, UPPER, LOWER)]))
    return stored(docs.select(F.col(fields[1]).alias("source"), ids.alias("doc_id"), leaf(columns).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("row")), "leaves")


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows of leaves() with tree, the rank of their source, n, the leaves of that source, and pos, their place in it;
    tree, source, n of all sources)."""
    ordered = rows.repartitionByRange("source", "doc_id", "leaf", "row").sortWithinPartitions("source", "doc_id", "leaf", "row")
    at = F.monotonically_increasing_id()  # the partition's number above bit 33, the row's number below
    ordered = stored(ordered.select("source", "doc_id", "leaf", "changed", F.shiftright(at, 33).alias("part"), F.bitwise_not(F.shiftleft(F.lit(-1).cast("long"), 33)).bitwiseAND(at).alias("at")), "ordered")
    spans = stored(ordered.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("rows")), "spans")
    # a source begins in its first partition, after those that begin in earlier ones and those that sort before it there
    sources = spans.groupBy("source").agg(F.min("part").alias("part"), F.sum("rows").alias("n"))
    begun = sources.groupBy("part").agg(F.count("*").alias("sources"))
    before = begun.select("part", (F.sum("sources").over(Window.orderBy("part")) - F.col("sources")).alias("before"))  # a row per partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    sources = stored(sources.join(before, "part").select("source", "n", (F.col("before") + rank).cast("long").alias("tree")), "sources")
    so_far = F.sum("rows").over(Window.partitionBy("source").orderBy("part")) - F.col("rows")
    spans = spans.withColumn("before", so_far).withColumnRenamed("source", "its")
    spans = spans.join(sources, F.col("its").eqNullSafe(F.col("source"))).select("part", "its", "tree", "n", (F.col("before") - F.col("first")).alias("shift"))
    spans = bounded_broadcast(stored(spans, "places"), 200_000)
    out = ordered.join(spans, (ordered["part"] == spans["part"]) & ordered["source"].eqNullSafe(spans["its"]))
    return out.select("tree", "n", (F.col("at") + F.col("shift")).alias("pos"), "doc_id", "leaf", "changed"), sources


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def local_levels(n: int, most: int) -> int:
    """Levels of a superblock of FAN ** most leaves in a source of n leaves: fewer, where the source is smaller."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and those of each level above."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def sides(level: list[str], i: int) -> tuple[str, str]:
    """The siblings of node i on its left and on its right, concatenated."""
    run = i - i % FAN
    return "".join(level[run:i]), "".join(level[i + 1 : run + FAN])


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def tops(blocks: DataFrame, levels: int) -> DataFrame:
    """tree, n (superblocks of the tree), pos, h: the top node of each superblock; blocks: placed leaves with block."""

    def of(key, pdf):
        import pandas as pd

        tree, n, block = map(int, key)
        nodes = pdf.sort_values("pos")["leaf"].tolist()
        return pd.DataFrame([(tree, -(-n // FAN**levels), block, reduced(nodes, local_levels(n, levels))[-1][0])], columns=["tree", "n", "pos", "h"])

    return blocks.select("tree", "n", "block", "pos", "leaf").groupBy("tree", "n", "block").applyInPandas(of, "tree long, n long, pos long, h string")


def climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, h: the top of each tree; tree, pos, path of each node: array of (left, right) siblings up to that top);
    nodes: stored rows of tree, n (nodes of the tree), pos (from 0), h. One pass per level, groups of FAN rows."""
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    done, runs = nodes.where("n = 1").select("tree", "h"), []
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("run")
        runs.append(stored(nodes.where("n > 1").groupBy("tree", "n", F.expr(f"pos div {FAN}").alias("up")).agg(run), "runs"))
        above = F.array_join(F.transform("run", lambda s: s["h"]), "")
        nodes = runs[-1].select("tree", F.ceil(F.col("n") / FAN).alias("n"), F.col("up").alias("pos"), F.sha2(above, 256).alias("h"))
        done = done.unionByName(nodes.where("n = 1").select("tree", "h"))
        most = -(-most // FAN)
    paths = None
    for level in reversed(runs):  # from the top: a node's path is its siblings, then the path of the node above
        hashes = lambda a, b: F.array_join(F.transform(F.slice("run", a, b), lambda s: s["h"]), "")
        each = F.transform("run", lambda s, i: F.struct(s["pos"].alias("pos"), hashes(F.lit(1), i).alias("left"), hashes(i + 2, F.lit(FAN)).alias("right")))
        own = level.select("tree", "n", "up", F.explode(each).alias("s")).select("tree", "n", "up", "s.*")
        own = own.select("tree", "up", "pos", F.array(F.struct("left", "right")).alias("own"))
        if paths is not None:  # none for a tree whose top this level gives
            above = paths.select("tree", F.col("pos").alias("up"), F.col("path").alias("above"))
            own = own.join(above, ["tree", "up"], "left").withColumn("own", F.concat("own", F.coalesce("above", F.array().cast("array<struct<left:string,right:string>>"))))
        paths = stored(own.select("tree", "pos", F.col("own").alias("path")), "paths")
    if paths is None:
        paths = nodes.sparkSession.createDataFrame([], "tree long, pos long, path array<struct<left:string,right:string>>")
    return stored(done, "tops"), paths


RESULT = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, levels: int = 3, fields: tuple[str, ...] = FIELDS, tampered=every_fifth) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; fields: id, source, others, text."""
    rows, sources = placed(leaves(docs, fields, tampered))
    rows = rows.withColumn("block", F.expr(f"pos div {FAN**levels}"))
    subroots, outer = climbed(stored(tops(rows, levels), "superblocks"))
    count = sources.count()
    root, upper = climbed(stored(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("pos"), "h"), "subroots"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = root.first()["h"] if count else ""
    # the required outer nodes: one row per superblock, its siblings inside the source and those of the source
    every = sources.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {FAN**levels}"))).alias("block"))
    of_source = subroots.join(upper.select(F.col("pos").alias("tree"), F.col("path").alias("upper")), "tree", "left")
    outer = every.join(outer.withColumnRenamed("pos", "block"), ["tree", "block"], "left").join(of_source.withColumnRenamed("h", "subroot"), "tree")
    outer = outer.select("tree", "block", "subroot", F.concat(F.coalesce("path", none), F.coalesce("upper", none)).alias("path"))

    def of(key, own, required):
        import pandas as pd

        own = own.sort_values("pos", kind="stable")
        local = reduced(own["leaf"].tolist(), local_levels(int(own["n"].iloc[0]), levels))
        far, subroot = [(s["left"], s["right"]) for s in required["path"].iloc[0]], required["subroot"].iloc[0]
        far_proof, out = "".join(a + b for a, b in far), []
        for i, (h, changed) in enumerate(zip(own["leaf"], own["changed"])):
            path, at = [], i
            for level in local[:-1]:
                path.append(sides(level, at))
                at //= FAN
            to = folded(changed or h, path + far)
            out.append((h, subroot, top, digest("".join(a + b for a, b in path) + far_proof), to, to == top))
        found = pd.DataFrame(out, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        found.insert(0, "doc_id", own["doc_id"].array)
        return found

    named = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make floats of integers with nulls
    found = named.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(of, RESULT)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[fields[0]].dataType))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)))


def op13_sql() -> str:
    """DuckDB: levels and folds by recursion; CRC-32 by its polynomial, bit by bit."""
    return """
WITH RECURSIVE c AS (SELECT *, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))) AS crc FROM documents),
e AS (SELECT doc_id, source, text IS NOT NULL AND coalesce(xor(crc, 4294967295) % 5 = 0, false) AS tampered, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM c),
d AS (SELECT row_number() OVER () AS r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS changed FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
up AS (SELECT tree, n, 0 AS level, pos, leaf AS h FROM l UNION ALL
    SELECT tree, (n + 15) // 16, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, n, level, pos // 16),
subroots AS (SELECT tree, h FROM up WHERE n = 1),
above AS (SELECT (SELECT count(*) FROM subroots) AS n, 0 AS level, tree AS pos, h FROM subroots UNION ALL
    SELECT (n + 15) // 16, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY n, level, pos // 16),
root AS (SELECT h AS root FROM above WHERE n = 1),
nodes AS (SELECT tree, n, level, pos, h FROM up WHERE n > 1 UNION ALL SELECT -1, n, level, pos, h FROM above WHERE n > 1),
sides AS (SELECT tree, level, pos, coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM nodes),
path AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY s.tree < 0, s.level) AS k, a, b FROM l JOIN sides s ON s.tree = l.tree AND s.pos = l.pos // (16 ** s.level)::BIGINT OR s.tree = -1 AND s.pos = l.tree // (16 ** s.level)::BIGINT),
proof AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256 FROM path GROUP BY r),
fold AS (SELECT r, 1 AS k, coalesce(changed, leaf) AS h FROM l UNION ALL SELECT fold.r, fold.k + 1, sha256(a || h || b) FROM fold JOIN path USING (r, k)),
f AS (SELECT r, arg_max(h, k) AS folded_root FROM fold GROUP BY r)
SELECT doc_id, leaf, subroots.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN subroots USING (tree) JOIN f USING (r) LEFT JOIN proof USING (r), root"""
