"""Merkle manifest of a data set: a tree of documents for each language, and a tree of the languages' roots.

A leaf is the SHA-256 of a document's fields. Leaves get their places in their tree by a sort over range
partitions, so a language with a third of all rows lies on many of them. A tree is cut into aligned blocks of
FANOUT ** DEPTH nodes; a block is a contiguous numpy matrix of hexadecimal digests, 64 bytes a row, whose rows
are reshaped by the fanout and hashed level by level. The roots of blocks are the nodes of the next round, until
each tree has one; the languages' roots then make a tree of their own in the same way. From the root
downwards each block is given the proof of its own root, and siblings of all its nodes are picked by index
arithmetic, so every document has its whole proof without a node being moved twice a round. Rounds grow
with the logarithm of the documents to the base 512; no task holds more than a block.

A proof is the siblings' digests from the leaf's level up to the root, left to right, with the place of
the node and the size of the run in each level; fold() makes the root of a claimed leaf out of them.

Defined results: nulls are written as `-`, so a null and an empty text differ; rows that repeat a doc_id are
leaves of their own, ordered by their digests; a null doc_id comes before all others and counts as the
empty text where a checksum of it is asked for; a null language is a language and comes first; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from .shared import fold as remainder
from .shared import shuffle_partitions, small_batches, stored, table

FANOUT = 8
#: Levels of a block.
DEPTH = 3
BLOCK = FANOUT**DEPTH
#: Bytes of a digest in hexadecimal letters.
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Where 3 divides the checksum of a document's id, the query tampers with it.
TAMPER = 3


def leaf(values: Sequence[Column]) -> Column:
    """SHA-256 over the values, each `-` if null, else the bytes of its text, a colon and the text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds pos, a row's place in its tree (column tree) by the order's columns, nulls first, and n, the rows of that tree."""
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    # the upper bits of the number tell the partition, the lower ones the place in it
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged").withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("many").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "part", "first", before.alias("before"), F.sum("many").over(tree).alias("n"))
    return ranged.join(counts, ["tree", "part"]).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")


def matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of HEX bytes."""
    return np.frombuffer(b"".join(digests.cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, HEX)


def parents(nodes: np.ndarray) -> np.ndarray:
    """The next level: every FANOUT consecutive rows are hashed together, and what is left of them at the end."""
    full = len(nodes) // FANOUT
    runs = [*nodes[: full * FANOUT].reshape(full, FANOUT * HEX)]
    if len(nodes) % FANOUT:
        runs.append(nodes[full * FANOUT :].reshape(-1))
    return np.frombuffer("".join([hashlib.sha256(r).hexdigest() for r in runs]).encode(), np.uint8).reshape(-1, HEX)


def levels(nodes: np.ndarray, whole: int) -> list[np.ndarray]:
    """The levels of a block, its own root last. whole: nodes of the tree that the block is part of."""
    out = [nodes]
    while whole > 1 and len(out) <= DEPTH:
        out.append(parents(out[-1]))
        whole = -(-whole // FANOUT)
    return out


def siblings(nodes: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of each node of a level: the run's others, left to right, its place in the run, and the run's size."""
    at = np.arange(len(nodes))
    place = at % FANOUT
    size = np.minimum(FANOUT, len(nodes) - (at - place))
    step = np.arange(FANOUT - 1)
    others = (at - place)[:, None] + step + (step >= place[:, None])
    picked = nodes[np.minimum(others, len(nodes) - 1)]
    return [x[: n - 1].tobytes() for x, n in zip(picked, size.tolist())], place, size


def texts(rows: Sequence[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary()).cast(pa.string())


def block_roots(nodes: DataFrame) -> DataFrame:
    """The nodes of the next round: tree, pos, n, node of every block of nodes (tree, pos, n, node)."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block["n"][0].as_py()
        root = levels(matrix(block["node"]), n)[-1]
        return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "node": texts([root.tobytes()])})

    blocks = nodes.select("tree", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block"), "pos", "n", "node")
    return blocks.groupBy("tree", "block").applyInArrow(run, "tree STRING, pos BIGINT, n BIGINT, node STRING")


PATH = "proof STRING, places ARRAY<INT>, sizes ARRAY<INT>, subroot STRING, root STRING"
_PATH = [c.split()[0] for c in PATH.split(", ")]


def paths(nodes: DataFrame, above: DataFrame, keep: str = "") -> DataFrame:
    """tree, pos, the columns of keep (a schema) and PATH of every node; above: the PATH of each block's root (tree, pos)."""
    kept = [c.split()[0] for c in keep.split(", ") if c]

    def run(block: pa.Table, over: pa.Table) -> pa.Table:
        block, top = block.sort_by("pos"), over.to_pylist()[0]
        *inner, _ = levels(matrix(block["node"]), block["n"][0].as_py())
        found = [siblings(level) for level in inner]
        at = [np.arange(len(block)) // FANOUT**k for k in range(len(found))]
        proof = [b"".join([s[i] for (s, _, _), i in zip(found, own)]) for own in zip(*[a.tolist() for a in at])] or [b""] * len(block)
        end = (top["proof"] or "").encode()
        place, size = ([[*own, *top[name]] for own in zip(*[x[k][a].tolist() for x, a in zip(found, at)])] or [top[name]] * len(block) for k, name in ((1, "places"), (2, "sizes")))
        out = {"tree": block["tree"], "pos": block["pos"], **{c: block[c] for c in kept}, "proof": texts([p + end for p in proof])}
        out |= {name: pa.array(v, pa.list_(pa.int32())) for name, v in (("places", place), ("sizes", size))}
        return pa.table(out | {c: pa.array([top[c]] * len(block), pa.string()) for c in ("subroot", "root")})

    block = F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")
    left = nodes.select("tree", block, "pos", "n", "node", *[c for c in kept if c != "node"]).groupBy("tree", "block")
    right = above.select("tree", F.col("pos").alias("block"), *_PATH).groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(run, "tree STRING, pos BIGINT, " + "".join(f"{c}, " for c in keep.split(", ") if c) + PATH)


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every round, the trees' roots last."""
    out = [nodes.select("tree", "pos", "n", "node")]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(stored(block_roots(out[-1]), "roots"))
    return out


def down(nodes: list[DataFrame], top: DataFrame) -> DataFrame:
    """The PATH of every node of the lowest round but one, from that of the trees' roots."""
    for level in nodes[-2:0:-1]:
        top = stored(paths(level, top), "paths")
    return top


def manifest(leaves: DataFrame, keep: str = "") -> DataFrame:
    """PATH of every leaf. leaves: tree (a tree's key; trees come in the order of their keys), doc_id, node (the
    leaf's digest) and the columns of keep (a schema); the result has doc_id, node and these, proof, places, sizes, subroot, root."""
    small_batches(leaves.sparkSession)
    lowest = stored(placed(stored(leaves, "leaves"), ["doc_id", "node"]), "placed")
    trees = rounds(lowest)
    roots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node")
    crown = stored(placed(roots, ["key"]), "crown")
    over = rounds(crown)
    none = F.array().cast("array<int>")
    top = over[-1].select("tree", "pos", F.lit("").alias("proof"), none.alias("places"), none.alias("sizes"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    top = paths(crown, down(over, top), "key STRING, node STRING")
    top = stored(top.select(F.col("key").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "proof", "places", "sizes", F.col("node").alias("subroot"), "root"), "tops")
    keep = ", ".join(["doc_id BIGINT", "node STRING", *([keep] if keep else [])])
    kept = [c.split()[0] for c in keep.split(", ")]
    return paths(lowest, down(trees, top), keep).select(*kept, *_PATH)


def fold(rows: DataFrame, claimed: str = "claimed") -> DataFrame:
    """Adds folded_root: the root that the claimed leaf and the proof make."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, proof, places, sizes in zip(*[batch.column(c).to_pylist() for c in (claimed, "proof", "places", "sizes")]):
                proof, at = proof.encode(), 0
                for place, size in zip(places, sizes):
                    mid, end = at + HEX * place, at + HEX * (size - 1)
                    node = hashlib.sha256(proof[at:mid] + node.encode() + proof[mid:end]).hexdigest()
                    at = end
                out.append(node)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "folded_root"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("folded_root", StringType())]))


def tree_of(lang: Column) -> Column:
    """A text that sorts as the languages do, null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "".join(map(chr, range(65, 91)))
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = [F.translate(c, upper, upper.lower()) if c == "text" else F.col(c) for c in FIELDS]
    claimed = F.when(remainder(F.col("doc_id"), TAMPER) == 0, leaf(tampered))
    leaves = docs.select(tree_of(F.col("lang")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf([F.col(c) for c in FIELDS]).alias("node"), claimed.alias("claimed"))
    rows = manifest(leaves, "claimed STRING").withColumn("claimed", F.coalesce("claimed", "node"))
    return fold(rows).select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _climb(name: str, count: int) -> str:
    """SQL: from the nodes of name0 (k, i, h, n) to those of name<count>, with the runs of each level."""
    return "".join(
        f"""
r{name}{j} AS (SELECT k, i // 8 AS i, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {name}{j} GROUP BY ALL),
{name}{j + 1} AS (SELECT k, i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 7) // 8 AS n FROM r{name}{j}),"""
        for j in range(count)
    )


def _follow(name: str, runs: str, count: int) -> str:
    """SQL: a leaf's way up from name0 (r, k, i, f, p): f is folded, p gathers the siblings."""
    return "".join(
        f"""
{name}{j + 1} AS (
  SELECT a.r, a.k, a.i // 8 AS i,
         CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(list_transform(hs, lambda x, y: CASE WHEN y = a.i % 8 + 1 THEN f ELSE x END), '')) END AS f,
         p || CASE WHEN n = 1 THEN '' ELSE array_to_string(list_filter(hs, lambda x, y: y <> a.i % 8 + 1), '') END AS p
  FROM {name}{j} a JOIN r{runs}{j} b ON a.k = b.k AND a.i // 8 = b.i),"""
        for j in range(count)
    )


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Levels that the SQL has for documents of a language and for languages.
_LEVELS, _CROWN = 8, 4
ORACLE = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS k, {_leaf_sql("text")} AS leaf,
         CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ord(x)::BIGINT)),
                       lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 3 = 0
              THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
a0 AS (SELECT k, pos AS i, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM l),{_climb("a", _LEVELS)}
b0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS i, h, count(*) OVER () AS n, k AS own FROM a{_LEVELS}),{_climb("b", _CROWN)}
w0 AS (SELECT r, k, pos AS i, coalesce(changed, leaf) AS f, '' AS p FROM l),{_follow("w", "a", _LEVELS)}
v0 AS (SELECT r, '' AS k, b.i, f, p FROM w{_LEVELS} w JOIN b0 b ON b.own = w.k),{_follow("v", "b", _CROWN)}
o AS (SELECT h FROM b{_CROWN})
SELECT doc_id, leaf, b0.h AS subroot, o.h AS root, sha256(v.p) AS proof_sha256, v.f AS folded_root, v.f = o.h AS verified
FROM l JOIN b0 ON b0.own = l.k JOIN v{_CROWN} v ON v.r = l.r, o
"""
