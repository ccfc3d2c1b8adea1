import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from immunospark.llm import merkle as mk

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, node STRING, tree INT"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """The root, and of each node its path: (siblings before, siblings after) a level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            run = runs[i // 8]
            paths[k].append((run[: i % 8], run[i % 8 + 1 :]))
        nodes, at = [H(*r) for r in runs], [i // 8 for i in at]
    return nodes[0], paths


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    leaf = lambda r, text: H(*map(coded, (r[0], r[3], r[2], r[4], text)))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    inner = {}
    for k in order:
        trees[k].sort(key=lambda x: x[:3])
        inner[k] = climb([x[2] for x in trees[k]])
    root, crown = climb([inner[k][0] for k in order])
    out = []
    for k, over in zip(order, crown):
        for (_, _, digest, r), path in zip(trees[k], inner[k][1]):
            text = r[1]
            if text is not None and zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for left, right in path + over:
                node = H(*left, node, *right)
            out.append((r[0], digest, inner[k][0], root, H(*[h for left, right in path + over for h in left + right]), node, node == root))
    return out


def key(row):
    return [(x is None, x) for x in row]


def write(spark, rows, folder):
    path = f"{folder}/documents.parquet"
    spark.createDataFrame([(*r, "extra", 7) for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return path


CASES = {
    "empty": [],
    "one": [(1, "Only", "en", None, 3)],
    "two languages": [(1, "A", "en", "s", 1), (2, None, None, None, None)],
    "ties and nulls": [(None, "Zed", "en", "x", 1), (None, None, None, "x", 1), (4, "Ä B", None, "x", 1), (4, "Ä B", None, "x", 1), (4, "other", None, "é", 1), (5, "", "", "", 0), (6, "long W " * 40_000, "zh", "q", 1)],
    "many trees": [(k, f"T{k}", f"l{k % 75}", "s", k) for k in range(150)],
    "deep": [(k * 7 % 5003, f"Text {k}", "en" if k % 30 else None, f"s{k % 3}", k) for k in range(4700)],
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_against_plain_trees(spark, tmp_path, case):
    rows = CASES[case]
    path = write(spark, rows, tmp_path)
    got = sorted((tuple(r) for r in mk.op12_merkle(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(brute(rows), key=key) if rows else got == []
    if rows:
        duck = duckdb.connect()
        duck.execute(f"create view documents as select * from '{path}/*.parquet'")
        assert sorted((r for r in duck.execute(mk.ORACLE).fetchall()), key=key) == got


def test_proofs_tell_any_change(spark):
    rows = spark.range(700).select(F.lit("").alias("tree"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    proofs = mk.manifest(rows)
    good = mk.fold(proofs, "node")
    assert good.where("folded_root = root").count() == 700
    assert mk.fold(proofs.withColumn("claimed", F.sha2(F.concat("node", F.lit("x")), 256))).where("folded_root = root").count() == 0
    swapped = proofs.withColumn("places", F.transform("places", lambda x, i: F.when(i == 0, (x + 1) % F.element_at("sizes", 1)).otherwise(x)))
    assert mk.fold(swapped, "node").where("folded_root = root").count() == 0


def test_siblings_by_index():
    import numpy as np

    nodes = np.frombuffer("".join(H(str(k)) for k in range(19)).encode(), np.uint8).reshape(-1, mk.HEX)
    others, place, size = mk.siblings(nodes)
    for k in range(19):
        run = [H(str(j)) for j in range(k // 8 * 8, min(19, k // 8 * 8 + 8)) if j != k]
        assert (others[k].decode(), place[k], size[k]) == ("".join(run), k % 8, len(run) + 1)
