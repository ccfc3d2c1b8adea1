import math
import random

import numpy as np
import pyarrow as pa
import pytest

from immunospark.llm import hard_negatives as hn


def brute(rows):
    """rows: (id, label, vec of integers)."""
    out = []
    for a, (i, label, v) in enumerate(rows):
        if i % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j, b, other == label) for b, (j, other, w) in enumerate(rows) if b != a]
        for p in sorted(s for s in scores if s[3])[:5]:
            fits = sorted(s for s in scores if not s[3] and -50 * p[0] <= -100 * s[0] <= -95 * p[0])
            out += [(i, p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(fits[:3])]
    return sorted(out)


def clean(rows):
    """What the query makes of (vec_id, label, embedding)."""
    for i, label, v in rows:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            yield i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]


def cloud(rng, n, dims, labels=4, spread=0.3):
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(k, rng.randrange(labels), [c + rng.gauss(0, spread) for c in rng.choice(centers)]) for k in range(n)]


def run(spark, tmp_path, rows, parts=3):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id BIGINT, label INT, embedding ARRAY<FLOAT>, q STRING, block INT").repartition(parts).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in hn.op11_hard_negatives(spark, str(tmp_path)).collect())


def floats(rows):
    return [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]


@pytest.mark.parametrize("rows", [7, 1024])
def test_clusters_against_brute_force(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(hn, "ROWS", rows)
    monkeypatch.setattr(hn, "PACK", 3)
    data = floats(cloud(random.Random(rows), 400, 5))
    got = run(spark, tmp_path, data)
    assert got == brute(list(clean(data))) and len(got) > 20


def test_hard_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 16)
    rng = random.Random(3)
    data = cloud(rng, 120, 3)
    data += [(200 + k, k % 3, [0.5, 0.5, 0.25]) for k in range(150)]  # one vector, a third of all
    data += [(50, 1, [0.5, 0.5, 0.25]), (50, 1, [0.5, 0.5, 0.25]), (50, 2, [0.1, 0.9])]  # repeated ids
    data += [(None, 1, [1.0]), (300, None, [1.0]), (301, 1, None), (302, 1, [None, 1.0, 1.0]), (350, 1, [float("nan"), 0.0, 0.0]), (400, 1, [float("inf"), 0.0, 0.0])]
    data += [(450, 1, []), (451, 1, [0.0, 0.0, 0.0]), (500, 3, [1.0, -2.0, 0.5, 9.0]), (-50, 2, [0.4, 0.4, 0.3]), (550, 9, [0.2] * 3)]
    data = floats(data)
    assert run(spark, tmp_path, data) == brute(list(clean(data)))


def test_empty_and_huge(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    big = floats([(k * 25, k % 2, [1e9 * (k + 1), 1e9]) for k in range(8)])  # scores beyond 2^62: nothing is pruned, nothing crashes
    run(spark, tmp_path / "c", big)
    far = floats([(k * 25, k % 2, [1e6 * (k + 1), 1e6]) for k in range(8)])  # beyond doubles, within 64 bits
    assert run(spark, tmp_path / "d", far) == brute(list(clean(far)))


def test_searches_scan_a_part_of_separated_data(spark):
    """Where vectors lie in clusters, the first radii meet the keys of few blocks."""
    rng = random.Random(9)
    rows = [(k, 0, [int(2000 * c) + rng.randrange(-20, 20) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1], [0.6, 0.6, 0.5])[k % 4]]) for k in range(4000)]
    index = hn.DistanceIndex(spark.createDataFrame(rows, "id BIGINT, label INT, vec ARRAY<BIGINT>"))
    queries = index.queries(400)
    asked = queries.selectExpr("q", "far", "0D AS inner", "-1D AS before", "60D AS radius")
    assert queries.count() == 10 and index.blocks.count() >= 4
    assert 0 < index.intervals(asked).count() < 10 * index.blocks.count()


def test_ragged_vectors():
    assert hn.vectors(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), 2).tolist() == [[1, 2], [0, 0], [3, 0]]
