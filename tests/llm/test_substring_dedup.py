import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from immunospark.llm import substring_dedup as sd

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def brute(texts, window):
    docs = [[w for w in BLANKS.split(t or "") if w] for t in texts]
    seen = Counter(tuple(d[p : p + window]) for d in docs for p in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = {p + k for p in range(len(d) - window + 1) if seen[tuple(d[p : p + window])] > 1 for k in range(window)}
        out.append((len(d), len(gone), " ".join(w for i, w in enumerate(d) if i not in gone)))
    return out


def tale(rng, n, letters):
    return " ".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(30))
def test_equal_windows_have_equal_anchors(seed):
    rng, window = random.Random(seed), 12
    letters = ["a", "b", "c d", "é", "x" * 50, *map(str, range(rng.choice([0, 3, 500])))]
    passage = tale(rng, 40, letters)
    texts = [f"{tale(rng, rng.randrange(30), letters)} {passage[rng.randrange(9):]} {tale(rng, rng.randrange(30), letters)}" for _ in range(8)] + ["", " ", "ha " * 90, "ab cd " * 70, tale(rng, 11, letters)]
    parser = sd.Parser()
    with np.errstate(over="ignore"):
        words, begins = parser.words([t.encode() for t in texts])
        first, last, name, place = sd.stretches(words, begins, window)
    docs = [BLANKS.sub(" ", t).split() for t in texts]
    assert np.diff(begins).tolist() == [len(d) for d in docs]
    flat = [w for d in docs for w in d]
    of = np.repeat(np.arange(len(docs)), np.diff(begins))
    anchors, covered = {}, []
    for f, z, n, at in zip(first.tolist(), last.tolist(), name.tolist(), place.tolist()):
        for p in range(f, z + 1):
            covered.append(p)
            assert p <= at < p + window and of[p] == of[p + window - 1]
            assert anchors.setdefault(tuple(flat[p : p + window]), (n, at - p)) == (n, at - p)
    assert covered == [p for p in range(len(flat) - window + 1) if of[p] == of[p + window - 1]]


def test_removed_words_against_brute_force(spark):
    rng = random.Random(5)
    few, many = list("abcdefgh"), [f"w{k}" for k in range(4000)]
    passage, long = tale(rng, 60, many), tale(rng, 20_000, many)
    texts = [None, "", " \t\n", tale(rng, 34, many), tale(rng, 35, many), "ha " * 200, "tick tock " * 100, "a b c " * 30, long, long[:40_000], "x" * 100_000]
    texts += [f"{tale(rng, 30, many)}\v{passage}\f{tale(rng, 10, few)}" for _ in range(60)] + [tale(rng, 300, few[:2]) for _ in range(4)] + [passage] * 20
    texts += [f"{tale(rng, 40, many)} " + " ".join(passage.split()[k : k + 35]) for k in range(0, 25, 5)] + [" ".join(passage.split()[5:39]) + " end"]
    rows = [(k % 90 if k != 50 else None, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id INT, text STRING, digest STRING, first INT")
    got = sd.substring_dedup(df.repartition(5)).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute(texts, 35))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_removed == sum(x.end - x.first for x in r.removed) for r in got)
    assert sd.substring_dedup(df.limit(0)).collect() == []


def test_repeated_rows_remove_each_other(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, text), (1, text), (None, text + " end"), (2, "a b"), (2, "a b")], "doc_id BIGINT, text STRING")
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in sd.substring_dedup(df).collect())
    assert got == [("1", "", 40), ("1", "", 40), ("2", "a b", 0), ("2", "a b", 0), ("None", "end", 40)]


def test_query_digest(spark):
    got = {r.doc_id: r for r in sd.op13_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for r, (n, gone, text) in zip(rows, brute([r.text for r in rows], 35)):
        g = got[r.doc_id]
        assert (g.n_words, g.n_removed, g.kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())
