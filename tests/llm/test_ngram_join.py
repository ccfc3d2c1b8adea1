import random
from collections import Counter, defaultdict

import pytest

from immunospark.llm import ngram_join as nj


def brute(rows):
    """doc_id: (class_id, n_links, n_copies) for distinct doc_ids."""
    sets = {}
    for i, t in rows:
        w = nj._WORD.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else ("empty", i)
    by = defaultdict(list)
    for i, s in sets.items():
        by[s].append(i)
    reps, up, links = list(by), {s: s for s in by}, Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(reps)):
        for b in range(a):
            x, y = reps[a], reps[b]
            if isinstance(x, frozenset) and isinstance(y, frozenset) and 5 * len(x & y) >= 4 * len(x | y):
                links[x] += 1
                links[y] += 1
                up[top(x)] = top(y)
    classes = defaultdict(list)
    for s in reps:
        classes[top(s)] += by[s]
    return {i: (min(classes[top(s)]), links[s], len(by[s])) for s in reps for i in by[s]}


def varied(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(25):  # clusters of any tightness, around the threshold too
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6, 20])):
            docs.append(" ".join(varied(rng, base, rng.choice([0, 0, 1, 2, 3, 4, 6]))))
    passage = [f"p{k}" for k in range(60)]  # a passage that many documents share
    docs += [" ".join([f"u{rng.randrange(9999)}" for _ in range(60)] + passage) for _ in range(60)]
    loose = [f"l{k}" for k in range(150)]  # a group whose members are about as far apart as the threshold
    docs += [" ".join(varied(rng, loose, rng.choice([1, 3, 5, 7]))) for _ in range(120)]
    docs += [docs[3]] * 30 + [docs[3].upper() + "  !"] * 3 + ["", None, "  ", "one two", "One  two.", "one two three", None]
    rng.shuffle(docs)
    return list(enumerate(docs))


def got_of(spark, rows):
    df = spark.createDataFrame([(i, t, "node", 3) for i, t in rows], "doc_id BIGINT, text STRING, node STRING, n INT").repartition(5)
    return {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in nj.joined(df).collect()}


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and salts
        for name, n in (("BLOCK", 7), ("STARS", 5), ("COPY", 4)):
            monkeypatch.setattr(nj, name, n)
    rows = corpus(11)
    want, got = brute(rows), got_of(spark, rows)
    assert max(x[1] for x in want.values()) > 20
    assert got == want


def test_long_texts_nulls_and_repeats(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    other = long + " " + " ".join(f"v{k}" for k in range(3000))
    rows = [(1, long), (2, other), (2, other), (None, long + " z"), (7, "alone in the dark here now")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.class_id, r.n_links, r.n_copies) for r in nj.joined(df).collect())
    assert got == [(-1, 1, 2, 1), (1, 1, 2, 1), (2, 1, 2, 2), (2, 1, 2, 2), (7, 7, 0, 1)]


def test_empty_table(spark):
    assert nj.joined(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_shortest_prefix_reaches_recall():
    d = nj.shortest()
    assert 1 - (1 - 0.8**d) ** nj.TREES >= nj.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** nj.TREES


def test_signatures_estimate_similarity():
    a = nj.shingles(" ".join(f"w{k}" for k in range(400)))
    b = nj.shingles(" ".join(f"w{k}" for k in range(40, 440)))
    s = nj.signatures([a, b])
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((s[0] == s[1]).mean() - true) < 0.12
