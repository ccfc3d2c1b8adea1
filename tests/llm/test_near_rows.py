"""The near-duplicate stage decides row by row: repeated rows, null ids, and one id with several texts."""

from collections import Counter

import corpus_pipeline as cp

DOCS = "doc_id BIGINT, text STRING, n_chars INT"


def text(name, changed=0):
    return " ".join([f"{name}{k}" for k in range(80)] + [f"end{changed}"])


def left(spark, rows):
    out = cp.dedup_near(spark, spark.createDataFrame(rows, DOCS).repartition(3), "")
    assert out.columns == ["doc_id", "text", "n_chars"]
    return Counter(tuple(r) for r in out.collect())


def test_repeated_null_and_shared_ids(spark):
    rows = [(1, text("a"), 0)] * 3  # repeated rows
    rows += [(2, text("b"), 7), (2, text("b"), 5)]  # repeated but for another column
    rows += [(3, text("c").upper(), 0), (3, text("c"), 0)]  # one id and shingle set, two texts
    rows += [(None, text("d"), 0)] * 2 + [(None, text("d", 1), 0)]  # null ids alone
    rows += [(None, text("e"), 0), (9, text("e", 1), 0)]  # a null id comes after any other
    rows += [(4, text("f"), 0), (5, text("f", 1), 0), (5, text("g"), 0)]  # the text that 5 alone has stays
    got = left(spark, rows)
    three = [r for r in got if r[0] == 3]
    null = [r for r in got if r[0] is None]
    assert len(three) == 1 and three[0][1].lower() == text("c").lower()
    assert len(null) == 1 and null[0][1] in (text("d"), text("d", 1))
    want = Counter([(1, text("a"), 0), (2, text("b"), 5), (9, text("e", 1), 0), (4, text("f"), 0), (5, text("g"), 0)])
    assert got == want + Counter(three + null)


def test_rows_without_words(spark):
    rows = [(1, "", 0), (1, "", 0), (1, "!!", 0), (2, "", 0), (3, None, 0), (3, None, 0), (None, None, 0), (None, None, 0)]
    assert left(spark, rows) == Counter({(1, "", 0): 1, (1, "!!", 0): 1, (2, "", 0): 1, (3, None, 0): 1, (None, None, 0): 2})
    assert not left(spark, [])
