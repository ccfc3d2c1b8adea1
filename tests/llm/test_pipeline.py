import re

import corpus_pipeline as cp
from immunospark.llm import language_id as li
from immunospark.llm import packing as pk
from immunospark.llm.shared import stored, table

from .test_lines_packing_mixing import brute_lines
from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    first = {r.doc_id: r.text for r in docs.collect()}

    docs = stored(cp.STAGES[0][1](spark, docs, SF), "t1")
    model = li.Classifier(li.learned(table(spark, SF, "documents").select("doc_id", "text", "lang")))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and kept == {i: t for i, t in first.items() if not model.predict(t)[3]}
    assert len(kept) > 0.9 * len(first)

    docs = stored(cp.STAGES[1][1](spark, docs, SF), "t2")
    lines = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    want = {i: t for i, t in brute_lines(list(kept.items())).items() if t == kept[i] or re.search(r"[^\x20\x09-\x0D]", t)}
    assert docs.columns == columns and {i: t for i, (t, _) in lines.items()} == want
    assert all(n == len(t) for t, n in lines.values())

    docs = stored(cp.STAGES[2][1](spark, docs, SF), "t3")
    near = {r.doc_id for r in docs.collect()}
    assert docs.columns == columns and near == {i for i, x in brute(list(want.items())).items() if x[0] == i}

    docs = stored(cp.STAGES[3][1](spark, docs, SF), "t4")
    mixed = [r.doc_id for r in docs.collect()]
    assert docs.columns == columns and len(set(mixed)) == len(mixed) and set(mixed) <= near and len(mixed) > 0.7 * len(near)

    out = cp.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == set(mixed) and {r.piece for r in out} >= {0}
    bins = {}
    for r in out:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= pk.CAPACITY


def test_stages_take_hard_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "src1", 0), (3, "the and of " * 30_000, "en", None, 1), (3, "the and of " * 30_000, "en", None, 1), (None, "the cat sat on the mat with them", "en", "src2", 3)]
    df = spark.createDataFrame([(*r, "x", {"k": 1}, "y") for r in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, n_dropped STRING, kinds MAP<STRING, INT>, dotted STRING")
    df = df.withColumnRenamed("dotted", "a.b")
    for name, stage in cp.STAGES:
        for docs in (df, df.limit(0)):
            got = stored(stage(spark, docs, SF), "hard")
            if name != "best_fit_packing":
                assert got.columns == df.columns or name == "line_dedup" and set(got.columns) == set(df.columns)
            got.count()
