"""Assembly of many groups: no object per letter, groups that go on in the next Arrow batch, the same contigs as the fold."""

import random

import pytest

from immunospark.operators import assemble


def _rows(groups, reads):
    rng = random.Random(5)
    rows = []
    for g in range(groups):
        truth = "".join(rng.choice("ACGT") for _ in range(260))
        for k in range(reads):
            at = rng.randrange(180)
            read = list(truth[at : at + 80])
            if rng.random() < 0.4:
                read[rng.randrange(80)] = rng.choice("ACGTN")
            if rng.random() < 0.3:
                del read[40:42]
            rows.append((None if g == 0 else f"g{g}", f"r{k}", "".join(read), rng.randrange(1, 4), 1, 1.0))
    return rows


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_groups_over_batches_equal_the_fold(spark, batch):
    rows = _rows(12, 25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "g STRING, id STRING, seq STRING, min_cnt LONG, median_cnt LONG, avg_cnt DOUBLE")
        got = assemble.assemble(df, ["g"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in {r[0] for r in rows}:
        merged = {}
        for _, _, seq, low, *_ in (r for r in rows if r[0] == g):
            times, most = merged.get(seq, (0, 0))
            merged[seq] = times + 1, max(most, low)
        made = assemble.Assembly()
        for seq, (times, low) in sorted(merged.items(), key=lambda x: (-x[1][1], -len(x[0]), x[0])):
            made.add(seq, assemble.threshold(low, False), times)
        for i, c in enumerate(made.without_contained()):
            want[g, i] = made.text[c], made.reads[c], [tuple(map(int, w)) for w in made.weights[c]]
    assert {(r.g, r.contig): (r.consensus, r.n_reads, [tuple(w) for w in r.pos_weight]) for r in got} == want


def test_no_frame_per_group(spark, monkeypatch):
    def none(*_, **__):
        raise AssertionError("a pandas frame for each group")

    rows = _rows(2, 4)
    df = spark.createDataFrame(rows, "g STRING, id STRING, seq STRING, min_cnt LONG, median_cnt LONG, avg_cnt DOUBLE")
    monkeypatch.setattr(type(df.groupBy("g")), "applyInPandas", none)
    assert assemble.assemble(df, ["g"]).count() > 0
    assert assemble.assemble(df.limit(0), ["g"]).count() == 0
