"""Reads are cut from texts in Arrow batches: the rows of the SQL, without a walk from the start of a text for each of its reads."""

import random

import pytest

from immunospark.plans import standins


@pytest.mark.parametrize("size", [4_000_000, 50])
def test_reads_equal_the_sql(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(standins, "BYTES", size)
    monkeypatch.setattr(standins, "BATCH", 3)
    rng = random.Random(6)
    texts = [None, "", "...", "Abc", "x" * 150, "y" * 151, "İKſß日本 Z\u0000z", "É" * 9]
    texts += ["".join(rng.choices("abcxyzABCXYZ 0.-\nİKäÄ日", k=rng.randint(0, 900))) for _ in range(60)]
    rows = [(i if i % 9 else None, t, rng.choice(["de", None]), rng.choice(["web", None])) for i, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    want = spark.sql(standins.READS_SPARK.replace("FROM documents", "FROM {documents}"), documents=documents)
    got = standins.reads(spark, str(tmp_path))
    assert got.schema.simpleString() == want.schema.simpleString()
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(got) == order(want) and got.count() > 100
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
