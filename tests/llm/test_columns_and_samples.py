"""Columns of any name and type in what the pipeline calls, and samples that are drawn from what there is."""

from pyspark.sql import functions as F

from immunospark.llm import language_id, line_dedup, ngram_join, toxicity


def hard(spark):
    words = " ".join(f"word{k}" for k in range(40))
    rows = [(1, words, "x", {"k": 1}), (1, words, "x", {"a": 2}), (2, words + " more", "y", None), (None, words, "z", {}), (3, None, None, None), (4, "a line of words\nother words here " + words[:50], "q", {"k": 3})]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, dotted STRING, kinds MAP<STRING, INT>")
    return df.withColumnRenamed("dotted", "a.b").withColumn("c`d", F.lit(1))


def test_near_duplicates_with_maps_and_dots(spark):
    df = hard(spark)
    got = ngram_join.kept(df)
    assert got.columns == df.columns
    rows = sorted((r["doc_id"] or 0, r["a.b"] or "", str(r["kinds"])) for r in got.collect())
    assert [r[0] for r in rows] == [1, 3, 4] and rows[0][2] == "{'a': 2}"  # of repeated rows the one whose map's JSON comes first
    assert ngram_join.kept(df.limit(0)).count() == 0


def test_line_dedup_with_dots(spark):
    df = hard(spark)
    got = line_dedup.line_dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"] and got.count() == 6
    assert sorted(r["a.b"] or "" for r in got.collect()) == ["", "q", "x", "x", "y", "z"]


def test_toxic_sample_is_of_documents_that_exist(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 20)
    docs = spark.range(100).select((F.col("id") * 37).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = toxicity.training(docs, labels)
    assert [y for _, y in got] == [0] * 20 + [1] * 20
    assert toxicity.training(docs.limit(0), labels) == [] and toxicity.training(docs, labels.limit(0)) == []


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 3 * 10_000 * language_id.SAMPLE_CHARS)
    rows = spark.range(40_000).select(F.concat(F.lit("l"), (F.col("id") % 10_000).cast("string")).alias("lang"), F.concat(F.lit("words of number "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    got = language_id.learned(rows)
    assert 9_900 <= len(got) <= 10_000 and sum(map(len, got.values())) <= language_id.ALL_BYTES
    monkeypatch.setattr(language_id, "LANGUAGES", 5)
    assert len(language_id.learned(rows)) == 5
