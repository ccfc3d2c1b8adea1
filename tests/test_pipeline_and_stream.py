"""From reads to reports, and extraction as a stream."""

import pytest
from pyspark.sql import functions as F

from immunospark.operators import reference
from immunospark.operators.graph import cut
from immunospark.plans import pipeline
from immunospark.sources import tables
from immunospark.sources.fastx import read_fastx
from immunospark.streaming.extract import candidate_batches, clean_stream


@pytest.fixture(scope="module")
def inputs(spark, golden):
    one, two = (read_fastx(spark, str(golden / f"{k}.fq")) for k in (1, 2))
    return cut(tables.zipped(one, two)), cut(reference.load(read_fastx(spark, str(golden / "genes.fa")))), tables.read_report(spark, str(golden / "report.tsv"))


def test_bulk_run(spark, inputs):
    pairs, ref, gold = inputs
    out = pipeline.run(pairs, ref)
    assert out["report"].count() >= 41
    # golden CDR3s are found again, letter by letter
    assert out["report"].join(gold, "cdr3nt", "left_semi").count() >= 38
    assert out["airr"].where("locus = 'IGH'").count() > 0


def test_run_goes_on_from_stored_results(spark, inputs, tmp_path):
    pairs, ref, _ = inputs
    first = pipeline.run(pairs, ref)
    pipeline.resume(0, str(tmp_path), {k: first[k] for k in ("reads", "contigs", "annotations", "placed", "cdr3")})
    again = pipeline.run(pairs.limit(0), ref, stored=pipeline.stored_results(3, str(tmp_path), spark))
    assert sorted(map(str, again["report"].collect())) == sorted(map(str, first["report"].collect()))
    rows = first["cdr3"].collect()
    assert len({r.ordinal for r in rows}) == len(rows) and all(0 <= r.germline_similarity <= 100 for r in rows)
    assert any(r.germline_similarity > 80 for r in rows)


def test_cells_run(spark, inputs):
    pairs, ref, _ = inputs
    pairs = pairs.withColumn("barcode", F.concat(F.lit("BC"), (F.pmod(F.xxhash64("id"), F.lit(3))).cast("string")))
    cells = pipeline.run(pairs, ref, pipeline.Options(barcoded=True))["cells"].collect()
    assert {r.barcode for r in cells} <= {"BC0", "BC1", "BC2"} and all(r.cell_type == "B" for r in cells)


def test_streamed_extraction_equals_batch(spark, inputs, tmp_path):
    pairs, ref, _ = inputs
    reads = pairs.select("id", "seq", "qual")
    reads.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert clean_stream(stream).isStreaming
    seen: list = []
    candidate_batches(stream, ref, lambda df, epoch: seen.extend(r.id for r in df.collect()), checkpoint=f"{tmp_path}/cp").awaitTermination()
    want = {r.id for r in reference.good_candidates(reads, ref).collect()}
    assert set(seen) == want and len(seen) == len(want)
