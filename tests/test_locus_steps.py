"""Steps that the reports of CDR3 rows share: one pass per locus, no frame to the end of a group, small expressions."""

import random

from pyspark.sql import functions as F

from immunospark.operators import barcode_report as br
from immunospark.plans import standins

SCHEMA = "barcode STRING, locus STRING, rank INT, partial BOOLEAN, ordinal LONG, chain STRUCT<v: STRING, d: STRING, j: STRING, c: STRING, cdr3nt: STRING, cdr3aa: STRING, count: DOUBLE, cid: STRING, germline_similarity: DOUBLE, complete_vdj: INT>"


def _ranked(spark):
    rng = random.Random(3)
    rows = [(f"b{rng.randrange(4)}", rng.choice(["IGH", "IGK", "TRA"]), rng.choice([1, 2, 2]), False, i, ("v", None, "j", None, "N", rng.choice("ABC"), float(rng.randrange(6)), f"c{rng.randrange(5)}", 1.0, 1)) for i in range(120)]
    rows.append(("b9", "TRG", 1, False, 999, ("v", None, "j", None, "N", "A", 1.0, "c1", 1.0, 1)))
    return br.representatives(spark.createDataFrame(rows, SCHEMA))


def test_one_pass_has_what_three_had(spark):
    ranked = _ranked(spark)
    key = ["barcode", "locus"]
    want = br.abundances(ranked).join(ranked.where("is_rep").select(*key, "chain"), key, "left").join(br.secondaries(ranked), key, "left")
    got = br.per_locus(ranked)
    assert got.columns == want.columns == [*key, "abundance", "chain", "others"]
    assert {(r.barcode, r.locus): r for r in got.collect()} == {(r.barcode, r.locus): r for r in want.collect()}


def test_no_frame_to_the_end_of_a_group(spark):
    assert "unboundedfollowing" not in _ranked(spark)._jdf.queryExecution().executedPlan().toString().lower()


def test_pushed_down_locus_is_small(spark):
    rows = standins.cdr3_rows(spark, "/root/testdata/sf0.001")
    plan = br.chain_rows(rows).where("NOT partial AND locus IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    assert max(map(len, (x for x in plan.splitlines() if "Filter (" in x))) < 12_000


def test_huge_methods_are_left_to_operators(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 65_535)
        standins.cdr3_rows(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(name)) == standins.HUGE_METHOD
        spark.conf.set(name, 30_000)
        standins.cdr3_rows(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(name)) == 30_000  # a user's own
    finally:
        spark.conf.set(name, before)


def test_locus_of_lists_and_none(spark):
    from immunospark.functions import genes

    cases = [("IGHV1*01,IGHV2", "IGH"), ("*", None), (".", None), ("", None), (None, None), ("TR", None), ("IG,HV", None), ("XYZ1", None), ("TRDV2", "TRD")]
    df = spark.createDataFrame(cases, "g STRING, want STRING")
    for r in df.select("*", genes.locus_of(F.col("g")).alias("raw"), genes.locus_of(genes.called(genes.first_gene(F.col("g")))).alias("named")).collect():
        assert r.raw == r.named == r.want


def test_contigs_of_airr_rows_are_made_once_a_contig(spark):
    from immunospark.plans.queries import QUERIES

    plan = QUERIES["airr_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "min_by" not in plan.lower()
