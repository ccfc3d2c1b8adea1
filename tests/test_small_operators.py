"""Reference building, pair rules, cell files, sinks and cleanup, each against hand-made expectations."""

import pytest
from pyspark.sql import functions as F

from immunospark.functions import read_format
from immunospark.operators import airr, filters, graph, reference, smartseq
from immunospark.sources import references, sinks


def test_reference_from_genome(spark):
    genome = spark.createDataFrame([("chr1", "acgtACGTAAccggTT"), ("chr2", "GGGTTTAAACCC")], "id STRING, seq STRING")
    line = lambda c, a, b, s, t, g, kind="exon": f'{c}\tX\t{kind}\t{a}\t{b}\t.\t{s}\t.\tgene_id "e"; transcript_name "{t}"; gene_name "{g}"; level 2;'
    lines = ["#head", line("1", 1, 4, "+", "t1", "Abc"), line("1", 9, 10, "+", "t1", "Abc"), line("1", 1, 9, "+", "t1", "Abc", "CDS"), line("chr2", 10, 12, "-", "t2", "neg"), line("chr2", 1, 4, "-", "t2", "neg"), line("2", 1, 2, "+", "t3", "other")]
    gtf = spark.createDataFrame(list(enumerate(lines)), "ordinal BIGINT, value STRING")
    names = spark.createDataFrame([("ABC",), ("Neg",)], "gene STRING")
    got = sorted(tuple(r)[:6] for r in references.from_genome(genome, gtf, names).collect())
    assert got == [("ABC", "chr1", 1, 10, "+", "ACGTAA"), ("NEG", "chr2", 1, 12, "-", "GGG" + "ACCC")]
    with pytest.raises(Exception, match="no chromosome"):
        references.from_genome(genome.where("id = 'chr1'"), gtf, names).collect()
    assert references.from_genome(genome, gtf, names.limit(0)).count() == 0


def test_reference_from_database(spark):
    rows = [
        (0, "A1|IGHV1*01|Homo", "sapiens|F|V-REGION|1", "acg"), (1, "A1|IGHV1*01|Homo", "sapiens|F|V-REGION|2", "nnt"), (2, "B7|IGHV1*01|Homo", "sapiens|F|V-REGION|3", "ggg"),
        (3, "C1|TRAV2*01|Homo", "sapiens|F", "TT.A"), (4, "D1|HLA-A|Homo", "sapiens|F", "AAA"), (5, "E1|IGHV1*02|Mus", "musculus|F", "CCC"),
    ]
    fasta = spark.createDataFrame(rows, "ordinal BIGINT, id STRING, comment STRING, seq STRING")
    assert sorted(map(tuple, references.from_database(fasta, "Homo_sapiens").collect())) == [(0, "IGHV1*01", "ACGNNT"), (3, "TRAV2*01", "TT.A")]


def test_merged_references(spark):
    one = spark.createDataFrame([(1, "a", "AC"), (2, "b", "GG")], "gene_idx INT, name STRING, seq STRING")
    two = spark.createDataFrame([(1, "c", "TT")], one.schema)
    assert sorted(map(tuple, reference.merged(one, two).collect())) == [(1, "a", "AC"), (2, "b", "GG"), (3, "c", "TT")]


def test_pair_rules(spark):
    cases = [(a, b, c, d) for a in (True, False, None) for b in (True, False, None) for c in (True, False) for d in (True, False)]
    df = spark.createDataFrame(cases, "h1 BOOLEAN, h2 BOOLEAN, l1 BOOLEAN, l2 BOOLEAN")
    for r in df.select("*", filters.either_mate(F.col("h1"), F.col("h2")).alias("fastq"), filters.both_complex(F.col("l1"), F.col("l2"), F.col("h1"), F.col("h2")).alias("bam")).collect():
        assert r.fastq == bool(r.h1 or r.h2) and r.bam == (not r.l1 and not r.l2 and bool(r.h1 or r.h2))
    rows = spark.createDataFrame([("AAAA", "AAAA", None, True), ("AAAA", "ACGT", "AAAA", True), ("ACGT", "ACGT", None, False), ("AAAA", "ACGT", "CCCC", True), (None, "A", None, True)], "b STRING, s1 STRING, s2 STRING, low BOOLEAN")
    keep = filters.either_mate(F.lit(True), F.lit(False), F.col("b"), F.col("s1"), F.col("s2"), F.col("low"))
    assert [r[0] for r in rows.select(keep).collect()] == [False, False, True, True, True]


def test_names_of_mates(spark):
    df = spark.createDataFrame([("r/1",), ("r/2",), ("r/3",), ("r1",)], "n STRING")
    assert [r[0] for r in df.select(read_format.read_name(F.col("n"))).collect()] == ["r", "r", "r/3", "r1"]
    assert [r[0] for r in df.select(read_format.read_name(F.col("n"), 2)).collect()] == ["r", "r", "r", ""]


def test_cells_from_files(spark):
    top = spark.createDataFrame([("c1", "a0", "TGT", 1, 1), ("c1", "a0", "TGC", 1, 2), ("c2", "a1", "TTT", 2, 1)], "cell STRING, cid STRING, cdr3nt STRING, side INT, rank INT")
    ann = spark.createDataFrame([("c1", "a0", "S"), ("c1", "a9", "S"), ("c2", "a0", "S"), ("c2", "a1", "S")], "cell STRING, cid STRING, seq STRING")
    rows = spark.createDataFrame([("c1", "a0_0", "TGT"), ("c1", "a0_1", "TGC"), ("c2", "a1_0", "TTT"), ("c2", "a7_0", "TTT")], "cell STRING, sequence_id STRING, junction STRING")
    assert sorted(r.cid for r in smartseq.report(top).collect()) == ["c1_a0", "c1_a0", "c2_a1"]
    assert sorted(r.cid for r in smartseq.annotations(top, ann).collect()) == ["c1_a0", "c2_a1"]
    assert sorted((r.sequence_id, r.cell_id) for r in smartseq.airr(top, rows).collect()) == [("c1_a0_0", "c1"), ("c2_a1_0", "c2")]


CHAIN = "STRUCT<v: STRING, d: STRING, j: STRING, c: STRING, cdr3nt: STRING, cdr3aa: STRING, count: DOUBLE, cid: STRING, germline_similarity: DOUBLE, complete_vdj: INT>"


def test_tenx_and_airr_files(spark, tmp_path):
    t = ("TRBV1*01", None, "TRBJ1*01", "TRBC1", "TGTTTT", "CF", 2.5, "b1_1", 100.0, 1)
    b = ("IGHV1*01", "IGHD1*01", "IGHJ1*01", None, "TGTTAA", "C_", 3.0, "b2_1", 90.0, 0)
    report = spark.createDataFrame([("b1", "abT", t, None), ("b2", "B", b, None)], f"barcode STRING, cell_type STRING, chain1 {CHAIN}, chain2 {CHAIN}")
    sinks.write_tenx(report, f"file://{tmp_path}/out")
    lines = {k: [x.value for x in spark.read.text(f"file://{tmp_path}/out_{k}.csv").collect()] for k in "tb"}
    assert sorted(lines["t"]) == sorted([",".join(sinks.TENX), "b1,True,b1_1,True,None,TRB,TRBV1*01,None,TRBJ1*01,TRBC1,True,True,CF,TGTTTT,2.50,2.50,None,None"])
    assert "b2,True,b2_1,True,None,IGH,IGHV1*01,IGHD1*01,IGHJ1*01,None,False,False,C_,TGTTAA,3.00,3.00,None,None" in lines["b"]
    row = spark.createDataFrame([tuple(f"x{k}" for k in range(22)) + (1, 2.0)], ", ".join(f"{c} {'INT' if c == 'complete_vdj' else 'DOUBLE' if c == 'consensus_count' else 'STRING'}" for c in airr.COLUMNS))
    sinks.write_airr(row, f"file://{tmp_path}/airr.tsv")
    got = sorted(x.value for x in spark.read.text(f"file://{tmp_path}/airr.tsv").collect())
    assert got == sorted(["\t".join(airr.COLUMNS), "\t".join([*(f"x{k}" for k in range(22)), "1", "2.00"])])


def test_cleanup(spark, tmp_path):
    for name in ("reads", "contigs", "annotations", "airr"):
        spark.range(3).write.parquet(f"file://{tmp_path}/{name}")
    assert sinks.clean(spark, f"file://{tmp_path}", 0) == []
    assert sinks.clean(spark, f"file://{tmp_path}", 1) == ["reads", "contigs"]
    assert sinks.clean(spark, f"file://{tmp_path}", 2) == ["annotations"]
    assert [p.name for p in tmp_path.iterdir()] == ["airr"]


def test_work_folder_must_be_shared(monkeypatch):
    """Without the setting only a session in one process may fall back to a folder of its own."""
    class Conf(dict):
        pass

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graph._folder(Session())


def test_containment_with_foreign_letters(spark):
    """Seeds are k-mer codes, and a k-mer with N is none."""
    import random

    from immunospark.operators import contained

    rng = random.Random(7)
    host = "".join(rng.choice("ACGT") for _ in range(200))
    flip = lambda s, i: s[:i] + ("A" if s[i] != "A" else "C") + s[i + 1 :]
    rows = [("host", host), ("in", host[20:80]), ("off", flip(host[20:80], 3)), ("late", flip(host[20:80], 50)), ("two", flip(flip(host[20:80], 3), 50))]
    rows += [("n1", "N" + host[21:80]), ("n2", host[20:60] + "N" + host[61:80]), ("short", host[5:30]), ("other", "".join(rng.choice("ACGT") for _ in range(60)))]
    rows += [("nn", "N" * 60), ("none", None)]
    got = {(r.cid, r.host) for r in contained.contained(spark.createDataFrame(rows, "cid STRING, seq STRING")).collect()}
    assert got == {(c, "host") for c in ("in", "off", "late", "n1", "n2")}
    left = {r.cid for r in contained.without_contained(spark.createDataFrame(rows, "cid STRING, seq STRING")).collect()}
    assert left == {"host", "two", "short", "other", "nn", "none"}
