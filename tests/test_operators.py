"""Hand-made cases for branches that no golden file covers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from immunospark.functions import cdr3 as fcdr3
from immunospark.functions import dna, genes, read_format
from immunospark.operators import airr, barcodes, cluster, em, graph, intervals, kmers, mates, pileup, reference, report
from immunospark.operators import barcode_report as br
from immunospark.sources import tables
from immunospark.sources.fastx import read_fastx

CDR3 = "ordinal INT, cid STRING, idx INT, v STRING, d STRING, j STRING, c STRING, cdr1 STRING, cdr2 STRING, cdr3 STRING, score DOUBLE, count DOUBLE, germline_similarity DOUBLE, complete_vdj INT"


def cdr3_rows(spark, rows):
    """rows: (cid, v, j, c, cdr3, score, count)."""
    return spark.createDataFrame([(k, cid, 0, v, "*", j, c, "*", "*", s, float(score), float(n), 90.0, 0) for k, (cid, v, j, c, s, score, n) in enumerate(rows)], CDR3)


def test_reverse_complement_is_an_involution(spark):
    rng = random.Random(1)
    seqs = [("".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 60))),) for _ in range(200)]
    df = spark.createDataFrame(seqs, "s STRING")
    rc = dna.reverse_complement(F.col("s"))
    assert df.where(dna.reverse_complement(rc) != F.col("s")).count() == 0
    assert df.where(dna.canonical(F.col("s")) != dna.canonical(rc)).count() == 0


def test_codons(spark):
    got = spark.createDataFrame([("ATGTGGTAA",), ("atgNNN",), ("ATGA",), ("",)], "s STRING").select(dna.translate_codons(F.col("s"))).collect()
    assert [r[0] for r in got] == ["MW_", "M?", "M?", ""]


@pytest.mark.parametrize("seq,low", [("A" * 30, True), ("ACGT" * 10, False), ("ACGTACGTN" * 4, True), ("ACACACACAC" * 3, True), ("AACCGGGTTTACGT" * 2, False)])
def test_low_complexity(spark, seq, low):
    assert spark.range(1).select(dna.low_complexity(F.lit(seq))).first()[0] == low


@pytest.mark.parametrize("v,j,c,want", [
    ("IGKV1*01", "IGKJ1*01", "*", "IGKC"), ("TRBV1", "TRBJ2", "*", "TRBC"), ("TRAV1", "TRAJ2", "*", None), ("TRDV1", "TRDJ2", "*", None), ("IGHV1", "IGHJ1", "*", None),
    ("IGHV1", "IGHJ1", "IGHG1*02", "IGHG1"), ("TRBV1", "TRBJ1", "TRBC2*01", "TRBC"), ("*", "TRGJ1", ".", "TRGC"), ("IGLV1", "*", "*", None), ("*", "*", "IGHM", "IGHM"),
])
def test_infer_constant(spark, v, j, c, want):
    assert spark.range(1).select(genes.infer_constant(F.lit(v), F.lit(j), F.lit(c))).first()[0] == want


def test_gene_types(spark):
    names = ["IGHV1-2*01", "IGHD3-3*01", "IGHD", "IGHJ4*02", "TRDC", "IGLL5", "IGHM", "XYZ1"]
    got = spark.createDataFrame([(n,) for n in names], "n STRING").select(genes.gene_type(F.col("n"))).collect()
    assert [r[0] for r in got] == ["V", "D", "C", "J", "C", None, "C", None]


def test_read_format(spark):
    seq, comment = "ABCDEFGHIJ".translate(str.maketrans("ABCDEFGHIJ", "ACGTACGTNA")), "CR:Z:NN CB:Z:ACGT UR:Z:T"
    parts = read_format.parse("bc:0:3,bc:-2:-1,um:2:5:-,r1:4:-1,r2:0:99")
    cols = [read_format.extract(p, F.lit(seq)) for p in parts.values()]
    assert tuple(spark.range(1).select(*cols).first()) == (seq[:4] + seq[-2:], "GTAC", seq[4:], seq)
    for spec in ("bc:hd:1:5:-1", "bc:hd:CB:5:-1"):
        got = read_format.extract(read_format.parse(spec)["bc"], F.lit(seq), F.lit(comment))
        assert spark.range(1).select(got).first()[0] == "ACGT"
    assert spark.range(1).select(read_format.extract(read_format.parse("bc:hd:ZZ:0:-1")["bc"], F.lit(seq), F.lit(comment))).first()[0] == ""
    with pytest.raises(ValueError):
        read_format.parse("xx:0:1")


def test_tail_trim(spark):
    """Good bases then a bad tail: the read is cut where bad bases make up a tenth of what follows."""
    def brute(qual, solid, k):
        bad, at = 0, -1
        for j in range(len(qual) - 1, solid + k - 2, -1):
            if ord(qual[j]) - 32 <= 15:
                bad += 1
                if bad >= 0.1 * (len(qual) - j):
                    at = j
        return (0 if at < k else at) if at > 0 else len(qual)

    rng = random.Random(2)
    cases = [("".join(rng.choice("I#I/5") for _ in range(40)), rng.randrange(0, 20)) for _ in range(60)] + [("I" * 30, 0), ("#" * 30, 0)]
    got = spark.createDataFrame([(q, s) for q, s in cases], "q STRING, s INT").select("q", "s", kmers.tail_trim_length(F.col("q"), F.col("s"), 9).alias("n")).collect()
    assert [r.n for r in got] == [brute(r.q, r.s, 9) for r in got]


def test_tcr_error_filter_and_long_cdr3(spark):
    rows = [("a", "TRBV1", "TRBJ1", "*", "TGTAAA", 1, 100), ("a", "TRBV1", "TRBJ1", "*", "TGTAAC", 1, 5), ("a", "TRBV1", "TRBJ1", "*", "TGTAAG", 1, 4.99),
            ("b", "IGHV1", "IGHJ1", "*", "T" * 179, 1, 1), ("b", "IGHV1", "IGHJ1", "*", "T" * 180, 1, 1), ("b", "IGHV1", "IGHJ1", "*", "TGT", 0, 50), ("b", "IGHV1", "IGHJ1", "*", "TGC", 0.01, 0.5)]
    got = {r.cdr3nt: r for r in report.clonotype_report(cdr3_rows(spark, rows)).collect()}
    assert set(got) == {"TGTAAA", "TGTAAC", "T" * 179}  # a count below one is left out of whole counts
    assert got["T" * 179].cdr3aa == "out_of_frame"
    assert set(r.cdr3nt for r in report.clonotype_report(cdr3_rows(spark, rows), partial=True, decimals=True).collect()) >= {"TGT", "TGC"} - {"TGC"} | {"TGT"}


def test_kappa_and_lambda_share_a_denominator(spark):
    rows = [("a", "IGKV1", "IGKJ1", "*", "AAA", 1, 30), ("b", "IGLV1", "IGLJ1", "*", "CCC", 1, 10), ("c", "IGHV1", "IGHJ1", "*", "GGG", 1, 5)]
    got = {r.cdr3nt: r.frequency for r in report.clonotype_report(cdr3_rows(spark, rows)).collect()}
    assert got == {"AAA": 0.75, "CCC": 0.25, "GGG": 1.0}


def test_cells(spark):
    rows = [
        ("b1_0", "IGHV1", "IGHJ1", "IGHM", "TGTGCA", 1, 5), ("b1_1", "IGKV1", "IGKJ1", "IGKC", "TGTGCC", 1, 3), ("b1_2", "IGLV1", "IGLJ1", "IGLC", "TGTGCG", 1, 3),  # kappa wins the tie
        ("t1_0", "TRBV1", "TRBJ1", "TRBC1", "TGTAAA", 1, 9), ("t1_1", "TRBV2", "TRBJ1", "TRBC1", "TGTAAC", 1, 12), ("t1_2", "TRBV2", "TRBJ1", "TRBC1", "TGTTAA", 1, 99), ("t1_3", "TRAV1", "TRAJ1", "TRAC", "TGTCCC", 1, 1),
        ("g1_0", "TRGV1", "TRGJ1", "TRGC", "TGTGGG", 1, 2), ("g1_1", "TRDV1", "TRDJ1", "TRDC", "TGTGGA", 1, 2),
        ("x1_0", "TRBV1", "TRBJ1", "TRBC1", "TGTA", 1, 50),  # out of frame alone: no chain, no cell
    ]
    got = {r.barcode: r for r in br.barcode_report(cdr3_rows(spark, rows)).collect()}
    assert {k: v.cell_type for k, v in got.items()} == {"b1": "B", "t1": "abT", "g1": "gdT"}
    assert (got["b1"].chain1.v, got["b1"].chain2.v, [c.v for c in got["b1"].secondary2]) == ("IGHV1", "IGKV1", ["IGLV1"])
    # the stop-codon chain joins at once, the first representative when it is displaced
    assert got["t1"].chain1.cdr3nt == "TGTAAC" and [c.cdr3nt for c in got["t1"].secondary1] == ["TGTAAA", "TGTTAA"]
    assert (got["g1"].chain1.v, got["g1"].chain2.v) == ("TRDV1", "TRGV1")
    veto = spark.createDataFrame([("g1", "TRA", 1.0), ("g1", "TRB", 1.0)], "barcode STRING, locus STRING, coverage DOUBLE")
    assert {r.barcode for r in br.barcode_report(cdr3_rows(spark, rows), annotated=veto).collect()} == {"b1", "t1"}
    one = {r.barcode: r for r in br.barcode_report(cdr3_rows(spark, rows), chains=1).collect()}
    assert one["x1"].chain1.cdr3aa == "out_of_frame" and all(r.chain2 is None for r in one.values())


def test_imputation(spark):
    def cell(bc, beta, alpha):
        return [(f"{bc}_0", "TRBV1", "TRBJ1", "TRBC1", beta, 1, 5)] + ([(f"{bc}_1", "TRAV1", "TRAJ1", "TRAC", alpha, 1, 5)] if alpha else [])

    rows = [*cell("d1", "TGTAAA", "TGTCCCGGG"), *cell("d2", "TGTAAA", "TGTCCCGGG"), *cell("d3", "TGTAAA", "TGTCCCTTT")]
    rows += [*cell("r1", "TGTAAA", None), ("r1_9", "TRAV1", "TRAJ1", "TRAC", "TGTCCC", 0, 1), *cell("r2", "TGTAAA", None), *cell("r3", "TGTAAA", None), ("r3_9", "TRAV1", "*", "*", "TTT", 0, 1)]
    table = cdr3_rows(spark, rows)
    got = {r.barcode: r for r in br.impute(br.barcode_report(table), table).collect()}
    assert got["r1"].chain2.cid == "impute_from_d2_1"  # the second donor agrees with the first: the search stops there
    assert got["r2"].chain2 is None  # no partial chain
    assert got["r3"].chain2.cid == "impute_from_d3_1"  # a suffix, of one donor alone
    assert got["d1"].chain2.cid == "d1_1"


def test_expand_and_diffusion(spark):
    rows = [("a_0", "IGHV1", "IGHJ1", "IGHM", "TGTGCA", 1, 100), ("a_1", "IGKV1", "IGKJ1", "IGKC", "TGTGCC", 1, 100), ("a_2", "IGHV2", "IGHJ1", "IGHM", "TGTGAG", 1, 30), ("a_3", "IGHV3", "IGHJ1", "IGHM", "TGTGGG", 1, 3),
            ("b_0", "IGHV1", "IGHJ1", "IGHM", "TGTGCA", 1, 1), ("c_0", "IGHV1", "IGHJ1", "IGHM", "TGTGCA", 1, 1), ("c_1", "IGKV5", "IGKJ1", "IGKC", "TGTTTT", 1, 1), ("e_0", "IGHV1", "IGHJ1", "IGHM", "TGTGCA", 1, 2)]
    cells = br.barcode_report(cdr3_rows(spark, rows))
    got = {r.barcode: r for r in br.expand(cells, 1, 0.1).collect()}
    assert set(got) == {"a_0", "a_1", "b_0", "c_0", "e_0"} and got["a_1"].chain1.v == "IGHV2" and got["a_1"].chain2 is None
    # b lacks the light chain and is 1% of a; c has another light chain; e is exactly 2%
    assert {r.barcode for r in br.diffusion_filter(cells).collect()} == {"a", "c", "e"}


def test_report_lines_round_trip(spark, tmp_path):
    rows = [("b1_0", "IGHV1", "IGHJ1", "IGHM", "TGTGCA", 1, 5), ("b1_2", "IGHV2", "IGHJ1", "*", "TGTGCG", 1, 3), ("t1_0", "TRBV1", "TRBJ1", "TRBC1", "TGTAAA", 1, 9)]
    cells = br.barcode_report(cdr3_rows(spark, rows))
    br.report_lines(cells).write.text(f"file://{tmp_path}/r")
    back = tables.read_barcode_report(spark, f"file://{tmp_path}/r")
    assert sorted(map(str, back.collect())) == sorted(map(str, cells.select(back.columns).collect()))


def test_barcode_quality_breaks_ties(spark):
    white = spark.createDataFrame([("AAAA",), ("CAAC",), ("AAAC",)], "barcode STRING")
    seen = spark.createDataFrame([("AAAA", "IIII"), ("CAAA", "#III"), ("CAAA", "III#"), ("NAAA", "IIII"), ("GGGG", "IIII")], "barcode STRING, qual STRING")
    freq = white.withColumn("freq", F.lit(1))
    got = {(r.barcode, r.qual): r.corrected for r in barcodes.correct(seen, freq).collect()}
    assert got == {("AAAA", "IIII"): "AAAA", ("CAAA", "#III"): "AAAA", ("CAAA", "III#"): "CAAC", ("NAAA", "IIII"): "AAAA", ("GGGG", "IIII"): None}
    assert spark.range(1).select(barcodes.translate(F.lit("ACGT"), {"AC": "x", "GT": "y"}, 2)).first()[0] == "x-y"
    assert spark.range(1).select(barcodes.translate(F.lit("ACGG"), {"AC": "x", "GT": "y"}, 2)).first()[0] is None


def test_em(spark):
    compat = [("u", r, "a") for r in range(3)] + [("u", 3, "b")] + [("u", r, v) for r in range(4, 12) for v in "ab"] + [("z", r, v) for r in range(3) for v in "xy"]
    got = {(r.contig, r.variant): r.n for r in em.abundances(spark.createDataFrame(compat, "contig STRING, read INT, variant STRING")).collect()}
    assert math.isclose(got["u", "a"], 9, abs_tol=1e-3) and math.isclose(got["u", "a"] + got["u", "b"], 12)
    assert (got["z", "x"], got["z", "y"]) == (3.0, 0.0)


def test_pile_up_and_shallow(spark):
    reads = spark.createDataFrame([("c", 0, "ACGT"), ("c", 0, "ACGA"), ("c", 2, "GANA"), ("c", 6, "T")], "cid STRING, o INT, seq STRING")
    got = pileup.contigs(pileup.pile_up(reads, ["cid"], offset="o"), ["cid"]).first()
    assert got.consensus == "ACGANAT" and got.weight == 12 and got.pos_weight[3].a == 2
    w = F.array(*[F.struct(*[F.lit(n if b == "a" else 0).alias(b) for b in "acgt"]) for n in (1, 3, 3, 3, 1)])
    hole = F.array(*[F.struct(*[F.lit(n if b == "a" else 0).alias(b) for b in "acgt"]) for n in (3, 1, 3)])
    assert tuple(spark.range(1).select(pileup.shallow(w, 3), pileup.shallow(hole, 3), pileup.shallow(w, 9)).first()) == (False, True, True)


def test_clusters_are_connected_components(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("AC") for _ in range(10)) for _ in range(60)]
    df = spark.createDataFrame([(k, "V1*01,V2", "J1", s, 1.0) for k, s in enumerate(seqs)], "id INT, v STRING, j STRING, cdr3 STRING, count DOUBLE")
    got = {r.id: r.cluster for r in cluster.single_linkage(df, 0.85).collect()}
    up = list(range(60))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(60):
        for b in range(a):
            if sum(x != y for x, y in zip(seqs[a], seqs[b])) <= cluster.allowed(10, 0.85):
                up[top(a)] = top(b)
    assert len(set(got.values())) == len({top(k) for k in range(60)})
    assert all((got[a] == got[b]) == (top(a) == top(b)) for a in range(60) for b in range(a))


def test_links_of_a_dense_key_grow_with_its_sequences(spark, monkeypatch):
    seqs = ["".join(s) for s in itertools.product("ACGT", repeat=5)]
    df = spark.createDataFrame([("V1", "J1", s) for s in seqs], "v STRING, j STRING, cdr3 STRING")
    links = []
    monkeypatch.setattr(cluster, "components", lambda edges: links.append(edges.count()) or graph.components(edges))
    assert {r.cluster for r in cluster.single_linkage(df, 0.8).collect()} == {"V1|J1|5|AAAAA"}
    # all pairs that differ in one letter are 15 / 2 a sequence
    assert 0 < sum(links) <= 5 * len(seqs) * 3 // 4


@pytest.mark.parametrize(("ways", "at_once"), [(128, 4_000_000), (128, 0), (0, 0), (12, 0)])
def test_clusters_by_any_way_equal_brute_force(spark, monkeypatch, ways, at_once):
    monkeypatch.setattr(cluster, "WAYS", ways)
    monkeypatch.setattr(cluster, "AT_ONCE", at_once)
    rng = random.Random(29)
    rows = [(f"V{rng.randrange(2)}", "J1", "".join(rng.choice("ACGT") for _ in range(n))) for n in (0, 1, 4, 5, 8, 10, 12) for _ in range(2 * n * n + 1)]
    top = {r: r for r in rows}
    for _ in rows:
        before = dict(top)
        for a in top:
            for b in top:
                if a[0] == b[0] and len(a[2]) == len(b[2]) and sum(x != y for x, y in zip(a[2], b[2])) <= cluster.allowed(len(a[2]), 0.8):
                    top[a] = min(top[a], top[b])
        if top == before:
            break
    df = spark.createDataFrame([*rows, ("V1", "J1", None), ("*", "J1", "ACGTA")], "v STRING, j STRING, cdr3 STRING")
    got = cluster.single_linkage(df, 0.8).collect()
    assert len(got) == len(rows) + 1
    assert {(r.v, r.j, r.cdr3): r.cluster for r in got if r.cdr3 is not None} == {r: f"{t[0]}|{t[1]}|{len(t[2])}|{t[2]}" for r, t in top.items()}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200) if k != 99], "a INT, b INT")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {k: 0 if k <= 99 else 100 for k in range(201)}


def test_touching_and_nested_intervals(spark):
    rows = spark.createDataFrame([(0, "c", 0, 10), (1, "c", 11, 20), (2, "c", 30, 40), (3, "d", 0, 10), (4, "c", 5, 100_000)], "id INT, chrom STRING, start INT, end INT")
    found = spark.createDataFrame([("c", 10, 30), ("c", 15, 18)], "chrom STRING, start INT, end INT")
    assert {r.id for r in intervals.overlapping(rows, found, ["id"], 8).collect()} == {1, 2, 4}


def test_exons_from_cigars(spark):
    got = spark.createDataFrame([("5S10M100N20M2I3M5H",), ("30M",), ("4=1X2D3M",)], "c STRING").select(intervals.segments(F.lit(7), F.col("c"))).collect()
    assert [[(s.start, s.end) for s in r[0]] for r in got] == [[(7, 16), (117, 139)], [(7, 36)], [(7, 16)]]


def test_mates(spark):
    rng = random.Random(8)
    dna_ = "".join(rng.choice("ACGT") for _ in range(170))
    rc = mates.reverse_complement
    got = mates.resolve(dna_[:100], "I" * 100, rc(dna_[70:]), "I" * 100)
    assert got == [(dna_, "I" * 170, True)]
    through = mates.resolve(dna_[40:140], "I" * 100, rc(dna_[:100]), "I" * 100)
    assert through == [(dna_[40:100], "I" * 60, False)]
    apart = mates.resolve(dna_[:60], "I" * 60, rc(dna_[100:]), "I" * 70)
    assert [s for s, _, _ in apart] == [dna_[:60], rc(dna_[100:])]
    df = spark.createDataFrame([("r", dna_[:100], "I" * 100, rc(dna_[70:]), "I" * 100), ("p", "A" * 50, "I" * 50, None, None)], "id STRING, seq STRING, qual STRING, seq_2 STRING, qual_2 STRING")
    rows = mates.resolve_pairs(df).collect()
    assert sorted(r.id for r in rows) == ["r", "r.1"] and {r.seq for r in rows} == {dna_}


def test_junction_without_d(spark):
    hit = lambda a, b, c, d, e: F.struct(F.lit(a).alias("ref_len"), F.lit(b).alias("read_start"), F.lit(c).alias("read_end"), F.lit(d).alias("ref_start"), F.lit(e).alias("ref_end"))
    v, d, j = hit(296, 0, 100, 5, 290), hit(20, 104, 110, 3, 9), hit(60, 115, 150, 8, 43)
    got = spark.range(1).select(fcdr3.junction(v, d, j, F.lit(95), F.lit(130), F.lit(True)), fcdr3.junction(v, d, j, F.lit(95), F.lit(130), F.lit(False)), fcdr3.junction(j, d, v, F.lit(95), F.lit(130), F.lit(True))).first()
    assert tuple(got) == ("5,5,3,3,9,15,10,4,8,20", "5,5,14,*,*,*,*,*,8,20", None)


def test_airr_gaps(spark):
    assert spark.range(1).select(airr.gapped(F.lit("ACGTT"), F.lit("A..CG.T"))).first()[0] == "A..CG.TT"
    assert spark.range(1).select(airr.with_cdr3(F.lit("AACCGG"), F.lit(2), F.lit(3), F.lit("TTT"))).first()[0] == "AATTTGG"


def test_fasta_of_many_lines(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a/1 one two\nACG\nTTA\n\n>b\nGG\n>c\tx\n")
    got = read_fastx(spark, str(tmp_path / "x.fa")).orderBy("ordinal").collect()
    assert [(r.id, r.comment, r.seq, r.qual) for r in got] == [("a", "one two", "ACGTTA", None), ("b", None, "GG", None), ("c", "x", "", None)]


def test_unequal_inputs_fail(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a\nACGT\n+\nIIII\n@b\nACGT\n+\n@III\n")
    (tmp_path / "b.fq").write_text("@a\nACGT\n+\nIIII\n")
    one, two = (read_fastx(spark, str(tmp_path / f"{x}.fq")) for x in "ab")
    assert one.count() == 2
    with pytest.raises(Exception, match="different numbers"):
        tables.zipped(one, two).collect()


def test_contig_lines_round_trip(spark, tmp_path):
    from immunospark.sources import sinks

    text = ">assemble0 IGHV1\nACG\n1 0 0\n0 2 0\n0 0 3\n0 0 0\n>BC_1_7 x\nT\n0\n0\n0\n9\n"
    (tmp_path / "raw.out").write_text(text)
    got = tables.read_contigs(spark, str(tmp_path / "raw.out"))
    rows = {r.cid: r for r in got.collect()}
    assert rows["BC_1_7"].barcode == "BC_1" and rows["assemble0"].barcode is None and rows["assemble0"].pos_weight[2].g == 3
    assert sorted(r.value for r in sinks.contig_lines(got).collect()) == sorted(x.rstrip("\n") for x in (text[: text.index(">BC")], text[text.index(">BC") :]))


def test_reference_coordinates_predict_golden_cdrs(spark, golden):
    """CDR1, CDR2 and CDR3 starts of ungapped V hits follow from the reference's gapped coordinates."""
    ref = reference.load(read_fastx(spark, str(golden / "genes.fa")))
    assert ref.count() > 800 and ref.where("gene_type = 'J' AND j_end IS NOT NULL").count() > 20
    ann = tables.parse_annotation(read_fastx(spark, str(golden / "annot.fa")))
    hit = F.get("v", F.lit(0))
    v = ann.where(F.size("v") > 0).select("cid", hit.alias("h"), "cdr1", "cdr2", "cdr3")
    names = ref.select(F.explode(F.split("name", r"\|")).alias("gene"), F.length("seq").alias("n"), F.col("cdr1").alias("r1"), F.col("cdr2").alias("r2"), "cdr3_start")
    both = v.join(names, v["h.gene"] == names["gene"]).where((F.col("h.read_end") - F.col("h.read_start")) == (F.col("h.ref_end") - F.col("h.ref_start")))
    assert both.count() > 60 and both.where(F.col("h.ref_len") != F.col("n")).count() == 0
    shift = F.col("h.read_start") - F.col("h.ref_start")
    for got, want in (("cdr1", "r1"), ("cdr2", "r2")):
        rows = both.where(F.col(got).isNotNull() & F.col(want).isNotNull() & (F.col(f"{want}.a") >= F.col("h.ref_start")))
        assert rows.count() > 10 and rows.where((F.col(f"{got}.start") != F.col(f"{want}.a") + shift) | (F.col(f"{got}.end") != F.col(f"{want}.b") + shift)).count() == 0
    rows = both.where(F.col("cdr3").isNotNull() & (F.col("h.ref_end") >= F.col("cdr3_start") + 2))
    assert rows.count() > 40 and rows.where(F.col("cdr3.start") != F.col("cdr3_start") + shift).count() == 0


def test_example_reads_hit_the_reference(spark, golden):
    ref = reference.load(read_fastx(spark, str(golden / "genes.fa")))
    found = reference.read_hits(read_fastx(spark, str(golden / "1.fq")), ref, 27)
    assert found.count() > 150 and np.mean([r.length for r in found.collect()]) > 40


def test_assembly_of_a_tiled_sequence(spark):
    from immunospark.operators import assemble

    rng = random.Random(12)
    truth = {g: "".join(rng.choice("ACGT") for _ in range(300)) for g in "xy"}
    rows = [(g, f"{g}{k}", s[k : k + 80], 3, 3, 3.0) for g, s in truth.items() for k in range(0, 221, 20)] * 2
    reads = spark.createDataFrame(rows, "g STRING, id STRING, seq STRING, min_cnt BIGINT, median_cnt BIGINT, avg_cnt FLOAT").repartition(5)
    got = assemble.assemble(reads, ["g"])
    found = {r.g: r for r in got.collect()}
    assert {g: r.consensus for g, r in found.items()} == truth and all(r.n_reads == 24 for r in found.values())
    places = {r.id: (r.contig, r.offset) for r in assemble.assigned(reads.dropDuplicates(["id"]), got, ["g"]).collect()}
    assert places == {f"{g}{k}": (0, k) for g in "xy" for k in range(0, 221, 20)}


def bam_bytes(rows):
    """A BAM file of (name, flag, ref, pos, cigar, seq, qual, tags)."""
    import gzip
    import struct

    from immunospark.sources import bam

    names = [b"chr1", b"chr2"]
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", 1000) for n in names)
    out = [head]
    for name, flag, ref, pos, cigar, seq, qual, tags in rows:
        ops = [(int(n) << 4) | bam._OPS.index(c) for n, c in cigar]
        bases = [bam._BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), ref, pos + 50, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
        body += bytes(bases[k] << 4 | bases[k + 1] for k in range(0, len(bases), 2)) + bytes(ord(q) - 33 for q in qual)
        body += b"".join(t.encode() + b"Z" + v.encode() + b"\0" if isinstance(v, str) else t.encode() + b"i" + struct.pack("<i", v) for t, v in tags.items())
        out.append(struct.pack("<i", len(body)) + body)
    data = b"".join(out)
    return b"".join(gzip.compress(data[k : k + 100]) for k in range(0, len(data), 100)) + gzip.compress(b"")


def test_bam_and_sam_agree(spark, tmp_path):
    from immunospark.sources.bam import read_bam, read_sam

    rows = [("r1", 0x41, 0, 9, [(3, "M"), (10, "N"), (2, "M")], "ACGTA", "IIII#", {"CB": "AAAC-1", "NM": 2}), ("r2", 0x91, 1, 99, [(4, "S"), (1, "M")], "TTTTN", "#####", {})]
    (tmp_path / "x.bam").write_bytes(bam_bytes(rows))
    text = ["@HD\tVN:1.6"]
    for name, flag, ref, pos, cigar, seq, qual, tags in rows:
        text.append("\t".join([name, str(flag), f"chr{ref + 1}", str(pos + 1), "60", "".join(f"{n}{c}" for n, c in cigar), "=", str(pos + 51), "0", seq, qual, *[f"{t}:{'Z' if isinstance(v, str) else 'i'}:{v}" for t, v in tags.items()]]))
    (tmp_path / "x.sam").write_text("\n".join(text) + "\n")
    one = read_bam(spark, str(tmp_path / "x.bam")).drop("file_ord", "ordinal").orderBy("name").collect()
    two = read_sam(spark, str(tmp_path / "x.sam")).orderBy("name").collect()
    assert one == two and one[0].tags["CB"] == "AAAC-1" and one[0].cigar == "3M10N2M"


def test_hit_filters(spark):
    from immunospark.operators import filters

    hit = lambda a, b, c=0, d=10, n=11: F.struct(F.lit(n).alias("ref_len"), F.lit(a).alias("read_start"), F.lit(b).alias("read_end"), F.lit(c).alias("ref_start"), F.lit(d).alias("ref_end"))
    none = F.when(F.lit(False), hit(0, 0))
    cdr3 = F.struct(F.lit(90).alias("start"), F.lit(120).alias("end"))
    got = spark.range(1).select(
        filters.wrong_order([hit(0, 50), none, hit(30, 60), none]), filters.wrong_order([hit(0, 50), none, hit(45, 60), none]),
        filters.constant_only(none, none, hit(0, 80, 210, 290), F.lit(81), F.lit(-1)), filters.constant_only(hit(0, 5), none, hit(0, 80, 210, 290), F.lit(81), F.lit(-1)),
        filters.complete_vdj(hit(0, 95), hit(110, 140), cdr3, F.lit("ACGT")), filters.complete_vdj(hit(0, 95), hit(110, 140), cdr3, F.lit("ACGN")), filters.complete_vdj(hit(0, 95), none, cdr3, F.lit("A")),
        filters.overlap_low_complexity(F.lit("AAAAACCCCCG"), F.lit(0), F.lit(10)), filters.overlap_low_complexity(F.lit("AAACCCGGG"), F.lit(0), F.lit(8)),
    ).first()
    assert tuple(got) == (True, False, True, False, True, False, False, True, False)
