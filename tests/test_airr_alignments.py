"""AIRR alignment strings: by hand, on the golden contigs and row by row on the stand-in reads."""

from pyspark.sql import functions as F

from immunospark.functions import align
from immunospark.operators import airr, reference
from immunospark.plans import queries as q
from immunospark.plans.standins import reads
from immunospark.sources import tables
from immunospark.sources.fastx import read_fastx

SF = "/root/testdata/sf0.001"


def hit(gene, size, a, b, ra, rb):
    return {"gene": gene, "ref_len": size, "read_start": a, "read_end": b, "ref_start": ra, "ref_end": rb}


def letters(cigar, kinds):
    return sum(n for n, op in align.parse_cigar(cigar) if op in kinds)


def test_genes_with_a_gap_between_them():
    v, j = "ACGTACGTAC", "GGTTGGCCAA"
    seq = "TT" + v + "CAT" + j[2:] + "G"
    got = airr.aligned(seq, {"v": v, "j": j}, [hit("v", 10, 2, 11, 0, 9), None, hit("j", 10, 15, 22, 2, 9), None], (10, 16))
    assert got == ["2S10=12S", "", "15S2N8=1S", "", seq[2:23], v + "CAT" + j[2:], 8, 14]


def test_overlapping_genes_keep_v_then_j_then_d():
    seq = "AACCGGTTACGTACGT"
    catalogue = {"v": seq[:8], "d": seq[6:12], "j": seq[10:14] + "AA"}
    got = airr.aligned(seq, catalogue, [hit("v", 8, 0, 7, 0, 7), hit("d", 6, 6, 11, 0, 5), hit("j", 6, 10, 15, 0, 5), None], None)
    assert got[4] == seq and got[5] == seq[:8] + seq[8:10] + seq[10:14] + "AA" and got[6:] == [-1, -1]
    # D lies within V and J: it gives no columns, and none is given twice
    got = airr.aligned(seq, catalogue, [hit("v", 8, 0, 7, 0, 7), hit("d", 6, 10, 11, 4, 5), hit("j", 6, 10, 15, 0, 5), None], (7, 10))
    assert got[4] == seq and got[5] == seq[:8] + seq[8:10] + seq[10:14] + "AA" and got[6:] == [7, 10]


def test_gaps_of_either_side():
    gene = "ACGTTGCAAGGCTTACCGAT"
    shorter, longer = gene[:9] + gene[11:], gene[:9] + "TT" + gene[9:]
    got = airr.aligned(shorter, {"g": gene}, [hit("g", 20, 0, 17, 0, 19), None, None, None], (12, 17))
    assert len(got[4]) == 20 and got[4].replace("-", "") == shorter and got[5] == gene and got[6:] == [14, 19]
    got = airr.aligned(longer, {"g": gene}, [hit("g", 20, 0, 21, 0, 19), None, None, None], (12, 21))
    assert got[4] == longer and got[5].replace("-", "") == gene and len(got[5]) == 22 and got[6:] == [12, 21]


def test_no_hits(spark):
    assert airr.aligned("ACGT", {}, [None] * 4, (0, 3)) == ["", "", "", "", "", "", -1, -1]


def test_golden_contigs(spark, golden):
    ref = reference.load(read_fastx(spark, str(golden / "genes.fa")))
    ann = tables.parse_annotation(read_fastx(spark, str(golden / "annot.fa")))
    made = airr.alignments(ann, ref)
    by = {r.cid: r for r in made.collect()}
    lone = {r.cid: r for r in airr.contig_rows(ann, made).collect()}
    rows = ann.collect()
    assert len(by) == len(lone) == len(rows) == 84
    for r in rows:
        x, hits = by[r.cid], [r[g][0] if r[g] else None for g in "vdj"]
        for g in "vdjc":
            assert (x[f"{g}_cigar"] != "") == bool(r[g])
            if r[g]:
                assert letters(x[f"{g}_cigar"], "S=XD") == len(r.seq) and letters(x[f"{g}_cigar"], "N=XI") == r[g][0].ref_len
        if seen := [h for h in hits if h]:
            text, germ = x.sequence_alignment, x.germline_alignment
            assert len(text) == len(germ) and text.replace("-", "") == r.seq[seen[0].read_start : max(h.read_end for h in seen) + 1]
            alike = sum(a == b for a, b in zip(text, germ)) / len(text)
            assert alike >= 0.75
        else:
            assert x.sequence_alignment == ""
        if x.cdr3_start >= 0 and x.cdr3_end >= 0:
            assert x.sequence_alignment[x.cdr3_start : x.cdr3_end + 1].replace("-", "") == r.cdr3.seq
        assert lone[r.cid].junction == (r.cdr3.seq if r.cdr3 else "") and lone[r.cid].sequence == r.seq
    assert sum(x.cdr3_start >= 0 and x.cdr3_end >= 0 for x in by.values()) >= 30


def test_rearrangements_carry_them(spark, golden):
    ref = reference.load(read_fastx(spark, str(golden / "genes.fa")))
    ann = tables.parse_annotation(read_fastx(spark, str(golden / "annot.fa")))
    rows = tables.read_cdr3(spark, str(golden / "cdr3.out")).withColumnRenamed("cdr3", "cdr3nt").where("score > 0")
    got = airr.rearrangements(rows, ann, airr.alignments(ann, ref)).where("v_call <> '' AND j_call <> ''").collect()
    assert len(got) > 30 and all(r.v_cigar and r.j_cigar for r in got)
    assert sum(r.junction in r.sequence_alignment.replace("-", "") for r in got) == sum(r.sequence_alignment != "" for r in got) > 30


def test_variants_in_alignments(spark):
    """Letters within a gene change in the contig alone, those between genes in the germline too; gaps stay."""
    df = spark.createDataFrame([("TTAC-GTCCAATT", "TTACGGTCC-AGG", 2, 10, 2, "TTTTTTTT")], "t STRING, g STRING, s INT, e INT, at INT, c STRING")
    spans = F.array(F.struct(F.lit(0).alias("a"), F.lit(4).alias("b")), F.struct(F.lit(8).alias("a"), F.lit(11).alias("b")))
    got = df.select(airr.variant_aligned(F.col("t"), F.col("g"), F.col("s"), F.col("e"), F.col("at"), F.col("c"), spans).alias("x")).first().x
    # columns 2 to 10 hold places 2, 3, -, 4, 5, 6, 7, 8, 9 of the contig, of which 5 to 7 are outside of genes
    assert got.text == "TTTT-TTTTTTTT" and got.germline == "TTACGGTTT-AGG"


def test_alignment_strings_query(spark):
    """Every alignment spells out its read, and its cigars account for all letters of it."""
    texts = {r.id: r.seq for r in reads(spark, SF).collect()}
    got = q.QUERIES["alignment_strings"](spark, SF).collect()
    want = {r.cid for r in q.QUERIES["annotation"](spark, SF).where(F.col("v_gene").isNotNull() | F.col("j_gene").isNotNull()).collect()}
    assert {r.cid for r in got} == want and len(got) == len(want)
    for r in got:
        seq = texts[r.cid]
        assert r.sequence_alignment.replace("-", "") in seq and len(r.sequence_alignment) == len(r.germline_alignment)
        for cigar in (r.v_cigar, r.j_cigar):
            assert not cigar or letters(cigar, "S=XD") == len(seq)
