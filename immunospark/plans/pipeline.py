"""The stages from reads to reports as one plan.

stage 0: candidate reads; stage 1: contigs; stage 2: annotated contigs and CDR3 rows; stage 3: reports.
resume() writes results and stored_results() reads them again, so a run can start at any stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, read_format
from ..operators import airr, annotate, assemble, barcode_report, barcodes, diversity, filters, kmers, mates, ordering, pileup, prepare, reference, report, scaffold, variants
from ..operators.graph import cut


#: Stands for the barcode of reads without one, where these are kept.
NO_BARCODE = "none"


@dataclass
class Options:
    """Options of a run; names follow the command line of such pipelines."""

    read_format: str | None = None
    min_hit_len: int = 27
    kmer: int = 21
    contig_min_cov: int = 0
    barcoded: bool = False
    keep_no_barcode: bool = False
    #: Fragments that a barcode needs.
    barcode_least: int = 0
    #: The share of equal letters that a read needs on its contig.
    place_similarity: float = 0.9
    #: Whether reads are filtered and trimmed by their gene hits before they are assembled; letters of the library's reads, where these are long.
    trim: bool = True
    read_length: int = 0
    #: Whether mates join contigs of bulk reads.
    mate_extension: bool = True
    partial: bool = False
    impute: bool = True
    impute_bcr: bool = False
    tcr_error: float = report.TCR_ERROR
    bcr_error: float = report.BCR_ERROR


def extract(pairs: DataFrame, ref: DataFrame, options: Options) -> DataFrame:
    """Candidate reads (id, fragment, barcode, umi, gene, strand, seq), mates resolved and turned to the genes' strand; strand tells how they lay."""
    parts = read_format.parse(options.read_format) if options.read_format else {}
    cut = lambda kind, c, comp: read_format.extract(parts[kind], F.col(c), complement=comp) if kind in parts else F.col(c)
    barcode: Column = F.col("barcode") if "barcode" in pairs.columns else F.lit(None).cast("string")
    if "bc" in parts and "barcode_seq" in pairs.columns:
        barcode = read_format.extract(parts["bc"], F.col("barcode_seq"))
    umi = F.col("umi") if "umi" in pairs.columns else F.lit(None).cast("string")
    rows = pairs.select("id", cut("r1", "seq", True).alias("seq"), cut("r1", "qual", False).alias("qual"), cut("r2", "seq_2", True).alias("seq_2"), cut("r2", "qual_2", False).alias("qual_2"), barcode.alias("barcode"), umi.alias("umi"))
    if options.barcoded:
        rows = rows.withColumn("barcode", F.coalesce("barcode", F.lit(NO_BARCODE))) if options.keep_no_barcode else rows.where("barcode IS NOT NULL")
        if options.barcode_least:
            rows = barcodes.drop_thin_barcodes(rows, options.barcode_least)
    if "barcode_seq" in pairs.columns:
        own = pairs.select("id", (dna.low_complexity(F.col("barcode_seq")) & ((F.col("barcode_seq") == F.col("seq")) | F.coalesce(F.col("barcode_seq") == F.col("seq_2"), F.lit(False)))).alias("_own"))
        rows = rows.join(own.where("_own").select("id"), "id", "left_anti")
    codes = rows.select(F.col("id").alias("fragment"), "barcode", "umi")
    single = mates.resolve_pairs(rows).withColumn("fragment", mates.fragment_id(F.col("id"), F.col("merged")))
    # mates share their id until here
    single = single.select(F.concat_ws("/", "id", F.col("mate").cast("string")).alias("id"), "fragment", "seq")
    hit = reference.read_hits(single, ref, options.min_hit_len)
    found = single.join(hit.select("id", "strand", "gene", "length"), "id", "left")
    # a pair stays if either mate hits the reference; a mate without a hit lies on the other strand of the one that has it
    mate = hit.join(single.select("id", "fragment"), "id").groupBy("fragment").agg(F.max_by(F.struct("strand", "gene"), F.struct("length", "strand", -F.col("gene"))).alias("m"))
    found = found.join(mate, "fragment")
    strand, gene = F.coalesce("strand", -F.col("m.strand")), F.coalesce("gene", "m.gene")
    seq = F.when(strand == 1, F.col("seq")).otherwise(dna.reverse_complement(F.col("seq")))
    return found.join(codes, "fragment").select("id", "fragment", "barcode", "umi", gene.alias("gene"), strand.alias("strand"), seq.alias("seq"))


def _grouped(reads: DataFrame, ref: DataFrame, options: Options) -> tuple[DataFrame, str]:
    """Reads with the column by which they are assembled, and its name: the barcode, or the locus of bulk reads."""
    if options.barcoded:
        return reads, "barcode"
    return reads.join(ref.select(F.col("gene_idx").alias("gene"), "locus"), "gene").withColumn("locus", F.coalesce("locus", F.lit("other"))), "locus"


def mate_joined(made: DataFrame, rows: DataFrame, ref: DataFrame, by: str, options: Options) -> DataFrame:
    """Contigs (by, contig, consensus, n_reads, pos_weight) joined by the mates among the reads that equal their place."""
    made = cut(made.withColumn("cid", F.concat_ws("_", by, F.col("contig").cast("string"))))
    found = assemble.assigned(rows, made, [by], 1.0)
    kind = ref.select(F.col("gene_idx").alias("gene"), F.instr(F.lit("VDJC"), "gene_type").alias("rank"))
    lies = rows.select(by, "id", "fragment", "strand", "gene", F.length("seq").alias("length")).join(found, [by, "id"]).join(kind, "gene", "left")
    lies = lies.select("fragment", "strand", F.concat_ws("_", by, F.col("contig").cast("string")).alias("cid"), "offset", "length", "rank")
    lies = cut(lies)
    found = scaffold.fitting(scaffold.edges(lies), lies, made)
    return scaffold.scaffolds(made, cut(scaffold.links(found))).drop("cid")


def contigs(reads: DataFrame, ref: DataFrame, options: Options) -> DataFrame:
    """cid, contig, seq, weight, n_reads and barcode or locus of the contigs of each barcode, or of each locus for bulk reads."""
    rows, by = _grouped(cut(prepare.for_assembly(reads, ref, options.min_hit_len, options.read_length)) if options.trim else reads, ref, options)
    stats = kmers.read_stats(rows, options.kmer, key=["id"], by=[by] if options.barcoded else None)
    made = assemble.assemble(stats, [by], assemble.BARCODE_OVERLAP if options.barcoded else assemble.OVERLAP, options.barcoded)
    if options.contig_min_cov:
        made = made.where(~pileup.shallow(F.col("pos_weight"), options.contig_min_cov))
    if options.mate_extension and not options.barcoded:
        made = mate_joined(made, rows, ref, by, options)
    cid = F.concat_ws("_", by, F.col("contig").cast("string"))
    return made.select(cid.alias("cid"), "contig", F.col("consensus").alias("seq"), pileup.weight_sum(F.col("pos_weight")).alias("weight"), "n_reads", by)


def placed(reads: DataFrame, made: DataFrame, ref: DataFrame, options: Options) -> DataFrame:
    """cid, id, fragment, umi, offset, seq of the reads on the contigs that they fit best."""
    rows, by = _grouped(reads, ref, options)
    found = assemble.assigned(rows, made.withColumnRenamed("seq", "consensus"), [by], options.place_similarity)
    lies = rows.select(by, "id", "fragment", "umi", "seq").join(found, [by, "id"])
    return lies.join(made.select(by, "contig", "cid"), [by, "contig"]).select("cid", "id", "fragment", "umi", "offset", "seq")


def cdr3_rows(annotations: DataFrame, counts: DataFrame, made: DataFrame, ref: DataFrame) -> DataFrame:
    """The CDR3 table of annotated contigs; counts: cid, idx, cdr3, count. Contigs are in the order of their weight, then length."""
    names = lambda g: F.when(F.size(g) > 0, F.array_join(F.transform(F.filter(g, lambda h: (h.similarity == F.get(g, F.lit(0)).similarity) & (h.read_end - h.read_start == F.get(g, F.lit(0)).read_end - F.get(g, F.lit(0)).read_start)), lambda h: h.gene), ","))
    v, j = F.get("v", F.lit(0)), F.get("j", F.lit(0))
    whole = filters.complete_vdj(v, j, F.col("region"), F.col("seq"))
    rated = variants.with_germline_similarity(counts, annotations, ref)
    place = ordering.with_place(made.select("cid", "weight", F.length("seq").alias("n")), [F.desc("weight"), F.desc("n"), F.asc("cid")], "place").select("cid", "place")
    return annotations.where("cdr3 IS NOT NULL").withColumnRenamed("cdr3", "region").join(rated, "cid").join(place, "cid").select(
        "cid", "idx", *[names(g).alias(g) for g in "vdjc"], F.coalesce("cdr1.seq", F.lit("*")).alias("cdr1"), F.coalesce("cdr2.seq", F.lit("*")).alias("cdr2"),
        "cdr3", F.round(F.col("region.score") / 100, 2).alias("score"), "count", "germline_similarity", whole.cast("int").alias("complete_vdj"),
        (F.col("place") * (1 << 20) + F.col("idx")).alias("ordinal"),
    )


def run(pairs: DataFrame, ref: DataFrame, options: Options | None = None, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All results from read pairs (id, seq, qual, seq_2, qual_2[, barcode, umi]) and a loaded reference.

    stored: results of an earlier run (see resume() and stored_results()), which aren't worked out again.
    """
    options, have = options or Options(), stored or {}
    # each stage is written to the shared folder, so that the next ones don't run it again
    get = lambda name, make: have[name] if name in have else cut(make())
    reads = get("reads", lambda: extract(pairs, ref, options))
    made = get("contigs", lambda: contigs(reads, ref, options))
    annotations = get("annotations", lambda: annotate.with_coverage(variants.tie_broken(annotate.annotate(made, ref), made), made))
    lying = get("placed", lambda: placed(reads, made, ref, options))
    rows = get("cdr3", lambda: cdr3_rows(annotations, cut(variants.counted(annotations, lying, options.barcoded)), made, ref))
    clones = report.clonotype_report(rows, options.tcr_error, options.bcr_error, options.partial, by_barcode=options.barcoded)
    out = {"reads": reads, "contigs": made, "annotations": annotations, "placed": lying, "cdr3": rows, "report": clones, "diversity": diversity.diversity(clones)}
    airr_in = rows.withColumnRenamed("cdr3", "cdr3nt").where("score > 0")
    out["airr"] = airr.rearrangements(airr_in, annotations, airr.alignments(annotations, ref), cells=options.barcoded)
    if options.barcoded:
        cells = barcode_report.barcode_report(rows, partial=options.partial)
        out["cells"] = barcode_report.impute(cells, rows, options.impute_bcr) if options.impute else cells
    return out


#: Results by the stage that makes them.
STAGES = [("reads",), ("contigs",), ("annotations", "placed", "cdr3"), ("report", "airr", "diversity", "cells")]


def resume(stage: int, folder: str, results: dict[str, DataFrame]) -> None:
    """Write the results of a stage and of those after it as Parquet."""
    for names in STAGES[stage:]:
        for name in names:
            if name in results:
                results[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def stored_results(stage: int, folder: str, spark: SparkSession) -> dict[str, DataFrame]:
    """The results of all stages before a stage, from what resume() wrote; run() goes on from them."""
    return {name: spark.read.parquet(f"{folder}/{name}") for names in STAGES[:stage] for name in names}
