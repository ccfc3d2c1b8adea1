"""Gene references made of other files: a genome with its annotation, or a gene database."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement


def exons(lines: DataFrame) -> DataFrame:
    """ordinal, chrom, start, end (1-based, inclusive), strand, transcript, gene (upper case) of the exon lines of a GTF file (ordinal, value)."""
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    name = lambda key: F.regexp_extract(at(8), rf'{key} "(.*?)"', 1)
    rows = lines.where(~F.col("value").startswith("#")).where(at(2) == "exon")
    return rows.select("ordinal", at(0).alias("chrom"), at(3).cast("int").alias("start"), at(4).cast("int").alias("end"), at(6).alias("strand"), name("transcript_name").alias("transcript"), F.upper(name("gene_name")).alias("gene"))


def from_genome(genome: DataFrame, gtf: DataFrame, names: DataFrame) -> DataFrame:
    """name, chrom, start, end, strand, seq, ordinal of the transcripts of the genes wanted, exons in the order of the file.

    genome: FASTA records (id, seq); gtf: see exons(); names: gene. Either file may write chromosomes with or without
    `chr`, the genome's way is kept. A chromosome's text meets its exons once, as one row.
    """
    wanted = exons(gtf).join(names.select(F.upper("gene").alias("gene")).distinct(), "gene", "left_semi")
    plain = lambda c: F.regexp_replace(c, "^chr", "")
    by_transcript = wanted.groupBy(plain("chrom").alias("key"), "transcript", "gene", "strand").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end"))).alias("parts"))
    by_chrom = by_transcript.groupBy("key").agg(F.collect_list(F.struct("transcript", "gene", "strand", "parts")).alias("genes"))
    found = genome.select(F.col("id").alias("chrom"), plain("id").alias("key"), F.upper("seq").alias("text")).join(by_chrom, "key", "right")
    known = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no chromosome "), "key"))).otherwise(F.col("text"))

    def letters(g):
        one = lambda x: F.substr(known, x["start"], x["end"] - x["start"] + 1)
        return F.array_join(F.transform(g["parts"], lambda x: F.when(g["strand"] == "-", reverse_complement(one(x))).otherwise(one(x))), "")

    first, last = (lambda g: g["parts"][0]), (lambda g: F.element_at(g["parts"], -1))
    row = lambda g: F.struct(
        g["gene"].alias("name"), F.when(g["strand"] == "-", last(g)["start"]).otherwise(first(g)["start"]).alias("start"), F.when(g["strand"] == "-", first(g)["end"]).otherwise(last(g)["end"]).alias("end"),
        g["strand"].alias("strand"), letters(g).alias("seq"), first(g)["ordinal"].alias("ordinal"),
    )
    out = found.select("chrom", F.explode(F.transform("genes", row)).alias("x"))
    return out.select("x.name", "chrom", "x.start", "x.end", "x.strand", "x.seq", "x.ordinal")


def from_database(fasta: DataFrame, species: str) -> DataFrame:
    """ordinal, id, seq of a species' receptor genes from a database's records, whose headers are `accession|gene|species|...`.

    Genes begin with IG or TR. Records of one gene that follow one another are pieces of it, if they have one accession,
    and are joined; of other accessions the first counts. fasta: ordinal, id, comment, seq (id and comment part at a blank).
    """
    f = F.split(F.concat_ws(" ", "id", "comment"), r"\|")
    at = lambda k: F.get(f, F.lit(k))
    rows = fasta.select("ordinal", at(0).alias("accession"), at(1).alias("gene"), F.translate(at(2), " ", "_").alias("species"), F.translate("seq", "acgtn", "ACGTN").alias("seq"))
    rows = rows.where(F.col("species").contains(species.replace(" ", "_")) & F.col("gene").rlike("^(IG|TR)"))
    # a gene's records lie together in the file, so that its name alone groups them
    w = Window.partitionBy("gene").orderBy("ordinal")
    kept = rows.withColumn("first", F.first("accession").over(w)).where(F.col("accession") == F.col("first"))
    pieces = kept.groupBy("gene").agg(F.min("ordinal").alias("ordinal"), F.array_sort(F.collect_list(F.struct("ordinal", "seq"))).alias("x"))
    return pieces.select("ordinal", F.col("gene").alias("id"), F.array_join(F.transform("x", lambda p: p["seq"]), "").alias("seq"))
