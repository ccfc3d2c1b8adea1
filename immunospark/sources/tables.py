"""Readers of the text tables: Spark's own text and CSV sources, with null tokens made null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genes

CDR3_SCHEMA = "cid STRING, idx INT, v STRING, d STRING, j STRING, c STRING, cdr1 STRING, cdr2 STRING, cdr3 STRING, score DOUBLE, count DOUBLE, germline_similarity DOUBLE, complete_vdj INT"
REPORT_SCHEMA = "count BIGINT, frequency DOUBLE, cdr3nt STRING, cdr3aa STRING, v STRING, d STRING, j STRING, c STRING, cid STRING, cid_full_length INT"
CHAIN_FIELDS = ["v", "d", "j", "c", "cdr3nt", "cdr3aa", "count", "cid", "germline_similarity", "complete_vdj"]
MISSING_BARCODE = "missing_barcode"


def _tsv(spark: SparkSession, path: str, schema: str, comment: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).options(sep="\t", mode="FAILFAST", quote="")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def _nulls(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: genes.called(F.col(c)) for c in cols})


def read_cdr3(spark: SparkSession, path: str) -> DataFrame:
    """The CDR3 table with an ordinal by contig, variant and row; genes stay comma lists, `*` is null."""
    df = _tsv(spark, path, CDR3_SCHEMA).withColumn("ordinal", F.monotonically_increasing_id())
    return _nulls(df, "v", "d", "j", "c", "cdr1", "cdr2")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return _nulls(_tsv(spark, path, REPORT_SCHEMA, "#"), "v", "d", "j", "c")


def chain_from_text(text: Column) -> Column:
    """A chain struct from its comma-separated text, null for *."""
    parts = F.split(text, ",")
    cast = {"count": "double", "germline_similarity": "double", "complete_vdj": "int"}
    fields = [(genes.called(F.get(parts, F.lit(i))) if n in "vdjc" else F.get(parts, F.lit(i)).cast(cast.get(n, "string"))).alias(n) for i, n in enumerate(CHAIN_FIELDS)]
    return F.when(text != "*", F.struct(*fields))


def read_barcode_report(spark: SparkSession, path: str) -> DataFrame:
    raw = _tsv(spark, path, "barcode STRING, cell_type STRING, c1 STRING, c2 STRING, s1 STRING, s2 STRING", "#")
    many = lambda c: F.when(F.col(c) == "*", F.array().cast("array<string>")).otherwise(F.split(c, ";"))
    return raw.select("barcode", "cell_type", chain_from_text(F.col("c1")).alias("chain1"), chain_from_text(F.col("c2")).alias("chain2"),
                      F.transform(many("s1"), chain_from_text).alias("secondary1"), F.transform(many("s2"), chain_from_text).alias("secondary2"))


_HIT = r"([^,\s(]+)\((\d+)\):\((\d+)-(\d+)\):\((\d+)-(\d+)\):([0-9.]+)"


def gene_hits(field: Column) -> Column:
    """The hits of an annotation field, `name(reflen):(readstart-readend):(refstart-refend):similarity` joined by commas, as an array of structs."""
    def one(x: Column) -> Column:
        g = lambda k: F.regexp_extract(x, _HIT, k)
        return F.struct(g(1).alias("gene"), *[g(k).cast("int").alias(n) for k, n in enumerate(("ref_len", "read_start", "read_end", "ref_start", "ref_end"), 2)], g(7).cast("double").alias("similarity"))

    return F.transform(F.regexp_extract_all(field, F.lit(_HIT), F.lit(0)), one)


def cdr(field: Column) -> Column:
    """CDRk(start-end):score=sequence as a struct, null if there is none."""
    pattern = r"^CDR\d\((\d+)-(\d+)\):([0-9.]+)=(\w+)$"
    g = lambda k: F.regexp_extract(field, pattern, k)
    return F.when((g(4) != "null") & (g(4) != ""), F.struct(g(1).cast("int").alias("start"), g(2).cast("int").alias("end"), g(3).cast("double").alias("score"), g(4).alias("seq")))


def parse_annotation(fasta: DataFrame) -> DataFrame:
    """Contig annotations from FASTA records (id, comment, seq)."""
    f = F.split("comment", r"\s+")
    at = lambda k: F.get(f, F.lit(k))
    return fasta.select(
        F.col("id").alias("cid"), at(0).cast("int").alias("len"), at(1).cast("double").alias("coverage"),
        *[gene_hits(at(2 + k)).alias(g) for k, g in enumerate("vdjc")], *[cdr(at(6 + k)).alias(f"cdr{k + 1}") for k in range(3)], "seq",
    )


def annotation_line(row: Column | None = None) -> Column:
    """The header comment of an annotation, the inverse of parse_annotation."""
    def hits(g: str) -> Column:
        one = lambda h: F.format_string("%s(%d):(%d-%d):(%d-%d):%.2f", h.gene, h.ref_len, h.read_start, h.read_end, h.ref_start, h.ref_end, h.similarity)
        return F.when(F.size(g) > 0, F.array_join(F.transform(g, one), ",")).otherwise("*")

    def region(k: int) -> Column:
        c = F.col(f"cdr{k}")
        return F.when(c.isNull(), f"CDR{k}(0-0):0.00=null").otherwise(F.format_string(f"CDR{k}(%d-%d):%.2f=%s", c.start, c.end, c.score, c.seq))

    return F.concat_ws(" ", F.col("len").cast("string"), F.format_string("%.2f", F.col("coverage")), *[hits(g) for g in "vdjc"], *[region(k) for k in (1, 2, 3)])


def parse_contigs(lines: DataFrame) -> DataFrame:
    """Contigs from the six-line records of an assembly: lines (line_no from 0, value)."""
    rows = lines.select(F.floor(F.col("line_no") / 6).alias("_r"), (F.col("line_no") % 6).alias("_k"), "value")
    wide = rows.groupBy("_r").agg(*[F.max(F.when(F.col("_k") == k, F.col("value"))).alias(f"l{k}") for k in range(6)])
    numbers = lambda k: F.transform(F.split(F.trim(f"l{k}"), r"\s+"), lambda x: x.cast("int"))
    weights = F.transform(F.arrays_zip(*[numbers(k).alias(b) for k, b in zip(range(2, 6), "acgt")]), lambda x: F.struct(*[x[b].alias(b) for b in "acgt"]))
    head = F.split(F.substring("l0", 2, 1 << 20), r"\s+")
    cid = F.get(head, F.lit(0))
    return wide.select(cid.alias("cid"), F.get(head, F.lit(1)).alias("name"), F.col("l1").alias("consensus"), weights.alias("pos_weight"),
                       F.when(cid.contains("_"), genes.barcode_of(cid)).alias("barcode"))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one text, so that its lines can be numbered."""
    whole = spark.read.text(path, wholetext=True)
    return parse_contigs(whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("line_no", "value")))


def parse_assembled_reads(fasta: DataFrame) -> DataFrame:
    """id, strand, min_cnt, median_cnt, barcode, umi, seq of assembled reads."""
    f = F.split("comment", r"\s+")
    tag = lambda t: F.nullif(F.regexp_extract("comment", rf"(?:^|\s){t}:(\S+)", 1), F.lit(""))
    return fasta.select("id", *[F.get(f, F.lit(k)).cast("int").alias(n) for k, n in enumerate(("strand", "min_cnt", "median_cnt"))], tag("barcode").alias("barcode"), tag("umi").cast("int").alias("umi"), "seq")


def parse_kmer_dump(fasta: DataFrame) -> DataFrame:
    """kmer (canonical), n of a dump; k-mers seen once are skipped."""
    from ..functions.dna import canonical

    return fasta.select(canonical(F.col("seq")).alias("kmer"), F.col("id").cast("bigint").alias("n")).where("n > 1")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("barcode")).where("barcode <> ''")


def read_translation(spark: SparkSession, path: str) -> DataFrame:
    """to, from: columns divided by the first comma, tab or space."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^([^,\t ]+)", 1).alias("to"), F.regexp_extract("value", r"^[^,\t ]+[,\t ]([^,\t ]+)", 1).alias("from")).where("from <> ''")


def parse_barcodes(fasta: DataFrame) -> DataFrame:
    """file_ord, ordinal, id, value; the token of a missing barcode is null."""
    return fasta.select("file_ord", "ordinal", "id", F.nullif("seq", F.lit(MISSING_BARCODE)).alias("value"))


def zipped(left: DataFrame, right: DataFrame, suffix: str = "_2") -> DataFrame:
    """Lock-step records of two inputs; unequal lengths fail."""
    keys = ["file_ord", "ordinal"]
    renamed = right.select(*keys, *[F.col(c).alias(c + suffix) for c in right.columns if c not in keys])
    both = left.withColumn("_l", F.lit(1)).join(renamed.withColumn("_r", F.lit(1)), keys, "full_outer")
    check = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("the inputs have different numbers of records"))).otherwise(F.lit(True))
    return both.withColumn("_ok", check).where("_ok").drop("_l", "_r", "_ok")


def cells_from_files(spark: SparkSession, read, paths: list[str]) -> DataFrame:
    """UNION ALL of one file per cell; a cell's id is its file's name before the first dot."""
    out = None
    for p in paths:
        df = read(spark, p).withColumn("cell", F.lit(p.rsplit("/", 1)[-1].split(".", 1)[0]))
        out = df if out is None else out.unionByName(df)
    return out


def parse_interval_headers(fasta: DataFrame) -> DataFrame:
    """Gene intervals from headers `name chrom start end strand`."""
    f = F.split("comment", r"\s+")
    return fasta.select(F.col("id").alias("name"), F.get(f, F.lit(0)).alias("chrom"), *[F.get(f, F.lit(k)).cast("int").alias(n) for k, n in ((1, "start"), (2, "end"))], F.get(f, F.lit(3)).alias("strand"), "seq")
