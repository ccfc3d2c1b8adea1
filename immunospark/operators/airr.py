"""AIRR rearrangement rows from CDR3s, annotations and alignments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align, dna, genes
from ..functions import cdr3 as fcdr3

#: Genes of a catalogue that is shared with all tasks.
MAX_GENES = 20_000
_STRINGS = ["v_cigar", "d_cigar", "j_cigar", "c_cigar", "sequence_alignment", "germline_alignment"]
_ALIGNED = pa.schema([("cid", pa.string()), *[(c, pa.string()) for c in _STRINGS], ("cdr3_start", pa.int32()), ("cdr3_end", pa.int32())])

COLUMNS = [
    "sequence_id", "sequence", "rev_comp", "productive", "locus", "v_call", "d_call", "j_call", "c_call", "sequence_alignment", "germline_alignment", "cdr1", "cdr2", "junction",
    "junction_aa", "v_cigar", "d_cigar", "j_cigar", "c_cigar", "v_identity", "j_identity", "cell_id", "complete_vdj", "consensus_count",
]


def with_cdr3(seq: Column, start: Column, end: Column, cdr3: Column) -> Column:
    """A contig with one of its CDR3 variants put in place of [start, end]."""
    return F.concat(F.substr(seq, F.lit(1), start), cdr3, F.substr(seq, end + 2, F.length(seq)))


def variant_aligned(text: Column, germline: Column, start: Column, end: Column, at: Column, cdr3: Column, genes: Column) -> Column:
    """The two alignments (fields text, germline) with a CDR3 variant put at columns [start, end]; at is where the CDR3 begins in the contig, genes the spans (a, b) of its hits. Outside of them the germline has the contig's own letters, and so the variant's."""

    def step(done: Column, i: Column) -> Column:
        letter, germ, new = F.substr(text, i + 1, F.lit(1)), F.substr(germline, i + 1, F.lit(1)), F.substr(cdr3, done["n"] + 1, F.lit(1))
        own = (letter != "-") & (germ != "-") & ~F.exists(genes, lambda g: (g["a"] <= at + done["n"]) & (at + done["n"] <= g["b"]))
        return F.struct(
            F.concat(done["text"], F.when(letter == "-", letter).otherwise(new)).alias("text"), F.concat(done["germline"], F.when(own, new).otherwise(germ)).alias("germline"),
            (done["n"] + F.when(letter == "-", 0).otherwise(1)).alias("n"),
        )

    none = F.struct(F.lit("").alias("text"), F.lit("").alias("germline"), F.lit(0).alias("n"))
    got = F.aggregate(F.sequence(start, end), none, step)
    around = lambda x, part: F.concat(F.substr(x, F.lit(1), start), part, F.substr(x, end + 2, F.length(x)))
    return F.struct(around(text, got["text"]).alias("text"), around(germline, got["germline"]).alias("germline"))


def indexed(rows: DataFrame) -> DataFrame:
    """Rows with index: their number, from 0, among those of their contig, in input order."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("cid").orderBy("ordinal")) - 1)


def rearrangements(rows: DataFrame, annotations: DataFrame, alignments: DataFrame | None = None, cells: bool = False) -> DataFrame:
    """The 24 columns. rows: cid, cdr3nt, count, complete_vdj, ordinal; annotations as parsed; alignments: cid, the four cigars, sequence_alignment, germline_alignment, cdr3_start, cdr3_end. cells: ids are cells' contigs, without an index.

    Gene calls come from the annotation, and contigs whose CDR3 is partial there have no rows.
    """
    hit = lambda g: F.get(g, F.lit(0))
    ann = annotations.where("cdr3.score > 0").select(
        "cid", "seq", F.col("cdr3.start").alias("_s"), F.col("cdr3.end").alias("_e"), F.coalesce("cdr1.seq", F.lit("")).alias("cdr1"), F.coalesce("cdr2.seq", F.lit("")).alias("cdr2"),
        *[F.coalesce(hit(g).gene, F.lit("")).alias(f"{g}_call") for g in "vdjc"],
        *[F.coalesce(F.format_string("%.2f", hit(g).similarity), F.lit("")).alias(f"{g}_identity") for g in "vj"],
        genes.locus(hit("v").gene, hit("j").gene, hit("c").gene, genes.C_J_V).alias("locus"),
        F.filter(F.array(*[F.struct(hit(g).read_start.alias("a"), hit(g).read_end.alias("b")) for g in "vdj"]), lambda x: x["a"].isNotNull()).alias("_hits"),
    )
    df = indexed(rows).select("cid", "cdr3nt", "count", "complete_vdj", "index").join(ann, "cid")
    if alignments is not None:
        df = df.join(alignments, "cid", "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("string") for c in ("v_cigar", "d_cigar", "j_cigar", "c_cigar", "sequence_alignment", "germline_alignment")} | {"cdr3_start": F.lit(-1), "cdr3_end": F.lit(-1)})
    none = F.lit(None).cast("struct<text:string,germline:string>")
    if alignments is not None:
        aligned = (F.col("cdr3_start") >= 0) & (F.col("cdr3_end") >= 0)
        none = F.when(aligned, variant_aligned(F.col("sequence_alignment"), F.col("germline_alignment"), F.col("cdr3_start"), F.col("cdr3_end"), F.col("_s"), F.col("cdr3nt"), F.col("_hits")))
    # lambdas aren't shared between uses, so what is used twice is a column first
    df = df.withColumn("_both", none).withColumn("_codons", dna.translate_codons(F.col("cdr3nt")))
    df = df.withColumn("_aa", fcdr3.airr_translation(F.col("cdr3nt"), F.col("_codons")))
    aa = F.col("_aa")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return df.select(
        (F.col("cid") if cells else F.concat_ws("_", "cid", F.col("index").cast("string"))).alias("sequence_id"),
        with_cdr3(F.col("seq"), F.col("_s"), F.col("_e"), F.col("cdr3nt")).alias("sequence"), F.lit("F").alias("rev_comp"),
        F.when(aa == "", "F").otherwise("T").alias("productive"), F.coalesce("locus", F.lit("")).alias("locus"), "v_call", "d_call", "j_call", "c_call",
        F.coalesce("_both.text", F.lit("")).alias("sequence_alignment"), F.coalesce("_both.germline", F.lit("")).alias("germline_alignment"),
        "cdr1", "cdr2", F.col("cdr3nt").alias("junction"), aa.alias("junction_aa"), blank("v_cigar"), blank("d_cigar"), blank("j_cigar"), blank("c_cigar"), "v_identity", "j_identity",
        (genes.barcode_of(F.col("cid")) if cells else F.lit("")).alias("cell_id"), "complete_vdj", F.col("count").alias("consensus_count"),
    )


def columns(seq: str, gene: str, hit: dict) -> tuple[str, list[tuple[int, str, str]]]:
    """The script of a hit's global alignment, and its columns: a place in the contig, the contig's letter and the gene's, - for none. A letter that the contig lacks is at the place of the next one."""
    read, germline = seq[hit["read_start"] : hit["read_end"] + 1], gene[hit["ref_start"] : hit["ref_end"] + 1]
    script = align.affine(germline, read)[1]
    letters, germs = iter(read), iter(germline)
    out, at = [], hit["read_start"]
    for step in script:
        out.append((at, "-" if step == "D" else next(letters), "-" if step == "I" else next(germs)))
        at += step != "D"
    return script, out


def aligned(seq: str, catalogue: dict[str, str], hits: list[dict | None], cdr3: tuple[int, int] | None) -> list:
    """The four cigars of the hits (V, D, J and C), the contig and its germline from the first of V, D and J to the last, and where the CDR3 is in these, -1 if it isn't.

    Where genes overlap V comes before J and J before D; between genes the germline has the contig's own letters.
    """
    made = [columns(seq, catalogue[h["gene"]], h) if h else ("", []) for h in hits]
    cigars = [align.cigar(script, h["read_start"], len(seq) - 1 - h["read_end"], h["ref_start"], h["ref_len"] - 1 - h["ref_end"]) if h else "" for h, (script, _) in zip(hits, made)]
    out: list[tuple[int, str, str]] = []
    done = None
    for k, (h, (_, cols)) in enumerate(zip(hits[:3], made)):
        if not h:
            continue
        first = h["read_start"] if done is None else max(h["read_start"], done + 1)
        last = min(h["read_end"], hits[2]["read_start"] - 1) if k == 1 and hits[2] else h["read_end"]
        if last < first:
            continue
        if done is not None:
            out += [(p, seq[p], seq[p]) for p in range(done + 1, first)]
        out += [c for c in cols if first <= c[0] <= last]
        done = last
    place = {p: i for i, (p, letter, _) in enumerate(out) if letter != "-"}
    ends = [place.get(x, -1) for x in cdr3] if cdr3 else [-1, -1]
    return [*cigars, "".join(c[1] for c in out), "".join(c[2] for c in out), *ends]


def alignments(annotations: DataFrame, ref: DataFrame) -> DataFrame:
    """cid, the four cigars, sequence_alignment, germline_alignment, cdr3_start, cdr3_end of annotated contigs, by the best hit of each type; ref is a loaded reference."""
    rows = ref.select("name", "seq").limit(MAX_GENES + 1).collect()
    if len(rows) > MAX_GENES:
        raise ValueError(f"a reference of more than {MAX_GENES} genes")
    shared = annotations.sparkSession.sparkContext.broadcast({name: r["seq"] for r in rows for name in (r["name"], r["name"].split("|")[0])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                cdr3 = (r["cdr3"]["start"], r["cdr3"]["end"]) if r["cdr3"] else None
                found.append([r["cid"], *aligned(r["seq"], shared.value, [r[g] for g in "vdjc"], cdr3)])
            cols = list(zip(*found)) or [[] for _ in _ALIGNED]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ALIGNED)], schema=_ALIGNED)

    best = annotations.select("cid", "seq", *[F.get(g, F.lit(0)).alias(g) for g in "vdjc"], F.struct("cdr3.start", "cdr3.end").alias("places"), F.col("cdr3").isNotNull().alias("has"))
    best = best.select("cid", "seq", *"vdjc", F.when(F.col("has"), F.col("places")).alias("cdr3"))
    return best.mapInArrow(run, "cid STRING, " + ", ".join(f"{c} STRING" for c in _STRINGS) + ", cdr3_start INT, cdr3_end INT")


def contig_rows(annotations: DataFrame, alignments: DataFrame) -> DataFrame:
    """cid and the 19 AIRR columns of a contig by itself; all but its sequence are blank where neither a gene nor a CDR3 was found."""
    hit = lambda g: F.get(g, F.lit(0))
    blank = lambda c: F.coalesce(c, F.lit(""))
    nt = F.col("cdr3.seq")
    aa = F.when(F.length(nt) % 3 != 0, "out_of_frame").otherwise(dna.translate_codons(nt))
    known = F.col("cdr3").isNotNull()
    for g in "vdjc":
        known = known | hit(g).isNotNull()
    df = annotations.join(alignments.drop("cdr3_start", "cdr3_end"), "cid", "left")
    return df.select(
        "cid", F.col("seq").alias("sequence"), F.when(known, "F").otherwise("").alias("rev_comp"), *[blank(hit(g).gene).alias(f"{g}_call") for g in "vdjc"], *[blank(F.col(c)).alias(c) for c in _STRINGS],
        *[blank(F.col(f"cdr{k}.seq")).alias(f"cdr{k}") for k in (1, 2)], blank(nt).alias("junction"), blank(aa).alias("junction_aa"),
        F.when(nt.isNull(), "").when(aa.rlike("^[A-Z]+$"), "T").otherwise("F").alias("productive"), *[blank(F.format_string("%.2f", hit(g).similarity)).alias(f"{g}_identity") for g in "vj"],
    )


def gapped(sequence: Column, germline: Column) -> Column:
    """A sequence with the dots of its gapped germline put in: the germline's letters are consumed in step with the sequence's."""
    step = lambda a, g: F.when(g == ".", F.struct(F.concat(a["out"], F.lit(".")).alias("out"), a["i"].alias("i"))).otherwise(
        F.struct(F.concat(a["out"], F.substr(sequence, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))
    )
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    return F.aggregate(F.split(germline, ""), start, step, lambda a: F.concat(a["out"], F.substr(sequence, a["i"], F.length(sequence))))
