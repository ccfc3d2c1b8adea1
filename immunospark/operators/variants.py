"""CDR3 variants of contigs, and how many reads each of them has.

Reads that lie on a contig vote for the letters of its CDR3: each stretch that covers the CDR3 is a
variant, and a read that covers a part of it fits the variants that agree with that part. Reads are
reduced to the parts that they show, and fragments to their sets of parts, before they meet the
variants, so a contig's work is that of its distinct parts; expectation-maximisation then shares out
what fits several variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align
from . import em

#: Bases by which a read must reach into a CDR3, at either end.
REACH = 3
#: Gene name prefixes' third letters that stand for chains with a D gene.
WITH_D = "HBD"
FIELDS = ["gene", "read_start", "read_end", "ref_start", "ref_end"]


def shown(placed: DataFrame, annotations: DataFrame) -> DataFrame:
    """cid, fragment, umi, at, part, whole: the letters (from base `at` of the CDR3) that each read shows of its contig's CDR3.

    placed: cid, fragment, umi, offset (of the read in its contig, from 0, negative where it begins before), seq.
    """
    places = annotations.where("cdr3 IS NOT NULL").select("cid", F.col("cdr3.start").alias("a"), F.col("cdr3.end").alias("b"), F.length("seq").alias("n"))
    rows = placed.join(places, "cid")
    first, last = F.greatest("offset", F.lit(0)), F.least(F.col("offset") + F.length("seq"), F.col("n")) - 1
    rows = rows.where((last > F.col("a") + REACH) & (first < F.col("b") - REACH))
    lo, hi = F.greatest(first, F.col("a")), F.least(last, F.col("b"))
    part = F.substr("seq", lo - F.col("offset") + 1, hi - lo + 1)
    return rows.select("cid", "fragment", "umi", (lo - F.col("a")).cast("int").alias("at"), part.alias("part"), ((lo == F.col("a")) & (hi == F.col("b"))).alias("whole"))


def compatible(variant: Column, at: Column, part: Column) -> Column:
    """Whether a part that begins at base `at` of the CDR3 agrees with a variant."""
    return F.substr(variant, at + 1, F.length(part)) == part


def counted(annotations: DataFrame, placed: DataFrame, single: bool = False) -> DataFrame:
    """cid, idx, cdr3, count of the variants of each contig with a CDR3, most covered first; those without a count go.

    single: the consensus is the only variant, as for barcodes. A fragment counts once, however many reads
    it has, and where there are UMIs each of them counts once on a contig.
    """
    parts = shown(placed, annotations)
    own = annotations.where("cdr3 IS NOT NULL").select("cid", F.col("cdr3.seq").alias("cdr3"))
    spanning = parts.where("whole AND NOT part RLIKE '[^ACGTN]'" if not single else "false")
    found = spanning.groupBy("cid", F.col("part").alias("cdr3")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("cid").orderBy(F.desc("n"), "cdr3")
    # a contig that no read spans has its consensus; joins rather than unions, whose partitionings adaptive execution mixes up in Spark 4.1
    variants = own.join(found.withColumnRenamed("cdr3", "read_cdr3"), "cid", "left").select("cid", F.coalesce("read_cdr3", "cdr3").alias("cdr3"), F.coalesce("n", F.lit(0)).alias("n"))
    variants = variants.withColumn("idx", F.row_number().over(order) - 1)
    sizes = variants.groupBy("cid").agg(F.count(F.lit(1)).alias("size"))

    # fragments by the sets of parts that they show; of the fragments of a UMI on a contig the first stands for it
    shows = parts.groupBy("cid", "fragment").agg(F.min("umi").alias("umi"), F.array_sort(F.collect_set(F.struct("at", "part"))).alias("parts"))
    one = F.coalesce(F.concat(F.lit("u"), F.col("umi").cast("string")), F.concat(F.lit("f"), F.col("fragment").cast("string")))
    shows = shows.groupBy("cid", one.alias("one")).agg(F.min(F.struct("fragment", "parts")).alias("x"))
    sets = shows.select("cid", F.col("x.parts").alias("parts")).groupBy("cid", "parts").agg(F.count(F.lit(1)).alias("weight"))
    sets = sets.join(sizes, "cid")
    plain = sets.where("size = 1").groupBy("cid").agg(F.sum("weight").cast("double").alias("alone")).withColumn("idx", F.lit(0))
    several = sets.where("size > 1").join(variants.select("cid", "idx", "cdr3"), "cid")
    fits = several.where(F.forall("parts", lambda p: compatible(F.col("cdr3"), p["at"], p["part"])))
    shared = em.abundances(fits.select("cid", F.struct("parts").alias("read"), "idx", "weight"), "cid", "read", "idx", "weight")
    # the share that a fit leaves of a variant nobody needs is no count
    counts = variants.join(plain, ["cid", "idx"], "left").join(shared.select("cid", "idx", F.col("n").alias("count")), ["cid", "idx"], "left")
    kept = counts.withColumn("count", F.coalesce("alone", "count")).where("count > 0")
    return kept.select("cid", (F.row_number().over(Window.partitionBy("cid").orderBy("idx")) - 1).alias("idx"), "cdr3", "count")


def tie_broken(annotations: DataFrame, contigs: DataFrame) -> DataFrame:
    """Annotations whose best gene of each type is, of those that equal it in extent and similarity, the one most abundant in all contigs.

    contigs: cid, weight, seq. A gene's abundance is the mean weight of the contigs whose best hit it is.
    """
    types = "vdjc"
    long = None
    for t in types:
        got = annotations.select("cid", F.lit(t).alias("type"), F.posexplode(t).alias("pos", "hit"))
        long = got if long is None else long.unionByName(got)
    depth = contigs.select("cid", (F.col("weight") / F.length("seq")).alias("depth"))
    abundance = long.where("pos = 0").join(depth, "cid").groupBy(F.col("hit.gene").alias("gene")).agg(F.sum("depth").alias("abundance"))
    rated = long.withColumn("gene", F.col("hit.gene")).join(abundance, "gene", "left").withColumn("abundance", F.coalesce("abundance", F.lit(0.0)))
    ranked = rated.groupBy("cid", "type").agg(F.array_sort(F.collect_list(F.struct("pos", "abundance", "hit"))).alias("x"))
    first = F.col("x")[0]
    extent = lambda h: h["read_end"] - h["read_start"]
    equals = F.filter("x", lambda y: (extent(y["hit"]) == extent(first["hit"])) & (y["hit"]["similarity"] == first["hit"]["similarity"]))
    best = F.array_max(F.transform(equals, lambda y: F.struct(y["abundance"], -y["pos"])))["col2"]
    # the chosen hit and the first one change places
    swapped = F.transform("x", lambda y, i: F.when(i == 0, F.get("x", (-best).cast("int"))["hit"]).when(i == -best, first["hit"]).otherwise(y["hit"]))
    wide = ranked.select("cid", "type", swapped.alias("hits")).groupBy("cid").agg(*[F.max_by("hits", F.when(F.col("type") == t, 1)).alias(f"new_{t}") for t in types])
    others = [c for c in annotations.columns if c not in types]
    got = annotations.join(wide, "cid", "left")
    return got.select(*[F.coalesce(f"new_{c}", c).alias(c) if c not in others else F.col(c) for c in annotations.columns])


def similarity_to_germline(genes: dict[str, tuple[str, int | None, int | None]], v, d, j, start: int, end: int, score: float, cdr3: str) -> float:
    """The share of the germline letters of V, D and J within the CDR3 that the CDR3 has; 0 where that can't be told.

    genes: name to sequence, start of the CDR3 in a V gene, its end in a J gene. Hits have gene, read_start, read_end, ref_start, ref_end.
    """
    if score <= 0 or not v or not j or not v["read_start"] <= start <= v["read_end"] or not j["read_start"] <= end <= j["read_end"]:
        return 0.0
    pieces = []
    seq, anchor, _ = genes[v["gene"]]
    pieces.append((seq, anchor if anchor is not None else v["ref_end"] - (v["read_end"] - start), v["ref_end"], start, v["read_end"]))
    if v["gene"][2:3] in WITH_D:
        if not d:
            return 0.0
        pieces.append((genes[d["gene"]][0], d["ref_start"], d["ref_end"], d["read_start"], d["read_end"]))
    seq, _, anchor = genes[j["gene"]]
    # a J gene's CDR3 ends at the first base of its motif's first codon here, two before j_end
    pieces.append((seq, j["ref_start"], anchor - 2 if anchor is not None else j["ref_start"] + end - j["read_start"], j["read_start"], end))
    same = length = 0
    for germline, lo, hi, a, b in pieces:
        if b < a or hi < lo:
            return 0.0
        if start <= a and b <= end:
            same += align.affine(germline[lo : hi + 1], cdr3[a - start : b - start + 1])[1].count("=")
            length += hi - lo + 1
    return same / length if length else 0.0


def with_germline_similarity(rows: DataFrame, annotations: DataFrame, ref: DataFrame) -> DataFrame:
    """Adds germline_similarity, in percent, to rows (cid, cdr3). The reference is a gene catalogue; its sequences are shared with all tasks."""
    genes = {name: (r["seq"], r["cdr3_start"], r["j_end"]) for r in ref.select("name", "seq", "cdr3_start", "j_end").collect() for name in (r["name"], r["name"].split("|")[0])}
    shared = rows.sparkSession.sparkContext.broadcast(genes)

    @F.pandas_udf("double")
    def similarity(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        known = shared.value
        for pdf in parts:
            # nested rows come as Row or dict, numbers beside nulls as floats
            hits = [[{k: x[k] if k == "gene" else int(x[k]) for k in FIELDS} if x is not None and x["gene"] is not None else None for x in pdf[c]] for c in ("_v", "_d", "_j")]
            each = zip(*hits, map(int, pdf["_a"]), map(int, pdf["_b"]), pdf["_s"], pdf["cdr3"])
            yield pd.Series([round(100 * similarity_to_germline(known, *row), 2) for row in each], dtype=float)

    first = lambda c: F.get(c, F.lit(0)).alias(c)
    hits = annotations.where("cdr3 IS NOT NULL").select("cid", first("v"), first("d"), first("j"), F.col("cdr3.start").alias("_a"), F.col("cdr3.end").alias("_b"), F.col("cdr3.score").alias("_s"))
    both = rows.join(hits.withColumnsRenamed({c: f"_{c}" for c in "vdj"}), "cid")
    got = both.withColumn("germline_similarity", similarity(F.struct("_v", "_d", "_j", "_a", "_b", "_s", "cdr3")))
    return got.select(*rows.columns, "germline_similarity")
