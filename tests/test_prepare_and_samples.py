"""Reads made ready for assembly, share-first samples, and the chains query against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from immunospark.operators import barcodes, intervals, prepare, samples
from immunospark.plans import queries as q
from immunospark.plans.standins import reads

SF = "/root/testdata/sf0.001"


def rand(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_reads_are_trimmed_and_dropped_by_their_genes(spark):
    rng = random.Random(8)
    v, j, c = rand(rng, 150), rand(rng, 60), rand(rng, 400)
    ref = spark.createDataFrame([(1, "IGHV1*01", v, "V"), (2, "IGHJ1*01", j, "J"), (3, "IGHM", c, "C")], "gene_idx INT, name STRING, seq STRING, gene_type STRING")
    junk = rand(rng, 20)
    rows = [
        ("front", junk + v[:90], 1), ("whole", v[20:110], 1), ("back", v[110:] + j + c[:30] + rand(rng, 25), 1), ("both", junk + v + j + c[:40] + junk, 1),
        ("order", j + v[:90], 1), ("deep", c[250:350], 1), ("near", c[50:150], -1), ("forward", c[150:250], 1), ("none", rand(rng, 80), 1), ("tiny", rand(rng, 30), 1), ("null", None, 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id STRING, seq STRING, strand INT, other STRING")
    got = {r.id: r for r in prepare.for_assembly(df, ref).collect()}
    assert {k: r.seq for k, r in got.items()} == {
        "front": v[:90], "whole": v[20:110], "back": v[110:] + j + c[:30], "both": v + j + c[:40], "near": c[50:150], "none": rows[8][1],
    } and all(r.other == "x" for r in got.values())
    hits = {r.id: r for r in prepare.gene_hits(df, ref).collect()}
    both = hits["both"]
    assert (both.v.read_start, both.v.ref_start, both.v.ref_len, both.v.gene) == (20, 0, 150, "IGHV1*01") and both.v.similarity == 100
    moved = {r.id: r for r in prepare.prepared(df.join(prepare.gene_hits(df, ref), "id", "left")).collect()}["both"]
    assert (moved.cut_front, moved.cut_back, moved.v.read_start, moved.j.read_start, moved.c) == (20, 20, 0, 150, None)
    assert prepare.for_assembly(df.limit(0), ref).columns == df.columns and prepare.for_assembly(df.limit(0), ref).count() == 0
    assert len(prepare.for_assembly(df, ref, first_length=300).collect()) == 3  # a third of a long library


def test_samples_are_the_smallest(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("place"), F.concat(F.lit("b"), (F.col("id") % 10).cast("string")).alias("barcode")).repartition(7)
    got = [r.place for r in samples.smallest(rows, 300, F.col("place")).collect()]
    assert sorted(got) == list(range(300))
    first, again = ({tuple(r) for r in samples.smallest(x, 300).collect()} for x in (rows, rows.repartition(3)))
    assert first == again and len(first) == 300
    whole = rows.withColumn("h", F.pmod(F.xxhash64("place", "barcode"), F.lit(1 << 40))).orderBy("h").limit(300).drop("h")
    assert first == {tuple(r) for r in whole.collect()}
    assert samples.smallest(rows, 10_000).count() == 5000 and samples.smallest(rows.limit(0), 5).count() == 0
    white = spark.createDataFrame([(f"b{k}",) for k in range(11)], "barcode STRING")
    freq = {r.barcode: r.freq for r in barcodes.whitelist_frequencies(rows, white, 300, order="place").collect()}
    seen = defaultdict(int)
    for r in rows.where("place < 300").collect():
        seen[r.barcode] += 1
    assert freq == {f"b{k}": seen[f"b{k}"] + 1 for k in range(11)}
    sam = rows.select(F.lit(0).alias("flag"), F.repeat(F.lit("A"), 20).alias("seq"), F.col("place").alias("pos"), (F.col("place") + 100).alias("mate_pos"), F.lit(True).alias("same_chrom"))
    drawn, every = intervals.library_profile(sam, 100).first(), intervals.library_profile(sam, None).first()
    assert drawn[:3] == every[:3] and abs(drawn.frag_std - every.frag_std) < 1e-6


def test_hit_chains_query(spark):
    """Every chain of the query's reads: clusters of shared 9-mers, the longest rising chain of each by trying all predecessors."""
    comp = str.maketrans("ACGT", "TGCA")
    index = defaultdict(list)
    for r in q._reference(spark, SF).collect():
        for i in range(len(r.seq) - 8):
            if set(r.seq[i : i + 9]) <= set("ACGT"):
                index[r.seq[i : i + 9]].append((r.gene_idx, i))
    want = {}
    for r in reads(spark, SF).collect():
        for strand, seq in ((1, r.seq), (-1, r.seq.translate(comp)[::-1])):
            by = defaultdict(list)
            for i in range(len(seq) - 8):
                for g, at in index.get(seq[i : i + 9], ()):
                    by[g].append((i, at))
            for g, hits in by.items():
                if len({a for a, _ in hits}) + 8 < 27:
                    continue
                hits.sort(key=lambda x: x[0] - x[1])
                parts, part = [], hits[:1]
                for x, y in zip(hits, hits[1:]):
                    if (y[0] - y[1]) - (x[0] - x[1]) > 10:
                        parts.append(part)
                        part = []
                    part.append(y)
                for part in [*parts, part]:
                    mean, best = sum(a - b for a, b in part) / len(part), {}
                    if len(part) < 3:
                        continue
                    for a, b in sorted(part, key=lambda x: (x[1], -x[0])):
                        before = [best[h] for h in best if h[0] < a and h[1] < b]
                        n, strain, chain = max(before, key=lambda x: x[:2]) if before else (0, 0.0, [])
                        best[a, b] = (n + 1, strain - abs(a - b - mean), [*chain, (a, b)])
                    n, _, chain = max(best.values(), key=lambda x: x[:2])
                    straight = len({a - b for a, b in chain}) == 1
                    cover = min(len({p + k for p in side for k in range(9)}) for side in zip(*chain))
                    if straight and len(part) * 9 >= 27 and cover >= 27:
                        want[str(r.id), strand, g, chain[0][0], chain[-1][0] + 8] = (n, cover)
    got = {(r.id, r.strand, r.gene, r.read_start, r.read_end): (r.n, min(r.read_cover, r.gene_cover)) for r in q.QUERIES["hit_chains"](spark, SF).collect()}
    assert len(want) >= 5 and {k: got.get(k) for k in want} == want
