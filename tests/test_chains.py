import random

import numpy as np
import pytest

from immunospark.functions.dna import CODONS
from immunospark.operators import cdr3_ladder, chains


def brute_rising(hits):
    """The longest strictly rising chain with the least strain, by trying all predecessors."""
    a, b = zip(*hits)
    mean = sum(x - y for x, y in hits) / len(hits)
    order = sorted(range(len(hits)), key=lambda i: (b[i], -a[i]))
    best = {}
    for i in order:
        options = [best[h] for h in best if a[h] < a[i] and b[h] < b[i]]
        n, strain = max([(o[0], o[1]) for o in options], default=(0, 0.0))
        best[i] = (n + 1, strain - abs(a[i] - b[i] - mean))
    n, strain = max(best.values())
    return n, strain


@pytest.mark.parametrize("seed", range(60))
def test_rising_is_longest_and_straightest(seed):
    rng = random.Random(seed)
    hits = list({(rng.randrange(25), rng.randrange(25)) for _ in range(rng.randrange(1, 60))})
    a, b = (np.array(x) for x in zip(*hits))
    got = chains.rising(a, b)
    x, y = a[got], b[got]
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
    mean = (a - b).mean()
    n, strain = brute_rising(hits)
    assert len(got) == n and abs(-np.abs(x - y - mean).sum() - strain) < 1e-6


def test_clusters_strays_and_holes():
    a, b = np.array([1, 2, 3, 40, 41, 9]), np.array([1, 2, 3, 10, 11, 9])
    assert sorted(len(c) for c in chains.clusters(a, b, 10)) == [2, 4]
    places = lambda *runs: (np.concatenate([np.arange(s, s + n) for s, n, _ in runs]), np.concatenate([np.arange(s - d, s - d + n) for s, n, d in runs]))
    assert chains.without_strays(*places((0, 5, 0), (6, 2, 3), (9, 5, 0))).tolist() == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]
    assert len(chains.without_strays(*places((0, 5, 0), (6, 3, 3), (10, 5, 0)))) == 13
    assert len(chains.without_strays(*places((0, 2, 0), (6, 5, 3)))) == 5 and len(chains.without_strays(*places((0, 5, 0), (6, 2, 3)))) == 5
    assert len(chains.without_strays(*places((0, 30, 0), (31, 5, 3), (40, 30, 0)))) == 60
    assert chains.widest(np.array([1, 2, 300, 301, 302, 600]), 200).tolist() == [2, 3, 4]
    assert chains.cover(np.array([0, 1, 20]), 9) == 19 and chains.cover(np.array([], int), 9) == 0


def planted(rng, gene, kind):
    """A read of the gene with an indel, and where it should lie: read and gene extents."""
    at, n = rng.randrange(0, 60), 120
    read = gene[at : at + n]
    size = rng.choice([1, 2, 3, 6])
    cut = rng.randrange(40, 80)
    if kind == "deletion":
        return read[:cut] + read[cut + size :], (0, n - size - 1), (at, at + n - 1)
    if kind == "insertion":
        return read[:cut] + "".join(rng.choice("ACGT") for _ in range(size)) + read[cut:], (0, n + size - 1), (at, at + n - 1)
    return read, (0, n - 1), (at, at + n - 1)


def test_reads_with_planted_indels(spark):
    rng = random.Random(4)
    genes = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(5)]
    comp = str.maketrans("ACGT", "TGCA")
    rows, want = [], {}
    for k in range(60):
        g, kind = rng.randrange(5), ("deletion", "insertion", "plain")[k % 3]
        read, (rs, re_), (gs, ge) = planted(rng, genes[g], kind)
        turned = k % 2
        rows.append((f"r{k}", read.translate(comp)[::-1] if turned else read))
        want[f"r{k}"] = (-1 if turned else 1, g + 1, rs, re_, gs, ge)
    rows += [("noise", "".join(rng.choice("ACGT") for _ in range(100))), ("short", "ACG"), ("empty", ""), ("none", None), ("n", "N" * 50)]
    reads = spark.createDataFrame(rows, "id STRING, seq STRING")
    ref = spark.createDataFrame(list(enumerate(genes, 1)), "gene_idx INT, seq STRING")
    found = chains.read_chains(reads, ref)
    got = {r.id: r for r in found.collect()}
    assert set(got) == set(want) and found.count() == 60
    for k, (strand, gene, rs, re_, gs, ge) in want.items():
        r = got[k]
        assert (r.strand, r.gene, r.read_start, r.read_end, r.gene_start, r.gene_end) == (strand, gene, rs, re_, gs, ge), k
        # all letters but up to eight on either side of the indel and those inserted are covered
        assert r.read_cover >= re_ - rs + 1 - 22 and r.gene_cover >= ge - gs + 1 - 22
    best = {r.id: (r.strand, r.gene) for r in chains.best_gene(found).collect()}
    assert best == {k: w[:2] for k, w in want.items()}
    assert chains.read_chains(reads.limit(0), ref).count() == 0


class Gene:
    def __init__(self, seq, cdr3_start=None, j_end=None, name="IGHV"):
        self.seq, self.cdr3_start, self.j_end, self.name = seq, cdr3_start, j_end, name


class Lie:
    """A hit without indels."""

    def __init__(self, gene, start, ref_start, size):
        self.gene, self.start, self.end, self.ref_start, self.ref_end = gene, start, start + size - 1, ref_start, ref_start + size - 1

    def at(self, ref):
        return self.start + ref - self.ref_start if self.ref_start <= ref <= self.ref_end else None

    def clean(self, ref, way, columns):
        return True


def coding(rng, n, avoid="YCWFG*"):
    """Codons of none of these amino acids."""
    return "".join(rng.choice([c for c, a in CODONS.items() if a not in avoid]) for _ in range(n))


def ladder(seq, v=None, j=None, segments=None):
    return cdr3_ladder.cdr3(seq, segments or [(0, len(seq))], v, j, None)


def test_rungs_of_the_ladder():
    rng = random.Random(2)
    v_seq, j_tail = coding(rng, 30), "TGGGGCCAAGGGACC" + coding(rng, 6)
    anchored = v_seq + "TATTACTGT" + coding(rng, 2)  # Y Y C near the end of V
    middle = coding(rng, 9)
    seq = anchored + middle + j_tail
    v_gene, j_gene = Gene(anchored, len(v_seq) + 6), Gene(middle[-9:] + j_tail, j_end=9 + 2, name="IGHJ")
    v, j = Lie(v_gene, 0, 0, len(anchored)), Lie(j_gene, len(anchored) + len(middle) - 9, 0, 9 + len(j_tail))
    start, end = len(v_seq) + 6, len(anchored) + len(middle) + 2
    assert ladder(seq, v, j) == (start, end, 100.0)
    # V's alignment ends before the anchor: the motif in the V's frame is taken
    assert ladder(seq, Lie(v_gene, 0, 0, len(v_seq)), j) == (start, end, 100.0)
    # neither gene tells, both motifs do
    bare = Gene(anchored), Gene(middle[-9:] + j_tail, name="IGHJ")
    assert ladder(seq, Lie(bare[0], 0, 0, len(anchored)), Lie(bare[1], j.start, 0, j.end - j.start + 1)) == (start, end, 100.0)
    # Y-x-C without the second Y: five of six marks
    weak = seq.replace("TATTACTGT", "TATGCTTGT")
    got = ladder(weak, Lie(Gene(weak[: len(anchored)]), 0, 0, len(anchored)), j)
    assert got[:2] == (start, end) and abs(got[2] - 500 / 6) < 0.01
    # a gap in the middle makes it partial
    hole = start + 15
    gapped = seq[:hole] + "N" * 7 + seq[hole + 7 :]
    assert ladder(gapped, v, j, [(0, hole), (hole + 7, len(seq))])[2] == 0
    # without J the CDR3 goes on to the segment's end, in frame
    alone = seq[: start + 40]
    assert ladder(alone, v) == (start, start + 38, 0.0)
    assert ladder("", None, None) is None and ladder("ACGT", None, None) is None and ladder(coding(rng, 40)) is None


@pytest.mark.parametrize("seed", range(40))
def test_ladder_takes_anything(seed):
    rng = random.Random(seed)
    seq = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 120)))
    gene = Gene("".join(rng.choice("ACGT") for _ in range(90)), rng.choice([None, 60, 80]), rng.choice([None, 20]))
    def lie():
        size = rng.randrange(1, max(2, min(90, len(seq))))
        return Lie(gene, rng.randrange(0, max(1, len(seq) - size + 1)), rng.randrange(0, 90 - size + 1), size) if len(seq) > 2 and rng.random() < 0.8 else None
    got = ladder(seq, lie(), lie())
    assert got is None or 0 <= got[0] < got[1] < len(seq) and 0 <= got[2] <= 100.01
