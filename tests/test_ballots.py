"""Contigs of a batch are hit all at once, with the results of one after another."""

import random

from immunospark.operators import annotate


def test_hits_of_a_batch_equal_those_one_by_one():
    rng = random.Random(8)
    dna = lambda n, a="ACGT": "".join(rng.choices(a, k=n))
    genes = [annotate.Gene(f"IGH{k}{i}", dna(rng.randint(5, 160), "ACGT" if i % 5 else "ACGTN"), k, "IGH") for i, k in enumerate("VJCVJCDVJCVJCVJC")]
    genes.append(annotate.Gene("IGHV99", "ACGTACGTTG" * 12, "V", "IGH"))
    ref = annotate.Reference(genes)
    seqs = ["ACG", "ACGTACGTTG" * 9]
    for i in range(150):
        s = dna(rng.randint(0, 30)) + rng.choice(genes).seq + dna(rng.randint(0, 5)) + rng.choice(genes).seq[rng.randint(0, 20) :]
        s = "".join(x if rng.random() > 0.03 else rng.choice(["", "A", "CG"]) for x in s)
        seqs.append(s if i % 6 else s[:50] + "N" * rng.randint(1, 9) + s[50:])
    got = [annotate.annotate_one(ref, "x", s, v) for s, v in zip(seqs, ref.ballots(seqs))]
    assert got == [annotate.annotate_one(ref, "x", s) for s in seqs]
    assert sum(bool(r["v"]) for r in got) > 40
    # by chance alone, reads get no votes and so no look at genes one by one
    chance = [dna(150) for _ in range(500)]
    assert sum(map(len, ref.ballots(chance))) < 25
    assert ref.ballots([]) == []
