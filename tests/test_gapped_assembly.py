"""Reads with indels join the contig that they belong to."""

import random

import pytest

from immunospark.operators.assemble import OVERLAP, Assembly, assemble


def rand(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(25))
def test_planted_indels_stay_in_one_contig(seed):
    rng = random.Random(seed)
    truth = rand(rng, 220)
    made = Assembly(OVERLAP)
    for at in range(0, 121, 20):
        made.add(truth[at : at + 100], 0.9, 3)
    assert [made.text[c] for c in made.text] == [truth]
    reads = 21
    for _ in range(12):
        at, size, cut = rng.randrange(120), rng.choice([1, 2, 3, 6]), rng.randrange(40, 60)
        read = truth[at : at + 100]
        read = read[:cut] + read[cut + size :] if rng.random() < 0.5 else read[:cut] + rand(rng, size) + read[cut:]
        made.add(read, 0.9)
        reads += 1
    # indels of single reads leave the consensus as it is
    assert list(made.text.values()) == [truth] and list(made.reads.values()) == [reads]


def test_a_read_with_an_indel_extends_the_contig():
    rng = random.Random(1)
    truth = rand(rng, 200)
    for read, want in ((truth[60:95] + truth[97:170], truth[:170]), (truth[60:95] + truth[97:120], truth[:120])):
        made = Assembly(OVERLAP)
        made.add(truth[:120], 0.9, 4)
        made.add(read, 0.9)
        assert list(made.text.values()) == [want]
    made = Assembly(OVERLAP)
    made.add(truth[50:], 0.9, 4)
    made.add(truth[10:85] + truth[87:150], 0.9)
    assert list(made.text.values()) == [truth[10:]]


def test_letters_that_most_reads_have_become_columns():
    rng = random.Random(2)
    left, right, extra = rand(rng, 60), rand(rng, 60), "ACG"
    made = Assembly(OVERLAP)
    made.add(left + right, 0.9, 1)
    made.add(left + extra + right, 0.9, 5)
    assert len(made.text) == 1 and edit_distance(next(iter(made.text.values())), left + extra + right) == 0
    made = Assembly(OVERLAP)
    made.add(left + right, 0.9, 5)
    made.add(left + extra + right, 0.9, 1)
    assert list(made.text.values()) == [left + right]


def test_unlike_reads_stay_apart():
    rng = random.Random(3)
    a, b = rand(rng, 100), rand(rng, 100)
    made = Assembly(OVERLAP)
    for read in (a, b, a[:40] + b[40:], ""):
        made.add(read, 0.9)
    assert len(made.text) == 4


def test_groups_with_indels(spark):
    rng = random.Random(4)
    truth = rand(rng, 150)
    rows = [("x", f"r{k}", truth[k : k + 100], 5, 5, 5.0) for k in range(0, 50, 10)]
    rows += [("x", "del", truth[10:60] + truth[63:110], 1, 1, 1.0), ("x", "ins", truth[20:70] + "GG" + truth[70:118], 1, 1, 1.0), ("y", "del", truth[10:60] + truth[63:110], 1, 1, 1.0)]
    got = assemble(spark.createDataFrame(rows, "g STRING, id STRING, seq STRING, min_cnt LONG, median_cnt LONG, avg_cnt DOUBLE"), ["g"]).collect()
    assert {(r.g, r.consensus, r.n_reads) for r in got} == {("x", truth[:140], 7), ("y", truth[10:60] + truth[63:110], 1)}
