"""Reads that meet no other are contigs without a lookup; the contigs are those of the fold that looks up all."""

import random

from immunospark.operators import assemble


def _groups():
    rng = random.Random(11)
    dna = lambda n, a="ACGT": "".join(rng.choices(a, k=n))
    out = []
    for g in range(40):
        truth, reads = dna(rng.choice([120, 400, 3000])), []
        for _ in range(rng.randint(1, 30)):
            at, size = rng.randrange(len(truth) - 60), rng.choice([15, 60, 60, 60, 90])
            read = list(truth[at : at + size])
            for _ in range(rng.choice([0, 0, 1, 4])):
                read[rng.randrange(len(read))] = rng.choice(["A", "C", "", "GT"])
            reads.append("".join(read) + (dna(30) if rng.random() < 0.2 else ""))
        if g % 7 == 0:
            reads += ["ACG" * 20, "ACG" * 25 + "T", dna(80, "AC"), dna(5), "N" * 12 + dna(60) if g % 14 else dna(60)]
        out.append([(s, rng.randint(1, 3), rng.choice([0.9, 0.95])) for s in sorted(set(reads), key=lambda s: (-len(s), s))])
    return [*out, []]


def _plain(rows, overlap):
    made = assemble.Assembly(overlap)
    for seq, times, similarity in rows:
        made.add(seq, similarity, times)
    return made, made.without_contained()


def test_fold_with_meetings_equals_the_plain_fold():
    groups = _groups()
    for overlap in (17, 31):
        joined = 0
        for (made, kept), rows in zip(assemble.fold(groups, overlap), groups):
            plain, want = _plain(rows, overlap)
            assert kept == want
            assert [(made.text[c], made.reads[c], made.weight(c).tolist()) for c in kept] == [(plain.text[c], plain.reads[c], plain.weights[c].tolist()) for c in kept]
            joined += len(rows) - len(want)
        assert joined > 100


def test_strangers_are_not_looked_up(monkeypatch):
    rng = random.Random(3)
    rows = [("".join(rng.choices("ACGT", k=150)), 1, 0.9) for _ in range(400)]
    want = _plain(rows, 17)[0]
    calls = []
    own = assemble.Assembly._hits
    monkeypatch.setattr(assemble.Assembly, "_hits", lambda self, read: calls.append(read) or own(self, read))
    [(made, kept)] = assemble.fold([rows], 17)
    assert [made.text[c] for c in kept] == [want.text[c] for c in range(400)]
    assert len(calls) < 40
