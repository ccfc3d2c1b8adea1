"""Queries without SQL, row by row against plain Python over the same tables."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from immunospark.functions import align
from immunospark.operators import assemble, barcode_report, mates
from immunospark.operators.graph import cut
from immunospark.plans import queries as q
from immunospark.plans.standins import cdr3_rows, reads, table

SF = "/root/testdata/sf0.001"


def test_em_abundance(spark):
    fits = defaultdict(list)
    for r in table(spark, SF, "events").collect():
        fits[r.user_id % 50].append(sorted({r.event_type} if r.event_id % 3 == 0 else {r.event_type, "other"}))
    got = {(r.contig, r.variant): r.n for r in q.QUERIES["em_abundance"](spark, SF).collect()}
    assert {c for c, _ in got} == set(fits)
    for c, sets in fits.items():
        names = sorted({v for s in sets for v in s})
        share = {v: sum(s == [v] for s in sets) for v in names}
        if not sum(share.values()):
            want = {v: float(len(sets)) if v == names[0] else 0.0 for v in names}
        else:
            share = {v: n / sum(share.values()) for v, n in share.items()}
            for _ in range(1000):
                want = dict.fromkeys(names, 0.0)
                for s in sets:
                    if total := sum(share[v] for v in s):
                        for v in s:
                            want[v] += share[v] / total
                new = {v: n / sum(want.values()) for v, n in want.items()}
                moved, share = max(abs(new[v] - share[v]) for v in names), new
                if moved < 1e-6:
                    break
        for v in names:
            assert abs(got[c, v] - want[v]) < 1e-6


def test_center_cluster(spark):
    rows = spark.sql(q._NODES, customer=table(spark, SF, "customer")).collect()
    amounts = defaultdict(float)
    for r in rows:
        amounts[r.v, r.j, r.cdr3] += r.amount
    centers, want = defaultdict(list), {}
    for (v, j, s), _ in sorted(amounts.items(), key=lambda x: (x[0][:2], -round(x[1], 6), x[0][2])):
        near = max(centers[v, j], key=lambda c: sum(a == b for a, b in zip(s, c)), default=None)
        if near is None or sum(a == b for a, b in zip(s, near)) < 8:
            centers[v, j].append(s)
            near = s
        want[v, j, s] = near
    got = {(r.v, r.j, r.cdr3): r.cluster for r in q.QUERIES["center_cluster"](spark, SF).collect()}
    assert got == want


def test_secondary_expand(spark):
    cells = cut(barcode_report.barcode_report(cdr3_rows(spark, SF))).collect()
    want = Counter()
    for c in cells:
        want[f"{c.barcode}_0", c.chain1 and c.chain1.cid, c.chain2 and c.chain2.cid] += 1
        if c.chain2:
            for k, x in enumerate([x for x in c.secondary2 if x["count"] >= 0.1 * c.chain2["count"]], 1):
                want[f"{c.barcode}_{k}", None, x.cid] += 1
    got = Counter((r.barcode, r.cid1, r.cid2) for r in q.QUERIES["secondary_expand"](spark, SF).collect())
    assert got == want and any(not b.endswith("_0") for b, _, _ in got)


def agree(a, b):
    """Chains of one class whose called genes don't contradict each other."""
    kind = lambda x: next((g[:3] for g in (x.v, x.j, x.c) if g), None)
    family = lambda k: "B" if k and k.startswith("IG") else "abT" if k in ("TRA", "TRB") else "gdT" if k else None
    gene = lambda x, y: not x or not y or x.split("*")[0] == y.split("*")[0]
    return family(kind(a)) == family(kind(b)) and all(gene(a[k], b[k]) for k in "vjc")


def test_chain_imputation_takes_donors_that_share_the_other_chain(spark):
    """Every imputed chain comes from a donor with the same present CDR3, fits a partial CDR3 of the cell, and nothing else changes."""
    rows = cut(q._order_cells(spark, SF))
    before = {r.barcode: r for r in cut(barcode_report.barcode_report(rows)).collect()}
    after = {r.barcode: r for r in q.QUERIES["chain_imputation"](spark, SF).collect()}
    assert set(before) == set(after)
    partials = defaultdict(list)
    for r in rows.where("score = 0").collect():
        partials[r.cid.rsplit("_", 1)[0]].append(r.cdr3)
    given = 0
    for b, r in after.items():
        for s in (1, 2):
            was, now = before[b][f"chain{s}"], r[f"cid{s}"]
            if was is not None or now is None:
                assert now == (was and was.cid)
                continue
            given += 1
            other = before[b][f"chain{3 - s}"]
            donors = [d for d in before.values() if d[f"chain{s}"] and d[f"chain{3 - s}"] and d[f"chain{3 - s}"].cdr3nt == other.cdr3nt and f"impute_from_{d[f'chain{s}'].cid}" == now]
            assert donors and before[b].cell_type != "B"
            assert any(d[f"chain{s}"].cdr3nt.startswith(p) or d[f"chain{s}"].cdr3nt.endswith(p) for d in donors for p in partials[b])
    assert given >= 0


def plain_overlap(a, b, least):
    """The only offset at which the start of b is like the end of a."""
    out = []
    for at in range(max(0, len(a) - least)):
        room = len(a) - at
        size = min(room, len(b))
        same = sum(x == y for x, y in zip(a[at : at + size], b[:size]))
        wanted = 0.85 if room >= 100 else 0.85 + (room - 50) / 50 * 0.1 if room >= 50 else 0.95
        if same + room - size >= int(room * wanted):
            out.append((at, size, same))
    return out[0] if len(out) == 1 else None


def test_mate_merge(spark):
    """Pairs that overlap at one place alone, without a repeat in it, are merged to the text that they were cut from."""
    texts = {(r.doc_id, r.part): (r.id, r.seq) for r in reads(spark, SF).collect()}
    got = defaultdict(list)
    for r in q.QUERIES["mate_merge"](spark, SF).collect():
        got[r.id.removesuffix(".1") if r.merged else r.id].append((r.seq, r.merged))
    merged = checked = 0
    for (doc, part), (rid, seq) in texts.items():
        if (doc, part + 1) not in texts or len(seq + texts[doc, part + 1][1]) < 200:
            continue
        both = seq + texts[doc, part + 1][1]
        if rid not in got:
            continue  # of low complexity
        checked += 1
        whole = plain_overlap(seq, both[100:200], min(250 // 20, 31))
        if any(m for _, m in got[rid]):
            merged += 1
            assert whole == (100, 50, 50) and {s for s, _ in got[rid]} == {both[:200]}
    assert checked > 100 and merged > 0.9 * checked


def test_assembly_accounts_for_reads(spark):
    """Every read lies in a contig of its cell with the share of equal letters wanted, and contigs count reads once."""
    made = defaultdict(list)
    for r in q.QUERIES["assembly"](spark, SF).collect():
        made[r.cell].append(r)
    number = Counter()
    for r in reads(spark, SF).collect():
        number[str(r.doc_id)] += 1
    assert set(made) == set(number)
    for cell, contigs in made.items():
        assert sum(c.n_reads for c in contigs) <= number[cell] and len({c.contig for c in contigs}) == len(contigs)
    few = {c for c, n in number.items() if n <= 12}
    for r in reads(spark, SF).collect():
        if str(r.doc_id) in few and len(r.seq) >= 40:
            a = align.letters(r.seq)
            best = 0.0
            for c in made[str(r.doc_id)]:
                t = align.letters(c.consensus)
                for at in range(-len(a) + 17, len(t) - 16):
                    lo, hi = max(0, at), min(len(t), at + len(a))
                    best = max(best, (t[lo:hi] == a[lo - at : hi - at]).mean() if hi - lo >= min(17, len(a)) else 0)
            assert best >= 0.85


def test_annotation_places_are_alignments(spark):
    """A hit's place says that the read there is the gene there: the seeds of its k-mers lie at the places it tells."""
    from immunospark.operators import annotate

    ref = q._reference(spark, SF)
    genes = {f"IGH{'V' if r.gene_idx % 2 == 0 else 'J'}{r.gene_idx}": r.seq for r in ref.collect()}
    texts = {r.id: r.seq for r in reads(spark, SF).collect()}
    model = annotate.Reference([annotate.Gene(n, s, n[3], "IGH") for n, s in genes.items()])
    got = q.QUERIES["annotation"](spark, SF).collect()
    assert len(got) == len(texts)
    names, placed = set(genes), 0
    for r in got:
        found = {k: model.hits(texts[r.cid]).get(k.upper(), []) for k in "vj"} if r.v_gene or r.j_gene else {}
        for k, hits in found.items():
            if (name := r[f"{k}_gene"]) is None:
                continue
            hit = next(h for h in hits if h.gene.name == name)
            assert name in names and hit.start == r[f"{k}_start"]
            # letter by letter along the hit's own alignment
            seq, gene, i, j, same = texts[r.cid], genes[name], hit.start, hit.ref_start, 0
            for step in "".join(p.steps(seq) for p in hit.parts) if hit.parts else hit.steps(seq):
                if step == "=":
                    assert seq[i] == gene[j]
                    same += 1
                i, j = i + (step in "=XI"), j + (step in "=XD")
            if not hit.parts:
                assert (i - 1, j - 1, same) == (hit.end, hit.ref_end, hit.matches)
            placed += 1
            # no other gene of the type has a longer exact stretch of letters in common with the read by half
            best = hits[0].matches
            assert hit.matches >= best * annotate.SECONDARY
    assert placed
    hit = {r.cid for r in got if r.v_gene or r.j_gene}
    # a read that shares 30 letters with a gene is never missed
    words = {g[i : i + 30] for g in genes.values() for i in range(len(g) - 29)}
    assert all(i in hit for i, s in texts.items() if any(s[k : k + 30] in words for k in range(len(s) - 29)))


def test_mates_keep_apart(spark):
    df = spark.createDataFrame([("r", "ACGTTGCAAGCTTGACCATG" * 3, None, "TTGACCGATAGCATCCAGTA" * 3, None)], "id STRING, seq STRING, qual STRING, seq_2 STRING, qual_2 STRING")
    assert sorted((r.id, r.mate) for r in mates.resolve_pairs(df).collect()) == [("r", 1), ("r", 2)]
    assert assemble.threshold(1, False) == 0.9
    assert df.select(F.length("seq")).first()[0] == 60
