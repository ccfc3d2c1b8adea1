"""Contigs joined by mates, on made-up contigs."""

import random
from itertools import pairwise

from pyspark.sql import functions as F

from immunospark.operators import assemble, scaffold


def _text(seed: int, n: int) -> str:
    return "".join(random.Random(seed).choices("ACGT", k=n))


def _contigs(spark, texts: dict[str, str]):
    rows = [(c, s, 2, [dict(zip("acgt", (int(b == x) for x in "ACGT"))) for b in s], "x") for c, s in texts.items()]
    return spark.createDataFrame(rows, "cid string, consensus string, n_reads bigint, pos_weight array<struct<a:int,c:int,g:int,t:int>>, locus string")


def test_ends_that_agree_and_gaps(spark):
    whole = _text(1, 120)
    texts = {"a": whole[:70], "b": whole[58:], "c": _text(2, 50), "d": _text(3, 40)}
    links = spark.createDataFrame([("a", "b", 3), ("b", "c", 2), ("c", "gone", 9)], "src string, dst string, n bigint")
    got = {r.cid: r for r in scaffold.scaffolds(_contigs(spark, texts), links).collect()}
    assert set(got) == {"a", "d"} and got["d"].consensus == texts["d"]
    one = got["a"]
    assert one.consensus == whole + "N" * scaffold.GAP + texts["c"] and one.n_reads == 6 and one.locus == "x"
    sums = [sum(w) for w in one.pos_weight]
    assert sums == [1] * 58 + [2] * 12 + [1] * 50 + [0] * scaffold.GAP + [1] * 50


def test_rings_are_opened_at_the_lightest_link():
    steps = {"a": ("b", 5), "b": ("c", 2), "c": ("a", 4)}
    assert scaffold.ordered(["a", "b", "c"], steps) == ["c", "a", "b"]
    assert scaffold.ordered(["a", "b"], {"b": ("a", 1)}) == ["b", "a"]


def test_overlap_is_the_longest_and_no_containment():
    assert scaffold.overlap("CC" + "A" * 12, "A" * 11 + "G") == 11
    assert scaffold.overlap("A" * 12, "A" * 12, 12) == 0
    assert scaffold.overlap("ACGT" * 5, "TTTT" * 5) == 0 and scaffold.overlap("", "") == 0


def _lying(spark, rows):
    return spark.createDataFrame(rows, "fragment string, strand int, cid string, offset int, length int, rank int")


def test_edges_follow_strands_and_gene_order(spark):
    rows = [("f1", 1, "a", 0, 50, 1), ("f1", -1, "b", 5, 50, 3), ("f2", 1, "a", 20, 50, None), ("f2", -1, "b", 0, 40, 1), ("f3", 1, "a", 0, 50, 4), ("f3", -1, "b", 0, 50, 1),
            ("f4", 1, "a", 0, 9, 1), ("f4", 1, "b", 0, 9, 1), ("f5", 1, "a", 0, 9, 1), ("f5", -1, "a", 0, 9, 1)]
    assert [tuple(r) for r in scaffold.edges(_lying(spark, rows)).collect()] == [("a", "b", 2, 70, 55)]
    assert scaffold.edges(_lying(spark, [])).count() == 0


def test_edges_equal_brute_force(spark):
    rng = random.Random(41)
    rows = [(f"f{rng.randrange(40)}", rng.choice((1, -1)), rng.choice("abcd"), rng.randrange(90), rng.randrange(20, 60), rng.choice((None, 1, 2, 3, 4))) for _ in range(400)]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] == 1 and b[1] == -1 and a[2] != b[2] and (a[5] is None or b[5] is None or a[5] <= b[5]):
                want.setdefault((a[2], b[2]), []).append((a, b))
    span = lambda reads: max(r[3] + r[4] for r in reads) - min(r[3] for r in reads)
    want = {(*e, len({a[0] for a, _ in ps}), span([a for a, _ in ps]), span([b for _, b in ps])) for e, ps in want.items()}
    assert {tuple(r) for r in scaffold.edges(_lying(spark, rows)).collect()} == want and len(want) == 12


def test_no_task_holds_the_edges_of_its_fragments(spark, capsys):
    scaffold.edges(_lying(spark, [("f1", 1, "a", 0, 50, 1)])).explain()
    plan = capsys.readouterr().out
    groups = [line.split("keys=[")[1].split("]")[0] for line in plan.splitlines() if "Aggregate(keys=" in line]
    assert groups and not any("fragment" in g for g in groups)


def test_contigs_of_one_gene_type_are_not_joined(spark):
    whole = _text(23, 60)
    contigs = _contigs(spark, {"v1": _text(29, 40), "v2": _text(31, 40), "c": _text(37, 40), "l": whole[:40], "r": whole[20:], "s": "ACG"})
    lying = _lying(spark, [(f"f{i}", s, c, 0, 40, r) for i, (c, r) in enumerate([("v1", 1), ("v2", 1), ("c", 4), ("l", 1), ("l", 3), ("r", 1)]) for s in (1, -1)])
    edges = spark.createDataFrame([(a, b, 1, 40, 40) for a, b in [("v1", "v2"), ("v1", "c"), ("c", "v1"), ("l", "r"), ("r", "l"), ("s", "c"), ("v2", "s")]], "src string, dst string, n bigint, src_span int, dst_span int")
    assert {(r.src, r.dst) for r in scaffold.fitting(edges, lying, contigs).collect()} == {("v1", "c"), ("l", "r")}


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"c{a}", f"c{b}", rng.randrange(1, 12), rng.randrange(50, 60), rng.randrange(50, 60)) for a in range(12) for b in range(12) if a != b and rng.random() < 0.4]
    edges = spark.createDataFrame(rows, "src string, dst string, n bigint, src_span int, dst_span int")
    want = set()
    for e in rows:
        fits = True
        for at, other, span in ((0, 1, 3), (1, 0, 4)):
            mine = [x for x in rows if x[at] == e[at]]
            near = [x for x in mine if x[2] >= 0.9 * max(y[2] for y in mine)]
            fits &= e == min(near, key=lambda x: (-x[span], -x[2], x[other]))
        if fits:
            want.add(e[:3])
    got = [tuple(r) for r in scaffold.links(edges).collect()]
    assert set(got) == want and len(got) == len(want) > 2
    assert len({g[0] for g in got}) == len({g[1] for g in got}) == len(got)


def test_a_chain_of_many_contigs(spark):
    whole = _text(7, 400)
    texts = {f"c{k}": whole[k * 35 : k * 35 + 55] for k in range(10)}
    links = spark.createDataFrame([(a, b, 1) for a, b in pairwise(texts)], "src string, dst string, n bigint")
    (row,) = scaffold.scaffolds(_contigs(spark, texts).repartition(3), links).collect()
    assert row.cid == "c0" and row.consensus == whole[: 9 * 35 + 55] and row.n_reads == 20


def test_index_follows_the_contigs():
    rng = random.Random(11)
    base = _text(13, 300)
    made = assemble.Assembly()
    for _ in range(150):
        at = rng.randrange(0, 240)
        read = list(base[at : at + 60])
        if rng.random() < 0.3:
            read[rng.randrange(60)] = rng.choice("ACGTN")
        made.add("".join(read), 0.9)
    want: dict[str, set[int]] = {}
    for c, text in made.text.items():
        for k in range(len(text) - made.k + 1):
            want.setdefault(text[k : k + made.k], set()).add(c)
    assert made.index == want
    for c, text in made.text.items():
        assert text == "".join("ACGT"[w.argmax()] if w.any() else "N" for w in made.weights[c])


def test_contained_contigs_by_seeds():
    base = _text(17, 200)
    made = assemble.Assembly()
    off = lambda s, k: s[:k] + ("A" if s[k] != "A" else "C") + s[k + 1 :]
    texts = [base, base[20:90], off(base[30:100], 5), off(base[30:100], 60), off(off(base[30:100], 5), 60), base[50:65], off(base[50:65], 7), _text(19, 80)]
    for c, t in enumerate(texts):
        codes = assemble._CODE[assemble.align.letters(t)]
        made._put(c, made._added(assemble.np.zeros((len(t), 4), dtype=assemble.np.int64), codes, 0, 1), 1)
    assert made.without_contained() == [0, 4, 7]


def test_columns_of_links_are_unique(spark):
    assert scaffold.links(spark.createDataFrame([("a", "b", 1, 2, 3)], "src string, dst string, n bigint, src_span int, dst_span int")).select(F.count("*")).first()[0] == 1
