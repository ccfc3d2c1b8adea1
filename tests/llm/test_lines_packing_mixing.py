import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from immunospark.llm import line_dedup as ld
from immunospark.llm import mixing as mx
from immunospark.llm import packing as pk

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_lines STRING, item INT"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s1", "clash", 3) for i, t in rows], DOCS)


# ---- line dedup ------------------------------------------------------------------------------------


def templates(line):
    """The keys of all templates of a line, worked out from its text alone."""
    tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
    if len(tokens) < ld.MIN_TOKENS and len("".join(tokens)) < ld.MIN_CHARS:
        return []
    tokens = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
    leaf, rest = (len(tokens), *tokens[: ld.DEPTH]), len(tokens) - ld.DEPTH
    keys = [(leaf, tuple(tokens))]
    if rest >= ld.PER_FIELD:
        k = min(rest, ld.SEGMENTS)
        segs = [tuple(tokens[ld.DEPTH + j * rest // k : ld.DEPTH + (j + 1) * rest // k]) for j in range(k)]
        for need, m in ld.masks():
            if k >= need:
                keys.append((leaf, m, tuple(None if j in m else s for j, s in enumerate(segs))))
    return keys


def brute_lines(rows):
    """A line goes if an earlier document has an equal line, or a root of one of its templates: a line without an earlier one of its templates."""
    first, least = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            keys = templates(line)
            for key in keys:
                least[key] = min(least.get(key, i), i)
            if keys:
                first[keys[0]] = min(first.get(keys[0], (i, keys)), (i, keys))
    roots = {}
    for i, keys in first.values():
        if all(least[k] >= i for k in keys):
            for k in keys:
                roots[k] = min(roots.get(k, i), i)
    stays = {line: min([i, *(roots[k] for k in keys if k in roots)]) for line, (i, keys) in first.items()}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if not (keys := templates(x)) or stays[keys[0]] >= i) for i, t in rows}


def line_corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(4) or "")
    common = ["All rights reserved by the owner", "Posted by NAME in SPORT on date", "x y z", "a b"]
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 8, 12]))) for _ in range(rng.randrange(6))]
        lines += [rng.choice(common), f"Page {i} of {rng.randrange(99)} in this book", f"Hello dear reader welcome to the place of {rng.choice('abcdefgh')} and all its wonders for you today"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n \n"), (103, rows[3][1]), (104, rows[3][1].replace("\n", "\r\n")), (105, "z " * 50_000 + "end")]
    return rows


def test_lines_match_brute_force(spark):
    rows = line_corpus()
    got = {r.doc_id: r for r in ld.line_dedup(docs(spark, rows).repartition(4)).collect()}
    want = brute_lines(rows)
    assert {i: got[i].text for i in want} == want
    assert sum(r.n_dropped for r in got.values()) > 60
    for i, t in rows:
        assert got[i].n_lines == (0 if t is None else t.count("\n") + 1)


def test_first_document_keeps_its_lines_and_long_passages_go(spark):
    passage = " ".join(f"word{chr(97 + k % 26)}{k}" for k in range(60))
    rows = [(1, f"own line of one\n{passage}"), (2, f"{passage}\nown line of two"), (3, f"nothing shared in here at all\n{passage}")]
    got = {r.doc_id: r.text for r in ld.line_dedup(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "own line of two", 3: "nothing shared in here at all"}


def test_segments_are_told_by_all_their_bits(spark):
    """Two of four segments differ, so no template is shared, however few bits of the words' hashes do."""
    rows = [(1, "The report says north wordjiaa rose today"), (2, "The report says south wordqsaa rose today")]
    assert {r.doc_id: r.text for r in ld.line_dedup(docs(spark, rows)).collect()} == dict(rows)


def test_end_of_a_chain_stays(spark):
    """Document 2 goes for document 1; document 3 is like 2 alone, which is gone, and stays; 4 goes for 3, an equal line."""
    rows = [(1, "a b c p q r t"), (2, "a b c P q r t"), (3, "a b c P Q r t"), (4, "a b c P Q r t")]
    assert {r.doc_id: r.text for r in ld.line_dedup(docs(spark, rows)).collect()} == {1: rows[0][1], 2: "", 3: rows[2][1], 4: ""}


def test_one_leaf_of_many_lines(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(f"The report says w{chr(97 + rng.randrange(26))}{'x' * rng.randrange(12)} v{'y' * rng.randrange(9)}{chr(97 + rng.randrange(26))} rose {'z' * rng.randrange(1, 9)}" for _ in range(50))) for i in range(2000)]
    got = {r.doc_id: r.text for r in ld.line_dedup(docs(spark, rows).repartition(4)).collect()}
    want = brute_lines(rows)
    left = sum(t.count("\n") + 1 for t in want.values())
    assert got == want and 10_000 < left < 90_000


def test_lines_any_column_names_and_long_words(spark):
    passage = "长" * 40
    df = spark.createDataFrame([(1, passage, 1, 2, 3, 4), (2, f"{passage}\nshort", 5, 6, 7, 8)], "doc_id BIGINT, text STRING, _doc INT, _text INT, _dropped INT, _LINES INT")
    out = ld.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, passage, 1, 2, 3, 4, 1, 0), (2, "short", 5, 6, 7, 8, 2, 1)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lines_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    got = ld.op2_line_dedup(spark, f"/root/testdata/{sf}")
    want = con.execute(f"select {', '.join(got.columns)} from ({ld.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lines_null_id_repeats_and_empty(spark):
    rows = [(None, "one two three"), (2, "one two three"), (2, "one two three"), (3, "one two three\nkeep me here")]
    got = sorted((str(r.doc_id), r.text) for r in ld.line_dedup(docs(spark, rows)).collect())
    assert got == [("2", ""), ("2", ""), ("3", "keep me here"), ("None", "one two three")]
    empty = ld.line_dedup(docs(spark, []))
    assert empty.count() == 0 and set(empty.columns) == {"doc_id", "text", "lang", "source", "n_lines", "item", "n_dropped"}


# ---- packing ---------------------------------------------------------------------------------------

TEXTS = ["", None, "a", "Don't we'll  x y", "naïve Café ÉTÉ 123 4", "日本語 text mixed", "<|endoftext|> is special", "tab\tand\x0bvt\x1cfs", "İstanbul ΣΑΣ", "(a)-b_c!!?? x's", "é combining"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pk.tokenizer_path(None))


def pack_corpus():
    rng = random.Random(2)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(["the", "quick", "Straße", "12", "fox,"]) for _ in range(rng.randrange(1, 900)))) for i in range(150)]
    return rows + [(900, "word " * 9000), (901, "x " * 4095), (902, "x " * 4096), (901, "x " * 4095)]


@pytest.mark.parametrize("items", [20, 8000])
def test_packing_matches_brute_force(spark, tokenizer, monkeypatch, items):
    monkeypatch.setattr(pk, "ITEMS", items)
    rows = pack_corpus()
    got = pk.pack(docs(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    bound = pk.lower_bound(np.array([r.length for r in got]), 4096)
    assert len(bins) <= bound + (1 if items > 1000 else 3)


def test_bounds_never_exceed_what_packs():
    rng = np.random.default_rng(4)
    for _ in range(60):
        c = int(rng.integers(5, 60))
        sizes = rng.integers(1, c + 1, int(rng.integers(1, 40))).tolist()
        bins, offsets, room = pk.best_fit(sizes, c)
        assert pk.lower_bound(np.array(sizes), c) <= len(room)
        for b in range(len(room)):
            got = sorted((o, s) for o, s, x in zip(offsets, sizes, bins) if x == b)
            assert sum(s for _, s in got) == c - room[b] and all(got[k][0] == sum(s for _, s in got[:k]) for k in range(len(got)))
    # items over half need a bin each, which the sum alone doesn't tell
    assert pk.lower_bound(np.array([6] * 10), 10) == 10
    # two of three fit a bin: dual feasible functions see it
    assert pk.lower_bound(np.array([34] * 6), 100) == 3


def test_packing_empty(spark):
    assert pk.pack(docs(spark, [])).count() == 0


# ---- mixing ----------------------------------------------------------------------------------------



def levels():
    return [("domain", mx.domain_of(F.col("source"))), ("lang", F.col("lang")), ("source", F.col("source"))]


def mix_rows():
    rng = random.Random(9)
    rows = []
    for i in range(700):
        source = "src0" if rng.random() < 0.4 else f"src{rng.randrange(7)}"
        rows.append((i, " ".join("w" * (i % 3 + 1) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "de", "fr", None]), source))
    return rows + [(1000, None, "en", "src1"), (1001, "a b", "en", None), (1002, "c " * 3000, "en", "src2"), (5, rows[5][1], rows[5][2], rows[5][3]), (None, "null id", "en", "src3")]


def brute_budgets(node, leaves, amount, weights, epochs):
    """Water-filling, one unit of shortage at a time: reference by bisection on the level."""
    kids = sorted({x[: len(node) + 1] for x in leaves if x[: len(node)] == node and len(x) > len(node)})
    room = lambda n: sum(t for x, t in leaves.items() if x[: len(n)] == n) * epochs
    if not kids:
        return {node: min(amount, room(node))}
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(room(k), mid * weights.get(k, 1.0)) for k in kids) < amount:
            lo = mid
        else:
            hi = mid
    out = {}
    for k in kids:
        out |= brute_budgets(k, leaves, min(room(k), hi * weights.get(k, 1.0)), weights, epochs)
    return out


def taken_budgets(spark, leaves, share, weights, epochs):
    names = ["a", "b", "c"]
    rows = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "a STRING, b STRING, c STRING, t BIGINT")
    return {(r.a, r.b, r.c): r.mix_budget for r in mx.budgets(rows, names, share, weights, epochs).collect()}


def test_budgets_match_bisection(spark):
    rng = random.Random(1)
    for _ in range(8):
        leaves = {(f"d{rng.randrange(3)}", f"l{rng.randrange(3)}", f"s{k}"): rng.randrange(0, 500) for k in range(rng.randrange(1, 14))}
        weights = {k[:n]: rng.choice([1, 2, 5]) for k in leaves for n in (1, 2, 3)}
        epochs, share = rng.choice([1, 2]), rng.random() * 1.2
        got = taken_budgets(spark, leaves, share, weights, epochs)
        want = brute_budgets((), leaves, min(share, epochs) * sum(leaves.values()), weights, epochs)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - int(want[k] + 1e-4)) <= (1e-3 < want[k] % 1 < 1 - 1e-3 and 0 or 1) for k in got)


def test_budgets_of_many_leaves_and_weight_zero(spark):
    """More leaves than a driver would hold by name; a node of weight 0 gets nothing, and its share goes to its siblings."""
    leaves = spark.range(300_000).selectExpr("'d' AS a", "concat('l', id % 2) AS b", "concat('s', id) AS c", "1 + id % 3 AS t")
    got = mx.budgets(leaves, ["a", "b", "c"], 0.25, {("d", "l0"): 0}, 1)
    sums = {r.b: (r.x, r.n) for r in got.groupBy("b").agg(F.sum("mix_budget").alias("x"), F.count(F.lit(1)).alias("n")).collect()}
    assert sums["l0"] == (0, 150_000) and sums["l1"][0] == 150_000


@pytest.mark.parametrize("share,epochs", [(0.6, 2), (0.9, 1), (1.7, 3), (0.0, 1)])
def test_mix_matches_brute_force(spark, share, epochs):
    import hashlib

    rows = mix_rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, mix_epoch STRING")
    got = Counter((r.doc_id, r.mix_epoch) for r in mx.mix(df, levels(), share=share, epochs=epochs).collect())
    leaf = lambda r: ((f"domain{int(r[3][3:]) % 3}" if r[3] else ""), r[2] or "", r[3] or "")
    tokens = lambda r: len((r[1] or "").split())
    totals = Counter()
    for r in rows:
        totals[leaf(r)] += tokens(r)
    want = Counter()
    for x, amount in brute_budgets((), dict(totals), min(share, epochs) * sum(totals.values()), mx.WEIGHTS, epochs).items():
        amount += 1e-4  # bisection ends a little off whole numbers
        mine = [r for r in rows if leaf(r) == x]
        whole = min(int(amount // totals[x]), epochs) if totals[x] else 1
        rest = int(amount) - whole * totals[x] if totals[x] else 0
        for e in range(whole):
            want.update((r[0], e) for r in mine)
        if rest > 0:
            key = lambda r: (hashlib.md5(f"17:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0])
            ties, total, out = sorted({key(r) for r in mine}), 0, []
            for k in ties:
                same = [r for r in mine if key(r) == k]
                total += sum(map(tokens, same))
                if total > rest:
                    break
                out += same
            want.update((r[0], whole) for r in out)
    assert got == want


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    assert mx.mix(df, levels()).count() == 0


def test_mix_any_column_names(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "src1", 1, 2, 3, 4)], "doc_id BIGINT, text STRING, lang STRING, source STRING, _whole INT, _rest INT, _cut INT, mix_leaf INT")
    out = mx.mix(df, levels(), share=1.0, epochs=1)
    assert out.select(*df.columns).collect() == df.collect()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    got = mx.op10_mixing(spark, f"/root/testdata/{sf}")
    want = con.execute(f"select {', '.join(got.columns)} from ({mx.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
