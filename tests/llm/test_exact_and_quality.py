import hashlib
import re

import duckdb
import pytest

from immunospark.llm import exact_dedup as ed
from immunospark.llm import quality_rules as qr

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, digest STRING, n INT"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash", 7) for i, t in rows], DOCS)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_matches_brute_force(spark):
    rows = [(5, "a b"), (3, "ab"), (9, " a\tb\n"), (1, None), (2, ""), (4, " \x0b"), (8, "x" * 200_000), (7, "é b"), (6, "éb"), (10, "a b"), (11, "\u00a0ab")]
    got = {r.doc_id: r for r in ed.dedup(docs(spark, rows), ed.DigestIndex.create(spark)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        same = [(j, u or "") for j, u in rows if norm(u) == norm(t)]
        keep = min(same, key=lambda x: (-len(x[1]), x[0]))[0]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(same), i == keep)
        assert got[i].text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()


def test_exact_repeated_rows_and_null_id(spark):
    got = ed.dedup(docs(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "q")]), ed.DigestIndex.create(spark)).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_index_persists_and_appends(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = ed.DigestIndex.create(spark, path, 3)
    ed.dedup(docs(spark, [(1, "a"), (2, "b")]), index).collect()
    again = ed.DigestIndex(spark, path, 3)  # as a new session would
    got = {r.doc_id: (r.keep_id, r.kept) for r in ed.dedup(docs(spark, [(3, "a "), (4, "c"), (5, "c")]), again).collect()}
    assert got == {3: (1, False), 4: (4, True), 5: (4, False)}
    assert sorted(r.keep_id for r in ed.DigestIndex(spark, path, 3).read().collect()) == [1, 2, 4]
    fresh = ed.keyed(docs(spark, [(9, "zz")])).repartition(3, "digest").join(again.read().hint("merge"), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().sparkPlan().toString() + fresh._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan or plan.count("Exchange hashpartitioning") == 1
    again.drop()


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_in_batches_and_extreme_ids(spark, batches):
    """Batches of falling length lead to the best row of the whole table; ids need no sign."""
    least = -(1 << 63)
    rows = [(i, "ab" + " " * (i % 4) + "c" * (i % 7)) for i in range(60)] + [(least, "q"), (5, "q"), (least, " q"), (least + 1, " q")]
    index = ed.DigestIndex.create(spark)
    got = ed.dedup(docs(spark, rows), index, batches=batches).collect()
    best = {}
    for i, t in rows:
        best[norm(t)] = min(best.get(norm(t), (0, 0)), (-len(t), i)) if norm(t) in best else (-len(t), i)
    digest = {hashlib.sha256(k.encode()).hexdigest(): v[1] for k, v in best.items()}
    assert len(got) == len(rows) and all(r.keep_id == digest[r.text_sha256] and r.kept == (r.doc_id == r.keep_id) for r in got)
    assert index.read().count() == len(best)


def test_query_leaves_no_table_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert ed.op1_exact_dedup(spark, "/root/testdata/sf0.001").count() == 200
    assert {t.name for t in spark.catalog.listTables()} == before


def test_exact_empty(spark):
    assert ed.dedup(docs(spark, []), ed.DigestIndex.create(spark)).count() == 0


def quality_brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in win if win.count(x) > 1}
    cover = {i + k for i, x in enumerate(win) if x in twice for k in range(3)}
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


TEXTS = [None, "", " \n ", "a", "a b", "a b c a b c", "x y z x y z x y z\n\n q\nq\nq \n", "#a *b $% & | < >", "é\u00a0b c", " ".join(f"w{i % 37} u{i}" for i in range(300)),
         "a a a a a a", "\n".join(["one two three"] * 40), " ".join(f"t{i}" for i in range(60))]


def test_quality_statistics_match_brute_force(spark):
    got = qr.judged(docs(spark, list(enumerate(TEXTS)))).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_quality_long_text_null_groups_and_repeats(spark):
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    rows = [(1, long, None, None), (1, long, None, None), (2, None, "en", None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    got = sorted((r.doc_id, r.n_words, r.n_repeat_words) for r in qr.judged(df).collect())
    assert got == [(1, 40_000, 40_000)] * 2 + [(2, 0, 0)] or got == [(1, 40_000, 40_000), (1, 40_000, 40_000), (2, 0, 0)]


def test_quality_fence_is_per_group(spark):
    """A statistic that is usual in one source is an outlier in another."""
    plain = [(i, " ".join(f"word{i}x{k}" for k in range(80)), "en", "prose") for i in range(250)]
    code = [(1000 + i, " ".join(f"<$#%&*>{i}x{k}" for k in range(80)), "en", "code") for i in range(250)]
    odd = [(5000, code[0][1].replace("0x", "7x"), "en", "prose"), (5001, code[1][1].replace("1x", "9x"), "en", "code")]
    df = spark.createDataFrame(plain + code + odd, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    kept = {r.doc_id: r.kept for r in qr.judged(df).collect()}
    assert not kept.pop(5000)
    assert all(kept.values())


def test_quality_empty(spark):
    assert qr.judged(docs(spark, [])).count() == 0


@pytest.mark.parametrize("name,module", [("op1_exact_dedup", ed), ("op9_quality_rules", qr)])
def test_sql_agrees(spark, name, module):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = getattr(module, name)(spark, sf)
    want = con.execute(f"select {', '.join(got.columns)} from ({module.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
