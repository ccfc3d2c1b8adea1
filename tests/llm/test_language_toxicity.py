import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from immunospark.llm import language_id as li
from immunospark.llm import toxicity as tx
from immunospark.llm.shared import fold, table

SF = "/root/testdata/sf0.01"


def test_fold_is_crc32_of_the_decimal_text(spark):
    got = {r.id: (r.a, r.b) for r in spark.range(300).select("id", fold(F.col("id"), 5).alias("a"), fold(F.col("id"), 3).alias("b")).collect()}
    assert got == {i: (zlib.crc32(str(i).encode()) % 5, zlib.crc32(str(i).encode()) % 3) for i in range(300)}


def test_language_held_out_accuracy(spark):
    rows = li.op8_language_id(spark, SF).where("held_out").join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) / len(rows) < 0.03


def test_language_matches_plain_compression(spark):
    """The query's choice is the smallest compressed size, worked out here without Spark."""
    import zstandard

    docs = table(spark, SF, "documents")
    model = li.learned(docs.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    coders = {}
    for k, v in model.items():
        d = zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=li.LEVEL)
        coders[k] = zstandard.ZstdCompressor(level=li.LEVEL, dict_data=d, write_checksum=False, write_content_size=False)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.lang_pred for r in li.predicted(docs, model).collect()}
    for i, t in texts.items():
        data = li.letters(t)
        sizes = {k: sum(len(c.compress(data[a : a + li.BLOCK])) for a in range(0, len(data), li.BLOCK)) for k, c in coders.items()}
        assert got[i] == "und" and not data.strip() or sizes[got[i]] == min(sizes.values())


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !? 456", "de"), (4, "x" * 300_000, None), (4, "x" * 300_000, None), (None, "the cat", "en")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id BIGINT, text STRING, lang STRING, score STRING")
    got = li.predicted(df, {"en": b"the cat sat on the mat and " * 20, "de": b"der hund lief auf die matte und " * 20}).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (1, 2, 3))
    assert by[4].lang_pred in ("en", "de")
    none = li.predicted(df, {}).collect()
    assert all(r.lang_pred == "und" for r in none)
    assert li.predicted(df.limit(0), {}).count() == 0
    assert li.learned(df.limit(0)) == {} and li.learned(df.where("lang IS NULL")) == {}
    kept = li.kept(df, {"en": b"the cat sat on the mat and " * 20})
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {4, None}


def test_language_sample_depends_on_texts_alone(spark):
    """Rows that share an id, or have none, are learned from like any others; a text that repeats counts once."""
    en, de = "the cat sat on the mat and the dog ran off with number", "der hund lief auf die matte und die katze mit nummer"
    rows = [(7, f"{en} {'abcdefgh'[k % 8]}{'xyz'[k % 3]}", "en") for k in range(3000)] + [(None, f"{de} {'abcdefgh'[k % 8]}", "de") for k in range(900)]
    rows += [(1, "ça", "fr"), (2, "123", "xx")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").repartition(5)
    model = li.learned(df)
    assert set(model) == {"en", "de", "fr"} and model["en"].count(b"sat on") == 24
    got = {r.doc_id: r.lang_pred for r in li.predicted(spark.createDataFrame([(1, en, ""), (2, de, "")], df.schema), model).collect()}
    assert got == {1: "en", 2: "de"}


def test_held_out_of_null_id(spark):
    got = spark.createDataFrame([(None,), (1,)], "doc_id BIGINT").select((fold(F.col("doc_id"), 5) == 0).alias("a"), (fold(F.col("doc_id"), 3) == 1).alias("b")).first()
    assert (got.a, got.b) == (True, False)


def brute_marginals(crf, ids):
    """P(state 1) at every word by summing over all state sequences with plain forward-backward."""
    crf.ready()
    e, m = crf.p[ids], crf.step
    f = [e[0]]
    for x in e[1:]:
        f.append(f[-1] @ m * x)
        f[-1] = f[-1] / f[-1].sum()
    b = [np.ones(2)]
    for x in e[:0:-1]:
        b.append(m @ (x * b[-1]))
        b[-1] = b[-1] / b[-1].sum()
    b = b[::-1]
    return [float(x[1] * y[1] / (x * y).sum()) for x, y in zip(f, b)]


def test_marginals_match_plain_recursion():
    rng = np.random.default_rng(0)
    crf = tx.Crf(["bad", "worse", "mild"])
    crf.emit[:] = rng.normal(0, 1.5, crf.emit.shape)
    crf.move[:] = rng.normal(0, 1, (2, 2))
    for _ in range(40):
        n = int(rng.integers(1, 60))
        ids = np.where(rng.random(n) < 0.3, rng.integers(1, 4, n), 0)
        at = [int(i) for i in np.flatnonzero(ids)]
        want = brute_marginals(crf, ids)
        crf.powers = None
        got = crf.marginals(at, [int(ids[i]) for i in at], n)
        assert np.allclose(got, [want[i] for i in at], atol=1e-9)


def test_crf_gradient_is_that_of_the_likelihood():
    """Training raises the likelihood of the tags: labelled words end up tagged, others not."""
    rng = np.random.default_rng(1)
    seqs = np.where(rng.random((300, 12)) < 0.2, 1, 0)
    crf = tx.Crf(["bad"])
    crf.fit(seqs, seqs.copy())
    got = crf.marginals([3], [1], 12)
    assert got[0] > 0.9


def plain_score(crf, text):
    """Score and spans from the recursion over every word of a text, and the layer's formula."""
    found = list(re.finditer(r"\w+", text or ""))
    ids = np.array([crf.known.get(w := m.group().lower()) or crf.known.get(w[: tx.STEM] + "*") or 0 for m in found], dtype=int)
    x, spans = [1.0, 0.0, 0.0, 0.0], []
    if ids.any():
        p = [v if i else 0.0 for i, v in zip(ids, brute_marginals(crf, ids))]
        x = [1.0, max(p), math.log1p(sum(p)), sum(p) / math.sqrt(len(ids))]
        for i, m in enumerate(found):
            if p[i] >= tx.SPAN:
                if spans and i and p[i - 1] >= tx.SPAN:
                    spans[-1] = (spans[-1][0], m.end())
                else:
                    spans.append((m.start(), m.end()))
    return 1 / (1 + math.exp(-float(np.dot(x, crf.layer)))), spans


def test_query_matches_plain_scorer(spark):
    """Every row of the query: the model learned here from the allowed rows, scores and spans worked out without Spark."""
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = {}
    for r in table(spark, SF, "labels").where("toxic IS NOT NULL").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    learn = sorted((y, i) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 and i in docs and docs[i] is not None)
    assert len(learn) < tx.SAMPLE_DOCS
    model = tx.fitted([(docs[i][: tx.SAMPLE_CHARS], y) for y, i in learn])
    got = tx.op7_toxicity(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        score, spans = plain_score(model, docs[r.doc_id])
        assert abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert [(x.start, x.end) for x in r.spans] == spans
    assert any(r.spans for r in got)


def test_short_documents_train_the_field():
    rng = random.Random(3)
    word = lambda: f"word{rng.randrange(60)}"
    model = tx.fitted([(f"{word()} {word()}", 0) for _ in range(60)] + [(f"{word()} vile {word()}", 1) for _ in range(60)])
    assert np.abs(model.emit).sum() > 0
    assert model.score("a vile day")[0] > 0.5 > model.score("a fine day")[0]


def test_offsets_are_those_of_the_text():
    """A letter that grows in lower case splits no word and shifts none."""
    rng = random.Random(4)
    word = lambda: f"word{rng.randrange(60)}"
    model = tx.fitted([(" ".join(word() for _ in range(30)), 0) for _ in range(80)] + [(" ".join([*(word() for _ in range(9)), "vile", *(word() for _ in range(9))]), 1) for _ in range(80)])
    text = "KİTAP is here and vile word1 word2"
    assert [text[a:b] for a, b in model.score(text)[1]] == ["vile"]


def test_training_takes_one_bounded_text_an_id(spark):
    df = spark.createDataFrame([(1, "a" * 50_000)] * 40 + [(1, "b"), (2, "c")], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id BIGINT, toxic INT")
    assert tx.training(df, labels) == [("c", 0), ("a" * tx.SAMPLE_CHARS, 1)]


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.1"
    rows = tx.op7_toxicity(spark, big).join(table(spark, big, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert (s[y == 0] >= 0.5).mean() < 0.005 and (s[y == 1] >= 0.5).mean() > 0.85
    pairs = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert pairs > 0.95


def test_toxicity_spans_edges_and_empty(spark):
    rng = random.Random(0)
    filler = [f"word{k}" for k in range(200)]
    clean = [(" ".join(rng.choice(filler) for _ in range(40)), 0) for _ in range(120)]
    bad = [(" ".join([*(rng.choice(filler) for _ in range(20)), "vile", *(rng.choice(filler) for _ in range(20))]), 1) for _ in range(60)]
    model = tx.fitted(clean + bad)
    text = "Hello İ there, VILE word1 " + "word2 " * 60_000
    df = spark.createDataFrame([(1, text, "c"), (2, None, "c"), (3, "", "c"), (3, "", "c"), (None, "vile", "c")], "doc_id BIGINT, text STRING, spans STRING")
    got = {r.doc_id: r for r in tx.scored(df, model).collect()}
    assert [text[a.start : a.end] for a in got[1].spans] == ["VILE"]
    assert got[2].score == got[3].score < 0.5 and got[2].spans == []
    assert got[None].score > 0.5
    assert tx.scored(df.limit(0), model).count() == 0
    assert tx.fitted([]).score("x") == (0.0, []) and tx.fitted([("a", 1)]).score(None) == (0.0, [])
    assert math.isfinite(got[1].score)
    assert tx.training(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id BIGINT, toxic INT")) == []
