"""Quality rules whose cut-offs are learned per language and source.

Every document gets whole-text statistics; a base rule rejects the plainly broken ones. The rest
feed mergeable quantile sketches (Greenwald-Khanna summaries, merged from map tasks by the
aggregate) at three levels: language and source, language, all. The quartiles of the finest level
with enough documents give each statistic a fence, in place of a fixed cut-off, and documents
outside a fence are rejected. Fences widen by a fixed slack, so a group without spread rejects
nothing that is close to its quartiles.

DataFrame functions only. Statistics are worked out once and stored; what is shuffled are sketches
and rows of numbers. The join on (language, source) has two plain exchanges, so Spark splits a
source that holds a third of the rows; it broadcasts the thresholds only below its own size limit.

Defined results: a null text has no words and fails the base rule, like an empty one; a null
language or source counts as the empty string; repeated rows count and are judged one by one; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANK, stored, table, text_of

MIN_WORDS = 50
MAX_REPEAT = 0.5
#: Documents a level needs for its own fences.
MIN_GROUP = 200
#: Greenwald-Khanna accuracy: ranks are off by at most 1/ACCURACY of a group.
ACCURACY = 10_000
#: Quartile distances that a fence lies beyond its quartile.
REACH = 6.0
#: statistic: (fence below, fence above, slack)
RULES = {
    "word_len": (True, True, 1.0),
    "symbol_share": (False, True, 0.1),
    "dup_line_share": (False, True, 0.3),
    "repeat_share": (False, True, 0.2),
}


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the columns named."""
    text = text_of()
    # each step names what the next one uses more than once, so that nothing is worked out per element
    df = docs.select(
        "doc_id", *keep,
        F.filter(F.split(text, f"{BLANK}+"), lambda x: x != "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    df = df.select(
        "doc_id", *keep, "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(
            F.transform(
                F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
                lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
            )
        ).alias("_s"),
    )
    rest = ["doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    same = lambda x, i, d: F.coalesce(F.get("_s", i + d)["h"] == x["h"], F.lit(False))
    df = df.select(
        *rest,
        F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])).alias("_p"),
    )
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, x: a + x,
    )
    return df.select(*rest, covered.cast("long").alias("n_repeat_words"))


def with_base(stats: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    repeat = F.col("n_repeat_words") * 100 > F.col("n_words") * int(MAX_REPEAT * 100)
    return stats.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | repeat,
        "word_len": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
    })


def thresholds(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Quartiles of every statistic for each set of leading levels, down to none; depth tells how many."""
    out = None
    aggs = [F.percentile_approx(r, [0.25, 0.75], ACCURACY).alias(f"q_{r}") for r in RULES]
    passed = rows.where(~F.col("base_failed"))
    for depth in range(len(levels), -1, -1):
        got = passed.groupBy(*levels[:depth]).agg(F.count(F.lit(1)).alias("n"), *aggs)
        got = got.withColumns({k: F.lit(None).cast("string") for k in levels[depth:]}).withColumn("depth", F.lit(depth))
        out = got if out is None else out.unionByName(got)
    return out


def judged(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A row per document: its statistics, base_failed and kept."""
    named = docs.select("doc_id", "text", text_of(lang).alias("_lang"), text_of(source).alias("_source"))
    rows = stored(with_base(statistics(named, "_lang", "_source")), "quality")
    levels = ["_lang", "_source"]
    cuts = stored(thresholds(rows, levels), "fences")
    cut = F.struct(*[f"q_{r}" for r in RULES])
    for depth in (2, 1):
        at = cuts.where((F.col("depth") == depth) & (F.col("n") >= MIN_GROUP))
        rows = rows.join(at.select(*levels[:depth], cut.alias(f"_cut{depth}")), levels[:depth], "left")
    # the level of all documents is one row, which becomes literals instead of a join without a key
    whole = cuts.where(F.col("depth") == 0).first()
    each = [F.lit(whole[f"q_{r}"]) if whole[f"q_{r}"] else F.lit(None).cast("array<double>") for r in RULES]
    rows = rows.withColumn("_cut0", F.struct(*[c.alias(f"q_{r}") for c, r in zip(each, RULES)]))
    rows = rows.withColumn("_cut", F.coalesce("_cut2", "_cut1", "_cut0"))
    ok = ~F.col("base_failed")
    for r, (below, above, slack) in RULES.items():
        lo, hi = F.col(f"_cut.q_{r}")[0], F.col(f"_cut.q_{r}")[1]
        reach = (hi - lo) * REACH + slack
        if below:
            ok = ok & (F.col(r) >= lo - reach)
        if above:
            ok = ok & (F.col(r) <= hi + reach)
    kept = F.coalesce(ok, F.lit(False)).alias("kept")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def quartiles(level: str, depth: int) -> str:
        keys = ["_lang", "_source"][:depth]
        cuts = ", ".join(f"quantile_disc({r}, 0.25) AS lo_{r}, quantile_disc({r}, 0.75) AS hi_{r}" for r in RULES)
        by = f" GROUP BY {', '.join(keys)}" if keys else ""
        having = f" HAVING count(*) >= {MIN_GROUP}" if depth else ""
        return f"{level} AS (SELECT {''.join(k + ', ' for k in keys)}{cuts} FROM b WHERE NOT base_failed{by}{having})"

    def pick(end: str, r: str) -> str:
        return f"CASE WHEN c2._lang IS NOT NULL THEN c2.{end}_{r} WHEN c1._lang IS NOT NULL THEN c1.{end}_{r} ELSE c0.{end}_{r} END"

    tests = []
    for r, (below, above, slack) in RULES.items():
        lo, hi = pick("lo", r), pick("hi", r)
        reach = f"((({hi}) - ({lo})) * {REACH}::DOUBLE + {slack}::DOUBLE)"
        tests += [f"{r} >= ({lo}) - {reach}"] * below + [f"{r} <= ({hi}) + {reach}"] * above
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS _lang, coalesce(source, '') AS _source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
t AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, _lang, _source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(MAX_REPEAT * 100)} * n_words AS base_failed,
             word_chars / greatest(n_words, 1) AS word_len, n_symbols / greatest(n_words, 1) AS symbol_share,
             n_dup_lines / greatest(n_words, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share
      FROM s),
{quartiles('c2', 2)}, {quartiles('c1', 1)}, {quartiles('c0', 0)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND {' AND '.join(tests)}, false) AS kept
FROM b LEFT JOIN c2 USING (_lang, _source) LEFT JOIN c1 ON b._lang = c1._lang CROSS JOIN c0
"""


ORACLE = _oracle()
