"""Line dedup by a log-template tree.

Every line is parsed into a tree of fixed depth: the number of its tokens, then its DEPTH leading
tokens, where a token with a digit is the variable field <*>. A path through the tree ends in a leaf.
The rest of the line is cut into at most SEGMENTS even segments, and a leaf's templates are its lines
with up to a quarter of their segments generalised to <*>: two lines of a leaf that agree in all other
segments share a template. Short lines generalise nothing but their tokens with digits.

A template that recurs across documents is dropped from all of them but the first. A line is a root
if no document of smaller id than its first has a line of one of its templates; the first of a root's
occurrences always stays. Any other line is dropped if a document of smaller id has an equal line, or a root
of one of its templates. So whatever is dropped has a line like it, by a single template, that
stays: a chain of lines, each like the next, is not dropped for a line that its end isn't like, and a
document is never robbed of lines that it alone has.

Segments and lines are told by 64-bit hashes; what is grouped by is the leaf's hash with the line's,
or with two hashes of a template, 128 bits in all or more, so that no chance meeting drops a line.
(leaf, line) hashes are pre-aggregated to the smallest and the largest doc_id, and only lines of
leaves that hold several lines are spread over their templates, a fixed number of rows for each.
There is no step that needs the lines of a leaf or of a template in one place. Plain joins bring the
verdicts back, and Spark splits those that a frequent line makes uneven. Line texts are never
shuffled; a document's text meets its dropped line numbers once.

Defined results: a null text stays null and has no lines; blank lines are never dropped, nor are lines of fewer
than MIN_TOKENS tokens that have fewer than MIN_CHARS characters too; lines end at \\n, a \\r before it is blank; rows
that share a doc_id are one document when templates are compared; a null doc_id counts as smaller than any other;
an empty table gives no rows; all columns of the documents stay, whatever their names, and those that
the operator adds (n_lines, n_dropped) replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import named, small_batches, stored, table, unused, worker_cache

DEPTH = 3
SEGMENTS = 8
MIN_TOKENS = 3
#: Characters, blanks aside, by which a line of fewer tokens counts as a passage all the same.
MIN_CHARS = 32
#: Segments that a line needs for each that is generalised.
PER_FIELD = 4
#: Lines of an Arrow batch.
BATCH = 20_000
_LEAST = -(1 << 63)
_DIGIT = re.compile(rb"[0-9]")

SEGS = [f"s{j}" for j in range(SEGMENTS)]
LINES = "_doc BIGINT, _text BIGINT, _n INT, leaf BIGINT, line BIGINT, k INT, " + ", ".join(f"{s} BIGINT" for s in SEGS)


def parse(line: bytes) -> tuple[int, ...] | None:
    """leaf, line, k and the segments' hashes of a line: hashes of its path and of itself, its segments' number, and 0 for those it lacks."""
    tokens = line.split()  # of bytes: at ASCII blanks alone
    n = len(tokens)
    if n < MIN_TOKENS and (not n or len(line) < MIN_CHARS or len(b"".join(tokens).decode("utf-8", "replace")) < MIN_CHARS):
        return None
    if _DIGIT.search(line):
        tokens = [b"<*>" if _DIGIT.search(t) else t for t in tokens]
    rest, segs = n - DEPTH, [0] * SEGMENTS
    k = min(rest, SEGMENTS) if rest >= PER_FIELD else 0
    for j in range(k):
        segs[j] = xxhash.xxh3_64_intdigest(b" ".join(tokens[DEPTH + j * rest // k : DEPTH + (j + 1) * rest // k]))
    return xxhash.xxh3_64_intdigest(b"%d " % n + b" ".join(tokens[:DEPTH])), xxhash.xxh3_64_intdigest(b" ".join(tokens)), k, *segs


def parsed(docs: DataFrame) -> DataFrame:
    """A row per line that can be dropped: _doc, _text (its text's hash), _n (line number from 0), and what parse() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none", object)
        for batch in batches:
            owner, number, found = [], [], []
            for i, text in enumerate(batch.column("text")):
                for n, line in enumerate(text.as_py().split(b"\n")):
                    if (got := parse(line)) is not None:
                        owner.append(i)
                        number.append(n)
                        found.append(got)
                    if len(found) >= BATCH:
                        yield rows(batch, owner, number, found)
                        owner, number, found = [], [], []
            if found:
                yield rows(batch, owner, number, found)

    def rows(batch: pa.RecordBatch, owner: list[int], number: list[int], found: list[tuple]) -> pa.RecordBatch:
        at = pa.array(owner, pa.int32())
        cols = [c.view(np.int64) for c in np.array(found, dtype=np.uint64).T.copy()]
        cols[2] = cols[2].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("_doc").take(at), batch.column("_text").take(at), pa.array(number, pa.int32()), *map(pa.array, cols)],
            names=["_doc", "_text", "_n", "leaf", "line", "k", *SEGS],
        )

    small_batches(docs.sparkSession)
    texts = docs.where(F.col("text").isNotNull())
    return texts.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)).alias("_doc"), F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("text")
    ).mapInArrow(run, LINES)


def masks() -> list[tuple[int, tuple[int, ...]]]:
    """(segments a line must have at least, segments generalised)."""
    return [(max(c * PER_FIELD, max(m) + 1), m) for c in range(1, SEGMENTS // PER_FIELD + 1) for m in combinations(range(SEGMENTS), c)]


def generalised(lines: DataFrame) -> DataFrame:
    """leaf, line, root_lo: the smallest doc_id of the roots that share a wildcard template with a line. lines: leaf, line, lo, hi, k and segments."""
    several = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("leaf")
    shared = lines.where("k > 0").join(several, "leaf")
    # a mask is told by its bits; a line has those that its segments allow
    allowed = F.filter(F.array(*[F.struct(F.lit(need).alias("need"), F.lit(sum(1 << j for j in m)).alias("m")) for need, m in masks()]), lambda x: x["need"] <= F.col("k"))
    spread = shared.withColumn("_m", F.explode(F.transform(allowed, lambda x: x["m"])))
    seen = [F.when(F.col("_m").bitwiseAND(1 << j) == 0, F.col(s)).otherwise(0) for j, s in enumerate(SEGS)]
    spread = spread.select("leaf", "line", "lo", "hi", F.xxhash64("_m", "k", *seen).alias("t"), F.xxhash64(F.lit("u"), *seen[::-1], "_m").alias("u"))
    found = spread.groupBy("leaf", "t", "u").agg(F.min("lo").alias("t_lo"), F.max("hi").alias("t_hi"), F.count(F.lit(1)).alias("_n"))
    found = found.where("_n > 1 AND t_lo < t_hi").select("leaf", "t", "u", "t_lo")
    hits = stored(spread.select("leaf", "line", "lo", "t", "u").join(found, ["leaf", "t", "u"]), "template-lines")
    roots = hits.groupBy("leaf", "line").agg(F.min("t_lo").alias("first"), F.min("lo").alias("lo")).where("first >= lo").select("leaf", "line")
    led = hits.join(roots, ["leaf", "line"], "left_semi").groupBy("leaf", "t", "u").agg(F.min("lo").alias("root_lo"))
    return hits.join(led, ["leaf", "t", "u"]).groupBy("leaf", "line").agg(F.min("root_lo").alias("root_lo"))


def dropped(docs: DataFrame) -> DataFrame:
    """_doc, _text, _dropped: the line numbers that each document loses."""
    rows = stored(parsed(docs), "lines")
    # k and the segments are those of the line, the same in each of its rows
    lines = stored(rows.groupBy("leaf", "line").agg(F.min("_doc").alias("lo"), F.max("_doc").alias("hi"), *[F.min(c).alias(c) for c in ("k", *SEGS)]), "templates")
    wide = stored(generalised(lines), "wildcards")
    first = lines.select("leaf", "line", "lo", "hi").join(wide, ["leaf", "line"], "left")
    first = first.select("leaf", "line", F.least("lo", "root_lo").alias("lo"), "hi").where("lo < hi").drop("hi")
    gone = rows.select("_doc", "_text", "_n", "leaf", "line").join(first, ["leaf", "line"]).where(F.col("_doc") > F.col("lo"))
    return gone.select("_doc", "_text", "_n").distinct().groupBy("_doc", "_text").agg(F.collect_list("_n").alias("_dropped"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents with text rid of recurring templates; adds n_lines and n_dropped."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc, text, lost, lines = unused([*columns, "n_lines", "n_dropped"], "_doc", "_text", "_dropped", "_lines")
    keyed = docs.select(*named(columns), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)).alias(doc), F.xxhash64("text").alias(text))
    out = keyed.join(dropped(docs).toDF(doc, text, lost), [doc, text], "left")
    split = F.split("text", "\n")
    out = out.select(*named(columns), F.when(F.col(lost).isNotNull(), split).alias(lines), lost, F.size(split).alias("n_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    rest = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines"))
    return out.select(*[rest.alias(c) if c == "text" else x for c, x in zip(columns, named(columns))], n_lines.alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).alias("n_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def _oracle() -> str:
    """Templates by their own tokens instead of hashes."""
    each = ", ".join(f"({need}, {list(m)})" for need, m in masks())
    return rf"""
WITH d AS (SELECT doc_id, text, coalesce(doc_id::BIGINT, '{_LEAST}'::BIGINT) AS _doc, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT _doc, md5(text) AS _text, unnest(range(0, len(ls))) AS n, unnest(ls) AS raw FROM (SELECT DISTINCT _doc, text, ls FROM d WHERE text IS NOT NULL)),
t AS (SELECT _doc, _text, n, list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
g AS (SELECT _doc, _text, n, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w
  FROM t WHERE len(w) >= {MIN_TOKENS} OR len(w) > 0 AND length(array_to_string(w, '')) >= {MIN_CHARS}),
f AS (SELECT w, min(_doc) AS lo, max(_doc) AS hi, len(w) - {DEPTH} AS rest FROM g GROUP BY w),
s AS (SELECT w, lo, hi, CASE WHEN rest >= {PER_FIELD} THEN least(rest, {SEGMENTS}) ELSE 0 END AS k,
        [array_to_string(w[{DEPTH} + 1 + j * rest // least(rest, {SEGMENTS}) : {DEPTH} + (j + 1) * rest // least(rest, {SEGMENTS})], ' ') FOR j IN range(0, least(rest, {SEGMENTS}))] AS segs
  FROM f),
masks(need, m) AS (VALUES {each}),
x AS (SELECT w, lo, hi, {{'leaf': w[1:{DEPTH}], 'n': len(w), 'm': m, 'segs': [CASE WHEN list_contains(m, j) THEN NULL ELSE segs[j + 1] END FOR j IN range(0, k)]}} AS key
  FROM s JOIN masks ON k >= need),
p AS (SELECT key, min(lo) AS t_lo FROM x GROUP BY key HAVING count(*) > 1),
roots AS (SELECT w FROM x JOIN p USING (key) GROUP BY w HAVING min(t_lo) >= min(lo)),
r AS (SELECT key, min(lo) AS root_lo FROM x SEMI JOIN roots USING (w) GROUP BY key HAVING key IN (SELECT key FROM p)),
wide AS (SELECT w, min(root_lo) AS root_lo FROM x JOIN r USING (key) GROUP BY w),
gone AS (SELECT _doc, _text, n FROM g JOIN f USING (w) LEFT JOIN wide USING (w) WHERE _doc > least(f.lo, coalesce(root_lo, f.lo))),
lost AS (SELECT _doc, _text, list(n) AS ns FROM gone GROUP BY ALL)
SELECT d.doc_id, CASE WHEN ns IS NULL THEN text ELSE array_to_string([ls[i + 1] FOR i IN range(0, len(ls)) IF NOT list_contains(ns, i)], chr(10)) END AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, coalesce(len(ns), 0) AS n_dropped
FROM d LEFT JOIN lost ON d._doc = lost._doc AND md5(d.text) = lost._text
"""


ORACLE = _oracle()
