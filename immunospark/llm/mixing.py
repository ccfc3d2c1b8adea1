"""Mixing sources to target weights by hierarchical budgets.

The leaves of a tree of levels (domain, language, source) hold documents. A token budget is
propagated from the root: each node's budget is split among its children in proportion to their
weights; a child that can't use its share (its tokens times the epochs allowed are fewer) takes what
it can, and the rest goes to its siblings before anything is given back to an ancestor. A leaf fills
its budget with whole epochs, then with the longest prefix, in tokens, of one more epoch; the order
of an epoch is that of a seeded hash, another one for each epoch.

Budgets are worked out level by level with window functions over the children of a node: in order of
tokens per weight, those that can't use their share come first, so running sums tell the level to which the others are
filled. Nothing of it reaches the driver, however many leaves there are. The prefix is found without
sorting a leaf: token sums per slice of the hash range lead to the one slice where the budget ends, and only
that slice is put in order; a leaf of n documents has about sqrt(n) slices of sqrt(n) documents. The
result is the documents joined with a row per leaf: no document is
shuffled unless the table of leaves outgrows Spark's broadcast limit, and then skewed leaves split.

Defined results: a null level counts as the empty string; a null text has no tokens and is taken
with the prefix that it falls in; a node of weight 0 gets nothing; documents whose hash and id tie (repeated rows) are taken or left
together, left if they don't fit; an empty table gives no rows; columns of the documents stay as they
are, whatever their names; those that the operator adds begin with `mix_` and replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import BLANK, stored, table, unused

#: Budgets are cut to whole tokens; what rounding may take from a whole number is given back before.
EPSILON = 1e-6

Path = tuple[str, ...]

#: Weights of nodes among their siblings; others have weight 1.
WEIGHTS: dict[Path, float] = {
    ("domain0",): 5, ("domain1",): 3, ("domain2",): 2,
    **{(f"domain{d}", lang): w for d in range(3) for lang, w in {"en": 4, "de": 2, "fr": 2, "es": 2}.items()},
}
SHARE = 0.6
EPOCHS = 2
SEED = 17


def domain_of(source: Column) -> Column:
    """Stand-in for a domain column: the source's number modulo 3."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("int") % 3).cast("string"))).otherwise("")


def budgets(leaves: DataFrame, names: Sequence[str], share: float, weights: dict[Path, float], epochs: int) -> DataFrame:
    """Adds mix_budget, a whole number, to the leaves (names, t: tokens)."""
    for depth in range(1, len(names) + 1):
        known = [x for path, w in weights.items() if len(path) == depth for x in (F.array(*map(F.lit, path)), F.lit(float(w)))]
        weight = F.try_element_at(F.create_map(*known), F.array(*names[:depth])) if known else F.lit(None)
        leaves = leaves.withColumn(f"w{depth}", F.coalesce(weight, F.lit(1.0)))
    reached = F.lit(True)
    for depth in range(1, len(names) + 1):
        reached = reached & (F.col(f"w{depth}") > 0)
    leaves = leaves.withColumn("room", F.when(reached, (F.col("t") * epochs).cast("double")).otherwise(0.0))
    whole = leaves.agg(F.sum("t").alias("all"), F.sum("room").alias("most"))
    above = whole.select(F.least(F.col("all") * share, "most").alias("amount"))
    for depth in range(1, len(names) + 1):
        keys = list(names[:depth])
        nodes = leaves.groupBy(*keys).agg(F.max(f"w{depth}").alias("w"), F.sum("room").alias("room"))
        # the amount of the only root is one row that every child takes
        nodes = nodes.join(above, keys[:-1]) if depth > 1 else nodes.join(F.broadcast(above))
        ratio, group = F.when(F.col("w") > 0, F.col("room") / F.col("w")), Window.partitionBy(*keys[:-1])
        # running sums from either end: a frame that ends at the last row would be summed anew for each row
        up, down = group.orderBy(ratio.asc_nulls_first(), keys[-1]), group.orderBy(ratio.desc_nulls_last(), F.desc(keys[-1]))
        nodes = nodes.withColumn("before", F.coalesce(F.sum("room").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        nodes = nodes.withColumn("others", F.sum("w").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        level = F.max(F.when(F.col("others") > 0, (F.col("amount") - F.col("before")) / F.col("others"))).over(Window.partitionBy(*keys[:-1]))
        above = nodes.withColumn("level", level).select(*keys, F.coalesce(F.least("room", F.col("w") * F.col("level")), F.lit(0.0)).alias("amount"))
    budget = F.floor(F.greatest(F.col("amount"), F.lit(0.0)) + EPSILON).cast("bigint")
    return leaves.join(above, list(names)).select(*leaves.columns[: leaves.columns.index("w1")], budget.alias("mix_budget"))


def order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix(
    docs: DataFrame, levels: Sequence[tuple[str, Column]], share: float = SHARE, weights: dict[Path, float] | None = None,
    epochs: int = EPOCHS, seed: int = SEED, tokens: Column | None = None,
) -> DataFrame:
    """The documents taken, once per epoch that takes them: their columns, mix_epoch, mix_tokens, mix_budget, mix_<level>."""
    spark = docs.sparkSession
    weights = WEIGHTS if weights is None else weights
    if tokens is None:
        tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), f"{BLANK}+"), lambda x: x != ""))
    names = [f"mix_{name}" for name, _ in levels]
    docs = docs.drop("mix_epoch", "mix_budget")
    tagged = docs.withColumns({f"mix_{name}": F.coalesce(c.cast("string"), F.lit("")) for name, c in levels} | {"mix_tokens": tokens.cast("bigint")})
    meta = stored(tagged.select("doc_id", *names, "mix_tokens"), "mix-meta")
    totals = stored(meta.groupBy(*names).agg(F.sum("mix_tokens").alias("t"), F.count(F.lit(1)).alias("n")), "mix-totals")
    plan = budgets(totals, names, share, weights, epochs)
    whole = F.when(F.col("t") > 0, F.least(F.floor(F.col("mix_budget") / F.greatest("t", F.lit(1))), F.lit(epochs))).otherwise(1).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.when(F.col("t") > 0, F.col("mix_budget") - F.col("whole") * F.col("t")).otherwise(0))
    # hexadecimal digits of the hash that name a slice
    leaves = stored(plan.withColumn("digits", F.greatest(F.ceil(F.log2("n") / 8), F.lit(1)).cast("int")).drop("t", "n"), "mix-leaves")
    # the slice of the last epoch in which each leaf's budget ends, and the tokens before it
    last = meta.join(leaves.where("rest > 0"), names).withColumn("h", order(seed, F.col("whole")))
    last = last.withColumn("slice", F.substr("h", F.lit(1), F.col("digits")))
    slices = last.groupBy(*names, "rest", "slice").agg(F.sum("mix_tokens").alias("t"))
    running = slices.withColumn("sum", F.sum("t").over(Window.partitionBy(*names).orderBy("slice")))
    end = running.where("sum > rest").groupBy(*names).agg(F.min(F.struct("slice", (F.col("sum") - F.col("t")).alias("before"))).alias("end"))
    end = stored(end.select(*names, F.col("end.slice").alias("slice"), F.col("end.before").alias("before")), "mix-ends")
    within = last.join(end, [*names, "slice"])
    within = within.withColumn("sum", F.col("before") + F.sum("mix_tokens").over(Window.partitionBy(*names).orderBy("h", "doc_id")))
    # the first row that doesn't fit, and all after it, are left
    cut = within.where("sum > rest").groupBy(*names).agg(F.min(F.struct("h", "doc_id")).alias("cut"))
    (leaf,) = unused([*tagged.columns, "mix_epoch", "mix_budget"], "mix_leaf")
    leaves = leaves.join(cut, names, "left").select(*names, "mix_budget", F.struct("whole", "rest", "cut").alias(leaf))
    at = lambda name: F.col(leaf)[name]
    every = F.when(at("whole") > 0, F.sequence(F.lit(0), at("whole") - 1)).otherwise(F.array().cast("array<int>"))
    taken = (at("rest") > 0) & F.coalesce(F.struct(order(seed, at("whole")).alias("h"), F.col("doc_id")) < at("cut"), F.lit(True))
    runs = F.concat(every, F.when(taken, F.array(at("whole"))).otherwise(F.array().cast("array<int>")))
    return tagged.join(stored(leaves, "mix-plan"), names).withColumn("mix_epoch", F.explode(runs)).drop(leaf)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = mix(docs, [("domain", domain_of(F.col("source"))), ("lang", F.col("lang")), ("source", F.col("source"))])
    return got.select(
        "doc_id", F.col("mix_epoch").alias("epoch"), F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"),
        F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_budget").alias("leaf_budget"),
    )


def _oracle() -> str:
    names = ["domain", "lang", "source"]
    literal = lambda x: "'" + x.replace("'", "''") + "'"

    def level(depth: int) -> str:
        keys, up = names[:depth], ", ".join(names[: depth - 1])
        known = [(p, w) for p, w in WEIGHTS.items() if len(p) == depth]
        weight = "CASE " + " ".join("WHEN " + " AND ".join(f"{k} = {literal(x)}" for k, x in zip(keys, p)) + f" THEN {float(w)}::DOUBLE" for p, w in known) + " ELSE 1 END" if known else "1::DOUBLE"
        part = f"PARTITION BY {up}" if up else ""
        join = f"JOIN a{depth - 1} USING ({up})" if up else "CROSS JOIN a0"
        return f"""
n{depth} AS (SELECT {", ".join(keys)}, sum(room) AS room, {weight} AS w FROM totals GROUP BY {", ".join(keys)}),
l{depth} AS (SELECT *, (amount - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM n{depth} {join} WINDOW o AS ({part} ORDER BY room / w, {keys[-1]})),
a{depth} AS (SELECT {", ".join(keys)}, least(room, w * max(level) OVER ({part})) AS amount FROM l{depth})"""

    return rf"""
WITH m AS (
  SELECT doc_id, CASE WHEN x <> '' THEN 'domain' || (x::INT % 3) ELSE '' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda t: t <> ''))::BIGINT AS n_tokens
  FROM (SELECT *, regexp_extract(coalesce(source, ''), '(\d{{1,9}})$', 1) AS x FROM documents)),
totals AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS t, sum(n_tokens)::DOUBLE * {EPOCHS} AS room FROM m GROUP BY ALL),
a0 AS (SELECT least(sum(t) * {SHARE}::DOUBLE, sum(room)) AS amount FROM totals),{level(1)},{level(2)},{level(3)},
plan AS (SELECT *, CASE WHEN t > 0 THEN least(leaf_budget // t, {EPOCHS}) ELSE 1 END AS whole
  FROM (SELECT domain, lang, source, t, floor(amount + {EPSILON})::BIGINT AS leaf_budget FROM totals JOIN a3 USING (domain, lang, source))),
h AS (SELECT *, md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM m JOIN plan USING (domain, lang, source)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id NULLS FIRST) AS run FROM h),
-- the first row that doesn't fit, and all after it, are left
s AS (SELECT *, CASE WHEN t > 0 THEN leaf_budget - whole * t ELSE 0 END AS rest FROM r)
SELECT doc_id, unnest(range(0, whole)) AS epoch, domain, lang, source, n_tokens, leaf_budget FROM s
UNION ALL
SELECT doc_id, whole AS epoch, domain, lang, source, n_tokens, leaf_budget FROM s WHERE rest > 0 AND run <= rest
"""


ORACLE = _oracle()
