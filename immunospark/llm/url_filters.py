"""URL filters: allow and block rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's rate is a
beta-binomial posterior whose prior has the mean of the level above and a strength estimated from
the spread among the units of that level (method of moments): suffixes shrink to the overall rate,
domains to their suffix, hosts to their domain. What a unit adds to the level above is left out there, so that no
outcome is prior and evidence at once; where one suffix has all outcomes, the overall rate stands. A page is blocked if the lower posterior bound of
its host's bad rate is above MAX_BAD, so a host without evidence is never blocked.

Outcomes are pre-aggregated per host before any shuffle, and stored; the pages meet one row per host in a plain
join, whose hot partitions Spark splits. Only four numbers reach the driver.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is
judged like any other by the outcomes of the empty host; repeated rows are judged one by one; an empty table
gives no rows; without any outcome nothing is blocked by reputation; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Suffixes of two labels, under which a registered domain has three. Fixed values.
LONG_SUFFIXES = ["ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "org.uk"]
MAX_BAD = 0.5
#: Standard deviations of the posterior between its mean and its lower bound.
Z = 1.645
#: Limits of the estimated prior strengths, in labelled pages.
STRENGTH = (2.0, 1000.0)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def with_host(pages: DataFrame) -> DataFrame:
    df = pages.select("page_id", F.coalesce("url", F.lit("")).alias("_url"))
    host, path = split_url(F.col("_url"))
    return df.select("page_id", host.alias("host"), path.alias("path"))


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits a host and path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def with_units(df: DataFrame) -> DataFrame:
    """domain and suffix of host; a port is no part of them."""
    labels = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    df = df.withColumn("_labels", labels)
    long = F.array_join(F.slice("_labels", -2, 2), ".").isin(LONG_SUFFIXES)
    n = F.when((F.size("_labels") > 2) & long, 2).otherwise(1)
    tail = lambda k: F.when(F.size("_labels") <= k, F.array_join("_labels", ".")).otherwise(
        F.array_join(F.slice("_labels", F.size("_labels") - k + 1, k), ".")
    )
    return df.withColumns({"suffix": tail(n), "domain": tail(n + 1)}).drop("_labels")


def strength(units: DataFrame) -> DataFrame:
    """One row: the overall counts k and n, their rate m and the prior strength that the spread among units (k bad of n) tells."""
    totals = units.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("sq"))
    m = F.col("k") / F.col("n")
    v = m * (1 - m)
    between = F.greatest(F.col("sq") / F.col("n") - m * m - v * F.col("u") / F.col("n"), F.lit(1e-9))
    return totals.select("k", "n", m.alias("m"), F.least(F.greatest(v / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("strength"))


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, blocked for every host of `hosts`; outcomes: a row per host with k bad of n labelled pages."""
    seen = with_units(outcomes)
    levels = {
        "suffix": seen.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")),
        "domain": seen.groupBy("domain").agg(F.sum("k").alias("k"), F.sum("n").alias("n")),
        "host": seen.select("host", "k", "n"),
    }
    df, strengths, whole = with_units(hosts), {}, None
    for name, units in levels.items():
        whole = strength(units).first()
        if whole is None or whole["m"] is None:
            return hosts.select("host", F.lit(False).alias("blocked"))
        strengths[name] = whole["strength"]
        df = df.join(units.select(name, F.col("k").alias(f"k_{name}"), F.col("n").alias(f"n_{name}")), name, "left")
    count = lambda c, name: F.coalesce(f"{c}_{name}", F.lit(0)) if name else F.lit(0)
    others = F.lit(whole["n"]) - count("n", "suffix")
    mean = F.when(others > 0, (F.lit(whole["k"]) - count("k", "suffix")) / others).otherwise(whole["m"])
    for name, below in (("suffix", "domain"), ("domain", "host"), ("host", None)):
        n = count("n", name) - count("n", below)
        mean = (mean * strengths[name] + count("k", name) - count("k", below)) / (strengths[name] + n)
    size = strengths["host"] + count("n", "host")
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (size + 1))
    return df.select("host", (bound > MAX_BAD).alias("blocked"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """outcomes: page_id, bad (0 or 1); several rows of a page are several outcomes."""
    rows = with_host(pages)
    labelled = rows.join(outcomes.where(F.col("bad").isNotNull()).select("page_id", "bad"), "page_id")
    counts = labelled.groupBy("host").agg(F.sum("bad").alias("k"), F.count(F.lit(1)).alias("n"))
    found = reputations(rows.select("host").distinct(), stored(counts, "outcomes"))
    rule, verdict = rule_of(rules)
    method = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return rows.join(found, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict")
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled outcome of a page is the label of its id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    return judged(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def _oracle() -> str:
    def level(name: str, parent: str, below: str) -> str:
        k, n = (f"coalesce({c}_{name}, 0) - coalesce({c}_{below}, 0)" if below else f"coalesce({c}_{name}, 0)" for c in "kn")
        return f"""
{name}_s AS (SELECT least(greatest(m * (1 - m) / greatest(sq / n - m * m - m * (1 - m) * u / n, 1e-9) - 1, {STRENGTH[0]}), {STRENGTH[1]}) AS st
  FROM (SELECT sum(k) / sum(n) AS m, sum(n) AS n, count(*) AS u, sum(k::DOUBLE * k / n) AS sq FROM {name}_u)),
{name}_p AS (SELECT * REPLACE ((mean * st + {k}) / (st + {n}) AS mean, st + {n} AS size) FROM (SELECT h.*, st FROM (SELECT * EXCLUDE (st) FROM {parent}) h CROSS JOIN {name}_s))"""

    def units(name: str) -> str:
        return f"{name}_u AS (SELECT {name}, sum(k) AS k, sum(n) AS n FROM seen GROUP BY {name})"

    cases, verdicts = [], []
    for action, text in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        cases.append(f"WHEN {fits} THEN '{text}'")
        verdicts.append(f"WHEN {fits} THEN '{action}'")
    suffixes = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    return rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
lab AS (SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM p JOIN labels ON doc_id = page_id),
c AS (SELECT host, sum(bad) AS k, count(*) AS n FROM lab GROUP BY host),
h0 AS (SELECT DISTINCT host FROM p),
h1 AS (SELECT host, string_split(regexp_replace(host, ':\d*$', ''), '.') AS l FROM h0),
h2 AS (SELECT host, l, CASE WHEN len(l) > 2 AND array_to_string(l[-2:], '.') IN ({suffixes}) THEN 2 ELSE 1 END AS n FROM h1),
units AS (SELECT host, array_to_string(l[-n:], '.') AS suffix, array_to_string(l[-(n + 1):], '.') AS domain FROM h2),
seen AS (SELECT * FROM c JOIN units USING (host)),
whole AS (SELECT sum(k) AS k, sum(n) AS n FROM seen), {units('suffix')}, {units('domain')}, {units('host')},
counted AS (SELECT units.*, s.k AS k_suffix, s.n AS n_suffix, d.k AS k_domain, d.n AS n_domain, h.k AS k_host, h.n AS n_host, whole.k AS k, whole.n AS n
  FROM units LEFT JOIN suffix_u s USING (suffix) LEFT JOIN domain_u d USING (domain) LEFT JOIN host_u h USING (host) CROSS JOIN whole),
start AS (SELECT *, CASE WHEN n > coalesce(n_suffix, 0) THEN (k - coalesce(k_suffix, 0)) / (n - coalesce(n_suffix, 0)) ELSE k / n END AS mean, 0 AS size, 0 AS st FROM counted),
{level('suffix', 'start', 'domain')},{level('domain', 'suffix_p', 'host')},{level('host', 'domain_p', '')},
b AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)) > {MAX_BAD} AS blocked FROM host_p)
SELECT page_id, host, path, CASE {' '.join(cases)} END AS rule,
       CASE {' '.join(verdicts)} WHEN coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN b USING (host)
"""


ORACLE = _oracle()
