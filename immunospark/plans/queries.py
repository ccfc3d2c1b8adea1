"""One query per operator over the generic test tables, each with SQL that DuckDB runs where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cdr3 as fcdr3
from ..functions import dna, genes, read_format
from ..operators import barcode_report as br
from ..operators import barcodes, diversity, em, kmers, pileup, report
from ..operators.graph import cut
from .standins import CDR3, READS_DUCK, cdr3_rows, compiled, reads, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL -------------------------------------------------------------------------------

_AMINO = dna._AMINO
_LOCI = "('IGH','IGK','IGL','TRA','TRB','TRG','TRD')"


def _aa(s: str) -> str:
    at = lambda k: f"strpos('TCAG', substr({s}, 3 * i + {k}, 1))"
    one = f"CASE WHEN {at(1)} > 0 AND {at(2)} > 0 AND {at(3)} > 0 AND length({s}) >= 3 * i + 3 THEN substr('{_AMINO}', 16 * ({at(1)} - 1) + 4 * ({at(2)} - 1) + {at(3)}, 1) ELSE '?' END"
    return f"array_to_string(list_transform(range(0, (length({s}) + 2) // 3), lambda i: {one}), '')"


def _rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def _called(g: str) -> str:
    return f"CASE WHEN {g} IN ('*', '.', '') THEN NULL ELSE {g} END"


def _first(g: str) -> str:
    return _called(f"split_part({g}, ',', 1)")


def _locus(*gs: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN substr({g}, 1, 3) IN {_LOCI} THEN substr({g}, 1, 3) END" for g in gs) + ")"


_INFER = """CASE WHEN c IS NOT NULL THEN CASE WHEN coalesce(starts_with(v, 'IGH'), true) AND coalesce(starts_with(j, 'IGH'), true)
  THEN split_part(c, '*', 1) ELSE substr(split_part(c, '*', 1), 1, 4) END
  WHEN j IS NOT NULL AND NOT coalesce(regexp_matches(v, '^TR[AD]'), false) AND NOT starts_with(j, 'IGH') THEN substr(j, 1, 3) || 'C' END"""

#: Rows with genes called; infer: the constant gene inferred, as the clonotype report has it.
_GENES = f"""raw AS ({CDR3}),
g0 AS (SELECT ordinal, cid, {_first('v')} AS v, {_first('d')} AS d, {_first('j')} AS j, {_first('c')} AS c, cdr3, score, count, germline_similarity, complete_vdj FROM raw)"""
_CALLED = f"""{_GENES},
g1 AS (SELECT * REPLACE ({_INFER} AS c) FROM g0),
g AS (SELECT *, {_locus('v', 'j', 'c')} AS locus FROM g1),
kept AS (SELECT g.* FROM (SELECT *, max(count) OVER (PARTITION BY cid) AS most FROM g) g
  WHERE score <> 0 AND length(cdr3) < 180 AND count >= most * CASE WHEN starts_with(locus, 'TR') THEN 0.05::DOUBLE ELSE 0 END)"""


def _report_sql(source: str, count: str = "floor(count)::BIGINT") -> str:
    return f"""
best AS (SELECT v, d, j, c, cdr3, max(score) AS score, sum(count) AS count,
    arg_max(cid, (count, -ordinal)) AS cid, arg_max(complete_vdj, (count, -ordinal)) AS cid_full_length FROM {source} GROUP BY v, d, j, c, cdr3),
f AS (SELECT *, CASE WHEN {_locus('v', 'j', 'c')} = 'IGL' THEN 'IGK' ELSE {_locus('v', 'j', 'c')} END AS l FROM best),
t AS (SELECT *, CASE WHEN l IS NULL THEN 0 ELSE count / sum(count) OVER (PARTITION BY l) END AS frequency FROM f)
SELECT {count} AS count, frequency, cdr3 AS cdr3nt,
  CASE WHEN score = 0 THEN 'partial' WHEN length(cdr3) % 3 <> 0 THEN 'out_of_frame' ELSE {_aa('cdr3')} END AS cdr3aa, v, d, j, c, cid, cid_full_length
FROM t WHERE floor(count) > 0"""


def _rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- clonotype report ----------------------------------------------------------------------------


@query(f"WITH {_CALLED}, {_report_sql('kept')}".replace("frequency, cdr3 AS", "round(frequency, 9) AS frequency, cdr3 AS"))
def clonotype_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.clonotype_report(cdr3_rows(spark, sf_dir)), "frequency")


_FIRST_BARCODE = f"""{_CALLED},
bc AS (SELECT * REPLACE (1.0::DOUBLE AS count) FROM (SELECT *, row_number() OVER (PARTITION BY locus, cdr3, regexp_replace(cid, '_[^_]*$', '') ORDER BY ordinal) AS r FROM kept) WHERE r = 1)"""


@query(f"WITH {_FIRST_BARCODE}, {_report_sql('bc')}".replace("frequency, cdr3 AS", "round(frequency, 9) AS frequency, cdr3 AS"))
def distinct_barcode_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.clonotype_report(cdr3_rows(spark, sf_dir), by_barcode=True), "frequency")


@query(f"""WITH {_CALLED}, {_report_sql('kept').rsplit('SELECT', 1)[0]}
SELECT v, j, c, cdr3, cid, l AS locus, CASE WHEN l LIKE 'IG%' THEN 'B' WHEN l IN ('TRA', 'TRB') THEN 'abT' WHEN l IN ('TRG', 'TRD') THEN 'gdT' END AS cell_type,
  CASE WHEN l IN ('IGH', 'TRB', 'TRD') THEN 1 WHEN l IS NOT NULL THEN 2 END AS side FROM t""")
def gene_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = report.clonotypes(report.error_filter(report.with_genes(cdr3_rows(spark, sf_dir))))
    locus = genes.denominator_locus(genes.locus(F.col("v"), F.col("j"), F.col("c")))
    return kept.select("v", "j", "c", "cdr3", "cid", locus.alias("locus"), genes.cell_type(locus).alias("cell_type"), genes.chain_side(locus).alias("side"))


@query(f"""WITH raw AS ({CDR3})
SELECT ordinal, cdr3 AS cdr3nt, CASE WHEN score = 0 THEN 'partial' WHEN length(cdr3) % 3 <> 0 THEN 'out_of_frame' ELSE {_aa('cdr3')} END AS cdr3aa,
  CASE WHEN length(cdr3) % 3 <> 0 OR regexp_matches({_aa('cdr3')}, '[_?]') THEN '' ELSE {_aa('cdr3')} END AS junction_aa,
  {_rc('cdr3')} AS reverse FROM raw""")
def translate_cdr3(spark: SparkSession, sf_dir: str) -> DataFrame:
    nt = F.col("cdr3")
    return cdr3_rows(spark, sf_dir).select(
        "ordinal", nt.alias("cdr3nt"), fcdr3.amino_acids(nt, F.col("score")).alias("cdr3aa"), fcdr3.airr_translation(nt).alias("junction_aa"), dna.reverse_complement(nt).alias("reverse")
    )


# ---- cells ---------------------------------------------------------------------------------------

_CHAINS = f"""{_GENES},
ch AS (SELECT *, regexp_replace(cid, '_[^_]*$', '') AS barcode, {_locus('j', 'c', 'v')} AS locus,
    CASE WHEN score = 0 THEN 'partial' WHEN length(cdr3) % 3 <> 0 THEN 'out_of_frame' ELSE {_aa('cdr3')} END AS aa FROM g0),
cr AS (SELECT *, CASE WHEN aa = 'partial' THEN 0 WHEN contains(aa, '_') THEN 1 ELSE 2 END AS rank FROM ch WHERE aa <> 'partial' AND locus IS NOT NULL),
ab AS (SELECT barcode, locus, sum(count) AS abundance FROM cr GROUP BY barcode, locus),
rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY barcode, locus ORDER BY count DESC, ordinal) AS r FROM cr WHERE rank = 2) WHERE r = 1)"""


@query(f"WITH {_CHAINS} SELECT barcode, locus, cid, cdr3 AS cdr3nt, aa AS cdr3aa, count FROM rep")
def representative_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = br.chain_rows(cdr3_rows(spark, sf_dir)).where("NOT partial AND locus IS NOT NULL")
    return br.representatives(rows).where("is_rep").select("barcode", "locus", "chain.cid", "chain.cdr3nt", "chain.cdr3aa", "chain.count")


_NUMBER = "list_position(['IGH','IGK','IGL','TRA','TRB','TRG','TRD'], locus)"
_CELLS = f"""{_CHAINS},
ct AS (SELECT barcode, arg_max(locus, (abundance, -{_NUMBER})) FILTER (WHERE {_NUMBER} <= 5) AS m, arg_max(locus, (abundance, -{_NUMBER})) AS o FROM ab GROUP BY barcode),
cell AS (SELECT barcode, CASE WHEN coalesce(m, o) LIKE 'IG%' THEN 'B' WHEN coalesce(m, o) IN ('TRA', 'TRB') THEN 'abT' ELSE 'gdT' END AS cell_type FROM ct),
pick AS (SELECT cell.barcode, cell_type, rep.locus, rep.cid, rep.cdr3, rep.count, ab.abundance FROM cell JOIN rep USING (barcode) JOIN ab ON ab.barcode = rep.barcode AND ab.locus = rep.locus),
two AS (SELECT barcode, any_value(cell_type) AS cell_type,
  max({{'cid': cid, 'cdr3': cdr3, 'n': count}}) FILTER (WHERE (cell_type = 'B' AND locus = 'IGH') OR (cell_type = 'abT' AND locus = 'TRB') OR (cell_type = 'gdT' AND locus = 'TRD')) AS c1,
  arg_max({{'cid': cid, 'cdr3': cdr3, 'n': count}}, (abundance, -{_NUMBER})) FILTER (WHERE (cell_type = 'B' AND locus IN ('IGK', 'IGL')) OR (cell_type = 'abT' AND locus = 'TRA') OR (cell_type = 'gdT' AND locus = 'TRG')) AS c2
  FROM pick GROUP BY barcode)"""


@query(f"""WITH {_CELLS} SELECT barcode, cell_type, c1.cid AS cid1, c1.cdr3 AS cdr3_1, c1.n AS n1, c2.cid AS cid2, c2.cdr3 AS cdr3_2, c2.n AS n2 FROM two WHERE c1 IS NOT NULL OR c2 IS NOT NULL""")
def barcode_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = br.barcode_report(cdr3_rows(spark, sf_dir))
    cols = [F.col(f"chain{s}.{a}").alias(b) for s in (1, 2) for a, b in (("cid", f"cid{s}"), ("cdr3nt", f"cdr3_{s}"), ("count", f"n{s}"))]
    return got.select("barcode", "cell_type", *cols)


def _pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-cell report with many cells: each order is a cell, each of its lines a chain."""
    return br.barcode_report(_order_cells(spark, sf_dir))


_ORDER_CELLS = CDR3.replace("'B' || CAST(l_suppkey AS STRING) || '_' || CAST(l_orderkey % 500 AS STRING)", "'C' || CAST(l_orderkey AS STRING) || '_' || CAST(((l_linenumber * CAST(100000 AS BIGINT) + l_partkey) * 10000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS STRING)")


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled(spark)
    return spark.sql(_ORDER_CELLS.replace("FROM lineitem)", "FROM {lineitem})"), lineitem=spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))


_ORDERS = _CELLS.replace(CDR3, _ORDER_CELLS)


@query(f"""WITH {_ORDERS},
rows AS (SELECT barcode, 1 AS s, c1.cid AS cid, c1.cdr3 AS cdr3, c1.n AS n FROM two WHERE c1 IS NOT NULL UNION ALL SELECT barcode, 2, c2.cid, c2.cdr3, c2.n FROM two WHERE c2 IS NOT NULL),
src AS (SELECT barcode AS source, cdr3, max(s) AS s, arg_max(n, s) AS sn FROM rows WHERE n >= 40 GROUP BY barcode, cdr3),
hit AS (SELECT DISTINCT rows.barcode, source FROM rows JOIN src ON rows.cdr3 = src.cdr3 AND rows.s = src.s WHERE n < 40 AND sn * 0.2::DOUBLE > n),
fl AS (SELECT hit.barcode, bool_or(coalesce(CASE WHEN a.c1 IS NULL THEN b.c1 IS NOT NULL ELSE b.c1.n * 0.2::DOUBLE > a.c1.n AND contains(b.c1.cdr3, a.c1.cdr3) END, false)) AS x,
  bool_or(coalesce(CASE WHEN a.c2 IS NULL THEN b.c2 IS NOT NULL ELSE b.c2.n * 0.2::DOUBLE > a.c2.n AND contains(b.c2.cdr3, a.c2.cdr3) END, false)) AS y
  FROM hit JOIN two a ON a.barcode = hit.barcode JOIN two b ON b.barcode = hit.source GROUP BY hit.barcode)
SELECT barcode, cell_type FROM two WHERE (c1 IS NOT NULL OR c2 IS NOT NULL) AND barcode NOT IN (SELECT barcode FROM fl WHERE x AND y)""")
def denoise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.diffusion_filter(cut(_pair_report(spark, sf_dir)), high=40.0, share=0.2).select("barcode", "cell_type")


@query(f"""WITH {_ORDERS}
SELECT barcode || '_0' AS barcode, cell_type, c1.cid AS cid1 FROM two WHERE c1 IS NOT NULL OR c2 IS NOT NULL""".replace("SELECT barcode || '_0'", "SELECT barcode || '_0'"))
def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = br.expand(_pair_report(spark, sf_dir), side=1, share=1e9)
    return got.select("barcode", "cell_type", F.col("chain1.cid").alias("cid1"))


_SECONDARY = f"""{_CHAINS},
best AS (SELECT *, first_value(cid) OVER (PARTITION BY barcode, locus, aa ORDER BY count DESC, is_rep DESC, pushed) AS bc FROM (
  SELECT *, is_rep_led AND nxt IS NULL AS is_rep, CASE WHEN is_rep_led THEN nxt ELSE ordinal END AS pushed FROM (
    SELECT *, min(CASE WHEN is_rep_led THEN ordinal END) OVER (PARTITION BY barcode, locus ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM (
      SELECT *, coalesce(rank = 2 AND (prev IS NULL OR count > prev), false) AS is_rep_led FROM (
        SELECT *, max(CASE WHEN rank = 2 THEN count END) OVER (PARTITION BY barcode, locus ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM cr))))),
sec AS (SELECT *, row_number() OVER (PARTITION BY barcode, locus ORDER BY pushed, ordinal) AS k FROM best WHERE NOT is_rep AND bc = cid AND (barcode, locus) IN (SELECT (barcode, locus) FROM rep))"""


@query(f"WITH {_SECONDARY} SELECT barcode, locus, k::INT AS k, cid, aa AS cdr3aa, count FROM sec")
def secondary_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = br.chain_rows(cdr3_rows(spark, sf_dir)).where("NOT partial AND locus IS NOT NULL")
    got = br.secondaries(br.representatives(rows)).select("barcode", "locus", F.posexplode("others").alias("k", "x"))
    return got.select("barcode", "locus", (F.col("k") + 1).alias("k"), "x.cid", "x.cdr3aa", "x.count")


@query()
def secondary_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = br.expand(br.barcode_report(cdr3_rows(spark, sf_dir)), side=2, share=0.1)
    return got.select("barcode", "cell_type", F.col("chain1.cid").alias("cid1"), F.col("chain2.cid").alias("cid2"))


@query()
def chain_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_cells(spark, sf_dir)
    got = br.impute(cut(br.barcode_report(rows)), rows)
    return got.select("barcode", "cell_type", F.col("chain1.cid").alias("cid1"), F.col("chain2.cid").alias("cid2"))


@query(f"""WITH {_ORDERS}, rows AS (SELECT barcode, cell_type, c1.cid AS cid FROM two WHERE c1 IS NOT NULL UNION ALL SELECT barcode, cell_type, c2.cid FROM two WHERE c2 IS NOT NULL)
SELECT barcode, cid AS contig_id, aa AS cdr3, count AS reads FROM rows JOIN cr USING (barcode, cid) WHERE cell_type LIKE '%T' AND NOT regexp_matches(aa, '[_?]')""")
def tenx_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.tenx(_pair_report(spark, sf_dir), True).select("barcode", "contig_id", "cdr3", "reads")


@query(f"""WITH {_ORDERS}, {_CALLED.split(f'{_GENES},')[1].replace('g0', 'g0')},
two_rows AS (SELECT barcode, c1.cid AS cid FROM two WHERE c1.n >= 20 UNION ALL SELECT barcode, c2.cid FROM two WHERE c2.n >= 20),
keys AS (SELECT DISTINCT cr.barcode, cr.locus, cr.cdr3 FROM two_rows JOIN cr USING (barcode, cid)),
bc AS (SELECT * REPLACE (1.0::DOUBLE AS count) FROM (SELECT kept.*, row_number() OVER (PARTITION BY kept.locus, kept.cdr3, keys.barcode ORDER BY ordinal) AS r
  FROM kept JOIN keys ON keys.locus = kept.locus AND keys.cdr3 = kept.cdr3 AND keys.barcode = regexp_replace(kept.cid, '_[^_]*$', '')) WHERE r = 1),
{_report_sql('bc')}""".replace("frequency, cdr3 AS", "round(frequency, 9) AS frequency, cdr3 AS"))
def reported_barcode_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_cells(spark, sf_dir)
    cells = br.barcode_report(rows)
    parts = [cells.select("barcode", F.col(f"chain{s}").alias("x")).where(F.col("x.count") >= 20) for s in (1, 2)]
    seen = parts[0].unionByName(parts[1]).select("barcode", genes.locus(F.col("x.v"), F.col("x.j"), F.col("x.c"), genes.J_C_V).alias("locus"), F.col("x.cdr3nt").alias("cdr3"))
    return _rounded(report.clonotype_report(rows, by_barcode=True, reported=seen), "frequency")


# ---- diversity -----------------------------------------------------------------------------------

_DIVERSITY = """
w AS (SELECT chain, aa, sum(n) AS n FROM (
  SELECT l AS chain, cdr3aa AS aa, count AS n FROM y WHERE l IS NOT NULL UNION ALL SELECT split_part(c, '*', 1), cdr3aa, count FROM y WHERE l = 'IGH' AND split_part(c, '*', 1) IN ({iso})) GROUP BY chain, aa),
m AS (SELECT chain, sum(n)::BIGINT AS abundance, count(*) AS richness, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM w GROUP BY chain)
SELECT r::INT AS row, f.chain, coalesce(abundance, 0) AS abundance, coalesce(richness, 0) AS richness, round(richness / abundance * 1000, 9) AS cpk, round(h, 9) AS entropy,
  CASE WHEN richness > 1 THEN round(1 - h / ln(richness), 9) END AS clonality
FROM (SELECT unnest({rows}) AS chain, unnest(range(0, {n})) AS r) f LEFT JOIN m USING (chain)""".format(
    iso=", ".join(f"'{x}'" for x in genes.ISOTYPES), rows=str(diversity.ROWS), n=len(diversity.ROWS)
)


@query(f"""WITH {_CALLED}, {_report_sql('kept').rsplit('SELECT', 1)[0]},
z AS (SELECT floor(count)::BIGINT AS count, CASE WHEN score = 0 THEN 'partial' WHEN length(cdr3) % 3 <> 0 THEN 'out_of_frame' ELSE {_aa('cdr3')} END AS cdr3aa, v, j, c FROM t WHERE floor(count) > 0),
y AS (SELECT *, {_locus('coalesce(c, j, v)')} AS l FROM z WHERE NOT regexp_matches(cdr3aa, '[_?]') AND cdr3aa <> 'partial'), {_DIVERSITY}""")
def diversity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(diversity.diversity(report.clonotype_report(cdr3_rows(spark, sf_dir))), "cpk", "entropy", "clonality")


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS abundance, count(*) AS richness, round(count(*) / sum(n) * 1000, 9) AS cpk, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 9) AS entropy,
  CASE WHEN count(*) > 1 THEN round(1 - (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)), 9) END AS clonality FROM s GROUP BY user_id""")
def diversity_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    species = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(diversity.measures(species, ["user_id"]), "cpk", "entropy", "clonality")


# ---- reads and k-mers ----------------------------------------------------------------------------

_KMERS = f"""r AS ({READS_DUCK}),
k AS (SELECT id, barcode, pos, least(km, {_rc('km')}) AS kmer FROM (SELECT id, barcode, unnest(range(0, length(seq) - 20)) AS pos, seq FROM r WHERE length(seq) >= 21) q, LATERAL (SELECT substr(seq, pos + 1, 21) AS km))"""


@query(f"WITH {_KMERS} SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.kmer_count(reads(spark, sf_dir))


@query(f"WITH {_KMERS} SELECT barcode, kmer, count(*) AS n FROM k GROUP BY barcode, kmer")
def barcode_kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.kmer_count(reads(spark, sf_dir), by=["barcode"])


_STATS = f"""{_KMERS}, n AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer),
e AS (SELECT id, list_sort(list(n)) AS c FROM k JOIN n USING (kmer) GROUP BY id),
st AS (SELECT r.id, seq, CASE WHEN c IS NULL THEN CASE WHEN length(seq) < 21 THEN -1 ELSE -length(seq) END ELSE c[1] END AS min_cnt,
  CASE WHEN c IS NULL THEN CASE WHEN length(seq) < 21 THEN -1 ELSE -length(seq) END ELSE c[len(c) // 2 + 1] END AS median_cnt,
  (CASE WHEN c IS NULL THEN CASE WHEN length(seq) < 21 THEN -1 ELSE -length(seq) END ELSE list_sum(c) / len(c) END)::FLOAT AS avg_cnt
  FROM r LEFT JOIN e USING (id))"""


@query(f"WITH {_STATS} SELECT id, min_cnt, median_cnt, round(avg_cnt::DOUBLE, 4) AS avg_cnt FROM st")
def kmer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = kmers.read_stats(reads(spark, sf_dir), keep=["id"])
    return got.select("id", "min_cnt", "median_cnt", F.round(F.col("avg_cnt").cast("double"), 4).alias("avg_cnt"))


@query(f"""WITH r AS ({READS_DUCK}), u AS (SELECT seq, min(id) AS id, count(*) AS n FROM r GROUP BY seq)
SELECT id, n, row_number() OVER (ORDER BY n DESC, length(seq) DESC, seq, id) AS place FROM u""")
def sort_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the global order, by a range-partitioned sort and the partitions' sizes instead of one window over all rows."""
    u = reads(spark, sf_dir).groupBy("seq").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    from ..operators.ordering import with_place

    return with_place(u, [F.desc("n"), F.length("seq").desc(), F.asc("seq"), F.asc("id")], "place").select("id", "n", "place")


@query(f"""WITH r AS ({READS_DUCK}), b AS (SELECT *, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'C', '')) AS c, length(seq) - length(replace(seq, 'G', '')) AS g, length(seq) - length(replace(seq, 'T', '')) AS t, length(seq) AS n FROM r)
SELECT id, greatest(a, c, g, t) >= n // 2 OR 0 >= n // 10 OR (a <= 2)::INT + (c <= 2)::INT + (g <= 2)::INT + (t <= 2)::INT >= 2 AS low FROM b""")
def low_complexity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("id", dna.low_complexity(F.col("seq")).alias("low"))


@query(f"WITH r AS ({READS_DUCK}) SELECT id, {_rc('seq')} AS rc, {_aa('seq')} AS aa FROM r")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("id", dna.reverse_complement(F.col("seq")).alias("rc"), dna.translate_codons(F.col("seq")).alias("aa"))


_FORMAT = "bc:0:15,bc:32:40,um:16:25:-,r1:41:-1,r2:-30:-1"


@query(f"""WITH r AS ({READS_DUCK}) SELECT id, substr(seq, 1, 16) || substr(seq, 33, 9) AS bc, {_rc('substr(seq, 17, 10)')} AS um, substr(seq, 42) AS r1, right(seq, 30) AS r2 FROM r""")
def read_format_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_format.parse(_FORMAT)
    return reads(spark, sf_dir).select("id", *[read_format.extract(p, F.col("seq")).alias(k) for k, p in parts.items()])


@query(f"""WITH r AS ({READS_DUCK}) SELECT lang, CASE WHEN seq = '' THEN NULL END AS none, pos::INT AS pos, sum((b = 'A')::INT)::BIGINT AS a, sum((b = 'C')::INT)::BIGINT AS c, sum((b = 'G')::INT)::BIGINT AS g, sum((b = 'T')::INT)::BIGINT AS t
FROM (SELECT lang, seq, unnest(range(0, length(seq))) AS pos FROM r) q, LATERAL (SELECT substr(seq, pos + 1, 1) AS b) GROUP BY lang, none, pos""".replace("CASE WHEN seq = '' THEN NULL END AS none, ", "").replace("lang, none, pos", "lang, pos"))
def pile_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.pile_up(reads(spark, sf_dir), ["lang"])


@query("""WITH p AS (""" + SQL["pile_up"] + """), q AS (SELECT *, greatest(a, c, g, t) AS m FROM p)
SELECT lang, string_agg(CASE WHEN a = m THEN 'A' WHEN c = m THEN 'C' WHEN g = m THEN 'G' ELSE 'T' END, '' ORDER BY pos) AS consensus, sum(a + c + g + t)::BIGINT AS weight, min(a + c + g + t) < 1000 AS shallow FROM q GROUP BY lang""")
def consensus_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pileup.contigs(pileup.pile_up(reads(spark, sf_dir), ["lang"]), ["lang"])
    return got.select("lang", "consensus", "weight", (F.array_min(F.transform("pos_weight", lambda x: x["a"] + x["c"] + x["g"] + x["t"])) < 1000).alias("shallow"))


@query(f"WITH r AS ({READS_DUCK}) SELECT seq, string_agg(id, '|' ORDER BY doc_id, part) AS name, min(doc_id * 1000000 + part) AS ordinal FROM r GROUP BY seq")
def dedup_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select("seq", F.col("id").alias("name"), (F.col("doc_id") * 1_000_000 + F.col("part")).alias("ordinal"))
    return kmers.dedup_reference(rows)


# ---- barcodes ------------------------------------------------------------------------------------

_WHITE = "SELECT DISTINCT translate(lpad(CAST(c_custkey * 7 AS STRING), 10, '0'), '0123456789', 'ACGTACGTAC') AS barcode FROM {customer}"
_SEEN = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN overlay ELSE b END AS barcode FROM (SELECT o_orderkey, b, substr(b, 1, CAST(o_orderkey % 10 AS INT)) || 'G' || substr(b, CAST(o_orderkey % 10 + 2 AS INT)) AS overlay
FROM (SELECT o_orderkey, translate(lpad(CAST(o_custkey * 7 AS STRING), 10, '0'), '0123456789', 'ACGTACGTAC') AS b FROM {orders}))"""


@query(f"""WITH wl AS ({_WHITE.format(customer='customer')}), s AS ({_SEEN.format(orders='orders')}),
fr AS (SELECT wl.barcode, count(s.barcode) + 1 AS freq FROM wl LEFT JOIN s USING (barcode) GROUP BY wl.barcode),
nb AS (SELECT DISTINCT s.barcode, i, x, substr(s.barcode, 1, i) || base || substr(s.barcode, i + 2) AS cand FROM (SELECT DISTINCT barcode FROM s) s, (SELECT unnest(range(0, 10)) AS i), (VALUES (0, 'A'), (1, 'C'), (2, 'G'), (3, 'T')) v(x, base) WHERE substr(s.barcode, i + 1, 1) <> base),
b AS (SELECT nb.barcode, arg_min(cand, (-freq, i, x)) AS best FROM nb JOIN fr ON fr.barcode = nb.cand GROUP BY nb.barcode)
SELECT id, s.barcode, CASE WHEN fr.barcode IS NOT NULL THEN s.barcode ELSE best END AS corrected FROM s LEFT JOIN fr USING (barcode) LEFT JOIN b ON b.barcode = s.barcode""")
def barcode_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = spark.sql(_WHITE, customer=table(spark, sf_dir, "customer"))
    seen = spark.sql(_SEEN, orders=table(spark, sf_dir, "orders"))
    return barcodes.correct(seen, barcodes.whitelist_frequencies(seen, white, sample=None), qual=None).select("id", "barcode", "corrected")


@query("""WITH t AS (SELECT lpad(CAST(n_nationkey AS STRING), 2, '0') AS f, n_name AS n FROM nation), o AS (SELECT o_orderkey AS id, lpad(CAST(o_orderkey % 9000 AS STRING), 4, '0') AS barcode FROM orders)
SELECT id, barcode, CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN a.n || '-' || b.n END AS translated FROM o LEFT JOIN t a ON a.f = substr(barcode, 1, 2) LEFT JOIN t b ON b.f = substr(barcode, 3, 2)""")
def barcode_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("from"), F.col("n_name").alias("to"))
    seen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lpad((F.col("o_orderkey") % 9000).cast("string"), 4, "0").alias("barcode"))
    return barcodes.translated(seen, names, 2).select("id", "barcode", "translated")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 20)")
def thin_barcode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes.drop_thin_barcodes(table(spark, sf_dir, "events"), 20, "user_id").select("event_id", "user_id")


@query("SELECT l_suppkey, count(DISTINCT CASE WHEN l_linenumber < 5 THEN l_partkey END) + count(DISTINCT CASE WHEN l_linenumber >= 5 THEN l_orderkey END) AS n FROM lineitem GROUP BY l_suppkey")
def umi_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("umi", F.when(F.col("l_linenumber") < 5, F.col("l_partkey")))
    return barcodes.umi_count(rows, ["l_suppkey"], "umi", "l_orderkey")


@query()
def em_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    compat = e.select((F.col("user_id") % 50).alias("contig"), F.col("event_id").alias("read"), "event_type").withColumn("variant", F.explode(F.when(F.col("read") % 3 == 0, F.array("event_type")).otherwise(F.array("event_type", F.lit("other")))))
    return em.abundances(compat)


# ---- clusters, intervals, AIRR, alignments ---------------------------------------------------------

from ..operators import airr, cluster, intervals  # noqa: E402

_NODES = "SELECT c_mktsegment AS v, CAST(c_nationkey AS STRING) AS j, translate(lpad(CAST(c_custkey * 7 AS STRING), 10, '0'), '0123456789', 'ACGTACGTAC') AS cdr3, c_custkey AS id, c_acctbal AS amount FROM {customer}"


@query(f"""WITH RECURSIVE n AS ({_NODES.format(customer='customer')}), d AS (SELECT DISTINCT v, j, cdr3 FROM n),
e AS (SELECT a.v, a.j, a.cdr3 AS a, b.cdr3 AS b FROM d a JOIN d b USING (v, j) WHERE hamming(a.cdr3, b.cdr3) <= 2),
r(v, j, a, b) AS (SELECT * FROM e UNION SELECT r.v, r.j, r.a, e.b FROM r JOIN e ON r.v = e.v AND r.j = e.j AND r.b = e.a)
SELECT id, n.v || '|' || n.j || '|10|' || m AS cluster FROM n JOIN (SELECT v, j, a, min(b) AS m FROM r GROUP BY v, j, a) x ON x.v = n.v AND x.j = n.j AND x.a = n.cdr3""")
def hamming_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_NODES, customer=table(spark, sf_dir, "customer"))
    return cluster.single_linkage(rows, 0.8).select("id", "cluster")


@query()
def center_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.centers(spark.sql(_NODES, customer=table(spark, sf_dir, "customer")), 0.8, amount="amount")


@query(f"""WITH n AS ({_NODES.format(customer='customer')}), s AS (SELECT v, cdr3, sum(amount) AS a FROM n GROUP BY v, cdr3)
SELECT v, arg_min(cdr3, (-a, cdr3)) AS cdr3, round(max(a), 6) AS amount FROM s GROUP BY v""")
def cluster_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_NODES, customer=table(spark, sf_dir, "customer"))
    return _rounded(cluster.representatives(rows, "v", amount="amount"), "amount", digits=6)


@query("""WITH a AS (SELECT event_id, user_id % 50 AS chrom, floor(epoch(ts) / 60)::BIGINT AS start, floor(epoch(ts) / 60)::BIGINT + event_id % 90 AS stop FROM events),
g AS (SELECT user_id % 50 AS chrom, floor(epoch(ts) / 60)::BIGINT + 40 AS start, floor(epoch(ts) / 60)::BIGINT + 60 AS stop FROM events WHERE event_type = 'purchase')
SELECT event_id, chrom, start, stop AS "end" FROM a WHERE EXISTS (SELECT 1 FROM g WHERE g.chrom = a.chrom AND a.start <= g.stop AND a.stop > g.start)""")
def interval_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 60)
    rows = e.select("event_id", (F.col("user_id") % 50).alias("chrom"), at.alias("start"), (at + F.col("event_id") % 90).alias("end"))
    found = e.where("event_type = 'purchase'").select((F.col("user_id") % 50).alias("chrom"), (at + 40).alias("start"), (at + 60).alias("end"))
    return intervals.overlapping(rows, found, ["event_id"], 1440)


_CONTIG = "translate(md5('c' || CAST(ordinal % 900 AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""WITH {_CALLED}, k AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY ordinal) - 1 AS i FROM kept),
x AS (SELECT cid, min_by({_CONTIG}, ordinal) || min_by({_CONTIG}, ordinal) AS seq FROM kept GROUP BY cid)
SELECT cid || '_' || i AS sequence_id, substr(seq, 1, 20) || cdr3 || substr(seq, 42) AS sequence,
  CASE WHEN length(cdr3) % 3 <> 0 OR regexp_matches({_aa('cdr3')}, '[_?]') THEN 'F' ELSE 'T' END AS productive,
  CASE WHEN length(cdr3) % 3 <> 0 OR regexp_matches({_aa('cdr3')}, '[_?]') THEN '' ELSE {_aa('cdr3')} END AS junction_aa, count AS consensus_count
FROM k JOIN x USING (cid)""")
def airr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = report.error_filter(report.with_genes(cdr3_rows(spark, sf_dir)))
    hits = "array<struct<gene:string,ref_len:int,read_start:int,read_end:int,ref_start:int,ref_end:int,similarity:double>>"
    # the contig is made of the first ordinal: once a contig, and nothing but numbers in the aggregate
    ann = kept.groupBy("cid").agg(F.min("ordinal").alias("ordinal")).select("cid", F.repeat(F.expr(_CONTIG), F.lit(2)).alias("seq")).withColumns(
        {"cdr3": F.struct(F.lit(20).alias("start"), F.lit(40).alias("end"), F.lit(100.0).alias("score")), **{f"cdr{k}": F.struct(F.lit("A").alias("seq")) for k in (1, 2)}, **{g: F.array().cast(hits) for g in "vdjc"}}
    )
    got = airr.rearrangements(kept.withColumnRenamed("cdr3", "cdr3nt"), ann)
    return got.select("sequence_id", "sequence", "productive", "junction_aa", "consensus_count")


@query("""SELECT max(l_quantity)::BIGINT AS longest, avg(l_linenumber) > 3.5 AS late FROM lineitem""")
def library_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.when(F.col("l_linenumber") > 3, 1).otherwise(0).alias("flag"), F.repeat(F.lit("A"), F.col("l_quantity").cast("int")).alias("seq"),
        F.lit(0).alias("pos"), F.col("l_partkey").cast("int").alias("mate_pos"), F.lit(True).alias("same_chrom"),
    )
    return intervals.library_profile(rows, None).select(F.col("max_len").cast("bigint").alias("longest"), F.col("paired").alias("late"))


SQL["library_facts"] = "SELECT max(l_quantity)::BIGINT AS longest, avg(CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END) > 0.5 AS late FROM lineitem"


@query(f"""WITH {_CALLED}, k AS (SELECT * FROM kept WHERE locus IS NOT NULL),
o AS (SELECT *, first_value(locus) OVER (PARTITION BY regexp_replace(cid, '_[^_]*$', '') ORDER BY count DESC, cdr3, v NULLS FIRST, j NULLS FIRST, cid) AS l0 FROM k),
s AS (SELECT *, CASE WHEN locus LIKE 'IG%' THEN 0 WHEN locus IN ('TRA', 'TRB') THEN 1 ELSE 2 END AS t, CASE WHEN l0 LIKE 'IG%' THEN 0 WHEN l0 IN ('TRA', 'TRB') THEN 1 ELSE 2 END AS t0 FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(cid, '_[^_]*$', ''), locus IN ('IGH', 'TRB', 'TRD') ORDER BY count DESC, cdr3, v NULLS FIRST, j NULLS FIRST, cid) AS r FROM s WHERE t = t0)
SELECT regexp_replace(cid, '_[^_]*$', '') AS cell, cid, cdr3 AS cdr3nt, count, r::INT AS rank FROM p WHERE r <= 2""")
def top_n_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = report.error_filter(report.with_genes(cdr3_rows(spark, sf_dir))).withColumn("cell", genes.barcode_of(F.col("cid"))).withColumnRenamed("cdr3", "cdr3nt")
    return report.top_per_cell(kept, 2).select("cell", "cid", "cdr3nt", "count", "rank")


@query("""WITH h AS (SELECT l_orderkey AS contig, l_partkey % 40 AS gene, l_quantity AS weight, l_linenumber + 10 AS length, ordinal FROM (SELECT *, l_linenumber AS ordinal FROM lineitem)),
b AS (SELECT contig, min(gene) AS gene, any_value(weight) AS w FROM h GROUP BY contig), a AS (SELECT h.gene, sum(weight / length) AS abundance FROM h GROUP BY gene),
e AS (SELECT contig, gene, 0 AS o FROM b UNION ALL SELECT contig, gene, 1 + gene FROM h)
SELECT contig, arg_max(gene, (round(abundance, 6), -o)) AS gene FROM e JOIN a USING (gene) GROUP BY contig""")
def gene_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contig"), (F.col("l_partkey") % 40).alias("gene"), F.col("l_quantity").alias("weight"), (F.col("l_linenumber") + 10).alias("length"))
    best = h.groupBy("contig").agg(F.min("gene").alias("gene")).withColumn("type", F.lit("V"))
    equals = h.select("contig", F.lit("V").alias("type"), "gene", F.col("gene").alias("ordinal"))
    return pileup.break_ties(best, equals, _rounded(pileup.gene_abundance(h), "abundance", digits=6)).select("contig", "gene")


# ---- reference hits --------------------------------------------------------------------------------

from ..operators import chains, mates, reference  # noqa: E402

_REF = "SELECT item_id AS gene_idx, translate(regexp_replace(lower(text), '[^a-z]', ''{all}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM {benchmark}"


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REF.replace("{all}", ""), benchmark=table(spark, sf_dir, "benchmark"))


_HITS = f"""r AS ({READS_DUCK}), ref AS ({_REF.format(all=", 'g'", benchmark='benchmark')}),
rk AS (SELECT gene_idx AS gene, pos, substr(seq, pos + 1, 9) AS km FROM (SELECT *, unnest(range(0, length(seq) - 8)) AS pos FROM ref)),
st AS (SELECT id, 1 AS strand, seq FROM r UNION ALL SELECT id, -1, {_rc('seq')} FROM r),
qk AS (SELECT id, strand, pos, substr(seq, pos + 1, 9) AS km FROM (SELECT *, unnest(range(0, length(seq) - 8)) AS pos FROM st WHERE length(seq) >= 9))"""


@query(f"WITH {_HITS} SELECT id, strand, gene, count(DISTINCT qk.pos) AS n FROM qk JOIN rk USING (km) GROUP BY id, strand, gene HAVING count(DISTINCT qk.pos) + 8 >= 27")
def hit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reference.candidate_hits(reads(spark, sf_dir), _reference(spark, sf_dir), 27)
    return reference.candidates(found, 27)


@query(f"""WITH {_HITS}, h AS (SELECT id, strand, gene, qk.pos AS q, rk.pos AS g, rk.pos - qk.pos AS d FROM qk JOIN rk USING (km)),
c AS (SELECT id, strand, gene FROM h GROUP BY ALL HAVING count(DISTINCT q) + 8 >= 27),
m AS (SELECT id, strand, gene, arg_max(d, (n, -d)) AS main FROM (SELECT id, strand, gene, d, count(*) AS n FROM h JOIN c USING (id, strand, gene) GROUP BY ALL) GROUP BY ALL),
n AS (SELECT DISTINCT id, strand, gene, q, g FROM h JOIN m USING (id, strand, gene) WHERE abs(d - main) <= 10),
a AS (SELECT id, strand, gene, sum(least(9, q - coalesce(p, -1000000))) AS len FROM (SELECT *, lag(q) OVER (PARTITION BY id, strand, gene ORDER BY q) AS p FROM (SELECT DISTINCT id, strand, gene, q FROM n)) GROUP BY ALL),
b AS (SELECT id, strand, gene, sum(least(9, g - coalesce(p, -1000000))) AS len FROM (SELECT *, lag(g) OVER (PARTITION BY id, strand, gene ORDER BY g) AS p FROM (SELECT DISTINCT id, strand, gene, g FROM n)) GROUP BY ALL),
z AS (SELECT id, strand, gene, least(a.len, b.len)::INT AS length FROM a JOIN b USING (id, strand, gene) WHERE least(a.len, b.len) >= 27)
SELECT id, strand, gene, length FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length DESC, strand DESC, gene) AS r FROM z) WHERE r = 1""")
def hit_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.read_hits(reads(spark, sf_dir), _reference(spark, sf_dir), 27)


@query()
def hit_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of every read's hits with the stand-in genes, at the operator's own k-mer length."""
    return chains.read_chains(reads(spark, sf_dir), _reference(spark, sf_dir))


@query()
def mate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 150 bases that overlap the next 100 of their document by construction, as pairs."""
    r = reads(spark, sf_dir)
    nxt = r.select("doc_id", (F.col("part") - 1).alias("part"), F.col("seq").alias("n"))
    both = F.concat("seq", "n")
    pairs = r.join(nxt, ["doc_id", "part"]).where(F.length(both) >= 200).select(
        "id", "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"), dna.reverse_complement(F.substr(both, F.lit(101), F.lit(100))).alias("seq_2"), F.repeat(F.lit("I"), F.lit(100)).alias("qual_2")
    )
    return mates.resolve_pairs(pairs).select("id", "seq", "merged")


# ---- assembly and annotation -----------------------------------------------------------------------

from ..operators import annotate, assemble  # noqa: E402


@query()
def assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of each document's reads: the document stands for the barcode."""
    r = reads(spark, sf_dir).select(F.col("doc_id").cast("string").alias("cell"), "id", "seq", F.lit(1).alias("min_cnt"), F.lit(1).alias("median_cnt"), F.lit(1.0).alias("avg_cnt"))
    return assemble.assemble(r, ["cell"], assemble.BARCODE_OVERLAP, True, weights=False).select("cell", "contig", "consensus", "n_reads")


def _annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reads annotated with the benchmark passages as genes of one locus, and these genes."""
    kind = F.when(F.col("gene_idx") % 2 == 0, "V").otherwise("J")
    none = F.lit(None).cast("struct<a:int,b:int>")
    ref = _reference(spark, sf_dir).select(
        "gene_idx", F.concat(F.lit("IGH"), kind, F.col("gene_idx").cast("string")).alias("name"), "seq", kind.alias("gene_type"), F.lit("IGH").alias("locus"),
        none.alias("cdr1"), none.alias("cdr2"), F.lit(None).cast("int").alias("cdr3_start"), F.lit(None).cast("int").alias("j_end"),
    )
    return annotate.annotate(reads(spark, sf_dir).select(F.col("id").alias("cid"), "seq"), ref), ref


@query()
def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene hits of reads."""
    got, _ = _annotated(spark, sf_dir)
    first = lambda c: F.get(c, F.lit(0))
    return got.select("cid", *[first(c).gene.alias(f"{c}_gene") for c in "vj"], *[first(c).read_start.alias(f"{c}_start") for c in "vj"])


@query()
def alignment_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cigars and alignments of the reads that have a hit."""
    got, ref = _annotated(spark, sf_dir)
    hit = got.where((F.size("v") > 0) | (F.size("j") > 0))
    return airr.alignments(hit, ref).select("cid", "v_cigar", "j_cigar", "sequence_alignment", "germline_alignment")


# ---- contained contigs and mate edges ----------------------------------------------------------------

from ..operators import contained as inside  # noqa: E402

_PIECES = """SELECT cid, seq FROM (SELECT CAST(gene_idx AS STRING) AS cid, seq FROM ref UNION ALL SELECT concat(CAST(gene_idx AS STRING), 'p'), concat(substr(seq, 8, 30), 'A', substr(seq, 39, 20)) FROM ref
UNION ALL SELECT concat(CAST(gene_idx AS STRING), 'q'), concat(substr(seq, 3, 20), 'AA', substr(seq, 25, 30)) FROM ref)"""


@query(f"""WITH ref AS ({_REF.format(all=", 'g'", benchmark='benchmark')}), s AS ({_PIECES}),
p AS (SELECT a.cid, b.cid AS host, a.seq, b.seq AS h, unnest(range(0, length(b.seq) - length(a.seq) + 1)) AS pl FROM s a JOIN s b ON a.cid <> b.cid AND length(b.seq) > length(a.seq) AND length(a.seq) >= 30)
SELECT DISTINCT cid, host FROM p WHERE hamming(seq, substr(h, pl + 1, length(seq))) <= 1""")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = spark.sql(_PIECES.replace("FROM ref", "FROM {ref}"), ref=_reference(spark, sf_dir))
    return inside.contained(pieces)


# ---- mates ------------------------------------------------------------------------------------------


@query(f"""WITH r AS ({READS_DUCK}), f AS (SELECT doc_id, part // 2 AS pair, max(CASE WHEN part % 2 = 0 THEN seq END) AS a, max(CASE WHEN part % 2 = 1 THEN seq END) AS b FROM r GROUP BY doc_id, part // 2)
SELECT doc_id, pair, a AS seq1, {_rc('b')} AS seq2 FROM f""")
def mate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads of each document, two by two; a last one without a mate stays alone."""
    name = F.struct("doc_id", F.expr("part div 2").alias("pair"))
    rows = reads(spark, sf_dir).select(name.alias("name"), F.when(F.col("part") % 2 == 0, F.lit(0x41)).otherwise(0x91).alias("flag"), "seq", F.lit(None).cast("string").alias("qual"))
    return intervals.pairs_of_candidates(rows, rows).select("name.doc_id", "name.pair", "seq1", "seq2")


@query("""WITH p AS (SELECT o_orderkey AS fragment, o_custkey % 60 AS contig, o_orderkey % 100 AS off FROM orders UNION ALL SELECT l_orderkey, l_suppkey % 60, l_linenumber FROM lineitem)
SELECT a.contig AS src, b.contig AS dst, count(*) AS n, min(a.off) AS first, max(a.off) AS last FROM p a JOIN p b USING (fragment) WHERE a.contig <> b.contig GROUP BY a.contig, b.contig""")
def mate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and every one of its lines is a placement."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fragment"), (F.col("o_custkey") % 60).alias("contig"), (F.col("o_orderkey") % 100).alias("offset"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fragment"), (F.col("l_suppkey") % 60).alias("contig"), F.col("l_linenumber").cast("bigint").alias("offset"))
    return inside.mate_edges(o.unionByName(li))


@query("""WITH p AS (SELECT o_orderkey AS fragment, 1 AS strand, o_custkey % 60 AS cid, o_orderkey % 100 AS off, 100 AS len, CAST(o_custkey % 4 AS INT) AS rank FROM orders
  UNION ALL SELECT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE -1 END, l_suppkey % 60, l_linenumber * 20, 60 + l_linenumber, CASE WHEN l_partkey % 5 > 0 THEN CAST(l_partkey % 4 AS INT) END FROM lineitem),
f AS (SELECT a.cid AS src, b.cid AS dst, a.fragment, min(a.off) AS sa, max(a.off + a.len) AS sb, min(b.off) AS da, max(b.off + b.len) AS db
  FROM p a JOIN p b ON a.fragment = b.fragment AND a.strand = 1 AND b.strand = -1 AND a.cid <> b.cid WHERE coalesce(a.rank <= b.rank, TRUE) GROUP BY ALL),
e AS (SELECT src, dst, count(*) AS n, max(sb) - min(sa) AS src_span, max(db) - min(da) AS dst_span FROM f GROUP BY src, dst),
s AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY src_span DESC, n DESC, dst) AS r FROM (SELECT *, max(n) OVER (PARTITION BY src) AS m FROM e) WHERE n >= m * 0.9),
d AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY dst_span DESC, n DESC, src) AS r FROM (SELECT *, max(n) OVER (PARTITION BY dst) AS m FROM e) WHERE n >= m * 0.9)
SELECT s.src, s.dst, s.n FROM s JOIN d ON s.src = d.src AND s.dst = d.dst WHERE s.r = 1 AND d.r = 1""")
def mate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links among 60 contigs of all orders and lines as placements."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fragment"), F.lit(1).alias("strand"), (F.col("o_custkey") % 60).alias("cid"), (F.col("o_orderkey") % 100).alias("offset"), F.lit(100).alias("length"), (F.col("o_custkey") % 4).cast("int").alias("rank"))
    part = F.col("l_partkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fragment"), F.when(part % 3 == 0, 1).otherwise(-1).alias("strand"), (F.col("l_suppkey") % 60).alias("cid"), (F.col("l_linenumber") * 20).cast("bigint").alias("offset"), (F.col("l_linenumber") + 60).cast("int").alias("length"), F.when(part % 5 > 0, (part % 4).cast("int")).alias("rank"))
    return scaffold.links(scaffold.edges(o.unionByName(li)))


# ---- filters by gene hits, junctions, motifs -----------------------------------------------------------

from ..operators import filters, prepare, scaffold  # noqa: E402

_HIT_ROWS = """SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS INT) AS q, l_partkey % 5 <> 0 AS has_v, l_suppkey % 3 <> 0 AS has_j, l_orderkey % 4 <> 0 AS has_c,
  CAST(l_partkey % 40 AS INT) AS va, CAST(l_partkey % 40 + 60 AS INT) AS vb, CAST(l_suppkey % 30 AS INT) AS vr, CAST(90 + l_quantity AS INT) AS ja, CAST(120 + l_quantity AS INT) AS jb,
  CAST(l_linenumber * 3 AS INT) AS jr, CAST(115 + l_partkey % 50 AS INT) AS ca, CAST(170 + l_quantity AS INT) AS cb, CAST(l_orderkey % 260 AS INT) AS cr FROM {lineitem}"""


def _hit(kind: str) -> Column:
    start, end, ref = F.col(f"{kind}a"), F.col(f"{kind}b"), F.col(f"{kind}r")
    fields = F.struct(F.lit(kind).alias("gene"), F.lit(100).alias("ref_len"), start.alias("read_start"), end.alias("read_end"), ref.alias("ref_start"), (ref + end - start).alias("ref_end"), F.lit(100.0).alias("similarity"))
    return F.when(F.col(f"has_{kind}"), fields)


@query(f"""WITH h AS ({_HIT_ROWS.format(lineitem='lineitem')})
SELECT o, n, p, q,
  (has_v AND has_j AND vb - 10 > ja) OR (has_v AND has_c AND vb - 10 > ca) OR (has_j AND has_c AND jb - 10 > ca) AS wrong_order,
  NOT has_v AND NOT has_j AND has_c AND (cr >= 200 OR (cr >= 100 AND (q % 2 = 0 OR ca > 0 OR cb < 249))) AS constant_only,
  q < 31 AS too_short,
  has_v AND has_j AND has_c AND vb <= ja + 3 AND jb <= ca + 6 AND vr <= 10 AND cr <= 10 AS full_length,
  has_v AND has_j AND vb <= ja + 3 AND vr = 0 AND vb >= 80 AND ja <= 130 AND jr + jb - ja >= 99 AS complete_vdj,
  CASE WHEN has_v AND has_j AND has_c THEN vb <= ja AND jb <= ca + 6 AND vr + vb - va >= 49 AND jr <= 51 AND jr + jb - ja >= 80 AND cr <= 20 ELSE q >= 25 END AS plausible FROM h""")
def hit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters that look at a read's or contig's gene hits, over hits made of every line."""
    rows = spark.sql(_HIT_ROWS, lineitem=table(spark, sf_dir, "lineitem"))
    v, j, c = _hit("v"), _hit("j"), _hit("c")
    text = F.repeat(F.lit("A"), 250)
    cdr3 = F.struct(F.lit(80).alias("start"), F.lit(130).alias("end"), F.when(F.col("q") >= 25, 100.0).otherwise(50.0).alias("score"), F.repeat(F.lit("A"), 51).alias("seq"))
    return rows.select(
        "o", "n", "p", "q", filters.wrong_order([v, j, c]).alias("wrong_order"), filters.constant_only(v, j, c, F.lit(250), F.when(F.col("q") % 2 == 0, 1).otherwise(-1)).alias("constant_only"),
        filters.too_short(F.col("q"), 100).alias("too_short"), filters.full_length(v, j, c, text).alias("full_length"), filters.complete_vdj(v, j, cdr3, text).alias("complete_vdj"),
        filters.plausible(v, j, c, cdr3).alias("plausible"),
    )


@query(f"""WITH h AS (SELECT *, 88 + q % 13 AS sim, substr(repeat('ACGTTGCATC', 30), 1, 150 + (p % 100)::INT) AS seq FROM ({_HIT_ROWS.format(lineitem='lineitem')})),
g AS (SELECT *, length(seq) AS len FROM h WHERE NOT ((has_v AND has_j AND vb - 10 > ja) OR (has_v AND has_c AND vb - 10 > ca) OR (has_j AND has_c AND jb - 10 > ca))
  AND NOT (NOT has_v AND NOT has_j AND has_c AND (cr >= 200 OR (cr >= 100 AND (q % 2 = 0 OR ca > 0 OR cb < length(seq) - 1))))),
f AS (SELECT *, CASE WHEN has_v AND (vr < 31 AND sim > 90 OR sim > 95 AND vr <= 100 / 3.0) THEN va ELSE 0 END AS cut_front FROM g),
m AS (SELECT *, len - cut_front AS n1,
  CASE WHEN has_v AND vb - cut_front >= 0 AND va - cut_front < len - cut_front THEN greatest(va - cut_front, 0) END AS v1, CASE WHEN has_v THEN least(vb - cut_front, len - cut_front - 1) END AS v2,
  CASE WHEN has_j AND jb - cut_front >= 0 AND ja - cut_front < len - cut_front THEN greatest(ja - cut_front, 0) END AS j1, least(jb - cut_front, len - cut_front - 1) AS j2,
  CASE WHEN has_c AND cb - cut_front >= 0 AND ca - cut_front < len - cut_front THEN greatest(ca - cut_front, 0) END AS c1, least(cb - cut_front, len - cut_front - 1) AS c2 FROM f),
b AS (SELECT *, CASE WHEN c1 IS NOT NULL AND cr < 9 AND sim > 95 AND n1 - c2 - 1 > 0 AND NOT coalesce(j1 + n1 - c2 - 1 >= n1, false) AND NOT coalesce(v1 + n1 - c2 - 1 >= n1, false) THEN n1 - c2 - 1 ELSE 0 END AS cut_back FROM m),
z AS (SELECT *, n1 - cut_back AS n2 FROM b)
SELECT o, n, p, q, cut_front, cut_back, substr(seq, cut_front + 1, n2) AS seq, CASE WHEN v1 < n2 THEN v1 END AS v_start, CASE WHEN v1 < n2 THEN least(v2, n2 - 1) END AS v_end,
  CASE WHEN j1 < n2 THEN j1 END AS j_start, CASE WHEN j1 < n2 THEN least(j2, n2 - 1) END AS j_end, CASE WHEN cut_back = 0 THEN c1 END AS c_start, CASE WHEN cut_back = 0 AND c1 IS NOT NULL THEN c2 END AS c_end
FROM z WHERE n2 >= 31""")
def read_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, trimming and moved coordinates, over hits made of every line."""
    rows = spark.sql(_HIT_ROWS, lineitem=table(spark, sf_dir, "lineitem"))
    similar = (88 + F.col("q") % 13).cast("double")
    rows = rows.select(
        "o", "n", "p", "q", F.substr(F.lit("ACGTTGCATC" * 30), F.lit(1), (150 + F.col("p") % 100).cast("int")).alias("seq"), F.when(F.col("q") % 2 == 0, 1).otherwise(-1).alias("strand"),
        *[F.when(_hit(k).isNotNull(), _hit(k).withField("similarity", similar)).alias(k) for k in "vjc"],
    )
    return prepare.prepared(rows).select("o", "n", "p", "q", "cut_front", "cut_back", "seq", *[F.col(f"{k}.read_{e}").alias(f"{k}_{e}") for k in "vjc" for e in ("start", "end")])


@query(f"""WITH h AS ({_HIT_ROWS.format(lineitem='lineitem')}), x AS (SELECT *, p % 2 = 0 AS with_d, vb + 3 AS da, vb + 3 + n AS db, 80 AS s, 130 AS e FROM h)
SELECT o, n, p, q, CASE WHEN has_v AND has_j AND vb < ja AND vb >= s AND ja <= e THEN
  concat_ws(',', vb - s, 99 - (vr + vb - va), CASE WHEN with_d AND db < ja THEN (da - vb - 1)::VARCHAR WHEN NOT with_d THEN (ja - vb - 1)::VARCHAR ELSE '*' END,
    CASE WHEN with_d AND db < ja THEN concat_ws(',', 2, da - s, db - s, 99 - 2 - n, ja - db - 1) ELSE '*,*,*,*,*' END, jr, ja - s) END AS junction FROM x""")
def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_HIT_ROWS, lineitem=table(spark, sf_dir, "lineitem"))
    d = F.struct(F.lit(100).alias("ref_len"), (F.col("vb") + 3).alias("read_start"), (F.col("vb") + 3 + F.col("n")).alias("read_end"), F.lit(2).alias("ref_start"), (F.col("n") + 2).alias("ref_end"))
    return rows.select("o", "n", "p", "q", fcdr3.junction(_hit("v"), d, _hit("j"), F.lit(80), F.lit(130), F.col("p") % 2 == 0).alias("junction"))


@query(f"""WITH r AS ({READS_DUCK}), f AS (SELECT id, seq, {_aa('seq')} AS a, {_aa('substr(seq, 2)')} AS b, {_aa('substr(seq, 3)')} AS c, regexp_replace(seq, 'GTG', 'NNNNNNNN', 'g') AS parted FROM r)
SELECT id, contains(a, 'YYC') OR contains(b, 'YYC') OR contains(c, 'YYC') AS v_motif, regexp_matches(a, '[FW]G.G') OR regexp_matches(b, '[FW]G.G') OR regexp_matches(c, '[FW]G.G') AS j_motif,
  array_to_string(regexp_split_to_array(parted, 'N{{7,}}'), '|') AS pieces, length(seq) - length(replace(seq, 'G', '')) AS n_g FROM f""")
def read_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs of V and J genes in the three frames, and the pieces between runs of N that stand for a frequent triple."""
    s = F.col("seq")
    v, j = dna.motif_frames(s)
    return reads(spark, sf_dir).select("id", v.alias("v_motif"), j.alias("j_motif"), F.array_join(dna.n_runs(F.regexp_replace(s, "GTG", "NNNNNNNN")), "|").alias("pieces"), dna.count_base(s, "G").alias("n_g"))


@query("""WITH x AS (SELECT o_orderkey AS id, substr('ACGTN', (o_orderkey % 5)::INT + 1, 1) AS base, (o_custkey % 7)::INT AS a, (o_orderkey % 11)::INT AS c, (o_custkey % 3)::INT AS g, 0 AS t, 'r' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '/1' WHEN o_orderkey % 3 = 1 THEN '/2' ELSE '/3' END AS name FROM orders)
SELECT id, base = 'N' OR a + c + g + t = 0 OR CASE base WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END * 3 > a + c + g + t AS fits, regexp_replace(name, '/[12]$', '') AS mate_name, left(name, -2) AS short_name FROM x""")
def base_and_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.substr(F.lit("ACGTN"), (F.col("o_orderkey") % 5).cast("int") + 1, F.lit(1)).alias("base"),
        F.struct((F.col("o_custkey") % 7).cast("int").alias("a"), (F.col("o_orderkey") % 11).cast("int").alias("c"), (F.col("o_custkey") % 3).cast("int").alias("g"), F.lit(0).alias("t")).alias("w"),
        F.concat(F.lit("r"), F.col("o_custkey").cast("string"), F.element_at(F.array(F.lit("/1"), F.lit("/2"), F.lit("/3")), (F.col("o_orderkey") % 3).cast("int") + 1)).alias("name"),
    )
    return rows.select("id", pileup.base_compatible(F.col("w"), F.col("base")).alias("fits"), read_format.read_name(F.col("name")).alias("mate_name"), read_format.read_name(F.col("name"), 2).alias("short_name"))
