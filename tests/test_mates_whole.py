"""The whole mate queries take every read and every line."""

from pyspark.sql import functions as F

from immunospark.plans.queries import QUERIES
from immunospark.plans.standins import reads, table

SF = "/root/testdata/sf0.001"


def test_every_read_is_in_a_pair(spark):
    got = QUERIES["mate_pairs"](spark, SF).select(F.sum(F.length("seq1")), F.sum(F.length("seq2"))).first()
    assert got[0] + got[1] == reads(spark, SF).select(F.sum(F.length("seq"))).first()[0]


def test_every_line_is_a_placement(spark):
    last = QUERIES["mate_edges"](spark, SF).agg(F.sum("n")).first()[0]
    rows = [(r[0], r[1] % 60) for t, k, c in (("orders", "o_orderkey", "o_custkey"), ("lineitem", "l_orderkey", "l_suppkey")) for r in table(spark, SF, t).select(k, c).collect()]
    by = {}
    for f, c in rows:
        by.setdefault(f, []).append(c)
    assert last == sum(a != b for cs in by.values() for a in cs for b in cs)
