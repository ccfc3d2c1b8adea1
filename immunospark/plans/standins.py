"""Domain tables made from the generic test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DNA = ("ACGT" * 7)[:26]
_HEX, _HEX_DNA = "0123456789abcdef", "ACGT" * 4


def _locus(key: str) -> str:
    names = ["IGH", "IGK", "IGL", "TRA", "TRB", "TRG", "TRD"]
    return "CASE " + " ".join(f"WHEN {key} % 9 = {i} THEN '{x}'" for i, x in enumerate(names)) + f" WHEN {key} % 9 = 7 THEN 'TRB' ELSE '*' END"


def _dna(key: str, length: str) -> str:
    return f"substr(translate(md5(CAST({key} AS STRING)), '{_HEX}', '{_HEX_DNA}'), 1, CAST({length} AS INT))"


#: Rows like those of the CDR3 table: barcodes by supplier, contigs by order, genes and sequences by part.
CDR3 = f"""
SELECT ordinal, cid, idx,
  CASE WHEN loc = '*' OR p % 17 = 0 THEN '*' WHEN p % 10 = 3 THEN loc || 'V' || vn || '*01,' || loc || 'V9*01' ELSE loc || 'V' || vn || '*01' END AS v,
  CASE WHEN loc IN ('IGH', 'TRB', 'TRD') AND p % 3 > 0 THEN loc || 'D1*01' ELSE '*' END AS d,
  CASE WHEN loc = '*' OR p % 19 = 0 THEN '*' ELSE loc || 'J' || CAST(p % 3 + 1 AS STRING) || '*02' END AS j,
  CASE WHEN loc = '*' OR p % 4 = 0 THEN '*' WHEN loc = 'IGH' AND p % 4 = 1 THEN 'IGHM' WHEN loc = 'IGH' AND p % 5 = 1 THEN 'IGHG1*01' WHEN loc = 'IGH' THEN 'IGHA2' WHEN loc = 'IGL' THEN 'IGLC2*01' ELSE loc || 'C1' END AS c,
  '*' AS cdr1, '*' AS cdr2,
  'TGT' || {_dna('p % 1500', '14 + (p % 1500) % 17')} || CASE WHEN p % 1500 % 7 = 0 THEN 'N' ELSE 'T' END || 'GG' AS cdr3,
  CAST(CASE WHEN p % 11 = 0 THEN 0 WHEN p % 13 = 0 THEN 0.01 ELSE 1 END AS DOUBLE) AS score,
  cnt AS count, CAST(80 + p % 20 AS DOUBLE) AS germline_similarity, CAST(o % 2 AS INT) AS complete_vdj
FROM (
  SELECT (((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS ordinal, l_linenumber AS idx, l_partkey AS p, l_orderkey AS o,
    'B' || CAST(l_suppkey AS STRING) || '_' || CAST(l_orderkey % 500 AS STRING) AS cid,
    CASE WHEN l_linenumber = 7 THEN l_quantity / 64 ELSE l_quantity END AS cnt,
    {_locus('(l_suppkey + l_linenumber % 3)')} AS loc, CAST(l_partkey % 5 + 1 AS STRING) AS vn
  FROM lineitem)
"""

#: Reads of 150 bases that tile each document's letters, written as bases.
READS = f"""
SELECT CAST(doc_id AS STRING) || '.' || CAST(i AS STRING) AS id, doc_id, i AS part, source AS barcode, lang, substr(dna, CAST(i * 150 + 1 AS INT), 150) AS seq
FROM (SELECT doc_id, source, lang, dna, {{explode}} AS i
      FROM (SELECT doc_id, source, lang, translate(regexp_replace(lower(text), '[^a-z]', ''{{all}}), '{_LETTERS}', '{_DNA}') AS dna FROM documents WHERE text IS NOT NULL))
WHERE length(dna) > 0
"""
READS_SPARK = READS.format(explode="explode(sequence(0L, CAST((greatest(length(dna), 1) - 1) / 150 AS BIGINT)))", all="")
READS_DUCK = READS.format(explode="unnest(range(0, (greatest(length(dna), 1) - 1) // 150 + 1))", all=", 'g'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a small file of one row group is one task otherwise, and what follows is far dearer than its rows are to deal out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Bytes of code beyond which HotSpot interprets a method forever.
HUGE_METHOD = 8_000


def compiled(spark: SparkSession) -> None:
    """Lower the session's default limit on the size of a stage's method to HotSpot's own: the CDR3 rows' expressions and those on top of them make larger ones, which would be interpreted; over the limit Spark compiles operator by operator."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) == 65_535:
        spark.conf.set(name, HUGE_METHOD)


def cdr3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled(spark)
    return spark.sql(CDR3.replace("FROM lineitem)", "FROM {lineitem})"), lineitem=spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))


#: Letters of a read; reads of a batch that leaves a task, and bytes of texts that are cut at once. The base of each byte of UTF-8 text, 0 for what is no letter a to z.
READ, BATCH, BYTES = 150, 20_000, 4_000_000
_BASES = np.zeros(256, dtype=np.uint8)
for _l, _b in zip(_LETTERS, _DNA):
    _BASES[[ord(_l), ord(_l.upper())]] = ord(_b)


def tiled(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The reads of a batch of texts as READS has them, and the row and part of each: bases of all texts at once, cut without a walk from each text's start."""
    texts = texts.cast(pa.large_string())
    # the two letters beyond ASCII whose lower case begins with one of a to z
    for letter in ("\u0130", "\u212a"):
        texts = pc.replace_substring(texts, letter, letter.lower()[0])
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    bases = _BASES[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]]
    kept = np.flatnonzero(bases)
    ends = np.searchsorted(kept, ends - ends[0])
    n = -(-np.diff(ends) // READ)
    row = np.repeat(np.arange(len(texts)), n)
    part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.append(ends[:-1][row] + READ * part, ends[-1])
    return pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(begin), pa.py_buffer(bases[kept])]), row, part


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of READS_SPARK."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    kinds = {f.name: f.dataType for f in documents.schema}
    out = StructType([StructField(c, t) for c, t in (("id", StringType()), ("doc_id", kinds["doc_id"]), ("part", LongType()), ("barcode", kinds["source"]), ("lang", kinds["lang"]), ("seq", StringType()))])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            seq, row, part = tiled(batch.column("text"))
            for at in range(0, len(row), BATCH):
                doc, source, lang = (batch.column(i).take(pa.array(row[at : at + BATCH])) for i in range(3))
                place = pa.array(part[at : at + BATCH])
                name = pc.binary_join_element_wise(doc.cast(pa.string()), place.cast(pa.string()), ".")
                yield pa.RecordBatch.from_arrays([name, doc, place, source, lang, seq.slice(at, BATCH).cast(pa.string())], names=out.names)

    return documents.where("text IS NOT NULL").mapInArrow(run, out)
