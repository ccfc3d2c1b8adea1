"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with text of that language. A text
is compressed with every dictionary, block by block over its whole length, in lower case and with
each run of anything but letters as one space, and belongs to the language whose dictionary makes
it smallest. The margin is the share by which the runner-up is
larger; a text with a narrow margin is rejected.

Dictionaries come from a bounded sample of the labelled rows: of each language SAMPLE_DOCS distinct beginnings of
SAMPLE_CHARS characters (fewer where these would exceed SAMPLE_BYTES for all languages), drawn by their hash, so that neither repeated texts nor repeated or null ids weigh more, up to
DICT_BYTES a language and ALL_BYTES in all, which many languages share evenly. They are what is
broadcast, beside one small row for each of at most LANGUAGES languages. Everything else is a map over the documents: no shuffle, one Arrow batch in memory at a time.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; without
any labelled row every text is `und`; a language whose labelled texts have no letter can't be learned; ties go to the
language with more labelled rows, then the alphabetically first; with one
language the score is 1; a row with a null doc_id is not held out (null counts as the empty text, whose remainder is 0);
repeated rows are predicted one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold, small_batches, table, worker_cache

SAMPLE_DOCS = 300
SAMPLE_CHARS = 1500
DICT_BYTES = 96 << 10
#: Of all dictionaries.
ALL_BYTES = 24 << 20
#: The least that zstandard takes for a raw-content dictionary.
LEAST_BYTES = 8
#: Languages that are learned, those with most labelled rows; characters of all samples, which are fewer documents a language where there are many.
LANGUAGES = 20_000
SAMPLE_BYTES = 64 << 20
BLOCK = 2 << 10
LEVEL = 5
#: Share by which the second language must be larger.
MIN_MARGIN = 0.004
UND = "und"

_GAPS = re.compile(r"[\W\d_]+")

OUT = "doc_id BIGINT, lang_pred STRING, score DOUBLE, margin DOUBLE, rejected BOOLEAN"


def letters(text: str) -> bytes:
    return _GAPS.sub(" ", text.lower()).encode("utf-8", "replace")


def learned(rows: DataFrame) -> dict[str, bytes]:
    """language: the bytes of its dictionary. rows: text, lang of the labelled documents."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    counts = {r["lang"]: r for r in found}
    if not counts:
        return {}
    # a share of each language's distinct texts that is drawn by their hash, and then at most `most` of them
    most = max(2, min(SAMPLE_DOCS, SAMPLE_BYTES // (SAMPLE_CHARS * len(counts))))
    shares = rows.sparkSession.createDataFrame([(lang, int(min(1.0, 1.5 * most / r["texts"]) * (1 << 40))) for lang, r in counts.items()], "lang STRING, share BIGINT")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.col("h") < F.col("share")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = drawn.collect()
    by: dict[str, list] = {lang: [] for lang in counts}
    for r in got:
        by[r["lang"]].append((r["h"], r["text"]))
    room = min(DICT_BYTES, max(LEAST_BYTES, ALL_BYTES // len(counts)))
    out: dict[str, bytes] = {}
    for lang, texts in by.items():  # from most labelled rows to fewest, which settles ties
        # zstandard finds the end of a dictionary cheapest, so the last bytes are the ones to keep
        raw = b" ".join(dict.fromkeys(letters(t) for _, t in sorted(texts)[:most]))[-room:]
        if raw.strip():
            out[lang] = raw * -(-LEAST_BYTES // len(raw))
    return out


class Classifier:
    """Sizes of a text under each language's dictionary; it is pickled as the dictionaries alone."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries
        self.coders: list | None = None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "coders": None}

    def sizes(self, data: bytes) -> list[int]:
        if self.coders is None:
            worker_cache("none", object)
            self.coders = []
            for raw in self.dictionaries.values():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False))
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        if not text or not self.dictionaries or not regex.search(r"\p{L}", text):
            return UND, 0.0, 0.0, True
        sizes, langs = self.sizes(letters(text)), list(self.dictionaries)
        best = sizes.index(min(sizes))
        if len(sizes) == 1:
            return langs[0], 1.0, 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / sizes[best]
        score = 1 / sum(math.exp(-(s - sizes[best]) / 4) for s in sizes)
        return langs[best], score, margin, margin < MIN_MARGIN


def predicted(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Classifier(dictionaries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t) for t in batch.column("text").to_pylist()]
            cols = list(zip(*got)) if got else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def kept(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Classifier(dictionaries))

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        # only texts go to Python and only flags come back
        return pd.Series([not shared.value.predict(t)[3] for t in texts], dtype=bool)

    return docs.where(keeps(F.col("text").cast("string")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    model = learned(docs.where(~held).select("text", "lang"))
    out = predicted(docs, model)
    return out.withColumn("held_out", fold(F.col("doc_id"), 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
