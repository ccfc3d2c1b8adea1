"""Substring dedup by recompression.

Words become 64-bit names, and passes compress the sequence of names: maximal runs of a name become one
name, then pairs whose left name has bit 0 and whose right name has bit 1 in the pass's own hash become one
name. A name is a hash of what it stands for, so every task gives equal strings the same names: naming is
global without a shuffle. Whether two neighbours merge depends on these two alone, so the parse inside equal
substrings is equal but for a name or two at the ends of each pass. For a window of words, the names that
no context can change are known from the window alone; the first of them in the last pass that has any is
the window's anchor. Equal windows have equal anchors at equal places.

Consecutive windows of one anchor make a stretch, about one for every five words. Spark rounds then look
for equals, each among what the last one left:
  1. anchors: a stretch whose anchor no other has is unique;
  2. whole stretches: the windows of equal ones are equal, all at once;
  3. the windows of the other stretches and of one stretch of each equal kind, by the hash of all their words.
In each, equals within a batch are settled where they are, and one witness of them goes to the other tasks,
so a passage in a third of all documents is a row a batch in the shuffle, not a row a document. What rounds 2
and 3 compare are two independent 64-bit hashes. A document is known by its id and the hash of its text, so that
every scan finds it again; texts are moved when the third round reads windows, and when words are removed.

Defined results: a null text has no words; rows that repeat a doc_id are documents of their own, and copies
remove each other, all of them; a null doc_id stays null; of texts shorter than a window all words stay;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop_path, released, scratch, small_batches, stored, table, text_of, worker_cache

#: Words of a window.
WINDOW = 35
#: Runs, then pairs. Runs of later names occur in periodic passages only, and a runs pass costs every window a certain name at
#: either end, so later passes leave them alone. Windows that have names after the last pass take their anchor there.
PASSES = "r" + "p" * 8
#: Bytes of text that are parsed at a time, when documents are shorter.
PIECE = 1 << 20

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.r_[_U(1), np.full(size - 1, _U(b), _U)]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


class Sums:
    """Hashes of any stretch of a sequence from prefix sums of its values times powers."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.r_[_U(0), np.cumsum(values * up[: len(values)])]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))


class Parser:
    """What a worker needs to parse texts: tables of letters and powers."""

    def __init__(self):
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.letters = mixed(np.arange(1, 257, dtype=_U) * _U(_STEP))
        self.of_letters, self.of_words = Powers(_BASE), Powers(_STEP)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Names of the words of all texts, and the place of each text's first word, with the number of words at the end."""
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        filled = np.r_[False, ~self.blank[data], False]
        edges = np.flatnonzero(filled[1:] != filled[:-1])
        starts, ends = edges[::2], edges[1::2]
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        return Sums(self.letters[data], self.of_letters).of(starts, ends), np.searchsorted(starts, begins)

    def window_sums(self, words: np.ndarray) -> Sums:
        return Sums(mixed(words ^ _U(_BASE)), self.of_words)


def compressed(names: np.ndarray, head: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A pass over names (head: a text begins here): the new names, where each begins, and for each old name
    the first and the last new name that are certain where it was the first or the last one that was."""
    n = len(names)
    if PASSES[turn] == "r":
        edge = np.r_[True, names[1:] != names[:-1]] | head
    else:
        bit = (mixed(names + _U((turn + 1) * _BASE % (1 << 64))) & _U(1)).astype(bool)
        edge = np.r_[True, bit[:-1] | ~bit[1:]] | head
    new = np.flatnonzero(edge)
    at = np.cumsum(edge) - 1
    long = np.diff(np.r_[new, n])
    out = names[new]
    many = np.flatnonzero(long > 1)
    if PASSES[turn] == "r":
        # a run may go on beyond the window, at either end
        out[many] = mixed(out[many] * _U(_STEP) + long[many].astype(_U))
        return out, new, at + 1, at - 1
    out[many] = mixed(out[many] * _U(_BASE) + mixed(names[new[many] + 1] ^ _U(_STEP)))
    # a right name may belong to one before the window, a left name to one behind it
    return out, new, at + bit, at - ~bit


def stretches(words: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of consecutive windows with one anchor: first and last window (by the place of its first word), the anchor's name and place."""
    lengths = np.diff(begins)
    last = np.repeat(begins[1:], lengths)
    first = np.flatnonzero(np.arange(len(words)) + window <= last)
    if not len(first):
        return first, first, words[:0], first
    head = np.zeros(len(words), bool)
    head[begins[:-1][lengths > 0]] = True
    names, places = words, np.arange(len(words))
    final, left, right = first.copy(), first.copy(), first + (window - 1)
    out = []
    for turn in range(len(PASSES) + 1):
        if turn == len(PASSES):
            gone = np.ones(len(first), bool)
        else:
            new_names, new, to_right, to_left = compressed(names, head, turn)
            new_left, new_right = to_right[left], to_left[right]
            gone = new_left > new_right
        done = np.flatnonzero(gone)
        out.append((first[done], final[done], names[left[done]], places[left[done]]))
        stay = np.flatnonzero(~gone)
        if not len(stay):
            break
        first, final, left, right = first[stay], final[stay], new_left[stay], new_right[stay]
        same = (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (final[:-1] + 1 == first[1:])
        begin, end = np.flatnonzero(np.r_[True, ~same]), np.flatnonzero(np.r_[~same, True])
        first, final, left, right = first[begin], final[end], left[begin], right[begin]
        names, places, head = new_names, places[new], head[new]
    first, final, names, places = (np.concatenate(x) for x in zip(*out))
    # one anchor may have had windows in two passes
    order = np.argsort(first)
    first, final, names, places = first[order], final[order], names[order], places[order]
    same = (places[1:] == places[:-1]) & (names[1:] == names[:-1]) & (final[:-1] + 1 == first[1:])
    begin, end = np.flatnonzero(np.r_[True, ~same][: len(first)]), np.flatnonzero(np.r_[~same, True][: len(first)])
    return first[begin], final[end], names[begin], places[begin]


#: k1, k2: what must be equal, k1 being the anchor's name; state: 0 open, 1 settled (an equal was in its batch), 2 a witness for open rows elsewhere; whole: hash of the stretch, for the next round
ROWS = "k1 BIGINT, k2 BIGINT, doc_id BIGINT, digest BIGINT, whole BIGINT, first INT, last INT, state TINYINT"


def settled(k1: np.ndarray, k2: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of a batch by their keys: their state, and the rows that go on once more as witnesses."""
    order = np.lexsort((state, k2, k1))
    a, b = k1[order], k2[order]
    begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    many = np.repeat(np.diff(np.r_[begin, len(a)]) > 1, np.diff(np.r_[begin, len(a)]))
    out = state.copy()
    out[order[many & (state[order] == 0)]] = 1
    # a group of which any row was open sends its first row; the other witnesses of the batch say the same
    witnesses = order[begin[many[begin]]]
    out[order[many & (state[order] == 2)]] = 3
    return out, witnesses


def rows_of(k1: np.ndarray, k2: np.ndarray, state: np.ndarray, doc_id: pa.Array, digest: np.ndarray, first: np.ndarray, last: np.ndarray, whole: np.ndarray | None = None) -> pa.RecordBatch:
    """A batch of ROWS: settled rows get a second key of their own, and witnesses are added."""
    state, more = settled(k1, k2, state)
    stay = np.flatnonzero(state < 3)
    own = mixed(digest + mixed(first.astype(_U) + _U(_STEP)))
    take = np.r_[stay, more]
    k2 = np.r_[np.where(state == 1, own, k2)[stay], k2[more]]
    state = np.r_[state[stay], np.full(len(more), 2, np.int8)]
    whole = np.zeros(len(take), _U) if whole is None else whole[take]
    longs = [pa.array(x.view(np.int64)) for x in (k1[take], k2, digest[take], whole)]
    ints = [pa.array(x[take].astype(np.int32)) for x in (first, last)]
    return pa.RecordBatch.from_arrays([*longs[:2], doc_id.take(pa.array(take)), *longs[2:], *ints, pa.array(state)], names=[c.split()[0] for c in ROWS.split(", ")])


def parser() -> Parser:
    return worker_cache("recompression", Parser)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about PIECE bytes together."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PIECE or k + 1 == len(texts):
            yield begin, k + 1
            begin, size = k + 1, 0


def bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def documents_of(docs: DataFrame) -> DataFrame:
    text = text_of("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("digest", F.xxhash64("text"))


def all_stretches(docs: DataFrame, window: int) -> DataFrame:
    """Every stretch of every document, keyed by its anchor's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parser()
        for batch in batches:
            texts, got = bytes_of(batch.column("text")), []
            for i, j in slices(texts):
                words, begins = known.words(texts[i:j])
                first, last, name, _ = stretches(words, begins, window)
                doc = np.searchsorted(begins, first, side="right") - 1
                got.append((i + doc, first - begins[doc], last - begins[doc], name, known.window_sums(words).of(first, last + window)))
            if not got:
                continue
            doc, first, last, name, whole = (np.concatenate(x) for x in zip(*got))
            ids, digest = batch.column("doc_id").take(pa.array(doc)), batch.column("digest").to_numpy()[doc].view(_U)
            yield rows_of(name, np.zeros(len(name), _U), np.zeros(len(name), np.int8), ids, digest, first, last, whole)

    return docs.mapInArrow(run, ROWS)


def by_whole(rows: DataFrame) -> DataFrame:
    """Stretches keyed by their anchor and all of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            name, whole, digest = (batch.column(c).to_numpy().view(_U) for c in ("name", "whole", "digest"))
            yield rows_of(name, whole, np.zeros(len(batch), np.int8), batch.column("doc_id"), digest, batch.column("first").to_numpy(), batch.column("last").to_numpy())

    return rows.mapInArrow(run, ROWS)


def all_windows(docs: DataFrame, some: DataFrame, window: int) -> DataFrame:
    """The windows of the stretches in some (doc_id, digest, name, first, last, open), keyed by their anchor and all of their words."""
    lists = some.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("first", "last", "name", "open")).alias("some"))
    same = docs["doc_id"].eqNullSafe(lists["doc_id"]) & (docs["digest"] == lists["digest"])
    both = docs.hint("merge").join(lists, same).select(docs["doc_id"], docs["digest"], docs["text"], "some")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parser()
        for batch in batches:
            texts, got, lists = bytes_of(batch.column("text")), [], batch.column("some")
            for i, j in slices(texts):
                words, begins = known.words(texts[i:j])
                sums, part = known.window_sums(words), lists.slice(i, j - i)
                each = np.diff(part.offsets.to_numpy())
                first, last, name, is_open = (part.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("first", "last", "name", "open"))
                doc = np.repeat(np.arange(j - i), each)
                order = np.lexsort((first, doc))  # a set has no order of its own
                doc, first, last, name, is_open = doc[order], first[order], last[order], name[order], is_open[order]
                n = last - first + 1
                of = np.repeat(np.arange(len(n)), n)
                at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                place = begins[doc[of]] + at
                got.append((i + doc[of], at, name[of].view(_U), sums.of(place, place + window), np.where(is_open[of], 0, 2).astype(np.int8)))
            if not got:
                continue
            doc, at, name, key, state = (np.concatenate(x) for x in zip(*got))
            ids, digest = batch.column("doc_id").take(pa.array(doc)), batch.column("digest").to_numpy()[doc].view(_U)
            yield rows_of(name, key, state, ids, digest, at, at)

    return both.mapInArrow(run, ROWS)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, digest, first, last: windows that begin at the words first to last of a document also begin elsewhere."""
    spark = docs.sparkSession
    small_batches(spark)
    key, at, kind = ["doc_id", "digest"], ["first", "last"], Window.partitionBy("k1", "k2")
    with scratch() as done:
        counted = all_stretches(docs, window).withColumn("n", F.count(F.lit(1)).over(kind))
        shared = stored(counted.where("state = 1 or state = 0 and n > 1").select(*key, F.col("k1").alias("name"), "whole", *at), "anchors")
    released(spark)
    kinds = by_whole(shared).withColumn("n", F.count(F.lit(1)).over(kind)).withColumn("nth", F.row_number().over(kind.orderBy(*key, *at, "state")))
    equal, extra = (F.col("state") > 0) | (F.col("n") > 1), F.col("state") == 2
    # a kind's first row stands for it in the third round: settled rows are of kinds whose witness is among the others
    judged = kinds.select(*key, "k1", *at, equal.alias("equal"), extra.alias("extra"), (equal & (F.col("state") != 1) & (F.col("nth") == 1)).alias("stands"))
    judged = judged.select(*key, F.expr("if(stands or not equal, k1, null)").alias("name"), *at, "equal", "extra").where("not extra or name is not null")
    judged = stored(judged, "stretches")
    for path in done:
        drop_path(spark, path)
    released(spark)
    some = judged.where("name is not null").select(*key, "name", *at, (~F.col("equal")).alias("open"))
    windows = all_windows(docs, some, window).withColumn("n", F.count(F.lit(1)).over(kind))
    single = stored(windows.where("state = 1 or state = 0 and n > 1").select(*key, *at), "windows")
    released(spark)
    return judged.where("equal and not extra").select(*key, *at).unionByName(single)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: doc_id, text (the words that stay, joined by one space), n_words, n_removed, removed (first word and word behind the last of each removed part)."""
    docs = documents_of(docs)
    spans = repeated_spans(docs, window)
    lists = spans.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    same = docs["doc_id"].eqNullSafe(lists["doc_id"]) & (docs["digest"] == lists["digest"])
    both = docs.hint("merge").join(lists, same, "left").select(docs["doc_id"], docs["text"], "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone, parts = [], [], [], []
            lists = batch.column("spans")
            first, last = (lists.flatten().field(c).to_numpy() for c in ("first", "last"))
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            for k, text in enumerate(bytes_of(batch.column("text"))):
                words = text.split()  # at the six blank characters
                end = int(ends[k])
                begin = int(ends[k - 1]) if k else 0
                removed = []
                if end > begin:
                    steps = np.bincount(first[begin:end], minlength=len(words) + 1) - np.bincount(last[begin:end] + window, minlength=len(words) + 1)
                    edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(steps) > 0, False]))
                    removed = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
                kept, at = [], 0
                for a, b in removed:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                texts.append(b" ".join(kept))
                counts.append(len(words))
                gone.append(len(words) - len(kept))
                parts.append([{"first": a, "end": b} for a, b in removed])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "text", "n_words", "n_removed", "removed"],
            )

    return both.mapInArrow(run, "doc_id BIGINT, text STRING, n_words BIGINT, n_removed BIGINT, removed ARRAY<STRUCT<first: INT, end: INT>>")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
h AS (SELECT r, unnest(list_transform(range(1, len(w) - 33), lambda p: {'p': p, 'h': sha256(array_to_string(w[p:p + 34], ' '))})) AS s FROM d),
n AS (SELECT r, s.p AS p, count(*) OVER (PARTITION BY s.h) AS n FROM h),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM n WHERE n > 1),
words AS (SELECT r, unnest(list_transform(w, lambda x, i: {'i': i, 'x': x})) AS s FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(s.x, ' ' ORDER BY s.i) AS t FROM words ANTI JOIN gone ON words.r = gone.r AND words.s.i = gone.i GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
