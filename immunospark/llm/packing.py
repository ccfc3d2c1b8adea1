"""Best-fit packing with certified bounds.

Documents are tokenised and cut into pieces of at most CAPACITY tokens. A full piece is a sequence
of its own. The others are dealt to partitions of about ITEMS pieces by the hash of their id; each
partition is packed best-fit decreasing, and dual feasible functions give a lower bound of its
number of sequences. A partition that meets its bound is certified and keeps its sequences, all but
the emptiest one, as its bound is rounded up. Partitions with a gap keep their full sequences alone.
The pieces of all other sequences are exchanged: pooled, dealt anew and packed again; a round counts
if the pool's sequences get fewer. Rounds end when the total meets the bound of all pieces (from a
histogram of at most CAPACITY lengths), when a round brings nothing, or after ROUNDS.

Texts are read once and never shuffled; what moves are pieces of some 50 bytes. Every partition
holds about ITEMS pieces however many there are, and the driver sees counts alone.

The tokenizer merges within its own pre-tokens alone, so their ids are looked up in a bounded table
of those seen. Texts of Latin letters are cut into pre-tokens by the tokenizer's pattern; others, and
texts with special tokens, are cut at ASCII blanks, which it drops.

Defined results: a null text counts as empty and is the end token alone; repeated rows are packed
one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, stored, table, worker_cache

CAPACITY = 4096
END_TOKEN = 1
TOKENIZER = "word_bpe_49k.json"
ITEMS = 8_000
ROUNDS = 4
#: Words whose ids a worker remembers.
MEMORY = 300_000

PIECES = "item BIGINT, doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
#: The tokenizer's pre-token pattern over the characters up to U+017F, whose lower case and
#: normal form are single characters but for U+0130.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_PRETOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_OTHERS = re.compile("[^\\x00-\u012f\u0131-\u017f]|<\\|")
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


class _Known(dict):
    """The ids of pre-tokens, or of words between blanks, as bytes; the first MEMORY seen are remembered."""

    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(word)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < MEMORY:
            self[word] = out
        return out


class WordTokens:
    """The token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, letters = tokenizer.model, byte_letters()
        self.pretokens = _Known(lambda w: [t.id for t in model.tokenize(w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]))])
        self.words = _Known(lambda w: tokenizer.encode(w, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if _OTHERS.search(text):
            return b"".join(map(self.words.__getitem__, _BLANKS.split(text)))
        return b"".join(map(self.pretokens.__getitem__, _PRETOKENS.findall(text.lower())))


def tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path(TOKENIZER)
    return path


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """item (any unique number), doc_id, piece, start, length, ids_crc32 of every piece."""

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = tokenizer_path(path)
        tokens, end = worker_cache(f"tokens {where}", lambda: WordTokens(where)), np.array([END_TOKEN], dtype="<u4").tobytes()
        item = TaskContext.get().partitionId() << 36
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = tokens.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((item, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    item += 1
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item", *_COLUMNS])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The best of several dual-feasible-function bounds on the number of bins; counts: of distinct lengths."""
    sizes = lengths.astype(np.int64)
    if counts is None:
        sizes, counts = np.unique(sizes, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    # items above half need a bin each; items above capacity - a shut out all of size a and more
    big = sizes * 2 > capacity
    for a in [0, *sizes[~big].tolist()]:
        alone, half = sizes > capacity - a, big & (sizes <= capacity - a)
        rest = (~big) & (sizes >= a)
        free = int(((capacity - sizes[half]) * counts[half]).sum())
        need = int((sizes[rest] * counts[rest]).sum()) - free
        best = max(best, int(counts[alone].sum() + counts[half].sum()) + max(0, -(-need // capacity)))
    # u_k rounds x(k+1) down unless whole; values are scaled by k * capacity
    for k in range(2, 12):
        whole = sizes * (k + 1) % capacity == 0
        value = np.where(whole, sizes * k, sizes * (k + 1) // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: the bin and offset of each item, and the free room of each bin."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    room: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels = 0  # bit r: there is a bin with room r
    for i in order:
        n = lengths[i]
        above = levels >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                levels &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - n
        with_room[r - n].append(b)
        levels |= 1 << (r - n)
    return bins, offsets, room


def packed_round(items: DataFrame, n: int, turn: int, capacity: int) -> DataFrame:
    """Deal n items out and pack each partition; adds sequence_id, offset, its partition's bins and bound, and its sequence's room."""
    schema = PIECES + ", sequence_id BIGINT, offset BIGINT, part BIGINT, bins BIGINT, bound BIGINT, room INT, emptiest BOOLEAN"
    parts = max(1, -(-n // ITEMS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        part = int(pdf["part"].iloc[0])
        bins, offsets, room = best_fit(pdf["length"].tolist(), capacity)
        base = (turn << 56) | (part << 24)
        worst = max(range(len(room)), key=room.__getitem__)
        return pdf.assign(
            sequence_id=[base + b for b in bins], offset=offsets, bins=len(room), bound=lower_bound(pdf["length"].to_numpy(), capacity),
            room=[room[b] for b in bins], emptiest=[b == worst for b in bins],
        )[["item", *_COLUMNS, "sequence_id", "offset", "part", "bins", "bound", "room", "emptiest"]]

    dealt = items.select("item", *_COLUMNS, F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(run, schema)


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack stored pieces; adds sequence_id, offset and certified (its sequence is full, or in a partition that meets its bound)."""
    full = rows.where(F.col("length") == capacity)
    done = full.select(*_COLUMNS, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(True).alias("certified"))
    pool = rows.where(F.col("length") < capacity)
    lengths = pool.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    n = sum(r["n"] for r in lengths)
    bound = lower_bound(np.array([r["length"] for r in lengths]), capacity, np.array([r["n"] for r in lengths])) if n else 0
    settled, before, kept, current = None, None, 0, None
    good = ((F.col("bins") == F.col("bound")) | (F.col("room") == 0)).alias("certified")
    for turn in range(1, ROUNDS + 1):
        if not n:
            break
        trial = stored(packed_round(pool, n, turn, capacity), f"packed-{turn}")
        bins = trial.agg(F.countDistinct("sequence_id").alias("bins")).first()["bins"]
        if current is not None:
            if bins >= before:
                break  # the pool is no better for it: what it had stays
            done = done.unionByName(settled)
        current = trial
        if kept + bins <= bound:
            good = F.lit(True).alias("certified")
            break
        loose = (F.col("room") > 0) & ((F.col("bins") > F.col("bound")) | F.col("emptiest"))
        settled, pool = current.where(~loose).select(*_COLUMNS, "sequence_id", "offset", good), current.where(loose)
        got = pool.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sequence_id").alias("bins"), F.countDistinct("part").alias("parts")).first()
        n, before = got["n"], got["bins"]
        kept += bins - before
        if got["parts"] < 2:
            break  # nobody to exchange with
    return done if current is None else done.unionByName(current.select(*_COLUMNS, "sequence_id", "offset", good))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified."""
    return packed(stored(pieces(docs, path, capacity), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
