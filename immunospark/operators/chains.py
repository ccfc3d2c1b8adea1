"""Chains of k-mer hits: where a read lies on a gene when indels part its hits into several diagonals.

Hits of a read and a gene are parted into clusters wherever their sorted diagonals (read place less gene place)
leave a hole of more than the radius. Of a cluster the longest chain counts that rises strictly on read and gene;
of equally long ones that which strays least from the cluster's mean diagonal. Short runs that leave the
diagonal of their neighbours are by chance and go; on long sequences the chain is cut at wide holes and the
part with most hits stays.

On Spark, hits are counted where the read is (by an equi-join on k-mers, if the reference is too large to share); what one read and one gene share is gathered into a row, which is
bounded by the two lengths, and rows are chained in Arrow batches. Nothing is gathered by gene alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reference import K, RADIUS, candidate_hits

#: Hits that a cluster needs; hits of a run that is beyond chance; and what wide runs around it still overrule.
LEAST, RUN, WIDE = 3, 3, 10

CHAIN = "id STRING, strand INT, gene INT, read_start INT, read_end INT, gene_start INT, gene_end INT, read_cover INT, gene_cover INT, n INT"


def clusters(a: np.ndarray, b: np.ndarray, radius: int) -> list[np.ndarray]:
    """The hits (read places a, gene places b) of each cluster, in the order of its diagonals."""
    order = np.argsort(a - b, kind="stable")
    return np.split(order, np.flatnonzero(np.diff((a - b)[order]) > radius) + 1)


def rising(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The longest chain of hits that rises strictly in a and b; of those the one with the least sum of
    distances from the mean diagonal, of those the one whose last hits come first on the read."""
    order = np.lexsort((-a, b))
    a, b = a[order], b[order]
    off = np.abs((a - b) - (a - b).mean())
    if (np.diff(a) > 0).all() and (np.diff(b) > 0).all():
        return order
    n, places = len(a), np.unique(a)
    rank = np.searchsorted(places, a) + 1
    # of each read place the best chain that ends before it: (hits, -strain, -place, hit), kept by a tree of prefix maxima
    none = (0, 0.0, 0, -1)
    tree, before = [none] * (len(places) + 1), [-1] * n
    best = none
    waiting: list[tuple[int, tuple]] = []
    for i in range(n):
        if i and b[i] != b[i - 1]:  # hits of one gene place can't follow one another
            for r, value in waiting:
                while r <= len(places):
                    tree[r] = max(tree[r], value)
                    r += r & -r
            waiting = []
        top, r = none, int(rank[i]) - 1
        while r:
            top = max(top, tree[r])
            r -= r & -r
        before[i] = top[3]
        value = (top[0] + 1, top[1] - float(off[i]), -int(a[i]), i)
        waiting.append((int(rank[i]), value))
        best = max(best, value)
    out, i = [], best[3]
    while i >= 0:
        out.append(i)
        i = before[i]
    return order[out[::-1]]


def without_strays(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which hits of a chain stay when short runs on a diagonal of their own go: inner ones between two runs of one
    diagonal, and outer ones beside a long run."""
    cuts = np.flatnonzero(np.diff(a - b)) + 1
    runs = np.split(np.arange(len(a)), cuts)
    size, place = [len(r) for r in runs], [int(a[r[0]] - b[r[0]]) for r in runs]
    keep = []
    for i, run in enumerate(runs):
        if len(runs) == 1:
            stray = False
        elif i == 0:
            stray = size[0] < RUN and size[1] >= RUN
        elif i == len(runs) - 1:
            stray = size[i] < RUN and size[i - 1] >= RUN
        else:
            around = min(size[i - 1], size[i + 1])
            stray = place[i - 1] == place[i + 1] and (size[i] < RUN <= around or size[i] < 2 * RUN and around >= WIDE * RUN)
        if not stray:
            keep.append(run)
    return np.concatenate(keep) if keep else np.arange(0)


def widest(a: np.ndarray, gap: int) -> np.ndarray:
    """The part of a chain with most hits (the first of equals) when it is cut where read places lie further apart than gap."""
    parts = np.split(np.arange(len(a)), np.flatnonzero(np.diff(a) > gap) + 1)
    return max(parts, key=len)


def cover(places: np.ndarray, k: int) -> int:
    """Letters that k-mers at rising places cover."""
    return int(np.minimum(k, np.diff(places)).sum()) + k if len(places) else 0


def chains(a: np.ndarray, b: np.ndarray, need: int, k: int = K, radius: int = RADIUS, gap: int | None = None, strays: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """The chains (read places, gene places) of the clusters whose hits cover at least need letters of read and gene; strays: short runs off the diagonal may stay."""
    out = []
    for part in clusters(a, b, radius):
        if len(part) < LEAST or len(part) * k < need:
            continue
        x, y = a[part], b[part]
        order = rising(x, y)
        x, y = x[order], y[order]
        if not strays:
            stay = without_strays(x, y)
            x, y = x[stay], y[stay]
        if gap is not None and len(x):
            stay = widest(x, gap)
            x, y = x[stay], y[stay]
        if min(cover(x, k), cover(y, k)) >= need:
            out.append((x, y))
    return out


def chained(found: DataFrame, need: int, k: int = K, radius: int = RADIUS, gap: int | None = None) -> DataFrame:
    """CHAIN rows of hits (id, strand, gene, offset, gene_offset): every chain of every read, strand and gene, ends inclusive."""
    rows = found.groupBy("id", "strand", "gene").agg(F.collect_set(F.struct("offset", "gene_offset")).alias("hits"))
    rows = rows.where((F.size("hits") >= LEAST) & (F.size("hits") * k >= need)).select(F.col("id").cast("string").alias("id"), F.col("strand").cast("int").alias("strand"), F.col("gene").cast("int").alias("gene"), "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out, of = batch.column("hits"), [], []
            flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
            a, b = (flat.field(c).to_numpy().astype(np.int64) for c in ("offset", "gene_offset"))
            for i, end in enumerate(ends.tolist()):
                begin = int(ends[i - 1]) if i else 0
                for x, y in chains(a[begin:end], b[begin:end], need, k, radius, gap):
                    of.append(i)
                    out.append((int(x[0]), int(x[-1]) + k - 1, int(y[0]), int(y[-1]) + k - 1, cover(x, k), cover(y, k), len(x)))
            kept = [batch.column(c).take(pa.array(of, pa.int64())) for c in ("id", "strand", "gene")]
            made = [pa.array(c, pa.int32()) for c in (zip(*out) if out else [[]] * 7)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[c.split()[0] for c in CHAIN.split(", ")])

    return rows.mapInArrow(run, CHAIN)


def read_chains(reads: DataFrame, ref: DataFrame, need: int = 27, k: int = K, radius: int = RADIUS, read: str = "id", seq: str = "seq") -> DataFrame:
    """CHAIN rows of reads against a reference; only genes with enough hits are gathered."""
    return chained(candidate_hits(reads, ref, need, k, read, seq).where("id IS NOT NULL AND gene IS NOT NULL"), need, k, radius)


def best_gene(found: DataFrame) -> DataFrame:
    """id, strand, gene, length: of every read the chain that covers most of read and gene; ties go to the forward strand, then to the smallest gene."""
    length = F.least("read_cover", "gene_cover")
    return found.groupBy("id").agg(F.max(F.struct(length.alias("length"), "strand", (-F.col("gene")).alias("g"))).alias("x")).select("id", "x.strand", (-F.col("x.g")).alias("gene"), "x.length")
