"""Hard negatives by one-dimensional distance keys.

Scores are inner products of integer vectors. With M the greatest length of a vector, every vector x is
augmented by sqrt(M^2 - |x|^2) and a query by 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest scores are
the least distances. Pivots come from a bounded sample by k-means; a row's key is its nearest pivot and the
distance to it. The index holds all rows sorted by (pivot, distance), cut into blocks that know their least and
greatest key.

A query at distance d from a pivot can have rows within radius r only in blocks whose keys meet [d - r, d + r].
A search asks for the k best rows of a score range, an annulus around the query. It begins at the annulus' inner
radius and expands: each round scans the blocks that the last one's intervals left out, and the search ends
once the k-th row found is no farther than the radius, as every row not seen yet lies beyond it, or at the outer
radius. Once k rows are found, the k-th's distance is the next radius. Queries and intervals meet on rings of
equal width; the queries that a block is scanned for come in packs of bounded size, and a block and a pack are
one matrix product. So a vector with a third of all rows fills more blocks, not larger ones, and results are exact.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part;
vectors of fewer components than the longest have zeros at their end; rows that repeat a vec_id are rows of their own, each an
anchor if the id says so, and other rows to each other; ties of score and id (in whatever vectors) are ordered by place in the index and
differ in nothing that is returned; scores beyond 2^62 switch pruning off and wrap as 64-bit integers do; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import shuffle_partitions, small_batches, stored, table

#: Rows of a block, at most.
ROWS = 1024
#: Rows that pivots are fitted on, at most, and pivots at most.
SAMPLE, PIVOTS = 4096, 128
#: Queries that are scanned together.
PACK = 256
#: Rings that the keys of a pivot are dealt to.
RINGS = 64
#: The first step of a radius is the sample's usual distance to a nearest row, and this share of it in an annulus; steps grow by GROWTH.
STEP, GROWTH = 1 / 16, 4

ANCHOR_EVERY, MOVED_EVERY, LABELS, POSITIVES, NEGATIVES = 50, 7, 10, 5, 3

_ITEM = "id BIGINT, label INT, vec BINARY"
_BLOCK = "block BIGINT, pivot INT, lo DOUBLE, hi DOUBLE, ids ARRAY<BIGINT>, labels ARRAY<INT>, vecs BINARY"
_FOUND = "q BIGINT, want INT, score BIGINT, id BIGINT, row BIGINT"


def integers(vector: Column) -> Column:
    """floor(256 x) of each component."""
    return F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("bigint"))


def whole(vector: Column) -> Column:
    """Whether every component is a finite number."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def vectors(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column as a matrix, with zeros behind shorter ones."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def matrix(blobs: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, dims) if dims else np.zeros((len(blobs), 0), np.int64)


class Space:
    """The augmented space and its pivots; what tasks need of an index."""

    def __init__(self, dims: int, norm2: float):
        self.dims, self.norm2, self.pivots, self.step = dims, norm2, np.zeros((1, dims + 1)), norm2**0.5 + 1

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.c_[x, np.sqrt(np.maximum(0, self.norm2 - (x * x).sum(1)))]

    def distances(self, augmented: np.ndarray) -> np.ndarray:
        """To each pivot; not by the binomial formula, whose error grows near a pivot."""
        return np.sqrt(np.stack([((augmented - p) ** 2).sum(1) for p in self.pivots], 1))

    def fit(self, x: np.ndarray, k: int) -> None:
        """k-means with at most k pivots over the rows of x, and the step of a radius."""
        asked, x = x[:256].astype(float), np.unique(self.augmented(x), axis=0)
        if not len(x):
            return
        far = np.maximum(0, (asked**2).sum(1)[:, None] + self.norm2 - 2 * asked @ x[:, :-1].T)
        far.sort(axis=1)
        nearest = float(np.median(np.sqrt(far[:, min(1, len(x) - 1)])))  # the first is the row itself
        self.step = max(nearest, self.norm2**0.5 / 64, 0.5)  # copies lie at no distance
        k = min(k, len(x))
        centers = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(8):
            nearest = ((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)).argmin(1)
            centers = np.stack([x[nearest == c].mean(0) if (nearest == c).any() else centers[c] for c in range(k)])
        self.pivots = centers


class DistanceIndex:
    """Rows (id, label, vec ARRAY<BIGINT>) sorted by (pivot, distance)."""

    def __init__(self, rows: DataFrame):
        rows = stored(rows, "vectors")
        squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, longest, dims = rows.agg(F.count(F.lit(1)), F.max(squares), F.max(F.size("vec"))).first()
        self.count, self.norm2, self.space = n, longest or 0.0, Space(dims or 0, longest or 0.0)
        self.far = self.norm2 >= 2**62  # scores may overflow: nothing is pruned
        self._fit(rows)
        self.width = max(2 * self.norm2**0.5, 1.0) / RINGS
        self.slack = 1e-9 * (1 + self.norm2**0.5)
        self.blocks = self._sorted(rows)

    def _fit(self, rows: DataFrame) -> None:
        share = int(2**62 * min(1, SAMPLE / max(1, self.count)))
        drawn = rows.where(F.shiftrightunsigned(F.xxhash64("id", "vec"), 2) <= share).select("vec").limit(2 * SAMPLE).collect()
        x = np.zeros((len(drawn), self.space.dims), np.int64)
        for k, r in enumerate(drawn):
            x[k, : len(r["vec"])] = r["vec"]
        self.space.fit(x, max(1, min(PIVOTS, round(self.count**0.5 / 8))))

    def _sorted(self, rows: DataFrame) -> DataFrame:
        space, dims = self.space, self.space.dims

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = vectors(batch.column("vec"), dims)
                far = space.distances(space.augmented(x))
                pivot = far.argmin(1) if len(x) else np.zeros(0, np.int64)
                key = far[np.arange(len(x)), pivot]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(pivot.astype(np.int32)), pa.array(key)],
                    names=["id", "label", "vec", "pivot", "key"],
                )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, waiting = TaskContext.get().partitionId() << 24, []

            def block(rows: pa.Table) -> pa.RecordBatch:
                keys = rows["key"].to_numpy()
                vecs = b"".join(rows["vec"].to_pylist())
                columns = [[number], [rows["pivot"][0].as_py()], [keys[0]], [keys[-1]], [rows["id"].to_pylist()], [rows["label"].to_pylist()], [vecs]]
                types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _BLOCK.split(", ")])

            for batch in batches:
                waiting.append(batch)
                ready = pa.Table.from_batches(waiting)
                pivot = ready["pivot"].to_numpy()
                begin = 0
                for end in [*(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]:
                    # the last pivot's rows wait for the next batch unless they fill a block
                    while end - begin >= ROWS or (begin < end < len(pivot)):
                        size = min(ROWS, end - begin)
                        yield block(ready.slice(begin, size))
                        number, begin = number + 1, begin + size
                waiting = [ready.slice(begin).combine_chunks().to_batches()[0]] if begin < len(pivot) else []
            if waiting:
                yield block(pa.Table.from_batches(waiting))

        order = ["pivot", "key", "id"]
        keys = stored(rows.mapInArrow(keyed, _ITEM + ", pivot INT, key DOUBLE"), "keys")
        ranged = keys.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
        return stored(ranged.mapInArrow(cut, _BLOCK), "blocks")

    def queries(self, every: int) -> DataFrame:
        """The rows whose id is divisible by every: q (their place), id, label, vec, norm2, far (the distance to each pivot)."""
        space, dims = self.space, self.space.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, ids, labels, vecs in zip(*[batch.column(c).to_pylist() for c in ("block", "ids", "labels", "vecs")]):
                    at = [k for k, i in enumerate(ids) if i % every == 0]
                    x = matrix([vecs], dims).reshape(len(ids), dims)[at]
                    far = space.distances(np.c_[x.astype(float), np.zeros(len(at))])
                    norm2 = (x.astype(float) ** 2).sum(1)
                    columns = [[place(block, k) for k in at], [ids[k] for k in at], [labels[k] for k in at], [r.tobytes() for r in x], norm2.tolist(), far.tolist()]
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["q", "id", "label", "vec", "norm2", "far"])

        return stored(self.blocks.mapInArrow(run, "q BIGINT, " + _ITEM + ", norm2 DOUBLE, far ARRAY<DOUBLE>"), "queries")

    def distance(self, norm2: Column, score: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), norm2 + self.norm2 - 2 * score.cast("double")))

    def intervals(self, queries: DataFrame) -> DataFrame:
        """q, block: blocks that may hold rows of queries (q, far, inner, before, radius) between the radii before and radius."""
        ring = lambda x: F.least(F.greatest(F.floor(x / self.width), F.lit(0)), F.lit(RINGS))
        near = queries.select("q", "inner", "before", "radius", F.posexplode("far").alias("pivot", "d"))
        near = near.withColumn("low", ring(F.col("d") - F.col("radius") - self.slack)).withColumn("ring", F.explode(F.sequence("low", ring(F.col("d") + F.col("radius") + self.slack))))
        blocks = self.blocks.select("block", "pivot", "lo", "hi", ring(F.col("lo")).alias("least"))
        blocks = blocks.withColumn("ring", F.explode(F.sequence("least", ring(F.col("hi")))))
        bound = F.greatest(F.lit(0.0), F.col("lo") - F.col("d"), F.col("d") - F.col("hi"))
        # a block and an interval meet in the first ring that they share
        met = near.join(blocks, ["pivot", "ring"]).where(F.col("ring") == F.greatest("low", "least"))
        return met.where((bound <= F.col("radius") + self.slack) & (bound > F.col("before") + self.slack) & (F.col("d") + F.col("hi") + self.slack >= F.col("inner"))).select("q", "block")

    def scanned(self, hits: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows of every hit's block for each want of its query (q, label, vec, wants), of the query's label or of others."""
        dims, exact = self.space.dims, self.norm2 < 2**52
        packs = max(1, -(-queries.count() // PACK))
        asked = hits.join(queries.select("q", "label", "vec", "wants"), "q").withColumn("pack", F.pmod(F.xxhash64("q"), F.lit(packs)))
        asked = asked.groupBy("block", "pack").agg(F.collect_list(F.struct("q", "label", "vec", "wants")).alias("asked"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = float if exact else np.int64
            for batch in batches:
                out = []
                for block, ids, labels, vecs, asked in zip(*[batch.column(c).to_pylist() for c in ("block", "ids", "labels", "vecs", "asked")]):
                    ids, labels = np.array(ids, np.int64), np.array(labels)
                    x = matrix([vecs], dims).reshape(len(ids), dims).astype(kind)
                    scores = (matrix([a["vec"] for a in asked], dims).astype(kind) @ x.T).astype(np.int64)
                    for a, row in zip(asked, scores):
                        fits = (labels == a["label"]) == same
                        if a["q"] >> 11 == block:
                            fits[a["q"] & 2047] = False
                        mine = np.flatnonzero(fits)
                        for w in a["wants"]:
                            own = row[mine]
                            at = mine[(own >= w["lo"]) & (own <= w["hi"])]
                            if len(at) > 4 * k:  # what is below the k-th score can't be among the k best
                                kth = np.partition(row[at], len(at) - k)[len(at) - k]
                                at = at[row[at] >= kth]
                            best = at[np.lexsort((at, ids[at], -row[at]))[:k]]
                            out += [(a["q"], w["want"], s, i, block << 11 | j) for s, i, j in zip(row[best].tolist(), ids[best].tolist(), best.tolist())]
                columns = list(zip(*out)) or [[]] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _FOUND.split(", ")])

        both = asked.join(self.blocks.select("block", "ids", "labels", "vecs"), "block")
        return both.select("block", "ids", "labels", "vecs", "asked").mapInArrow(run, _FOUND)

    def search(self, queries: DataFrame, wants: DataFrame, k: int, same: bool) -> DataFrame:
        """q, want, score, id, row: for each want (q, want, lo, hi: a score range) the k best rows in it, by score, then smaller id, but the query's own."""
        lists = wants.groupBy("q").agg(F.collect_list(F.struct("want", "lo", "hi")).alias("wants"))
        queries = stored(queries.join(lists, "q"), "asking")
        end = F.sqrt("norm2") + self.norm2**0.5 + 1
        limit = F.lit(float("inf")) if self.far else end
        inner = F.lit(0.0) if self.far else F.when(F.col("hi") == 2**63 - 1, 0.0).otherwise(self.distance(F.col("norm2"), F.col("hi")))
        outer = limit if self.far else F.when(F.col("lo") == -(2**63), limit).otherwise(self.distance(F.col("norm2"), F.col("lo")))
        ranges = stored(wants.join(queries.select("q", "norm2"), "q").select("q", "want", "norm2", inner.alias("inner"), outer.alias("outer")), "ranges")
        first = ranges.groupBy("q").agg(F.min("inner").alias("inner"))
        radii, best, turn, place_ = first.select("q", "inner", F.lit(-1.0).alias("radius")), None, 0, Window.partitionBy("q", "want").orderBy(F.desc("score"), "id", "row")
        while True:
            state = ranges.drop("inner").join(radii.withColumnRenamed("inner", "least"), "q").join(ranges.select("q", "want", "inner"), ["q", "want"])
            if best is None:
                state = state.withColumn("kth", F.lit(None).cast("double"))
            else:
                reached = best.groupBy("q", "want").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") == k).select("q", "want", "low")
                state = state.join(reached, ["q", "want"], "left").withColumn("kth", F.when(F.col("low").isNotNull(), self.distance(F.col("norm2"), F.col("low"))))
            step = float("inf") if self.far else self.space.step * GROWTH**turn + self.slack
            grown = F.greatest("radius", "inner") + F.when(F.col("inner") > 0, STEP * step).otherwise(step)
            open_ = (F.col("radius") < F.col("outer")) & (F.col("kth").isNull() | (F.col("kth") > F.col("radius")))
            goal = F.least("outer", F.coalesce("kth", grown))
            asked = state.where(open_).groupBy("q").agg(F.first("least").alias("inner"), F.first("radius").alias("before"), F.max(goal).alias("radius"))
            asked = stored(asked, "radii")
            if asked.isEmpty():
                break
            hits = self.intervals(queries.select("q", "far").join(asked, "q"))
            found = self.scanned(hits, queries.join(asked.select("q"), "q", "left_semi"), k, same)
            found = found if best is None else found.unionByName(best)
            best = stored(found.withColumn("nth", F.row_number().over(place_)).where(F.col("nth") <= k).drop("nth"), "best")
            rest = radii.join(asked.select("q", F.col("radius").alias("new")), "q", "left")
            radii = stored(rest.select("q", "inner", F.coalesce("new", "radius").alias("radius")), "reached")
            turn += 1
        return queries.sparkSession.createDataFrame([], _FOUND) if best is None else best


def place(block: int, row: int) -> int:
    """The number of a row of the index."""
    return block << 11 | row


def hard_negatives(rows: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, over rows (id, label, vec ARRAY<BIGINT>):
    for the best positives of every anchor, the best rows of other labels whose score is from low to high percent of the positive's."""
    small_batches(rows.sparkSession)
    index = DistanceIndex(rows)
    anchors = index.queries(every)
    anything = anchors.select("q", F.lit(0).alias("want"), F.lit(-(2**63)).alias("lo"), F.lit(2**63 - 1).alias("hi"))
    near = index.search(anchors, anything, positives, True)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
    near = stored(near.select("q", F.row_number().over(order).alias("want"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda percent: F.expr(f"cast(positive_score as decimal(38)) * {percent}")
    wants = near.select("q", "want", F.ceil(share(low) / 100).cast("bigint").alias("lo"), F.floor(share(high) / 100).cast("bigint").alias("hi")).where("lo <= hi")
    found = index.search(anchors, stored(wants, "wants"), negatives, False)
    rank = F.row_number().over(Window.partitionBy("q", "want").orderBy(F.desc("score"), "id", "row"))
    found = found.select("q", "want", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["q", "want"]).join(anchors.select("q", F.col("id").alias("anchor_id")), "q").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole(F.col("embedding")))
    label = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").cast("bigint").alias("id"), label.cast("int").alias("label"), integers(F.col("embedding")).alias("vec")))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM s WHERE same QUALIFY nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.nth ORDER BY s.score DESC, s.vec_id) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""
