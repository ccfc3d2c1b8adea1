"""N-gram Jaccard join: documents whose sets of five-word shingles are at least 0.8 similar.

Documents of equal shingle sets are one node. Nodes are joined in a MinHash LSH forest of TREES
trees: each holds the nodes' signatures, DEPTH MinHash values deep, as a sorted prefix trie. Nodes
match on the longest prefix that they share with any other; from DEPTH on, prefixes are shortened
until the recall of a pair at the threshold, 1 - (1 - 0.8^d)^TREES, reaches RECALL. Candidates are
verified by their shingles, exactly.

No step lists the pairs of a group. A node is verified against one pivot, the smallest node of its
deepest matches; nodes nearer than half the reach (distance below 0.1) make up the pivot's star. As
Jaccard distance is a metric, any two nodes of a star are linked, so a star's links are known from
its size. Stars that meet in a bucket of the shortest prefixes and whose pivots' signatures are not
too far apart, by a margin of four standard deviations at the distance in question, are of one family: a task takes in a bucket,
in blocks of at most STARS, and gives back a spanning forest. Within a family, nodes of different
stars are compared exactly, in blocks of at most BLOCK nodes, inside tasks that give back a count per
node and a spanning forest of the stars they link. Linked stars make a class; its smallest doc_id
names it.

Groups that may hold a third of all rows are dealt out by salts in proportion to their size (pivot
text is copied to each salt), and counts are combined before each shuffle.

Words are runs of word characters in lower case. Defined results: a null text is empty; a document
without words is a class of its own; one with fewer than five words has the run of them as its only
shingle; rows that share doc_id and shingles give rows of their own with equal results, and kept() keeps one of
them; a null doc_id is carried along and comes after all others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .shared import named, shuffle_partitions, small_batches, stored, table, unused, worker_cache

WORDS = 5
#: The threshold as a fraction: similarity >= OVER / UNDER.
OVER, UNDER = 4, 5
REACH = 1 - OVER / UNDER
TREES, DEPTH = 24, 7
RECALL = 0.9999
#: Nodes of a block; stars of a bucket's block; members that share a copy of a pivot.
BLOCK, STARS, COPY = 512, 512, 256
#: Standard deviations by which signatures may say that pivots are farther apart than they are.
MARGIN = 4.0
_WORD = re.compile(r"\w+")


def shortest(recall: float = RECALL) -> int:
    """The longest prefix that reaches the recall at the threshold."""
    return max([d for d in range(1, DEPTH + 1) if 1 - (1 - (OVER / UNDER) ** d) ** TREES >= recall], default=1)


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    ws = _WORD.findall(text.lower()) if text else []
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(worker_cache("hashes", _Hashes).__getitem__, ws), dtype=np.uint64, count=len(ws))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), dtype=np.uint64)
    for k in range(min(len(h), WORDS)):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    n = TREES * DEPTH
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row per set (none empty)."""
    a, b = _coefficients()
    out = np.empty((len(sets), len(a)), dtype=np.int32)
    at, start = 0, 0
    while start < len(sets):
        # about 64k hashes at a time stay in cache
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[start:end])
        offsets = np.cumsum([0] + [len(s) for s in sets[start : end - 1]])
        for k in range(len(a)):
            out[start:end, k] = np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(32), offsets).astype(np.uint32).view(np.int32)
        start = end
    return out


SIGNED = "doc_id BIGINT, content BIGINT, node BINARY, n INT, sig ARRAY<INT>"


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, content (hash of the text), node (digest of the shingle set; null without words), n (its size), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(t.as_py()) for t in batch.column("text")]
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("content"),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([next(sigs) if len(s) else None for s in sets], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "content", "node", "n", "sig"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content")).mapInArrow(run, SIGNED)


def row_of(content: Column) -> Column:
    """What tells rows apart, and their order within a class: the smallest doc_id first, null ones last, then the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), content.alias("content"))


def prefix(tree: Column, depth: int) -> Column:
    return F.xxhash64(tree, F.slice("sig", tree * DEPTH + 1, depth))


def streamed(df: DataFrame, keys: list[str], sort: list[str], start: Callable, schema: str) -> DataFrame:
    """Deal rows out by keys and run through each group's rows in order; start() makes a consumer with row(...) and end(), that yield result rows."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        group, consumer, out = None, None, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], names=[n for n, _ in kinds])

        kinds = _arrow(schema)
        for b in batches:
            for values in zip(*(b.column(c) for c in columns)):
                row = {c: v.as_py() for c, v in zip(columns, values)}
                at = tuple(row[k] for k in keys)
                if at != group:
                    if consumer is not None:
                        out += consumer.end()
                    group, consumer = at, start()
                out += consumer.row(row)
                if len(out) >= 5000:
                    yield batch()
                    out = []
        if consumer is not None:
            out += consumer.end()
        yield batch()

    n = shuffle_partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *sort).mapInArrow(run, schema)


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"BIGINT": pa.int64(), "INT": pa.int32(), "DOUBLE": pa.float64(), "BINARY": pa.binary(), "BOOLEAN": pa.bool_()}
    return [(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))]


class _Pivot:
    """The first row is the pivot's; each other gives its distance from it."""

    def __init__(self):
        self.pivot = None

    def row(self, r: dict) -> list[tuple]:
        s = shingles(r["text"])
        if r["role"] == 0:
            self.pivot = s
            return []
        if self.pivot is None:  # its text is gone from the input
            return []
        both = len(np.intersect1d(self.pivot, s, assume_unique=True))
        either = len(self.pivot) + len(s) - both
        return [(r["pivot"], r["node"], 1 - both / either)]

    def end(self) -> list[tuple]:
        return []


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pivot, node, dist for stored pairs (pivot, node). texts: node, text."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / COPY).cast("int").alias("salts"))
    members = pairs.join(sizes, "pivot").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).join(texts, "node")
    pivots = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(texts.withColumnRenamed("node", "pivot"), "pivot")
    rows = members.select("pivot", "salt", F.lit(1).alias("role"), "node", "text").unionByName(pivots.select("pivot", "salt", F.lit(0).alias("role"), F.col("pivot").alias("node"), "text"))
    return streamed(rows, ["pivot", "salt"], ["role", "node"], _Pivot, "pivot BINARY, node BINARY, dist DOUBLE")


class _Forest:
    """Union-find that keeps the edges that joined something."""

    def __init__(self):
        self.up: dict = {}
        self.edges: list[tuple] = []

    def top(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x, y) -> None:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.up[b] = a
            self.edges.append((x, y))


class _Meet:
    """A spanning forest of a bucket's stars, joined where their pivots may be close enough by their signatures."""

    def __init__(self):
        self.rows: list[dict] = []

    def row(self, r: dict) -> list[tuple]:
        self.rows.append(r)
        return []

    def end(self) -> list[tuple]:
        if len(self.rows) < 2:
            return []
        sig = np.array([r["sig"] for r in self.rows])
        far = np.array([r["radius"] for r in self.rows])
        star = [r["star"] for r in self.rows]
        found = _Forest()
        for i in range(len(sig) - 1):
            like = (sig[i + 1 :] == sig[i]).mean(1)
            reach = np.minimum(REACH + far[i] + far[i + 1 :], 1)
            for j in i + 1 + np.flatnonzero(1 - like <= reach + MARGIN * np.sqrt(reach * (1 - reach) / sig.shape[1])):
                found.join(star[i], star[j])
        return found.edges


class _Compare:
    """Links between nodes of different stars of two blocks, or of one: counts per node (b null), and a spanning forest of linked stars (a, b)."""

    def __init__(self):
        self.sides: tuple[list, list] = ([], [])

    def row(self, r: dict) -> list[tuple]:
        self.job = r
        self.sides[r["side"]].append((r["node"], r["star"], shingles(r["text"])))
        return []

    def end(self) -> list[tuple]:
        left, right = self.sides
        own = self.job["p"] == self.job["q"]
        right = left if own else right
        if not left or not right:
            return []
        la, lb = (np.array([len(x[2]) for x in side]) for side in (left, right))
        flat = np.concatenate([x[2] for x in left] + ([] if own else [x[2] for x in right]))
        ids, col = np.unique(flat, return_inverse=True)
        rows = np.repeat(np.arange(len(left) + (0 if own else len(right))), la if own else np.concatenate([la, lb]))
        by = np.argsort(col, kind="stable")
        col, rows = col[by], rows[by]
        both, wide = np.zeros((len(left), len(right)), dtype=np.int64), 4096
        for c in range(0, len(ids), wide):
            i, j = np.searchsorted(col, [c, c + wide])
            m = np.zeros((len(left) + (0 if own else len(right)), wide), dtype=np.float32)
            m[rows[i:j], col[i:j] - c] = 1
            both += np.rint(m[: len(left)] @ (m if own else m[len(left) :]).T).astype(np.int64)
        linked = (UNDER + OVER) * both >= OVER * (la[:, None] + lb[None, :])
        names = {x: k for k, x in enumerate(dict.fromkeys(x[1] for side in (left, right) for x in side))}
        linked &= np.array([names[x[1]] for x in left])[:, None] != np.array([names[x[1]] for x in right])[None, :]
        out = [(x[0], None, int(n)) for x, n in zip(left, linked.sum(1)) if n]
        if not own:
            out += [(x[0], None, int(n)) for x, n in zip(right, linked.sum(0)) if n]
        found = _Forest()
        for i, j in zip(*np.nonzero(linked)):
            found.join(left[i][1], right[j][1])
        return out + [(a, b, 0) for a, b in found.edges]


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that edges (a, b) lead to. Labels spread and are followed to their own labels, round by round."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("further"))
        new = stored(step.join(jump, "to", "left").select("node", "old", F.least("to", F.coalesce("further", "to")).alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.where(F.col("old") != F.col("root")).limit(1).count():
            return labels


def placed(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, row (see row_of), node, first (the smallest row of its class; null without words), class_id, n_links, n_copies."""
    small_batches(docs.sparkSession)
    every = stored(signed(docs), "signed")
    rows = every.where(F.col("node").isNotNull())
    # one row per shingle set; the smallest doc_id that has it tells where its text is
    nodes = rows.groupBy("node").agg(F.min_by(F.struct("doc_id", "content", "sig"), row_of(F.col("content"))).alias("x"), F.count(F.lit(1)).alias("n_copies"))
    nodes = stored(nodes.select("node", F.col("x.doc_id").alias("doc_id"), F.col("x.content").alias("content"), F.col("x.sig").alias("sig"), "n_copies"), "nodes")

    # the forest: the shortest prefixes with company, and within them the deepest match of each node
    low = shortest()
    trees = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig")
    deep = list(range(DEPTH, low, -1))
    forest = trees.select("node", prefix(F.col("tree"), low).alias("bucket"), F.struct(*[prefix(F.col("tree"), d).alias(f"d{d}") for d in deep]).alias("deeper"))
    company = forest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1").select("bucket", "leader")
    matched = stored(forest.join(company, "bucket"), "matched")
    levels = matched.select("node", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"deeper.d{d}").alias("key")) for d in deep], F.struct(F.lit(low).alias("depth"), F.col("bucket").alias("key")))).alias("x")).select("node", "x.*")
    leaders = levels.groupBy("depth", "key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # the deepest match with the smallest leader; a node that leads its deepest matches is a pivot itself
    deepest = levels.join(leaders, ["depth", "key"]).groupBy("node").agg(F.min(F.struct((-F.col("depth")).alias("up"), "leader")).alias("x"))
    pairs = stored(deepest.select("node", F.col("x.leader").alias("pivot")).where("pivot < node"), "pairs")

    # the texts of all nodes with company, once each
    wanted = matched.select("node").distinct().join(nodes.select("node", "doc_id", "content"), "node")
    texts = stored(_texts(docs, wanted), "texts")

    # stars: members are verified, pivots of others are roots of their own
    near = stored(verified(pairs, texts), "near").where(F.col("dist") < REACH / 2)
    roots = near.select(F.col("pivot").alias("node")).distinct()
    members = near.join(roots, "node", "left_anti").select("node", F.col("pivot").alias("star"), "dist")
    alone = wanted.select("node").join(members.select("node"), "node", "left_anti").select("node", F.col("node").alias("star"), F.lit(0.0).alias("dist"))
    stars = stored(members.unionByName(alone), "stars")
    sizes = stored(stars.groupBy("star").agg(F.count(F.lit(1)).alias("size"), F.max("dist").alias("radius")), "sizes")

    # families: stars that meet in a bucket and may be close enough
    met = matched.select("node", "bucket").join(stars.select("node", "star"), "node").select("bucket", "star").distinct()
    crowd = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / STARS).cast("int").alias("blocks"))
    met = met.join(crowd, "bucket").withColumn("own", F.pmod(F.xxhash64("star"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "star").join(sizes.select("star", "radius"), "star")
    met = met.join(nodes.select(F.col("node").alias("star"), "sig"), "star")
    families = components(streamed(met, ["bucket", "bi", "bj"], ["star"], _Meet, "a BINARY, b BINARY"))

    # blocks of a family: a star of more than BLOCK nodes has its own, smaller ones share
    dealt = families.select(F.col("node").alias("star"), F.col("root").alias("family")).join(sizes.select("star", "size"), "star")
    large = F.col("size") > BLOCK
    small = dealt.groupBy("family").agg(F.ceil(F.sum(F.when(~large, F.col("size")).otherwise(0)) / BLOCK).alias("shared"))
    dealt = dealt.join(small, "family").select("star", "family", F.when(large, F.col("star")).alias("pure"), F.when(large, F.ceil(F.col("size") / BLOCK)).otherwise(F.greatest("shared", F.lit(1))).alias("n"))
    at = F.when(F.col("pure").isNotNull(), F.xxhash64("pure", F.pmod(F.xxhash64("node"), F.col("n")))).otherwise(F.pmod(F.xxhash64("star", F.lit(1)), F.col("n")))
    inside = stored(stars.select("node", "star").join(dealt, "star").select("node", "star", "family", "pure", at.alias("block")), "inside")
    blocks = inside.groupBy("family", "block").agg(F.min("pure").alias("pure"))
    p, q = (blocks.select("family", F.col("block").alias(x), F.col("pure").alias(f"pure_{x}")) for x in ("p", "q"))
    jobs = p.join(q, "family").where((F.col("p") <= F.col("q")) & ~F.coalesce(F.col("pure_p") == F.col("pure_q"), F.lit(False)))
    jobs = stored(jobs.select("family", "p", "q"), "jobs")
    side = lambda at, k: (jobs if k == 0 else jobs.where("p <> q")).join(inside.select("family", F.col("block").alias(at), "node", "star"), ["family", at]).select("family", "p", "q", F.lit(k).alias("side"), "node", "star")
    sides = side("p", 0).unionByName(side("q", 1)).join(texts, "node")
    compared = stored(streamed(sides, ["family", "p", "q"], ["side", "node"], _Compare, "a BINARY, b BINARY, n BIGINT"), "compared")

    # links per node, and classes of linked stars
    more = compared.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("m"))
    counts = stars.select("node", "star").join(sizes.select("star", "size"), "star").join(more, "node", "left")
    counts = counts.select("node", "star", (F.col("size") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    found = components(compared.where("b IS NOT NULL").select("a", "b"))
    grouped = counts.join(found.select(F.col("node").alias("star"), "root"), "star", "left").select("node", F.coalesce("root", "star").alias("root"), "n_links")
    grouped = stored(nodes.select("node", row_of(F.col("content")).alias("row"), "doc_id", "n_copies").join(grouped, "node", "left").select("node", "row", "doc_id", "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "grouped")
    names = grouped.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min("row").alias("first"))
    verdict = grouped.join(names, "root").select("node", "first", "class_id", "n_links", "n_copies")
    return every.select("doc_id", row_of(F.col("content")).alias("row"), "node").join(verdict, "node", "left")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (other shingle sets at least 0.8 similar), n_copies (documents of its own set, itself included)."""
    out = placed(docs)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs, of each class one: the smallest by row_of, and of rows that repeat it the one with the smallest columns.

    So rows of a null doc_id stay only in classes without another id, and rows of one doc_id are judged each by
    its own text. Rows without words are classes of their own, but those that repeat a doc_id and text are one
    document; with a null doc_id nothing says so, and all of them stay.
    """
    found = stored(placed(docs).select("row", F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("stays"), (F.col("node").isNotNull() | ~F.col("row.none")).alias("one")), "near-duplicates")
    rows = found.where("one").groupBy("row").agg(F.min("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    rows = stored(rows.where("NOT stays OR n > 1").select(F.col("row").alias("_row"), "stays"), "near-rows")
    key, same = unused(docs.columns, "_row", "_x")
    rows = rows.withColumnRenamed("_row", key)
    keyed = docs.withColumn(key, row_of(F.xxhash64(F.col("text").cast("string"))))
    columns = named(docs.columns)
    single = keyed.join(rows, key, "left_anti").select(*columns)
    # what has no order of its own, such as a map, is ordered by its JSON
    order = [F.to_json(F.struct(x.alias("x"))) if _unordered(f.dataType) else x for f, x in zip(docs.schema.fields, columns)]
    again = keyed.join(rows.where("stays"), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias(same))
    return single.union(again.select(*[F.col(same).getField(c).alias(c) for c in docs.columns]))


def _unordered(kind: DataType) -> bool:
    """Whether rows can't be ordered by a column of this type."""
    return any(x in kind.simpleString() for x in ("map<", "variant", "calendar"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes (node, doc_id, content). A text is found by its row's id and its own hash, so that rows without an id are no group."""
    rows = docs.where(F.col("text").isNotNull()).select(row_of(F.xxhash64(F.col("text").cast("string"))).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.join(wanted.select("node", row_of(F.col("content")).alias("row")), "row").groupBy("node").agg(F.min("text").alias("text"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))
