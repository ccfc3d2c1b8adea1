"""Toxic spans by a linear-chain conditional random field.

Labels say whether a document is toxic, not where. Token labels are therefore derived from the
labelled documents: a word is an offence if it is more frequent in toxic documents than in others by
log-odds whose lower bound is clear, and in toxic documents offences are tagged 1, all other tokens 0. On
those tagged tokens a two-state linear-chain CRF is fitted (penalised likelihood, forward-backward
gradients). Per document, forward-backward marginals of the whole token sequence give the spans
whose marginal is at least SPAN and three sums that a logistic layer, fitted on the same labelled
documents, turns into the score.

The vocabulary holds offences and beginnings of words that are. Other words share one potential, so runs of them are powers of one 2x2 matrix:
the recursion only stops at vocabulary words, whatever the length of the text.

The model is fitted on a bounded sample, SAMPLE_DOCS labelled documents of either label, drawn by
the hash of the id, one text an id and the first SAMPLE_CHARS characters of it; its vocabulary has at most VOCABULARY
words, the strongest. Of these documents every offence is trained on, in windows of WINDOW words, which short documents
fill up with words outside the vocabulary. Scoring is a map over documents and reads whole texts.

Defined results: null and empty texts get the score of a text without offences; without labelled
documents of both kinds every score is 0; a document with several labels counts as toxic if any is;
a row with a null doc_id is held out (null counts as the empty text, whose remainder is 0) and never learned from;
repeated rows are scored one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold, small_batches, stored, table

SAMPLE_DOCS = 2500
SAMPLE_CHARS = 20_000
VOCABULARY = 5000
#: Toxic documents that a word must be in, their least share, and the 95% lower bound that its log-odds must have, to be an offence.
MIN_DF, MIN_SHARE, MIN_LOG_ODDS = 4, 0.01, 2.0
#: Letters of a word's beginning.
STEM = 5
PENALTY = 1e-3
STEPS = 150
WINDOW = 24
SPAN = 0.5
_WORD = re.compile(r"\w+")

OUT = "doc_id BIGINT, score DOUBLE, spans ARRAY<STRUCT<start: INT, end: INT>>"


def words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)] if text else []


def stem(word: str) -> str:
    """The beginning of a word, by which its relatives are told; `*` is no word character."""
    return word[:STEM] + "*"


def offences(docs: list[tuple[list[str], int]]) -> set[str]:
    """Words, and beginnings of words, that tell toxic documents from others.

    A word counts in toxic documents by the different neighbours it has there, at most one pair a
    document, so that copies of one document count as one; in others it counts by documents.
    """
    n = Counter(y for _, y in docs)
    clean: Counter = Counter()
    around: dict[str, set] = defaultdict(set)
    for ws, y in docs:
        if not y:
            clean.update({*ws, *map(stem, ws)})
            continue
        seen: dict[str, tuple] = {}
        for before, w, after in zip(["", *ws], ws, [*ws[1:], ""]):
            seen.setdefault(w, (before, after))
            seen.setdefault(stem(w), (before, after))
        for w, pair in seen.items():
            around[w].add(pair)
    least = max(MIN_DF, math.ceil(MIN_SHARE * n[1]))
    toxic = {w: len(x) for w, x in around.items() if len(x) >= least}
    odds = {
        w: math.log((k + 0.5) / (n[1] - k + 0.5)) - math.log((clean[w] + 0.5) / (n[0] - clean[w] + 0.5)) - 1.645 * math.sqrt(1 / (k + 0.5) + 1 / (clean[w] + 0.5))
        for w, k in toxic.items()
    }
    strong = {w: o * math.sqrt(toxic[w]) for w, o in odds.items() if o >= MIN_LOG_ODDS}
    return set(sorted(strong, key=lambda w: (-strong[w], w))[:VOCABULARY])


class Crf:
    """Two states; a potential per vocabulary word (0: any other word), and transitions."""

    def __init__(self, vocabulary: list[str]):
        self.known = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.emit = np.zeros((len(vocabulary) + 1, 2))
        self.move = np.zeros((2, 2))
        self.layer = np.zeros(4)
        self.fitted = False
        self.powers: np.ndarray | None = None

    def ids(self, ws: list[str]) -> tuple[list[int], list[int]]:
        """Positions of vocabulary words, and their numbers: of the word itself, else of its beginning."""
        known, at, out = self.known, [], []
        for i, w in enumerate(ws):
            n = known.get(w) or known.get(w[:STEM] + "*")
            if n:
                at.append(i)
                out.append(n)
        return at, out

    def fit(self, seqs: np.ndarray, tags: np.ndarray) -> None:
        """seqs, tags: windows of word ids and labels, all of one length; Adam on the mean log-likelihood."""
        s, t = seqs.shape
        want_e, want_m = np.zeros_like(self.emit), np.zeros_like(self.move)
        np.add.at(want_e, (seqs.ravel(), tags.ravel()), 1)
        np.add.at(want_m, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (self.emit, self.move)]
        for step in range(1, STEPS + 1):
            p = np.exp(self.emit - self.emit.max(1, keepdims=True))
            m = np.exp(self.move - self.move.max())
            fwd, bwd = np.empty((s, t, 2)), np.empty((s, t, 2))
            fwd[:, 0] = p[seqs[:, 0]]
            fwd[:, 0] /= fwd[:, 0].sum(1, keepdims=True)
            for i in range(1, t):
                fwd[:, i] = fwd[:, i - 1] @ m * p[seqs[:, i]]
                fwd[:, i] /= fwd[:, i].sum(1, keepdims=True)
            bwd[:, -1] = 1
            for i in range(t - 2, -1, -1):
                bwd[:, i] = (bwd[:, i + 1] * p[seqs[:, i + 1]]) @ m.T
                bwd[:, i] /= bwd[:, i].sum(1, keepdims=True)
            node = fwd * bwd
            node /= node.sum(2, keepdims=True)
            edge = fwd[:, :-1, :, None] * m * (bwd * p[seqs])[:, 1:, None, :]
            edge /= edge.sum((2, 3), keepdims=True)
            have_e = np.zeros_like(self.emit)
            for y in (0, 1):
                have_e[:, y] = np.bincount(seqs.ravel(), node[:, :, y].ravel(), len(have_e))
            grads = ((want_e - have_e) / s - PENALTY * self.emit, (want_m - edge.sum((0, 1))) / s - PENALTY * self.move)
            for (x, a, b), g in zip(state, grads):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                x += 0.3 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)

    def ready(self) -> None:
        """Powers of the step over one word outside the vocabulary; they soon stop changing, so the last one stands for all longer runs."""
        self.p = np.exp(self.emit - self.emit.max(1, keepdims=True))
        m = np.exp(self.move - self.move.max())
        self.step = m
        one, out = m * self.p[0], [np.eye(2)]
        for _ in range(256):
            nxt = out[-1] @ one
            out.append(nxt / nxt.sum())
        self.powers = np.array(out)

    def marginals(self, at: list[int], ids: list[int], n: int) -> list[float]:
        """P(toxic) of the vocabulary words ids at positions `at` of n words."""
        if self.powers is None:
            self.ready()
        last = len(self.powers) - 1
        fwd, f, prev = [], None, -1
        for i, w in zip(at, ids):
            e = self.p[w]
            if f is None:
                # the first word has no transition before it
                f = np.ones(2) if i == 0 else self.p[0] @ self.powers[min(i - 1, last)] @ self.step
            else:
                f = f @ self.powers[min(i - prev - 1, last)] @ self.step
            f = f * e
            f = f / f.sum()
            fwd.append(f)
            prev = i
        out, b, nxt = [0.0] * len(at), None, n
        for k in range(len(at) - 1, -1, -1):
            i = at[k]
            if b is None:
                b = self.powers[min(n - 1 - i, last)].sum(1)
            else:
                b = self.powers[min(nxt - i - 1, last)] @ (self.step @ (self.p[ids[k + 1]] * b))
            b = b / b.sum()
            m = fwd[k] * b
            out[k] = float(m[1] / m.sum())
            nxt = i
        return out

    def features(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
        ws = words(text)
        at, numbers = self.ids(ws)
        if not at:
            return np.array([1.0, 0.0, 0.0, 0.0]), []
        got = self.marginals(at, numbers, len(ws))
        spans: list[tuple[int, int]] = []
        offending = {i for i, p in zip(at, got) if p >= SPAN}
        if offending:
            # the offsets count code points of the text as it is, and words are numbered in it as words() does
            for i, m in enumerate(_WORD.finditer(text)):
                if i in offending:
                    if spans and i - 1 in offending:
                        spans[-1] = (spans[-1][0], m.end())
                    else:
                        spans.append((m.start(), m.end()))
        total = sum(got)
        return np.array([1.0, max(got), math.log1p(total), total / math.sqrt(len(ws))]), spans

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        if not self.fitted:
            return 0.0, []
        x, spans = self.features(text)
        return float(1 / (1 + math.exp(-max(-500.0, min(500.0, float(x @ self.layer)))))), spans


def fitted(docs: list[tuple[str, int]]) -> Crf:
    """A model from (text, toxic) pairs."""
    tokens = [(words(t), y) for t, y in docs]
    if len({y for _, y in docs}) < 2:
        return Crf([])
    bad = offences(tokens)
    crf = Crf(sorted(bad))
    seqs, tags = [], []
    for ws, y in tokens:
        ids = np.zeros(len(ws), dtype=np.int64)
        at, numbers = crf.ids(ws)
        ids[at] = numbers
        ids = np.pad(ids, (0, max(0, WINDOW - len(ids))))
        starts, last = {0}, len(ids) - WINDOW
        for i in np.flatnonzero(ids):
            if not any(a <= i < a + WINDOW for a in (max(starts), 0)):
                starts.add(min(max(0, int(i) - WINDOW // 2), last))
        for i in sorted(starts):
            got = ids[i : i + WINDOW]
            seqs.append(got)
            tags.append(((got > 0) & (y == 1)).astype(np.int64))
    if seqs:
        crf.fit(np.array(seqs), np.array(tags))
    crf.fitted = True
    x = np.array([crf.features(t)[0] for t, _ in docs])
    y = np.array([y for _, y in docs], dtype=float)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ crf.layer, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
        crf.layer += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * crf.layer)
    return crf


#: Values of the hash that documents are drawn by.
_HASHES = 1 << 40


def training(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most SAMPLE_DOCS labelled documents of either label, drawn by the hash of their id. docs: doc_id, text; labels: doc_id, toxic."""
    there = docs.where(F.col("text").isNotNull()).select("doc_id")
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("y")).join(there, "doc_id", "left_semi")
    marks = stored(marks.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES))), "labelled")
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a share of the hashes first, so that no task gives more rows than it has of that share
    drawn = [
        marks.where((F.col("y") == y) & (F.col("h") < int(_HASHES * min(1.0, 1.5 * SAMPLE_DOCS / counts.get(y, 1))))).orderBy("h", "doc_id").limit(SAMPLE_DOCS).select("doc_id", "y")
        for y in (0, 1)
    ]
    # one text an id, cut where it is read: at most 2 * SAMPLE_DOCS * SAMPLE_CHARS characters reach the driver
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    rows = texts.join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return [(r["text"], r["y"]) for r in sorted(rows.collect(), key=lambda r: (r["y"], r["doc_id"]))]


def scored(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, score, spans (code-point offsets of offending words, end exclusive)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            got = [crf.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([[{"start": a, "end": b} for a, b in x] for _, x in got], spans)],
                names=["doc_id", "score", "spans"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 5) == 0
    model = fitted(training(docs.where(~held).select("doc_id", "text"), labels.where(~held)))
    return scored(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )
