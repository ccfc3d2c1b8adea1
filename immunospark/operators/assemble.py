"""Assembly of reads into contigs, group by group.

Assembly is an ordered fold: reads come in a total order, most solid first, and each one joins a contig
that it overlaps, with indels if need be, extends it, merges two, or founds a new one. Within a group the fold is sequential;
groups (a barcode, or a locus for bulk reads) are independent and are what Spark deals out.
Identical reads of a group are merged into one with a multiplicity in the engine before that, so a
group's task holds distinct reads only. Bulk groups by locus differ from one global fold where reads of
several loci overlap.

Most reads of a thin group overlap none of the others. Which pairs of reads may meet is found for many groups at
once, by their k-mers and letters; a read that meets none is a contig that isn't looked up until one of its pairs comes.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align
from .chains import LEAST, chains
from .reference import windows

K = 11
#: Overlap that joins a read and a contig, in bulk and within a barcode.
OVERLAP, BARCODE_OVERLAP = 31, 17
#: By how much the diagonals of a read's hits may step within one overlap.
GAP = 10
#: Letters of the groups whose pairs of reads are found at once; letters of a group beyond which all its contigs are looked up.
LETTERS, MOST_LETTERS = 500_000, 4_000_000
#: Pairs of equal k-mers, for each k-mer of a group and in all, beyond which its reads overlap so much that all contigs are looked up.
PAIRS, MOST_PAIRS = 8, 4_000_000
#: Letters of an overlap that are compared first.
AHEAD = 48
FOREIGN = re.compile("[^ACGT]")
_LETTERS = np.frombuffer(b"ACGT", dtype=np.uint8)
_CODE = np.full(256, 4, dtype=np.int64)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i

OUT_TAIL = "contig int, consensus string, n_reads bigint, pos_weight array<struct<a:int,c:int,g:int,t:int>>"


def threshold(min_cnt: int, barcoded: bool) -> float:
    """The similarity a read needs: stricter for reads whose rarest k-mer is frequent."""
    return 0.9 if barcoded or min_cnt < 2 else 0.95 if min_cnt < 20 else 0.97


class Assembly:
    """Contigs as position weights with a k-mer index of their consensus; a contig of one read may be without both, quiet, as long as it meets none."""

    def __init__(self, overlap: int = OVERLAP, k: int = K):
        self.overlap, self.k = overlap, k
        self.weights: dict[int, np.ndarray] = {}
        self.text: dict[int, str] = {}
        self.reads: dict[int, int] = {}
        self.index: dict[str, set[int]] = {}
        self.next = 0

    def _put(self, c: int, weights: np.ndarray, reads: int) -> None:
        text = np.where(weights.any(1), _LETTERS[weights.argmax(1)], 78).astype(np.uint8).tobytes().decode()
        if self.text.get(c) != text:
            new = self._kmers(text)
            if c in self.text:
                old = self._kmers(self.text[c])
                self._forget(c, old - new)
                new -= old
            for kmer in new:
                near = self.index.get(kmer)
                if near is None:
                    self.index[kmer] = {c}
                else:
                    near.add(c)
        self.weights[c], self.reads[c], self.text[c] = weights, reads, text

    def found(self, read: str, times: int) -> int:
        """A new quiet contig."""
        c, self.next = self.next, self.next + 1
        self.text[c], self.reads[c] = read, times
        return c

    def wake(self, c: int) -> None:
        """From now on a quiet contig is looked up."""
        if c in self.text and c not in self.weights:
            self._put(c, self._one(self.text.pop(c), self.reads[c]), self.reads[c])

    def weight(self, c: int) -> np.ndarray:
        return self.weights[c] if c in self.weights else self._one(self.text[c], self.reads[c])

    def _one(self, read: str, times: int) -> np.ndarray:
        codes = _CODE[align.letters(read)]
        return self._added(np.zeros((len(codes), 4), dtype=np.int64), codes, 0, times)

    def _kmers(self, text: str) -> set[str]:
        return {text[i : i + self.k] for i in range(len(text) - self.k + 1)}

    def _forget(self, c: int, kmers: set[str]) -> None:
        for kmer in kmers:
            self.index[kmer].discard(c)
            if not self.index[kmer]:
                del self.index[kmer]

    def _drop(self, c: int) -> None:
        self._forget(c, self._kmers(self.text[c]))
        del self.weights[c], self.text[c], self.reads[c]

    def _hits(self, read: str) -> dict[int, list[tuple[int, int]]]:
        """By contig: the places in the read and in the contig of all k-mers that they share."""
        out = defaultdict(list)
        kmers = [read[i : i + self.k] for i in range(len(read) - self.k + 1)]
        for i, near in enumerate(map(self.index.get, kmers)):
            for c in near or ():
                at = self.text[c].find(kmers[i])
                while at >= 0:
                    out[c].append((i, at))
                    at = self.text[c].find(kmers[i], at + 1)
        return out

    def places(self, read: str, similarity: float, hits: dict[int, list[tuple[int, int]]]) -> list[tuple[float, int, int]]:
        """(-matches, contig, offset of the read in it) of good overlaps without indels, best first."""
        out = []
        least, mine = min(self.overlap, len(read)), align.letters(read)
        for c, found in hits.items():
            text = align.letters(self.text[c])
            wild = "N" in read or "N" in self.text[c]
            votes = Counter(at - i for i, at in found)
            for offset in sorted(votes, key=lambda x: (-votes[x], x)):
                lo, hi = max(0, offset), min(len(text), offset + len(read))
                if hi - lo < least:
                    continue
                a, b = text[lo:hi], mine[lo - offset : hi - offset]
                same = int(np.count_nonzero((a == b) | (a == 78) | (b == 78) if wild else a == b))
                if same >= similarity * (hi - lo):
                    out.append((-same, c, offset))
                    break
        return sorted(out)

    @staticmethod
    def _bent(found: list[tuple[int, int]]) -> bool:
        """Whether a cluster of hits, large enough for a chain, has more than one diagonal."""
        places = sorted(at - i for i, at in found)
        first = 0
        for i in range(1, len(places) + 1):
            if i == len(places) or places[i] - places[i - 1] > GAP:
                if i - first >= LEAST and places[i - 1] > places[first]:
                    return True
                first = i
        return False

    def gapped(self, read: str, similarity: float, hits: dict[int, list[tuple[int, int]]]) -> tuple[int, int, int, str] | None:
        """The contig whose overlap with the read has indels and most matches: contig, where the overlap begins in read and contig,
        and its script. Between the ends of a chain of hits the read is aligned with the contig's weights; beyond them it goes on without indels."""
        best = None
        for c, found in sorted(hits.items()):
            if not self._bent(found):
                continue
            text = self.text[c]
            for a, b in chains(*np.array(found).T, self.overlap, self.k, GAP):
                if (a - b == a[0] - b[0]).all():
                    continue
                a0, a1, b0, b1 = int(a[0]), int(a[-1]) + self.k, int(b[0]), int(b[-1]) + self.k
                left, right = min(a0, b0), min(len(read) - a1, len(text) - b1)
                same = lambda x, y: "".join("=" if p == q or "N" in (p, q) else "X" for p, q in zip(x, y))
                script = same(read[a0 - left : a0], text[b0 - left : b0]) + align.weighted(self.weights[c][b0:b1], read[a0:a1])[1] + same(read[a1 : a1 + right], text[b1 : b1 + right])
                n = script.count("=")
                if n >= similarity * len(script) and (best is None or n > best[0]):
                    best = (n, c, a0 - left, b0 - left, script)
        return best and best[1:]

    def _woven(self, c: int, read: str, start: int, place: int, script: str, times: int) -> np.ndarray:
        """A contig's weights with a read that overlaps it by a script: columns that the read lacks stay, letters that the contig
        lacks become columns if the read stands for most of what lies there, and what reaches beyond either end is added."""
        codes, mine, steps = _CODE[align.letters(read)], self.weights[c], align.letters(script)
        read_on, contig_on = steps != ord("D"), steps != ord("I")
        i, j = start + np.cumsum(read_on) - read_on, place + np.cumsum(contig_on) - contig_on  # where each step begins
        total = np.pad(mine.sum(1), 1)
        keep = contig_on | (2 * times > np.maximum(total[j], total[j + 1]))
        rows = np.zeros((len(steps), 4), dtype=np.int64)
        rows[contig_on] = mine[j[contig_on]]
        put = read_on & (codes[np.minimum(i, len(codes) - 1)] < 4)
        rows[put, codes[i[put]]] += times
        one = lambda x: times * (x[:, None] == np.arange(4))
        i, j = start + int(read_on.sum()), place + int(contig_on.sum())
        return np.concatenate([one(codes[:start]) if place == 0 else mine[:place], rows[keep], mine[j:] if j < len(mine) else one(codes[i:])])

    @staticmethod
    def _added(weights: np.ndarray, codes: np.ndarray, offset: int, times: int) -> np.ndarray:
        left, right = max(0, -offset), max(0, offset + len(codes) - len(weights))
        grown = np.zeros((left + len(weights) + right, 4), dtype=np.int64)
        grown[left : left + len(weights)] = weights
        good = np.flatnonzero(codes < 4)
        grown[good + offset + left, codes[good]] += times
        return grown

    def add(self, read: str, similarity: float, times: int = 1, quiet: bool = False) -> int:
        """The contig that a read joins or founds; quiet: a founded one isn't looked up."""
        codes = _CODE[align.letters(read)]
        hits = self._hits(read)
        places = self.places(read, similarity, hits)
        if not places and (found := self.gapped(read, similarity, hits)):
            c, start, place, script = found
            self._put(c, self._woven(c, read, start, place, script, times), self.reads[c] + times)
            return c
        if not places:
            c = self.found(read, times)
            if not quiet:
                self.wake(c)
            return c
        _, c, offset = places[0]
        mine = self.weights[c]
        grown, reads, shift = self._added(mine, codes, offset, times), self.reads[c] + times, max(0, -offset)
        # a second contig that the read reaches into from this one's end is taken in, if they agree
        for _, d, other in places[1:]:
            at = offset - other + shift  # where contig d begins in the grown one
            text = self.text[d]
            lo, hi = max(0, at), min(len(grown), at + len(text))
            if hi <= lo or (at >= 0 and at + len(text) <= len(mine) + shift and len(text) <= len(mine)):
                continue
            base = np.where(grown[lo:hi].sum(1) > 0, grown[lo:hi].argmax(1), 4)
            theirs = _CODE[align.letters(text[lo - at : hi - at])]
            if ((base == theirs) | (base == 4) | (theirs == 4)).mean() < similarity:
                continue
            left, right = max(0, -at), max(0, at + len(text) - len(grown))
            grown = np.pad(grown, ((left, right), (0, 0)))
            grown[at + left : at + left + len(text)] += self.weights[d]
            reads += self.reads[d]
            self._drop(d)
            break
        self._put(c, grown, reads)
        return c

    def without_contained(self, mismatches: int = 1) -> list[int]:
        """Contigs that no longer one contains with at most that many mismatches."""
        order = sorted(self.text, key=lambda c: (-len(self.text[c]), c))
        rank = {c: i for i, c in enumerate(order)}
        kept: set[int] = set()
        hosts = self._quiet_hosts() if mismatches <= 1 else {}
        for c in order:
            own, half = self.text[c], len(self.text[c]) // 2
            inside = False
            # with one mismatch at most one half is exact, so its first k-mer leads to the host; short contigs are compared with all
            seeded = mismatches <= 1 and half >= self.k
            near = {*self.index.get(own[: self.k], ()), *self.index.get(own[half : half + self.k], ()), *hosts.get(c, ())} if seeded else kept
            for d in sorted(near & kept, key=rank.__getitem__):
                host, text = align.letters(self.text[d]), align.letters(own)
                if len(host) > len(text) and len(text):
                    windows = np.lib.stride_tricks.sliding_window_view(host, len(text))
                    inside = bool(((windows != text).sum(1) <= mismatches).any())
                    if inside:
                        break
            if not inside:
                kept.add(c)
        return sorted(kept)

    def _quiet_hosts(self) -> dict[int, set[int]]:
        """By contig the quiet ones, longer than it, that its first k-mer or that of its second half leads to."""
        quiet = [c for c in self.text if c not in self.weights]
        longest = max((len(self.text[c]) for c in quiet), default=0)
        seeds = {c: (x[: self.k], x[len(x) // 2 : len(x) // 2 + self.k]) for c, x in self.text.items() if 2 * self.k <= len(x) < longest}
        out = defaultdict(set)
        if len(seeds) > 16:
            by = defaultdict(list)
            for c, pair in seeds.items():
                for kmer in pair:
                    by[kmer].append(c)
            for d in quiet:
                for kmer in self._kmers(self.text[d]):
                    for c in by.get(kmer, ()):
                        out[c].add(d)
        elif seeds:
            for d in quiet:
                text = self.text[d]
                for c, (first, second) in seeds.items():
                    if first in text or second in text:
                        out[c].add(d)
        return out


def bends(read: str, other: str, similarity: float, overlap: int) -> bool:
    """Whether a read joins another one with indels."""
    one = Assembly(overlap)
    one.wake(one.found(other, 1))
    return one.gapped(read, similarity, one._hits(read)) is not None


def meetings(groups: list[list[str]], similarity: list[list[float]], overlap: int, k: int = K) -> list[dict[int, list[int]] | None]:
    """Of groups of reads in the order of their fold: by read the earlier ones that it may join, as they are or by a chain of hits,
    when each is a contig of its own. None for groups with foreign letters, or with so many shared k-mers that all contigs are to be looked up."""
    out = [None if sum(map(len, g)) > MOST_LETTERS or any(map(FOREIGN.search, g)) else {} for g in groups]
    own = [i for i, o in enumerate(out) if o is not None]
    seqs = [s for i in own for s in groups[i]]
    sizes = [len(groups[i]) for i in own]
    group, begin = np.repeat(np.arange(len(own)), sizes), np.cumsum([0, *sizes])
    size, least = np.array([len(s) for s in seqs], dtype=np.int64), np.array([x for i in own for x in similarity[i]])
    row, place, code, _, _ = windows(pa.array(seqs, pa.large_string()), k)
    bits = max(1, len(row)).bit_length()
    packed = (group[row] << 2 * k | code) << bits | np.arange(len(row))
    packed.sort()
    key, at = packed >> bits, packed & (1 << bits) - 1
    # each k-mer meets those before it in the run of equal ones
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    start = np.repeat(starts, np.diff([*starts, len(key)]))
    rank = np.arange(len(key)) - start
    of = group[row[at]]
    pairs, kmers = np.bincount(of, rank, len(own)), np.bincount(of, minlength=len(own))
    crowded = pairs > np.minimum(PAIRS * kmers, MOST_PAIRS)
    for g in np.flatnonzero(crowded):
        out[own[g]] = None
    rank[crowded[of]] = 0
    later = np.repeat(np.arange(len(key)), rank)
    earlier = np.arange(len(later)) - np.repeat(np.cumsum(rank) - rank - start, rank)
    r, s, a, b = row[at[later]], row[at[earlier]], place[at[later]], place[at[earlier]]
    other = r != s
    r, s, offset = r[other], s[other], (b - a)[other]
    longest = int(size.max(initial=0)) + 1
    ways, n = np.unique((r * max(1, len(seqs)) + s) * 2 * longest + offset + longest, return_counts=True)
    if not len(ways):
        return out
    pair, offset = ways // (2 * longest), ways % (2 * longest) - longest
    r, s = pair // len(seqs), pair % len(seqs)
    # hits on several diagonals near one another
    apart = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (np.diff(offset) > GAP)]))
    bent = (np.add.reduceat(n, apart) >= LEAST) & (np.diff([*apart, len(ways)]) > 1)
    live = [np.array([p for p in np.unique(pair[apart[bent]]).tolist() if bends(*(seqs[x] for x in divmod(p, len(seqs))), least[p // len(seqs)], overlap)], dtype=np.int64)]
    # overlaps without indels: some letters tell most apart
    lo, hi = np.maximum(0, offset), np.minimum(size[s], offset + size[r])
    ends = np.concatenate([[0], np.cumsum(size)])
    letters = np.frombuffer("".join(seqs).encode(), dtype=np.uint8)
    total, x, y, least = hi - lo, ends[s] + lo, ends[r] + lo - offset, least[r]
    some = np.flatnonzero(total >= np.minimum(overlap, size[r]))
    for width in (AHEAD, longest):
        good, at_once = [], max(1, 1_000_000 // width)
        for part in np.split(some, np.arange(at_once, len(some), at_once)):
            step = np.arange(min(width, int(total[part].max(initial=0))))
            i, j = (np.minimum(z[part][:, None] + step, len(letters) - 1) for z in (x, y))
            wrong = np.count_nonzero((letters[i] != letters[j]) & (step < total[part][:, None]), axis=1)
            spare = 1 if width == AHEAD else 0
            good.append(part[total[part] - wrong + spare >= least[part] * total[part]])
        some = np.concatenate(good)
    live.append(pair[some])
    for p in np.unique(np.concatenate(live)).tolist():
        x, y = divmod(p, len(seqs))
        g = int(group[x])
        out[own[g]].setdefault(x - int(begin[g]), []).append(y - int(begin[g]))
    return out


def fold(groups: list[list[tuple[str, int, float]]], overlap: int = OVERLAP) -> list[tuple[Assembly, list[int]]]:
    """The contigs of groups of reads (seq, times, similarity) in their order, and which of them stay."""
    out = []
    for rows, met in zip(groups, meetings([[r[0] for r in g] for g in groups], [[r[2] for r in g] for g in groups], overlap)):
        made, joined = Assembly(overlap), []
        for i, (seq, times, similarity) in enumerate(rows):
            for j in met.get(i, ()) if met else ():
                made.wake(joined[j])
            looked = met is None or made.weights
            joined.append(made.add(seq, similarity, times, met is not None) if looked else made.found(seq, times))
        out.append((made, made.without_contained()))
    return out


def assemble(reads: DataFrame, group: list[str], overlap: int = OVERLAP, barcoded: bool = False, weights: bool = True) -> DataFrame:
    """group, contig, consensus, n_reads, pos_weight (if weights is set) of reads (group, id, seq, min_cnt, median_cnt, avg_cnt)."""
    amounts = ["min_cnt", "median_cnt", "avg_cnt"]
    merged = reads.groupBy(*group, "seq").agg(F.count(F.lit(1)).alias("times"), *[F.max(c).alias(c) for c in amounts])
    kinds = dict(reads.dtypes)
    names = [*group, *[c.split()[0] for c in OUT_TAIL.split(", ")][: 4 if weights else 3]]

    def ordered(rows: list[tuple]) -> list[tuple[str, int, float]]:
        """A group's reads (seq, times, min_cnt and the other amounts) in the order of its fold, nulls last."""
        last = lambda x: (x is None or x != x, -x if x is not None else 0)
        alike = all(r[2:] == rows[0][2:] for r in rows)
        rows.sort(key=(lambda r: (-len(r[0]), r[0])) if alike else lambda r: (*map(last, r[2:]), -len(r[0]), r[0]))
        return [(seq, times, threshold(int(low), barcoded)) for seq, times, low, *_ in rows]

    def batch(firsts: list[pa.Table], groups: list[list[tuple]]) -> pa.RecordBatch:
        done = fold([ordered(g) for g in groups], overlap)
        kept = [(made, c) for made, some in done for c in some]
        of = pa.concat_tables(firsts).combine_chunks().take(pa.array(np.repeat(np.arange(len(done)), [len(some) for _, some in done])))
        number = pa.array([i for _, some in done for i in range(len(some))], pa.int32())
        cols = [number, pa.array([made.text[c] for made, c in kept], pa.string()), pa.array([made.reads[c] for made, c in kept], pa.int64())]
        if weights:
            ends = np.cumsum([0, *[len(made.text[c]) for made, c in kept]])
            table = np.concatenate([np.zeros((0, 4), dtype=np.int64), *[made.weight(c) for made, c in kept]])
            table = pa.StructArray.from_arrays([pa.array(w).cast(pa.int32()) for w in table.T.copy()], list("acgt"))
            cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table))
        keys = [of.column(g).chunk(0) if of.column(g).num_chunks else pa.array([], of.column(g).type) for g in group]
        return pa.RecordBatch.from_arrays([*keys, *cols], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come group after group; a group may go on in the next batch."""
        key, firsts, groups, held = None, [], [], 0
        for got in batches:
            table = pa.Table.from_batches([got]).select(group)
            keys = list(zip(*[c.to_pylist() for c in table.columns]))
            rows = zip(*[got.column(c).to_pylist() for c in ("seq", "times", *amounts)])
            for i, (mine, r) in enumerate(zip(keys, rows)):
                if not groups or mine != key:
                    if held >= LETTERS:
                        yield batch(firsts, groups)
                        firsts, groups, held = [], [], 0
                    key = mine
                    firsts.append(table.slice(i, 1))
                    groups.append([])
                groups[-1].append(r)
                held += len(r[0])
        if groups:
            yield batch(firsts, groups)

    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + ", " + ", ".join(OUT_TAIL.split(", ")[: 4 if weights else 3])
    return merged.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def assigned(reads: DataFrame, contigs: DataFrame, group: list[str], similarity: float = 0.9, k: int = K) -> DataFrame:
    """id, contig, offset of each read in the contig of its group that it fits best: an equi-join on k-mers, votes per diagonal, then the exact comparison."""
    from .reference import gene_kmers, hits

    refs = gene_kmers(contigs.select(F.struct(*group, "contig").alias("gene_idx"), F.col("consensus").alias("seq")), k)
    found = hits(reads.select(F.struct(*group, "id").alias("id"), "seq"), refs, k).where("strand = 1")
    same_group = F.lit(True)
    for g in group:
        same_group = same_group & F.col(f"id.{g}").eqNullSafe(F.col(f"gene.{g}"))
    votes = found.where(same_group).groupBy("id", "gene", (F.col("gene_offset") - F.col("offset")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("id").agg(F.max_by(F.struct("gene", "at"), F.struct("n", -F.col("gene.contig"), -F.col("at"))).alias("x"))
    best = best.select(*[F.col(f"id.{g}").alias(g) for g in group], F.col("id.id").alias("id"), F.col("x.gene.contig").alias("contig"), F.col("x.at").alias("offset"))
    both = best.join(reads.select(*group, "id", "seq"), [*group, "id"]).join(contigs.select(*group, "contig", "consensus"), [*group, "contig"])
    return both.where(overlap_similarity(F.col("consensus"), F.col("seq"), F.col("offset")) >= similarity).select(*group, "id", "contig", "offset")


def overlap_similarity(contig: Column, read: Column, offset: Column) -> Column:
    """The share of equal letters where a read lies on a contig."""
    lo, hi = F.greatest(offset, F.lit(0)), F.least(F.length(contig), offset + F.length(read))
    a = F.substr(contig, lo + 1, F.greatest(hi - lo, F.lit(0)))
    b = F.substr(read, lo - offset + 1, F.greatest(hi - lo, F.lit(0)))
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    return F.when(hi > lo, same / (hi - lo)).otherwise(0.0)
