"""Contig annotation: V, D, J and C genes, CDRs and the CDR3's score.

Stateless and so embarrassingly parallel: contigs stream through Arrow batches against the reference,
whose size is that of a gene catalogue (about a thousand short sequences; MAX_GENES is checked). For
each contig, k-mer hits choose candidate genes and their main diagonal; a candidate is aligned as the
best-scoring ungapped stretch of its diagonal, or by a gapped local alignment when its hits leave that
diagonal. A contig that a run of N parts, such as joined mates, is hit segment by segment, and hits of one
gene in order make one hit across the gap. The best V, J and C of one locus are kept, CDR1 and CDR2 are
projected from the V gene's coordinates, the CDR3 runs from the conserved cysteine to the J motif, and the D
gene is looked for between V and J. A CDR3 with a gap in it, or without V or J, is partial, of score 0.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import align
from . import cdr3_ladder
from .chains import chains, cover
from .reference import Places, frequent, windows

MAX_GENES = 20_000
K, RADIUS = 9, 10
#: Bases that k-mer hits of a candidate must cover, by gene type.
NEED = {"V": 17, "J": 15, "C": 17}
#: Contigs with other letters are hit segment by segment.
FOREIGN = re.compile("[^ACGT]")
#: Letters N in a row that part a contig.
GAP = 7
#: Letters of a gene, less one, that hits on either side of a gap may share.
OVERLAP = 2
#: Candidates aligned per type; share of the best similarity that secondary hits have; hits kept.
CANDIDATES, SECONDARY, KEEP = 40, 0.95, 3
MIN_SIMILARITY = 0.8
#: Letters at a hit's end below which it is extended to the end.
CLOSE = 5
_HIT = "array<struct<gene:string,ref_len:int,read_start:int,read_end:int,ref_start:int,ref_end:int,similarity:double>>"
_CDR = "struct<start:int,end:int,score:double,seq:string>"
OUT = f"cid string, len int, v {_HIT}, d {_HIT}, j {_HIT}, c {_HIT}, cdr1 {_CDR}, cdr2 {_CDR}, cdr3 {_CDR}, seq string"


@dataclass
class Gene:
    name: str
    seq: str
    kind: str
    locus: str
    cdr1: tuple[int, int] | None = None
    cdr2: tuple[int, int] | None = None
    cdr3_start: int | None = None
    j_end: int | None = None


@dataclass
class Hit:
    gene: Gene
    start: int
    end: int
    ref_start: int
    ref_end: int
    matches: int
    diagonal: bool
    script: str = field(default="", repr=False)
    parts: list[Hit] = field(default_factory=list, repr=False)

    @property
    def similarity(self) -> float:
        return 2 * self.matches / (self.end - self.start + self.ref_end - self.ref_start + 2)

    def at(self, ref: int) -> int | None:
        """The contig position that a gene position lies on."""
        if not self.ref_start <= ref <= self.ref_end:
            return None
        if self.parts:
            return next((x for p in self.parts if (x := p.at(ref)) is not None), None)
        if self.diagonal:
            return self.start + ref - self.ref_start
        i, j = self.start, self.ref_start
        for c in self.script:
            if j == ref and c in "=XD":
                return i
            i += c in "=XI"
            j += c in "=XD"
        return None

    def clean(self, ref: int, way: int, columns: int) -> bool:
        """Whether no indel lies within so many alignment columns from a gene position on, towards its start (way -1) or end (1)."""
        if self.parts:
            part = next((p for p in self.parts if p.ref_start <= ref <= p.ref_end), None)
            return part is not None and part.clean(ref, way, columns)
        if self.diagonal:
            return True
        j = self.ref_start - 1
        for k, c in enumerate(self.script):
            j += c in "=XD"
            if j == ref and c in "=XD":
                near = self.script[max(0, k - columns + 1) : k + 1] if way < 0 else self.script[k : k + columns]
                return "I" not in near and "D" not in near
        return False

    def steps(self, seq: str) -> str:
        """The alignment of a hit in one piece as a script."""
        if not self.diagonal:
            return self.script
        return "".join("=" if a == b else "X" for a, b in zip(seq[self.start : self.end + 1], self.gene.seq[self.ref_start : self.ref_end + 1]))

    def row(self) -> dict:
        return {"gene": self.gene.name, "ref_len": len(self.gene.seq), "read_start": self.start, "read_end": self.end, "ref_start": self.ref_start, "ref_end": self.ref_end, "similarity": round(100 * self.similarity, 2)}


class Reference:
    """Genes with a k-mer index."""

    def __init__(self, genes: list[Gene]):
        self.genes = genes
        self.index: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for g, gene in enumerate(genes):
            if gene.kind in NEED:
                for i in range(len(gene.seq) - K + 1):
                    self.index[gene.seq[i : i + K]].append((g, i))
        self.letters = [align.letters(g.seq) for g in genes]
        self.places = Places([g.seq if g.kind in NEED else None for g in genes], K)
        self.need = np.array([NEED.get(g.kind, K) for g in genes], dtype=np.int64)

    @classmethod
    def of(cls, ref: DataFrame) -> Reference:
        rows = ref.orderBy("gene_idx").limit(MAX_GENES + 1).collect()
        if len(rows) > MAX_GENES:
            raise ValueError(f"a reference of more than {MAX_GENES} genes")
        pair = lambda x: (x["a"], x["b"]) if x else None
        return cls([Gene(r["name"].split("|")[0], r["seq"], r["gene_type"], r["locus"], pair(r["cdr1"]), pair(r["cdr2"]), r["cdr3_start"], r["j_end"]) for r in rows if r["gene_type"]])

    def stretch(self, g: int, text: np.ndarray, diagonal: int, lo: int, hi: int) -> Hit | None:
        """The best-scoring ungapped stretch of a diagonal (contig position minus gene position) within [lo, hi): 1 for a match, -2 for a mismatch, 0 for N."""
        ref = self.letters[g]
        first, last = max(lo, diagonal), min(hi, diagonal + len(ref))
        if last <= first:
            return None
        t, r = text[first:last], ref[first - diagonal : last - diagonal]
        same = t == r
        score = np.where(same, 1, np.where((t == 78) | (r == 78), 0, -2))
        total = np.cumsum(score)
        floor = np.minimum.accumulate(np.concatenate([[0], total]))[:-1]
        end = int(np.argmax(total - floor))
        if total[end] - floor[end] <= 0:
            return None
        start = int(np.flatnonzero(np.concatenate([[0], total])[: end + 1] == floor[end])[-1])
        return Hit(self.genes[g], first + start, first + end, first + start - diagonal, first + end - diagonal, int(same[start : end + 1].sum()), True)

    def gapped(self, g: int, seq: str, lo: int, hi: int) -> Hit | None:
        gene = self.genes[g]
        score, ts, ps, script = align.local(gene.seq, seq[lo:hi])
        if score <= 0:
            return None
        m = script.count("=")
        read, ref = sum(c in "=XI" for c in script), sum(c in "=XD" for c in script)
        return Hit(gene, lo + ps, lo + ps + read - 1, ts, ts + ref - 1, m, "I" not in script and "D" not in script, script)

    def along(self, g: int, seq: str, a: np.ndarray, b: np.ndarray) -> Hit:
        """The alignment along a chain of hits: its runs letter by letter, what lies between two diagonals globally."""
        gene, i, j, script = self.genes[g], int(a[0]), int(b[0]), ""
        for run in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a - b)) + 1):
            shift, end = int(a[run[0]] - b[run[0]]), int(a[run[-1]]) + K
            start = max(int(a[run[0]]), i, j + shift)  # runs of two diagonals may overlap
            if start >= end:
                continue
            script += between(gene.seq[j : start - shift], seq[i:start]) + between(gene.seq[start - shift : end - shift], seq[start:end])
            i, j = end, end - shift
        return Hit(gene, int(a[0]), i - 1, int(b[0]), j - 1, script.count("="), "I" not in script and "D" not in script, script)

    def aligned(self, g: int, seq: str, text: np.ndarray, a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> Hit | None:
        """The alignment of a gene with a segment of a contig by the places of their k-mer hits."""
        found = chains(a, b, K, K, RADIUS, strays=True)
        if found:
            a, b = max(found, key=lambda x: min(cover(x[0], K), cover(x[1], K)))
            if (a - b != a[0] - b[0]).any():
                return self.along(g, seq, a, b)
        d, _ = max(Counter((a - b).tolist()).items(), key=lambda x: (x[1], -x[0]))
        return self.stretch(g, text, d, lo, hi)

    def votes(self, seq: str, pieces: list[tuple[int, int]]) -> dict[int, dict[int, list]]:
        """By gene and segment: the places in contig and gene of all k-mers that they share."""
        votes: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for s, (lo, hi) in enumerate(pieces):
            for i in range(lo, hi - K + 1):
                for g, offset in self.index.get(seq[i : i + K], ()):
                    votes[g][s].append((i, offset))
        return votes

    def ballots(self, seqs: list[str]) -> list[dict[int, dict[int, np.ndarray]] | None]:
        """The votes of many contigs at once, but for genes whose hits within any two neighbouring stripes of diagonals are too
        few for a candidate; None for contigs with foreign letters."""
        out = [None if FOREIGN.search(s) else {} for s in seqs]
        row, place, code, _, _ = windows(pa.array([s if o is not None else "" for s, o in zip(seqs, out)], pa.large_string()), K)
        at, g, offset = self.places.meet(code)
        row, place, g, offset = row[at], place[at], g.astype(np.int64), offset.astype(np.int64)
        key, least = row * len(self.genes) + g, self.need[g] - K + 1
        some = np.flatnonzero(frequent(key, least))
        # candidates' hits lie within RADIUS of one diagonal, so in two neighbouring stripes
        stripe = (place[some] - offset[some]) // (2 * RADIUS + 1)
        stripe -= stripe.min(initial=0)
        near = key[some] * (int(stripe.max(initial=0)) + 2) + stripe
        values, of, n = np.unique(near, return_inverse=True, return_counts=True)
        both = n.copy()
        both[:-1] += np.where(np.diff(values) == 1, n[1:], 0)
        good = both[of] >= least[some]
        kept = some[np.isin(key[some], key[some][good])]
        kept = kept[np.argsort(key[kept], kind="stable")]
        for part in np.split(kept, np.flatnonzero(np.diff(key[kept])) + 1):
            if len(part):
                out[row[part[0]]][int(g[part[0]])] = {0: np.stack([place[part], offset[part]], 1)}
        return out

    def met(self, seq: str, votes: dict[int, dict[int, np.ndarray]] | None = None) -> dict[str, list[tuple[int, Hit]]]:
        """By gene type the candidates, best first, and their alignments up to the ends of their k-mer hits. votes: those of all genes that may be candidates, if they are known."""
        pieces = segments(seq)
        if votes is None:
            votes = self.votes(seq, pieces)
        if not votes:
            return {}
        text = align.letters(seq)
        ranked: dict[str, list] = defaultdict(list)
        for g, by in votes.items():
            near = 0
            for hits in by.values():
                diagonals, counts = np.unique(np.subtract(*np.array(hits).T), return_counts=True)
                near = max(near, int(counts[np.abs(diagonals - diagonals[counts.argmax()]) <= RADIUS].sum()))
            if near + K - 1 >= NEED[self.genes[g].kind]:
                ranked[self.genes[g].kind].append((-near, g))
        out: dict[str, list[tuple[int, Hit]]] = {}
        for kind, rows in ranked.items():
            out[kind] = []
            for _, g in sorted(rows)[:CANDIDATES]:
                parts = [h for s, hits in sorted(votes[g].items()) if (h := self.aligned(g, seq, text, *np.array(hits).T, *pieces[s])) and h.matches >= K]
                if parts:
                    out[kind].append((g, joined(parts)))
        return out

    def ends(self, seqs: list[str], met: list[dict[str, list[tuple[int, Hit]]]]) -> dict[tuple[str, str, float], str]:
        """How the hits of many contigs that may be extended go on at their ends, all at once."""
        cases: dict[tuple[str, str, float], str] = {}
        for seq, kinds in zip(seqs, met):
            for rows in kinds.values():
                best = 0
                for _, hit in rows:
                    if most(hit, seq) >= SECONDARY * best:
                        for h in (hit.parts[0], hit.parts[-1]) if hit.parts else (hit,):
                            lo, hi = around(h, segments(seq))
                            cases[ahead(h, seq, h.start - lo, False)] = cases[ahead(h, seq, hi - 1 - h.end, True)] = ""
                    best = max(best, hit.matches)
        return dict(zip(cases, (x[3] for x in align.one_ends(list(cases)))))

    def hits(self, seq: str, votes: dict[int, dict[int, np.ndarray]] | None = None, met: dict[str, list[tuple[int, Hit]]] | None = None, known: dict[tuple[str, str, float], str] | None = None) -> dict[str, list[Hit]]:
        """Alignments by gene type, best first; votes, met and known as far as they are known."""
        out: dict[str, list[Hit]] = {}
        pieces = segments(seq)
        for kind, rows in (self.met(seq, votes) if met is None else met).items():
            found, best = [], 0
            for g, hit in rows:
                if most(hit, seq) >= SECONDARY * best:
                    hit = extended(hit, seq, pieces, known or {})
                best = max(best, hit.matches)
                if hit.similarity >= MIN_SIMILARITY and hit.matches >= NEED[kind] - 2:
                    found.append((-hit.matches, -hit.similarity, g, hit))
            out[kind] = [x[-1] for x in sorted(found, key=lambda x: x[:3])]
        return out


def most(hit: Hit, seq: str) -> int:
    """The matches of a hit that is extended, at most: it can't add more letters than gene and contig have left. What stays far behind the best one needs no extension."""
    return hit.matches + min(hit.ref_start, hit.start) + min(len(hit.gene.seq) - 1 - hit.ref_end, len(seq) - 1 - hit.end)


def between(t: str, p: str) -> str:
    """The script that aligns p with t from end to end."""
    if len(t) == len(p):
        return "".join("=" if a == b else "X" for a, b in zip(p, t))
    return align.affine(t, p)[1] if t and p else "I" * len(p) + "D" * len(t)


def reach(script: str, ahead: str, stop: bool) -> tuple[str, int]:
    """The part of a script from a hit's end onwards that lies before the next gap in the contig; how many letters it matches. stop: indels end it."""
    i, out = 0, ""
    for c in script:
        if i >= len(ahead) or (stop and c in "ID"):
            break
        out += c
        i += c in "=XI"
    return out, out.count("=")


def ahead(hit: Hit, seq: str, room: int, right: bool) -> tuple[str, str, float]:
    """The letters of gene and contig at one of a hit's ends, outwards, up to where its alignment can go on to, and the share of the usual score that is enough for it."""
    gene = hit.gene.seq
    t, p = (gene[hit.ref_end + 1 :], seq[hit.end + 1 : hit.end + 1 + room]) if right else (gene[: hit.ref_start][::-1], seq[hit.start - room : hit.start][::-1])
    # an alignment that scores goes no further in one than twice as far as in the other
    return t[: 2 * len(p) + CLOSE], p[: 2 * len(t) + CLOSE], 0.25 if outer(hit, right) else 1.0


def outer(hit: Hit, right: bool) -> bool:
    return hit.gene.kind == "J" if right else hit.gene.kind in "VC"


def beyond(hit: Hit, seq: str, room: int, right: bool, known: dict[tuple[str, str, float], str]) -> tuple[str, int]:
    """How a hit's alignment goes on at one of its ends within the room letters up to the gap or the contig's end: script (in the
    direction of the extension) and matches. Where a type's genes are cut off by the contig (J on the right, V and C on the left), a
    quarter of the usual score is enough, and fewer than CLOSE letters that are left of gene or contig are taken whole."""
    gene = hit.gene.seq
    t, p = (gene[hit.ref_end + 1 :], seq[hit.end + 1 : hit.end + 1 + room]) if right else (gene[: hit.ref_start][::-1], seq[hit.start - room : hit.start][::-1])
    case = ahead(hit, seq, room, right)
    script, matches = reach(known[case] if case in known else align.one_end(case[0], case[1], 0, case[2])[3], p, False)
    used, passed = sum(c in "=XI" for c in script), sum(c in "=XD" for c in script)
    near = min(len(t) - passed, (len(p) if right else hit.start) - used)
    if outer(hit, right) and 0 < len(t) - passed and near < CLOSE:
        rest = "".join("=" if a == b else "X" for a, b in zip(t[passed:], p[used:]))
        script, matches = script + rest, matches + rest.count("=")
    return script, matches


def around(hit: Hit, pieces: list[tuple[int, int]]) -> tuple[int, int]:
    """The segment that a hit begins in."""
    return next((a, b) for a, b in pieces if a <= hit.start < b)


def extended(hit: Hit, seq: str, pieces: list[tuple[int, int]], known: dict[tuple[str, str, float], str]) -> Hit:
    """A hit whose ends go on as far as its gene and the contig's segment agree."""
    if hit.parts:
        first, last = extended(hit.parts[0], seq, pieces, known), extended(hit.parts[-1], seq, pieces, known)
        left, right = hit.parts[0], hit.parts[-1]
        # inner ends stay: what lies there belongs to the gap
        head = Hit(hit.gene, first.start, left.end, first.ref_start, left.ref_end, first.left_matches + left.matches, first.left_plain and left.diagonal, first.left_script + left.steps(seq))
        tail = Hit(hit.gene, right.start, last.end, right.ref_start, last.ref_end, right.matches + last.right_matches, last.right_plain and right.diagonal, right.steps(seq) + last.right_script)
        parts = [head, *hit.parts[1:-1], tail]
        return Hit(hit.gene, head.start, tail.end, head.ref_start, tail.ref_end, sum(h.matches for h in parts), False, parts=parts)
    lo, hi = around(hit, pieces)
    left, lm = beyond(hit, seq, hit.start - lo, False, known)
    right, rm = beyond(hit, seq, hi - 1 - hit.end, True, known)
    size = lambda script, letters: sum(c in letters for c in script)
    plain = lambda script: "I" not in script and "D" not in script
    out = Hit(
        hit.gene, hit.start - size(left, "=XI"), hit.end + size(right, "=XI"), hit.ref_start - size(left, "=XD"), hit.ref_end + size(right, "=XD"),
        hit.matches + lm + rm, hit.diagonal and plain(left) and plain(right), left[::-1] + hit.steps(seq) + right,
    )
    out.left_script, out.right_script, out.left_matches, out.right_matches, out.left_plain, out.right_plain = left[::-1], right, lm, rm, plain(left), plain(right)
    return out


def segments(seq: str) -> list[tuple[int, int]]:
    """The stretches [from, to) of a contig between runs of N."""
    if "N" * GAP not in seq:
        return [(0, len(seq))] if seq else []
    out, at = [], 0
    for m in re.finditer("N{%d,}" % GAP, seq):
        out.append((at, m.start()))
        at = m.end()
    return [x for x in [*out, (at, len(seq))] if x[1] > x[0]]


def joined(parts: list[Hit]) -> Hit:
    """One hit of a gene's hits in a contig's segments: all that follow one another in the gene too, but for less than OVERLAP letters, if alike enough, else the best."""
    best = max(parts, key=lambda h: h.matches)
    chain = [best]
    for h in parts[parts.index(best) + 1 :]:
        if h.ref_start + OVERLAP > chain[-1].ref_end:
            chain.append(h)
    for h in parts[: parts.index(best)][::-1]:
        if h.ref_end < chain[0].ref_start + OVERLAP:
            chain.insert(0, h)
    if len(chain) == 1:
        return best
    whole = Hit(best.gene, chain[0].start, chain[-1].end, chain[0].ref_start, chain[-1].ref_end, sum(h.matches for h in chain), False, parts=chain)
    return whole if whole.similarity >= MIN_SIMILARITY else best


def secondary(hits: list[Hit]) -> list[Hit]:
    """The best hit, those that equal it, and close ones of other alleles, at most KEEP."""
    if not hits:
        return []
    best = hits[0]
    out = [best]
    for h in hits[1:]:
        if len(out) < KEEP and h.gene.locus == best.gene.locus and h.matches >= SECONDARY * best.matches and h.similarity >= SECONDARY * best.similarity:
            if h.matches == best.matches and h.similarity == best.similarity or h.gene.name.split("*")[0] not in {x.gene.name.split("*")[0] for x in out}:
                out.append(h)
    return out


def one_locus(found: dict[str, list[Hit]]) -> dict[str, list[Hit]]:
    """Hits of the locus whose V, J and C explain most of the contig; alpha and delta share their V genes."""
    family = lambda x: "TRA/D" if x in ("TRA", "TRD") else x
    weight: Counter = Counter()
    for hits in found.values():
        best: Counter = Counter()
        for h in hits:
            best[family(h.gene.locus)] = max(best[family(h.gene.locus)], h.matches)
        weight.update(best)
    if not weight:
        return {}
    top = max(weight, key=lambda x: (weight[x], x))
    return {k: [h for h in hits if family(h.gene.locus) == top] for k, hits in found.items()}


def d_gene(ref: Reference, seq: str, v: Hit, j: Hit, locus: str) -> list[Hit]:
    """The D genes that align best, by at least 5, between V and J."""
    lo, hi = v.end + 1, j.start
    found = []
    for g, gene in enumerate(ref.genes):
        if gene.kind == "D" and gene.locus == locus and hi - lo >= 5:
            hit = ref.gapped(g, seq, lo, hi)
            if hit:
                n, wrong, gaps = align.stats(hit.script)
                score = n * align.LOCAL_MATCH + wrong * align.LOCAL_MISMATCH + gaps * align.LOCAL_INDEL
                if score >= 5:
                    found.append((-score, -hit.similarity, g, hit))
    return [x[-1] for x in sorted(found, key=lambda x: x[:3])]


def annotate_one(ref: Reference, cid: str, seq: str, votes: dict | None = None, met: dict | None = None, known: dict | None = None) -> dict:
    found = ref.hits(seq, votes, met, known)
    if not any(found.values()):
        return {"cid": cid, "len": len(seq), "v": [], "d": [], "j": [], "c": [], "cdr1": None, "cdr2": None, "cdr3": None, "seq": seq}
    found = one_locus(found)
    v, j, c = (found.get(k, []) for k in "VJC")
    best_v, best_j = (v[0] if v else None), (j[0] if j else None)
    if best_v and best_j and best_j.start < best_v.start:
        j, best_j = [], None
    cdr = {}
    if best_v:
        for name in ("cdr1", "cdr2"):
            span = getattr(best_v.gene, name)
            a, b = (best_v.at(x) for x in span) if span else (None, None)
            if a is not None and b is not None:
                text, germ = seq[a : b + 1], best_v.gene.seq[span[0] : span[1] + 1]
                same = sum(x == y for x, y in zip(text, germ)) / max(len(text), len(germ), 1)
                cdr[name] = {"start": a, "end": b, "score": round(100 * same, 2), "seq": text}
    place = cdr3_ladder.cdr3(seq, segments(seq), best_v, best_j, c[0] if c else None)
    if place:
        cdr["cdr3"] = {"start": place[0], "end": place[1], "score": round(place[2], 2), "seq": seq[place[0] : place[1] + 1]}
    locus = best_v.gene.locus if best_v else best_j.gene.locus if best_j else ""
    d = d_gene(ref, seq, best_v, best_j, locus) if best_v and best_j and locus in ("IGH", "TRB", "TRD") else []
    rows = lambda hits: [h.row() for h in secondary(hits)]
    return {"cid": cid, "len": len(seq), "v": rows(v), "d": rows(d), "j": rows(j), "c": rows(c), "cdr1": cdr.get("cdr1"), "cdr2": cdr.get("cdr2"), "cdr3": cdr.get("cdr3"), "seq": seq}


def annotate(contigs: DataFrame, ref: DataFrame) -> DataFrame:
    """cid, len, v, d, j, c, cdr1, cdr2, cdr3, seq of contigs (cid, seq). Equal sequences are worked out once per batch."""
    shared = contigs.sparkSession.sparkContext.broadcast(Reference.of(ref))
    out = StructType.fromDDL(OUT)
    kinds = {f.name: to_arrow_type(f.dataType) for f in out}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            if len(known) > 20_000:
                known.clear()
            seqs = batch.column("seq").to_pylist()
            new = [s for s in dict.fromkeys(seqs) if s not in known]
            met = [model.met(seq, votes) for seq, votes in zip(new, model.ballots(new))]
            ends = model.ends(new, met)
            for seq, mine in zip(new, met):
                known[seq] = annotate_one(model, "", seq, None, mine, ends)
            rows = [known[s] for s in seqs]
            yield pa.RecordBatch.from_arrays([batch.column("cid").cast(kinds["cid"]), *[pa.array([r[c] for r in rows], kinds[c]) for c in out.names[1:]]], names=out.names)

    return contigs.select(F.col("cid").cast("string").alias("cid"), "seq").mapInArrow(run, out)


def with_coverage(annotations: DataFrame, weights: DataFrame) -> DataFrame:
    """coverage: a contig's weight (cid, weight) over 500, as the annotation's header has it."""
    return annotations.join(weights.select("cid", (F.col("weight") / 500).alias("coverage")), "cid", "left")
