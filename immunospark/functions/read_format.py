"""Read formats: which parts of the reads make up read 1, read 2, barcode and UMI.

A format is a comma list of kind:start:end[:strand], where kind is r1, r2, bc or um, an end of -1 is
the end of the read, other negative numbers count from it, and strand is + or -; `hd` between kind and
start takes the text from a field of the read's comment, by number or by tag: `bc:hd:CB:5:-1`. Several parts of a kind are joined in order, and if any of them is on the minus
strand the whole is reverse-complemented.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import reverse_complement_strict


@dataclass(frozen=True)
class Part:
    kind: str
    start: int = 0
    end: int = -1
    minus: bool = False
    field: str | None = None


def parse(spec: str) -> dict[str, list[Part]]:
    out: dict[str, list[Part]] = {}
    for item in spec.split(","):
        kind, *rest = item.strip().split(":")
        if kind not in ("r1", "r2", "bc", "um"):
            raise ValueError(f"unknown kind in {item!r}")
        field = None
        if rest[:1] == ["hd"]:
            field, rest = rest[1], rest[2:]
        minus = bool(rest) and rest[-1] in "+-" and rest.pop() == "-"
        numbers = [int(x) for x in rest] + [0, -1][len(rest) :]
        out.setdefault(kind, []).append(Part(kind, numbers[0], numbers[1], minus, field))
    return out


def comment_field(comment: Column, field: str) -> Column:
    """A field of the comment by its number, or from the first occurrence of a tag to the end of its field, tag included; empty if absent."""
    if field.isdigit():
        return F.coalesce(F.get(F.split(comment, "[ \t]"), F.lit(int(field))), F.lit(""))
    return F.regexp_extract(comment, re.escape(field) + "[^ \t]*", 0)


def extract(parts: list[Part], seq: Column, comment: Column | None = None, complement: bool = True) -> Column:
    """The text that parts cut from seq; complement=False reverses qualities instead."""
    cuts = []
    for p in parts:
        text = seq if p.field is None else comment_field(comment, p.field)
        n = F.length(text)
        at = F.lit(p.start) if p.start >= 0 else F.greatest(n + p.start, F.lit(0))
        end = F.lit(p.end) if p.end >= 0 else n + p.end
        cuts.append(F.coalesce(F.substr(text, at + 1, F.greatest(end - at + 1, F.lit(0))), F.lit("")))
    whole = F.concat(*cuts)
    if any(p.minus for p in parts):
        return reverse_complement_strict(whole) if complement else F.reverse(whole)
    return whole


def read_name(name: Column, trim: int = -1) -> Column:
    """The name that mates share: without its last `trim` letters, or, at -1, without a final /1 or /2."""
    if trim < 0:
        return F.regexp_replace(name, "/[12]$", "")
    return F.substr(name, F.lit(1), F.greatest(F.length(name) - trim, F.lit(0)))
