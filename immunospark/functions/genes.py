"""Receptor gene names: loci, chains, cells and constant genes.

A gene column is null, `*` or `.` where no gene was called.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Loci in report order; an index in this list is the locus number.
LOCI = ["IGH", "IGK", "IGL", "TRA", "TRB", "TRG", "TRD"]
#: Isotypes in class-switch order, as the statistics rank them.
ISOTYPES = ["IGHM", "IGHD", "IGHG3", "IGHG1", "IGHA1", "IGHG2", "IGHG4", "IGHE", "IGHA2"]
#: The order in which each report asks the genes for a locus.
V_J_C, J_C_V, C_J_V, V_C_J = "vjc", "jcv", "cjv", "vcj"


def called(gene: Column) -> Column:
    """The gene, or null if none was called."""
    return F.when(gene.isin("*", ".", ""), None).otherwise(gene)


def first_gene(genes: Column) -> Column:
    """The first of a comma list of equal hits."""
    return F.substring_index(genes, ",", 1)


def locus_of(gene: Column) -> Column:
    """The locus that the first three letters name. The gene is asked once: where Spark pushes a filter on the locus down, it puts in the whole expression that makes the gene."""
    return F.try_element_at(F.create_map(*[F.lit(x) for name in LOCI for x in (name, name)]), F.substring(gene, 1, 3))


def locus(v: Column, j: Column, c: Column, order: str = V_J_C) -> Column:
    genes = {"v": v, "j": j, "c": c}
    return F.coalesce(*[locus_of(genes[g]) for g in order])


def locus_by_first_called(v: Column, j: Column, c: Column) -> Column:
    """The locus of the first gene called of C, J, V, even if that names none."""
    return locus_of(F.coalesce(called(c), called(j), called(v)))


def locus_number(name: Column) -> Column:
    return F.when(name.isNotNull(), F.array_position(F.array(*[F.lit(x) for x in LOCI]), name).cast("int") - 1)


def denominator_locus(name: Column) -> Column:
    """Lambda counts among kappa."""
    return F.when(name == "IGL", "IGK").otherwise(name)


def is_tcr(name: Column) -> Column:
    return name.startswith("TR")


def cell_type(name: Column) -> Column:
    return F.when(name.isin("IGH", "IGK", "IGL"), "B").when(name.isin("TRA", "TRB"), "abT").when(name.isin("TRG", "TRD"), "gdT")


def cell_class(v: Column, j: Column, c: Column) -> Column:
    """BCR or TCR by the first gene that says so."""
    kind = lambda g: F.when(g.startswith("IG"), "BCR").when(g.startswith("TR"), "TCR")
    return F.coalesce(kind(v), kind(j), kind(c))


def chain_side(name: Column) -> Column:
    """1 for heavy, beta and delta chains, 2 for their partners."""
    return F.when(name.isin("IGH", "TRB", "TRD"), 1).when(name.isNotNull(), 2)


def without_allele(gene: Column) -> Column:
    return F.substring_index(gene, "*", 1)


def gene_type(gene: Column) -> Column:
    """V, D, J or C; a D that no digit follows is the delta constant gene."""
    kind = F.substring(gene, 4, 1)
    return (
        F.when(gene.startswith("IGLL"), None)
        .when(kind.isin("V", "J"), kind)
        .when(kind == "D", F.when(F.substring(gene, 5, 1).rlike(r"\d"), "D").otherwise("C"))
        .when(locus_of(gene).isNotNull(), "C")
    )


def infer_constant(v: Column, j: Column, c: Column) -> Column:
    """The constant gene without its allele, shortened to four letters unless all genes are IGH; a missing one is inferred from J for loci of one constant gene."""
    v, j, c = called(v), called(j), called(c)
    heavy = F.coalesce(v.startswith("IGH"), F.lit(True)) & F.coalesce(j.startswith("IGH"), F.lit(True))
    name = without_allele(c)
    inferred = F.when(j.isNotNull() & ~F.coalesce(v.rlike("^TR[AD]"), F.lit(False)) & ~j.startswith("IGH"), F.concat(F.substring(j, 1, 3), F.lit("C")))
    return F.when(c.isNotNull(), F.when(heavy, name).otherwise(F.substring(name, 1, 4))).otherwise(inferred)


def isotype(c: Column) -> Column:
    """The isotype of an IGH constant gene; null if it is none of the nine."""
    name = without_allele(called(c))
    return F.when(name.isin(ISOTYPES), name)


def same_gene(a: Column, b: Column) -> Column:
    return without_allele(a) == without_allele(b)


def compatible(a: Column, b: Column) -> Column:
    """Equal, or not called on one side."""
    a, b = called(a), called(b)
    return a.isNull() | b.isNull() | (a == b)


def barcode_of(cid: Column) -> Column:
    """A contig's barcode: its id without the last part."""
    return F.regexp_replace(cid, "_[^_]*$", "")
