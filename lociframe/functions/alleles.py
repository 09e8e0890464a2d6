"""Allele strings and genotype arrays as Column expressions.

Alleles are strings A, C, G, T, longer for insertions; missing is null (never 0, "-" or -1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(allele: Column) -> Column:
    return F.translate(allele, "ACGTacgt", "TGCAtgca")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(complement(sequence))


def is_snp(alleles: Column) -> Column:
    """All alleles one base long."""
    return F.forall(alleles, lambda a: F.length(a) == 1)


def is_biallelic(alleles: Column) -> Column:
    return F.size(F.array_distinct(alleles)) == 2


def same_alleles(a: Column, b: Column) -> Column:
    """The same alleles in any order."""
    return F.array_sort(a) == F.array_sort(b)


def is_ambiguous(alleles: Column) -> Column:
    """A/T or C/G: the same alleles on either strand."""
    return is_biallelic(alleles) & is_snp(alleles) & same_alleles(alleles, F.transform(alleles, complement))


def flip(alleles_a: Column, assessed_a: Column, alleles_b: Column, assessed_b: Column) -> Column:
    """What aligns an effect of b with a: 1, -1 for the other allele, null if they do not match.

    Equal alleles are compared as they are, else b's complement is."""
    direct = same_alleles(alleles_a, alleles_b)
    turned = same_alleles(alleles_a, F.transform(alleles_b, complement))
    sign = lambda x: F.when(assessed_a == x, F.lit(1)).otherwise(F.lit(-1))
    return F.when(direct, sign(assessed_b)).when(turned, sign(complement(assessed_b)))


def alternate_count(call: Column, ref: Column) -> Column:
    """How many of a call's alleles differ from ref; null if any is missing."""
    return F.when(F.size(call) > 0, F.aggregate(call, F.lit(0), lambda n, a: n + F.when(a.isNull(), F.lit(None).cast("int")).when(a == ref, 0).otherwise(1)))


def dosage_to_call(dosage: Column, ref: Column, alt: Column) -> Column:
    """Alleles of an alternate-allele dosage between 0 and 2: under 0.5 both ref, 1.5 and more both alt."""
    return F.when(dosage.isNull(), F.lit(None)).when(dosage < 0.5, F.array(ref, ref)).when(dosage < 1.5, F.array(ref, alt)).otherwise(F.array(alt, alt))


def probabilities_to_dosage(p: Column) -> Column:
    """Alternate dosage of (ref ref, ref alt, alt alt) probabilities; null if they are all zero."""
    total = p[0] + p[1] + p[2]
    return F.when(total > 0, (p[1] + 2 * p[2]) / total)


def probabilities_to_call(p: Column, least: float = 0.4) -> Column:
    """0, 1 or 2 alternate alleles: the most probable, if its probability is least or more."""
    top = F.array_max(p)
    return F.when(top >= least, F.when(p[0] == top, 0).when(p[1] == top, 1).otherwise(2))


def call_to_probabilities(count: Column) -> Column:
    one = lambda i: F.when(count.isNull(), 0.0).when(count == i, 1.0).otherwise(0.0)
    return F.array(one(0), one(1), one(2))


def mapped(chrom: Column, pos: Column) -> Column:
    return chrom.isNotNull() & (chrom != "0") & (pos >= 0)


def chromosome(name: Column) -> Column:
    """A chromosome name without chr, in upper case, M as MT, 23 to 26 as X, Y, X (PAR), MT."""
    bare = F.upper(F.regexp_replace(F.trim(name), "(?i)^chr", ""))
    return F.when(bare == "M", "MT").when(bare == "23", "X").when(bare == "24", "Y").when(bare == "25", "X").when(bare == "26", "MT").otherwise(bare)


def chromosome_order(chrom: Column) -> Column:
    """A sort key: one-character names, then longer ones, then X and Y, then MT; by name in each."""
    group = F.when(chrom == "MT", 3).when(chrom.isin("X", "Y"), 2).when(F.length(chrom) == 1, 0).otherwise(1)
    return F.struct(group.alias("g"), chrom.alias("name"))


def region(text: Column) -> Column:
    """chrom, start and stop of chr:start-stop or chr:pos; null if it is neither."""
    pattern = r"^([^:]+):(\d+)(?:-(\d+))?$"
    start = F.regexp_extract(text, pattern, 2)
    stop = F.regexp_extract(text, pattern, 3)
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("chrom"), start.cast("long").alias("start"), F.when(stop != "", stop).otherwise(start).cast("long").alias("stop")))


def gc_content(sequence: Column) -> Column:
    s = F.upper(sequence)
    gc = F.length(s) - F.length(F.translate(s, "GC", ""))
    return F.when(F.length(s) > 0, gc / F.length(s))


def strip_version(identifier: Column) -> Column:
    return F.regexp_replace(identifier, r"\..*$", "")
