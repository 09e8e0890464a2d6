"""Joins and reshaping of positions and intervals.

Spark has no band join, and falls back to comparing all with all. Here both sides get bins
of a given width, are joined by equality on (keys, bin), and the exact condition is
checked on what meets, so the join shuffles and its skew is handled like any other.
Intervals are closed unless said otherwise; rows with null keys or places never match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import carried

#: Positions in one block of an ordered pass over a chromosome.
BLOCK = 1 << 20


def _bin(x: Column, width: int) -> Column:
    return F.floor(x / width).cast("long")


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_pos: str, right_pos: str, window: int, strict: bool = True) -> DataFrame:
    """Pairs with equal keys whose positions differ by less than window (at most, if not strict).

    Each left row has one bin; each right row stands in its own and both neighbours. A pair
    thus meets once."""
    a = left.withColumn("__bin", _bin(F.col(left_pos), window))
    b = right.withColumn("__bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _bin(F.col(right_pos), window) + d)))
    gap = F.abs(F.col(left_pos) - F.col(right_pos))
    return a.join(b, [*on, "__bin"]).where(gap < window if strict else gap <= window).drop("__bin")


def _bins(start: Column, stop: Column, width: int) -> Column:
    return F.explode(F.when(start <= stop, F.sequence(_bin(start, width), _bin(stop, width))))


def point_join(points: DataFrame, spans: DataFrame, on: list[str], pos: str, start: str, stop: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the spans that hold them. width: about the length of a span. how: inner,
    left, left_semi or left_anti."""
    a = points.withColumn("__bin", _bin(F.col(pos), width))
    b = spans.withColumn("__bin", _bins(F.col(start), F.col(stop), width))
    keep = [k for k in on] + ["__bin"]
    b = b.select(*(F.col(c).alias(f"__{c}" if c in keep else c) for c in b.columns))
    cond = (F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(stop))
    for k in keep:
        cond = cond & (a[k] == b[f"__{k}"])
    out = a.join(b, cond, how)
    return out.drop(*(f"__{k}" for k in keep), "__bin")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int, touching: bool = True) -> DataFrame:
    """Pairs of spans that overlap; spans that share an end only if touching. A pair is
    kept in the first bin that both have, so once."""
    (ls, le), (rs, re) = left_span, right_span
    a = left.withColumn("__bin", _bins(F.col(ls), F.col(le), width))
    b = right.withColumn("__bin", _bins(F.col(rs), F.col(re), width))
    meets = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) if touching else (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    first = F.col("__bin") == F.greatest(_bin(F.col(ls), width), _bin(F.col(rs), width))
    return a.join(b, [*on, "__bin"]).where(meets & first).drop("__bin")


def anti_band_pairs(left: DataFrame, right: DataFrame, on: list[str], left_pos: str, right_pos: str, window: int, left_key: str, right_key: str, pairs: DataFrame) -> DataFrame:
    """The given pairs (left_key, right_key) that are not near each other: other keys, or window or more apart.

    Pairs come from the caller, as all with all is a cross join that does not scale."""
    near = band_join(left, right, on, left_pos, right_pos, window).select(left_key, right_key)
    return pairs.join(near, [left_key, right_key], "left_anti")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_pos: str, right_pos: str, columns: list[str], width: int = BLOCK) -> DataFrame:
    """left with `columns` of the right row of the same keys with the largest position up to
    left's; null without one. Both sides are sorted together once, in blocks of width positions, to which the last
    right row of the blocks before is carried. Of right rows at one position the one with the largest columns counts."""
    held = F.struct(*columns)
    a = left.withColumn("__pos", F.col(left_pos)).withColumn("__side", F.lit(1)).withColumn("__held", F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType)).withColumn("__row", F.struct(*left.columns))
    b = right.select(*on, F.col(right_pos).alias("__pos"), F.lit(0).alias("__side"), held.alias("__held"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    both = a.select(*on, "__pos", "__side", "__held", "__row").unionByName(b).withColumn("__block", _bin(F.col("__pos"), width))
    last = F.max_by("__held", F.when(F.col("__side") == 0, F.struct("__pos", "__held")))
    both = carried(both, on, "__block", {"__last": last}, {"__before": F.last("__last", ignorenulls=True)})
    w = Window.partitionBy(*on, "__block").orderBy("__pos", "__side", "__held").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__got", F.coalesce(F.last("__held", ignorenulls=True).over(w), "__before"))
    return both.where("__side = 1").select("__row.*", *(F.col(f"__got.{c}").alias(c) for c in columns))


def _reach(spans: DataFrame, on: list[str], start: str, stop: str, order: list[Column], width: int) -> DataFrame:
    """spans with __block and __reach, the largest stop of those before in order; null for the first."""
    s = carried(spans.withColumn("__block", _bin(F.col(start), width)), on, "__block", {"__most": F.max(stop)}, {"__before": F.max("__most")})
    w = Window.partitionBy(*on, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("__reach", F.greatest(F.max(stop).over(w), "__before")).drop("__before")


def merge_spans(spans: DataFrame, on: list[str], start: str, stop: str, gap: int = 0, width: int = BLOCK) -> DataFrame:
    """(keys, start, stop, n): spans joined where they overlap, or are up to gap apart.

    Spans become islands inside blocks of width positions; only one row a block is carried on, and islands that
    a span of an earlier block reaches join the last island before. Of equal spans the one that opens an island comes first."""
    w = Window.partitionBy(*on, "__block")
    s = spans.select(*on, start, stop).withColumn("__block", _bin(F.col(start), width))
    reach = F.max(stop).over(w.orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("__new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    s = s.withColumn("__island", F.sum("__new").over(w.orderBy(start, stop, F.desc("__new")).rowsBetween(Window.unboundedPreceding, 0)))
    islands = s.groupBy(*on, "__block", "__island").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("n"))
    before = Window.partitionBy(*on).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = islands.groupBy(*on, "__block").agg(F.max(stop).alias("__most"), F.max(start).alias("__last")).withColumn("__reach", F.max("__most").over(before))
    blocks = blocks.withColumn("__own", F.when(F.col("__last") <= F.col("__reach") + gap, None).otherwise(F.col("__last"))).withColumn("__open", F.max("__own").over(before))
    j = islands.join(blocks.select(*on, "__block", "__reach", "__open"), [*on, "__block"])
    founder = F.when(F.col(start) <= F.col("__reach") + gap, F.col("__open")).otherwise(F.col(start))
    return j.groupBy(*on, founder.alias("__founder")).agg(F.min(start).alias(start), F.max(stop).alias(stop), F.sum("n").alias("n")).drop("__founder")


def drop_contained(spans: DataFrame, on: list[str], start: str, stop: str, width: int = BLOCK) -> DataFrame:
    """Spans that no other span of their keys holds; of equal spans one stays. In blocks of width positions."""
    marked = _reach(spans.dropDuplicates([*on, start, stop]), on, start, stop, [F.col(start), F.desc(stop)], width)
    return marked.where(F.col("__reach").isNull() | (F.col(stop) > F.col("__reach"))).select(*spans.columns)


def first_match(matches: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the first in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return matches.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def neighbours(rows: DataFrame, on: list[str], pos: str, value: str, flank: int, out: str, width: int = BLOCK) -> DataFrame:
    """rows with the values of up to flank rows before and after, in order of position; in blocks of width
    positions, to which the nearest values of the others are carried."""
    r = rows.withColumn("__block", _bin(F.col(pos), width))
    ends = r.groupBy(*on, "__block").agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias("v"))
    ends = ends.select(*on, "__block", F.slice("v", F.greatest(F.lit(1), F.size("v") - flank + 1), flank).alias("last"), F.slice("v", 1, flank).alias("first"))
    w = Window.partitionBy(*on).orderBy("__block")  # one row a block
    earlier = F.flatten(F.collect_list("last").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    later = F.flatten(F.collect_list("first").over(w.rowsBetween(1, Window.unboundedFollowing)))
    ends = ends.select(*on, "__block", F.slice(earlier, F.greatest(F.lit(1), F.size(earlier) - flank + 1), flank).alias("__earlier"), F.slice(later, 1, flank).alias("__later"))
    own = Window.partitionBy(*on, "__block").orderBy(pos)
    before = F.concat("__earlier", F.collect_list(value).over(own.rowsBetween(-flank, -1)))
    after = F.concat(F.collect_list(value).over(own.rowsBetween(1, flank)), "__later")
    r = r.join(ends, [*on, "__block"]).withColumn("__b", before).withColumn("__a", after)
    return r.withColumn(out, F.concat(F.slice("__b", F.greatest(F.lit(1), F.size("__b") - flank + 1), flank), F.slice("__a", 1, flank))).select(*rows.columns, out)


def contact_join(pairs: DataFrame, contacts: DataFrame, chrom: str, pos_a: str, pos_b: str, resolution: int) -> DataFrame:
    """Pairs of positions with the contact of their two bins; contacts has (chrom, bin_a <= bin_b, value)."""
    lo, hi = F.least(pos_a, pos_b), F.greatest(pos_a, pos_b)
    binned = pairs.withColumn("bin_a", _bin(lo, resolution) * resolution).withColumn("bin_b", _bin(hi, resolution) * resolution)
    return binned.join(contacts, [chrom, "bin_a", "bin_b"], "left")
