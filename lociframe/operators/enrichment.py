"""Gene sets, ontologies, enrichment and prioritisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special, stats


def set_tables(hits: DataFrame, members: DataFrame, item: str, group: str, hit: str) -> DataFrame:
    """(group, a, b, c, d): hits and others, inside and outside each set. The outside comes from
    totals, so only memberships are joined."""
    h = hits.select(item, F.col(hit).cast("boolean").alias("__hit")).dropDuplicates([item])
    j = members.select(item, group).distinct().join(h, item)
    inside = j.groupBy(group).agg(F.count_if("__hit").alias("a"), F.count_if(~F.col("__hit")).alias("c"))
    total = h.agg(F.count_if("__hit").alias("__h"), F.count_if(~F.col("__hit")).alias("__o"))
    return inside.join(F.broadcast(total)).select(group, "a", (F.col("__h") - F.col("a")).alias("b"), "c", (F.col("__o") - F.col("c")).alias("d"))  # one row of totals


def fisher_enrichment(hits: DataFrame, members: DataFrame, item: str, group: str, hit: str, least: int = 1) -> DataFrame:
    t = set_tables(hits, members, item, group, hit).where(F.col("a") + F.col("c") >= least)
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    return t.withColumn("p", special.fisher_exact_p(a, b, c, d)).withColumn("odds_ratio", F.when(b * c > 0, a * d / (b * c)))


def rank_enrichment(scores: DataFrame, members: DataFrame, item: str, group: str, score: str, least: int = 1) -> DataFrame:
    """n, z, p and auc of each set's scores against all other items', from one ranking of all items.

    Items are ranked by distinct score through counts, not in one task."""
    from .ordered import running_sums, settled

    s = settled(scores.where(F.col(score).isNotNull()).dropDuplicates([item]))
    n = s.count()
    c = running_sums(s.groupBy(score).agg(F.count("*").alias("__k")), score, [score], {"__upto": F.col("__k")})
    r = c.select(score, (F.col("__upto") - (F.col("__k") - 1) / 2).alias("__rank"))
    j = members.select(item, group).distinct().join(s.select(item, score), item).join(r, score)
    g = j.groupBy(group).agg(F.count("*").alias("n"), F.sum("__rank").alias("r1")).where((F.col("n") >= least) & (F.col("n") < n))
    n1, n2 = F.col("n").cast("double"), (F.lit(n) - F.col("n")).cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    z = (u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return g.select(group, "n", z.alias("z"), stats.two_sided_normal_p(z).alias("p"), (u / (n1 * n2)).alias("auc"))


def prioritise(scores: DataFrame, terms: DataFrame, item: str, term: str, z: str, order: str | None = None) -> DataFrame:
    """(item, score, rank): the sum of z over the terms given, over the root of their number, ranked, ties by item.

    An item has about one z a term; they are added in order of size, so that equal z give equal scores, which tie, however
    rows come; or by the column order, as a sum over rows kept in that order would, to its last digit. Scores are written before they are ranked."""
    from .ordered import running_sums, settled

    t = terms.select(term).distinct()
    own = F.col(z).cast("double")
    if order is None:
        listed = F.sort_array(F.collect_list(own))
    else:
        listed = F.transform(F.sort_array(F.collect_list(F.when(own.isNotNull(), F.struct(F.col(order).alias("at"), own.alias("z"))))), lambda x: x["z"])
    j = scores.join(t, term).groupBy(item).agg(listed.alias("__z"))
    total = F.aggregate(F.slice("__z", 2, F.greatest(F.size("__z") - 1, F.lit(0))), F.get("__z", F.lit(0)), lambda a, x: a + x)
    s = settled(j.select(item, (total / F.sqrt(F.nullif(F.size("__z"), F.lit(0)).cast("double"))).alias("score")))
    return running_sums(s, "score", [F.desc("score"), item], {"rank": F.lit(1)}, descending=True)


def roll_up(terms: DataFrame, parents: DataFrame, usable: DataFrame, term: str, parent: str) -> DataFrame:
    """(term, used): each term itself if it is usable, else its nearest usable ancestors.

    parents is the edge table (term, parent); each round climbs one level for what is open,
    so rounds are at most the depth of the ontology. A term comes to each ancestor once, so
    edges in a circle end as well."""
    from .ordered import settled

    ok = usable.select(F.col(term).alias("used")).distinct()
    open_ = terms.select(F.col(term).alias("term"), F.col(term).alias("used")).distinct()
    up = parents.select(F.col(term).alias("used"), F.col(parent).alias("__up"))
    seen = open_ = settled(open_)
    while not open_.isEmpty():
        above = open_.join(ok, "used", "left_anti").join(up, "used").select("term", F.col("__up").alias("used")).distinct()
        open_ = settled(above.join(seen, ["term", "used"], "left_anti"))
        seen = settled(seen.union(open_).distinct())
    done = seen.join(ok, "used", "left_semi").select("term", "used")
    return done.distinct().withColumnRenamed("term", term)


def descendants(parents: DataFrame, term: str, parent: str) -> DataFrame:
    """(ancestor, term): the closure of the edges, by joins that stop when nothing is new."""
    from .ordered import settled

    edges = parents.select(F.col(parent).alias("ancestor"), F.col(term).alias("term")).distinct()
    closure = front = edges = settled(edges)
    while True:
        step = front.join(edges.select(F.col("ancestor").alias("term"), F.col("term").alias("__below")), "term").select("ancestor", F.col("__below").alias("term")).distinct()
        front = settled(step.join(closure, ["ancestor", "term"], "left_anti"))
        if front.isEmpty():
            break
        closure = settled(closure.union(front).distinct())
    return closure


def expand_annotations(scores: DataFrame, members: DataFrame, item: str, group: str, z: str, least_z: float, least_items: int = 10) -> DataFrame:
    """Memberships with those added whose z is least_z or more, of sets with enough items."""
    big = members.select(item, group).distinct().groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") >= least_items).select(group)
    m = members.select(item, group).distinct().join(big, group, "left_semi").withColumn("predicted", F.lit(False))
    add = scores.where(F.col(z) >= least_z).join(big, group, "left_semi").select(item, group).distinct().join(m, [item, group], "left_anti").withColumn("predicted", F.lit(True))
    return m.select(item, group, "predicted").union(add)


def real_against_permuted(overlaps: DataFrame, by: list[str], real: Column, hit: Column) -> DataFrame:
    """Hits among real and permuted results per track, chi-square and Fisher's p."""
    t = overlaps.groupBy(*by).agg(F.count_if(real & hit).alias("a"), F.count_if(real & ~hit).alias("b"), F.count_if(~real & hit).alias("c"), F.count_if(~real & ~hit).alias("d"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    return t.withColumn("p", special.fisher_exact_p(a, b, c, d))


def signed_edges(weights: DataFrame, a: str, b: str, w: str) -> DataFrame:
    """Edges with positive weight, without loops."""
    return weights.where((F.col(w) > 0) & (F.col(a) != F.col(b)))


def distinct_sets(members: DataFrame, item: str, group: str) -> DataFrame:
    """One name, the first, for each set of the same members, and the members' number."""
    s = members.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("__m"))
    return s.groupBy(F.sha2(F.to_json("__m"), 256).alias("__k"), F.size("__m").alias("n")).agg(F.min(group).alias(group)).drop("__k")


def ranked_within(values: DataFrame, by: list[str], order: list[Column | str], out: str = "rank") -> DataFrame:
    return values.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
