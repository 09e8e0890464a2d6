"""URL filters: rules first, then trust and distrust propagated over the host graph.

Edges between hosts are links (absolute hrefs and srcs, so canonical addresses too, and the targets of
refresh redirects), counted, and kinship: a host and its parent domain, as m.site.example
and site.example, lead to each other with KIN. Personalised PageRank spreads trust from hosts
with allowed pages along edges, and distrust from hosts with blocked pages against them
(who links to a blocked host is suspect). Ranks restart at the seeds, as does what hosts
without a way out hold; rounds go on until ROUNDS of them move less than TOLERANCE of all. Pages that
no rule decides get the verdict of their host: block if distrust is more than
`threshold` of the host's trust and distrust together; an even tie, and a host
that neither reaches, is allowed.

Edges are aggregated to one row per pair of hosts before they are iterated, the ranks are
joined and summed in Spark, and each round is written to the shared folder.
A host that very many others link to is one key of a join with one row a key on the
other side, which Spark splits, and of a sum, which is partly done before the shuffle.

Null urls, and urls without "://", have empty host and path, no rule, and the verdict
allow. Null or empty html has no links. Repeated rows, and rows without an id, are pages of their own. Columns
other than those named are not read. An empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Fixed values.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
DAMPING = 0.75
TOLERANCE = 1e-3
ROUNDS = 4
KIN = 1.0
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (text, verdict); null if none does."""
    out = F.lit(None)
    chain = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else out


def host_edges(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted."""
    target = F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|src|url)\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+)"""), F.lit(1)))
    links = pages.select(host.alias("src"), target.alias("to")).select("src", host_of(F.col("to")).alias("dst"))
    return links.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def kin_edges(hosts: DataFrame, weight: float = KIN) -> DataFrame:
    """(src, dst, weight): each host and domain of hosts(host) with its parent, both ways, up to the
    domain of two labels. Numeric addresses have no parent."""
    labels = F.split("host", r"\.")
    named = hosts.where(~F.col("host").rlike(r"^[0-9.]+(:|$)")).select(labels.alias("l")).where("size(l) > 2")
    steps = named.select("l", F.explode(F.sequence(F.lit(1), F.size("l") - 2)).alias("i"))
    part = lambda i: F.array_join(F.slice("l", i, F.size("l")), ".")
    pairs = steps.select(part(F.col("i")).alias("src"), part(F.col("i") + 1).alias("dst")).distinct()
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(weight))


def personalised_ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank) of every host that a kind's seeds(kind, host, weight) reach over its
    edges(kind, src, dst, weight). Ranks of a kind sum to 1, begin and restart at its seeds.

    What hosts without a way out hold restarts as well; as all restarts are at the seeds, that only scales
    the ranks, so they are iterated without it and scaled at the end. ROUNDS rounds are one plan."""
    start = materialize(_shares(seeds, "kind").select("kind", "host", F.col("share").alias("seed")), "start")
    steps = materialize(_shares(edges, "kind", "src").select("kind", "src", "dst", "share"), "steps")
    rank = start.select("kind", "host", F.col("seed").alias("rank"))
    change = 1.0 if not steps.isEmpty() else 0.0
    while change > tolerance:
        after = rank
        for _ in range(ROUNDS):
            moved = steps.join(after.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
            after = moved.unionByName(start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        both = after.withColumn("d", F.col("rank")).unionByName(rank.select("kind", "host", F.lit(0.0).alias("rank"), (-F.col("rank")).alias("d")))
        both = materialize(both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.abs(F.sum("d")).alias("d")), "ranks")
        change = both.groupBy("kind").agg((F.sum("d") / F.sum("rank")).alias("s")).agg(F.max("s")).first()[0] or 0.0
        rank = both.drop("d")
    return rank.join(rank.groupBy("kind").agg(F.sum("rank").alias("all")), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))


def _shares(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with share, their part of the weight of their keys."""
    rows = rows.where("weight > 0")
    return rows.join(rows.groupBy(*keys).agg(F.sum("weight").alias("all")), list(keys)).withColumn("share", F.col("weight") / F.col("all"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[UrlRule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of pages."""
    own = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parts = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ruled = parts.select("page", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("found"))
    seeds = materialize(ruled.where("host != ''").groupBy("host").agg(F.count_if(F.col("found.verdict") == "allow").alias("good"), F.count_if(F.col("found.verdict") == "block").alias("bad")), "seeds")
    links = host_edges(parts, F.col("host"), F.col("html"))
    hosts = seeds.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    edges = materialize(links.unionByName(kin_edges(hosts)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "host-edges")
    kinds = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    begin = seeds.select(F.lit("trust").alias("kind"), "host", F.col("good").alias("weight")).unionByName(seeds.select(F.lit("distrust").alias("kind"), "host", F.col("bad").alias("weight")))
    both = personalised_ranks(kinds, begin)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    hosts = both.groupBy("host").agg(of("trust"), of("distrust"))
    out = ruled.join(hosts, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    by_host = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return out.select(F.col("page").alias(id_col), "host", "path", F.col("found.text").alias("rule"), F.coalesce("found.verdict", by_host).alias("verdict"), "trust", "distrust")
