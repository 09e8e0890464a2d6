"""The star-schema tables seen as genetics data.

Each view is a list of expressions that Spark SQL and other engines read alike, so a query
and its SQL begin from the same rows. Positions grow with keys, so that larger tables are
longer chromosomes, not denser ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, list[str]]] = {
    "variants": ("part", ["p_partkey as variant", "p_size % 5 as chrom", "p_partkey * 97 as pos", "substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) as ref", "substr('CGTAGA', cast(p_size % 6 as int) + 1, 1) as alt", "p_retailprice as score"]),
    "genes": ("supplier", ["s_suppkey as gene", "s_nationkey % 5 as chrom", "s_suppkey * 1940 as start", "s_suppkey * 1940 + 500 + (s_suppkey % 7) * 300 as stop", "s_suppkey * 1940 + 400 as mid", "s_name as symbol"]),
    "peaks": ("customer", ["c_custkey as peak", "c_nationkey % 5 as chrom", "c_custkey * 130 as start", "c_custkey * 130 + 60 + (c_custkey % 11) * 40 as stop", "c_mktsegment as track", "c_acctbal as height"]),
    "genotypes": ("lineitem", ["l_partkey as variant", "l_suppkey as sample", "l_orderkey as obs", "l_linenumber as line", "l_returnflag as dataset", "case when l_tax = 0 then null else cast(l_quantity as int) % 3 end as dosage", "l_extendedprice / 999e0 as expression", "l_discount * 100 as quality", "l_linenumber as depth", "l_quantity as quantity"]),
    "effects": ("orders", ["o_orderkey as id", "o_custkey as snp", "o_orderkey % 7 as gene", "o_orderpriority as dataset", "(o_totalprice - 150000e0) / 77777e0 as z", "50 + o_orderkey % 100 as n", "((o_orderkey * 7919) % 1000003 + 1) / 1000004e0 as p", "o_orderkey % 5 as perm"]),
    "reads": ("lineitem", ["l_partkey as variant", "l_suppkey as sample", "cast(l_quantity as int) as ref_reads", "(cast(l_quantity as int) * 7 + l_linenumber * 5) % 43 as alt_reads"]),
    "annotated": ("events", ["event_id", "user_id", "event_type", "value"]),
}


class Views:
    """The views over one directory of tables; plain tables by their own names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        base, columns = VIEWS.get(name, (name, ["*"]))
        return self.spark.read.parquet(f"{self.sf_dir}/{base}.parquet").selectExpr(*columns)


def with_views(*names: str) -> str:
    """The views as common table expressions."""
    return "with " + ", ".join(f"{n} as (select {', '.join(VIEWS[n][1])} from {VIEWS[n][0]})" for n in names)
