"""Labelled matrices and result tables as text, and their Parquet forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for a missing number in text.
MISSING = ("", "NA", "NaN", "nan", "-", "null")

#: The columns of an association result in text.
RESULT_COLUMNS = ("PValue", "SNPName", "SNPChr", "SNPChrPos", "ProbeName", "ProbeChr", "ProbeCenterChrPos", "CisTrans", "SNPType", "AlleleAssessed", "OverallZScore", "DatasetsWhereSNPProbePairIsAvailableAndPassesQC", "DatasetsZScores", "DatasetsNrSamples", "IncludedDatasetsMeanProbeExpression", "IncludedDatasetsProbeExpressionVariance", "HGNCName", "IncludedDatasetsCorrelationCoefficient", "Meta-Beta (SE)", "Beta (SE)", "FoldChange", "FDR")


def _number(c):
    return F.when(~c.isin(*MISSING), c.try_cast("double"))


def read_matrix(spark: SparkSession, path: str, columns: list[str] | None = None, rows: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """(row, one double a column) of a text matrix whose first column names rows and first line columns.

    Only the columns asked for are kept, which Parquet copies then prune at the scan. Names asked
    for that the file lacks are an error."""
    m = spark.read.csv(path, sep=sep, header=True)
    first, *names = m.columns
    want = columns or names
    if missing := set(want) - set(names):
        raise KeyError(f"no such columns: {sorted(missing)}")
    out = m.select(F.col(f"`{first}`").alias("row"), *(_number(F.col(f"`{c}`")).alias(c) for c in want))
    return out.where(F.col("row").isin(rows)) if rows is not None else out


def read_cells(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(row, column, value) of a text matrix."""
    m = read_matrix(spark, path, sep=sep)
    return m.unpivot(["row"], m.columns[1:], "column", "value")


def write_matrix(wide: DataFrame, path: str) -> None:
    wide.write.csv(path, sep="\t", header=True)


def concat(*parts: DataFrame) -> DataFrame:
    """Rows of several matrices with the same columns, in any order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inspect(wide: DataFrame) -> DataFrame:
    """One row with the number of rows, of columns and of missing cells."""
    names = wide.columns[1:]
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in names), F.lit(0))
    return wide.agg(F.count("*").alias("rows"), F.lit(len(names)).alias("columns"), missing.alias("missing"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Association results with typed columns; ";"-joined lists are arrays, "-" is null."""
    t = spark.read.csv(path, sep="\t", header=True)
    text = lambda c: F.nullif(F.col(f"`{c}`"), F.lit("-"))
    numbers = lambda c: F.transform(F.split(F.col(f"`{c}`"), ";"), _number)
    out = [_number(F.col("PValue")).alias("p"), text("SNPName").alias("snp"), text("SNPChr").alias("snp_chrom"), text("SNPChrPos").try_cast("long").alias("snp_pos"), text("ProbeName").alias("probe"), text("ProbeChr").alias("probe_chrom"), text("ProbeCenterChrPos").try_cast("long").alias("probe_pos"), text("CisTrans").alias("kind"), F.split("SNPType", "/").alias("alleles"), text("AlleleAssessed").alias("assessed"), _number(F.col("OverallZScore")).alias("z")]
    lists = {"DatasetsZScores": "z_list", "DatasetsNrSamples": "n_list", "IncludedDatasetsCorrelationCoefficient": "r_list"}
    out += [numbers(c).alias(n) for c, n in lists.items() if c in t.columns]
    if "FDR" in t.columns:
        out.append(_number(F.col("FDR")).alias("fdr"))
    return t.select(*out)


def write_results(results: DataFrame, path: str) -> None:
    """Results (p, snp, snp_chrom, snp_pos, probe, probe_chrom, probe_pos, z[, fdr]) as text, by p; other
    columns of the layout are "-"."""
    have = {"PValue": "p", "SNPName": "snp", "SNPChr": "snp_chrom", "SNPChrPos": "snp_pos", "ProbeName": "probe", "ProbeChr": "probe_chrom", "ProbeCenterChrPos": "probe_pos", "AlleleAssessed": "assessed", "OverallZScore": "z", "FDR": "fdr"}
    cols = [(F.coalesce(F.col(have[c]).cast("string"), F.lit("-")) if have.get(c) in results.columns else F.lit("-")).alias(c) for c in RESULT_COLUMNS]
    results.orderBy("p", F.desc(F.abs("z")), "snp", "probe").select(*cols).write.csv(path, sep="\t", header=True)
