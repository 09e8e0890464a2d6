"""BED, bedGraph, narrowPeak, GTF/GFF, GMT, OBO, FASTA, GWAS results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _fields(spark: SparkSession, path: str, skip: str = r"^(#|track|browser)") -> DataFrame:
    return spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike(skip)).select(F.split("value", "\t").alias("x"))


def _text(i: int) -> Column:
    return F.nullif(F.get("x", F.lit(i)), F.lit("."))


def _chrom(strip: bool) -> Column:
    return F.regexp_replace(F.get("x", F.lit(0)), "^chr", "") if strip else F.get("x", F.lit(0))


def read_bed(spark: SparkSession, path: str, strip_chr: bool = True, one_based: bool = True) -> DataFrame:
    """(chrom, start, stop, name, score, strand); closed 1-based intervals if one_based."""
    return _fields(spark, path).select(_chrom(strip_chr).alias("chrom"), (F.get("x", F.lit(1)).cast("long") + int(one_based)).alias("start"), F.get("x", F.lit(2)).cast("long").alias("stop"), _text(3).alias("name"), _text(4).try_cast("double").alias("score"), _text(5).alias("strand"))


def read_bedgraph(spark: SparkSession, path: str, strip_chr: bool = True, one_based: bool = True) -> DataFrame:
    return _fields(spark, path).select(_chrom(strip_chr).alias("chrom"), (F.get("x", F.lit(1)).cast("long") + int(one_based)).alias("start"), F.get("x", F.lit(2)).cast("long").alias("stop"), F.get("x", F.lit(3)).try_cast("double").alias("value"))


def read_narrow_peak(spark: SparkSession, path: str, strip_chr: bool = True) -> DataFrame:
    extra = [_text(i).try_cast("double").alias(n) for i, n in ((6, "signal"), (7, "log_p"), (8, "log_q"))]
    return _fields(spark, path).select(_chrom(strip_chr).alias("chrom"), (F.get("x", F.lit(1)).cast("long") + 1).alias("start"), F.get("x", F.lit(2)).cast("long").alias("stop"), _text(3).alias("name"), *extra, _text(9).try_cast("long").alias("summit"))


def read_gtf(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    """(chrom, source, feature, start, stop, strand, attributes map); GTF and GFF3 attributes alike."""
    pairs = F.filter(F.split(_text(8), r";\s*"), lambda a: F.trim(a) != "")
    key = lambda a: F.regexp_extract(F.trim(a), r"^([^\s=]+)", 1)
    value = lambda a: F.regexp_replace(F.regexp_replace(F.trim(a), r"^[^\s=]+[\s=]*", ""), '"', "")
    entries = F.array_distinct(F.transform(pairs, key))
    attributes = F.map_from_entries(F.transform(entries, lambda k: F.struct(k, F.get(F.transform(F.filter(pairs, lambda a: key(a) == k), value), F.lit(0)))))
    g = _fields(spark, path, "^#").select(_chrom(False).alias("chrom"), _text(1).alias("source"), _text(2).alias("feature"), F.get("x", F.lit(3)).cast("long").alias("start"), F.get("x", F.lit(4)).cast("long").alias("stop"), _text(6).alias("strand"), attributes.alias("attributes"))
    return g.where(F.col("feature").isin(features)) if features else g


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(grp, description, item), one row a member."""
    g = _fields(spark, path, "^#").select(F.get("x", F.lit(0)).alias("grp"), _text(1).alias("description"), F.explode(F.slice("x", 3, F.greatest(F.size("x") - 2, F.lit(0)))).alias("item"))
    return g.where("item != ''")


def write_gmt(members: DataFrame, path: str, item: str = "item", group: str = "grp") -> None:
    members.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), "\t").alias("m")).select(F.concat_ws("\t", F.col(group).cast("string"), F.lit(""), "m").alias("value")).write.text(path)


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms (term, name), edges (term, parent)) of is_a relations; obsolete terms are left out.

    Stanzas are told apart by their own separator, so a file is split between tasks."""
    stanzas = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").rlike(r"^\[?Term\]"))
    live = stanzas.where(~F.col("value").rlike(r"(?m)^is_obsolete:\s*true"))
    t = live.select(F.regexp_extract("value", r"(?m)^id:\s*(\S+)", 1).alias("term"), F.regexp_extract("value", r"(?m)^name:\s*(.+)$", 1).alias("name"), F.regexp_extract_all("value", F.lit(r"(?m)^is_a:\s*(\S+)"), F.lit(1)).alias("parents"))
    return t.select("term", "name"), t.select("term", F.explode("parents").alias("parent"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence), a record a row."""
    r = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    return r.select(F.regexp_extract(F.get(lines, F.lit(0)), r"^(\S+)", 1).alias("name"), F.upper(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "")).alias("sequence"))


def read_gwas(spark: SparkSession, path: str, p_column: str = "P-VALUE", most_p: float | None = None) -> DataFrame:
    g = spark.read.csv(path, sep="\t", header=True)
    p = F.col(f"`{p_column}`").try_cast("double")
    return g.where(p <= most_p) if most_p is not None else g


def read_pileup(spark: SparkSession, path: str, least_quality: int = 0) -> DataFrame:
    """(chrom, pos, ref, a, c, g, t): counts of bases of enough quality; "." and "," are the reference.

    Insertions and deletions of any length, and read ends, are taken out of the bases first."""
    x = _fields(spark, path, "^#").select(F.get("x", F.lit(0)).alias("chrom"), F.get("x", F.lit(1)).cast("long").alias("pos"), F.upper(F.get("x", F.lit(2))).alias("ref"), F.get("x", F.lit(4)).alias("bases"), F.get("x", F.lit(5)).alias("quals"))
    pieces = F.split(F.regexp_replace("bases", r"\^.|\$", ""), "[+-]")  # each but the first begins with a length and so many bases
    digits = lambda p: F.regexp_extract(p, "^[0-9]+", 0)
    clean = F.array_join(F.transform(pieces, lambda p, i: F.when((i == 0) | (digits(p) == ""), p).otherwise(F.substring(p, F.length(digits(p)) + digits(p).try_cast("int") + 1, F.length(p)))), "")
    x = x.withColumn("b", F.split(clean, "")).withColumn("q", F.split("quals", ""))
    kept = F.filter(F.arrays_zip("b", "q"), lambda z: z["b"].isNotNull() & (z["b"] != "") & (F.ascii(z["q"]) - 33 >= least_quality))
    seen = F.transform(kept, lambda z: F.when(z["b"].isin(".", ","), F.col("ref")).otherwise(F.upper(z["b"])))
    count = lambda base: F.size(F.filter(seen, lambda s: s == base))
    return x.select("chrom", "pos", "ref", *(count(base).alias(base.lower()) for base in "ACGT"))


def read_regulome(spark: SparkSession, path: str) -> DataFrame:
    """RegulomeDB lines: (chrom, pos, id, data, score), positions from 1; data as an array of what supports the entry."""
    f = _fields(spark, path)
    return f.select(_chrom(True).alias("chrom"), (F.get("x", F.lit(1)).cast("long") + 1).alias("pos"), _text(2).alias("id"), F.filter(F.split(_text(3), r",\s*"), lambda y: y != "").alias("data"), _text(4).alias("score"))


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """UCSC wig files, fixedStep and variableStep: (chrom, start, stop, value), closed, from 1. A file is one task: give
    one a chromosome, as they are published."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).where("trim(line) != ''")
    lines = lines.where(~F.col("line").rlike(r"^(#|track|browser)"))
    head = F.col("line").rlike("^(fixedStep|variableStep)")
    w = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("head", F.last(F.when(head, F.struct("i", "line")), ignorenulls=True).over(w)).where(~head)
    item = lambda name: F.nullif(F.regexp_extract("head.line", rf"\b{name}=(\S+)", 1), F.lit(""))
    span = F.coalesce(item("span").cast("long"), F.lit(1))
    fixed = F.startswith("head.line", F.lit("fixedStep"))
    x = F.split(F.trim("line"), r"\s+")
    place = F.row_number().over(Window.partitionBy("file", "head.i").orderBy("i")) - 1
    start = F.when(fixed, item("start").cast("long") + place * F.coalesce(item("step").cast("long"), F.lit(1))).otherwise(F.get(x, F.lit(0)).try_cast("long"))
    value = F.when(fixed, F.get(x, F.lit(0))).otherwise(F.get(x, F.lit(1))).try_cast("double")
    return marked.select(F.regexp_replace(item("chrom"), "^chr", "").alias("chrom"), start.alias("start"), value.alias("value"), span.alias("span")).select("chrom", "start", (F.col("start") + F.col("span") - 1).alias("stop"), "value")


def read_soft(spark: SparkSession, path: str, table: str = "platform") -> DataFrame:
    """Rows of the tables of a SOFT family file: (entity, row) with each row a map from column to text. table is
    platform, sample or series. A file is one task, as its sections depend on the lines before."""
    section = F.regexp_extract_all("value", F.lit(rf"(?s)!{table}_table_begin\r?\n(.*?)!{table}_table_end"), F.lit(1))
    names = F.regexp_extract_all("value", F.lit(rf"(?im)^\^{table}\s*=\s*(\S+)"), F.lit(1))
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.arrays_zip(names.alias("entity"), section.alias("body"))).alias("s")).where("s.body is not null")
    rows = F.filter(F.split("s.body", r"\r?\n"), lambda y: y != "")
    each = pairs.select("s.entity", F.split(F.get(rows, F.lit(0)), "\t").alias("head"), F.explode(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).alias("line"))
    cells = F.split("line", "\t")
    return each.select("entity", F.map_from_entries(F.filter(F.arrays_zip(F.col("head").alias("k"), cells.alias("v")), lambda y: y["k"].isNotNull())).alias("row"))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Hi-C contacts of text lines: (bin_a, bin_b, value) with the lesser bin first, in order of both."""
    f = _fields(spark, path)
    a, b = F.get("x", F.lit(0)).try_cast("long"), F.get("x", F.lit(1)).try_cast("long")
    return f.select(F.least(a, b).alias("bin_a"), F.greatest(a, b).alias("bin_b"), F.get("x", F.lit(2)).try_cast("double").alias("value")).orderBy("bin_a", "bin_b")
