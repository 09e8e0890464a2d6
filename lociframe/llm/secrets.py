"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content (its blob).
The ledger, a Parquet folder, has for each blob what each rule version that scanned it has found. A scan
reads only the (blob, rule version) pairs that the ledger lacks, each blob once however
many paths hold it, and writes them as an increment of its own name, which a second try replaces. Findings are
taken from the ledger by exact rule version, a pair once even if several increments have it, and
joined back to all paths and versions. A blob that very many paths hold is split for that join (HOT).

A null text is the empty text, and stays null in redacted rows. Empty texts, repeated rows, null ids and empty tables need no
care: they are blobs (or none) like others. Matches of a kind are leftmost and do
not overlap; places count code points. Only the columns named are read; findings and redact keep all
columns of their input, whatever their names, but that findings replaces one named spans."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, fresh_path, materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if the group `part` of it has `least` characters.

    hint: a pattern without which the rule cannot match, cheap to look for."""

    kind: str
    pattern: str
    version: str = "1"
    part: int = 0
    least: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values of the base kinds. [0-9a-f]{16,} matches exactly the runs [0-9a-f]+ of 16
# characters or more, and AKIA[A-Z0-9]{14,} the runs AKIA[A-Z0-9]+ of 18 or more.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", part=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="-----BEGIN"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
)
RULES = BASE_RULES + MORE_RULES

#: Paths of one blob that go into one group of a join, about.
HOT = 1000
#: Increments in which scan takes the versions.
INCREMENTS = 2

PLACES = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, scans array<struct<rule:string,spans:{PLACES}>>, increment string"
#: Bytes of findings that may be broadcast.
BROADCAST_BYTES = 32 << 20


def _spans(text: Column, rule: Rule) -> Column:
    """Array of places of one rule. The pieces between matches and the matches, both in
    order, give each match its place; only texts with a match pay for that."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.part)) if rule.part else whole
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(part, F.length).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["len"], F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["part"], F.lit(-1)) >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(steps, start, step, lambda acc: acc["found"])
    may = text.rlike(rule.pattern)
    return F.when(F.contains(text, F.lit(rule.hint)) & may if rule.hint else may, found).otherwise(F.array().cast(PLACES))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path (blob, scans(rule, spans), increment); a new one is begun there if there is none."""
    spark.createDataFrame([], LEDGER).drop("increment").write.mode("ignore").parquet(f"{path}/increment=start")
    return spark.read.schema(LEDGER).parquet(path)


def scan_increment(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger rows (blob, scans) that versions adds: one row per blob that the ledger
    lacks at all or lacks under some of these rule versions, scanned for those alone."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = versions.select(text.alias("txt")).select(F.sha2("txt", 256).alias("blob"), "txt").groupBy("blob").agg(F.first("txt").alias("txt"))
    one = lambda r: F.struct(F.lit(r.key).alias("rule"), _spans(F.col("txt"), r).alias("spans"))
    if ledger is None:
        return blobs.select("blob", F.array(*map(one, rules)).alias("scans"))
    done = ledger.select("blob", F.explode("scans.rule").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    todo = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    todo = todo.where(F.size(F.array_except(F.array(*(F.lit(r.key) for r in rules)), "done")) > 0)
    every = F.array(*(F.when(~F.array_contains("done", r.key), one(r)) for r in rules))
    return todo.select("blob", F.filter(every, lambda x: x.isNotNull()).alias("scans"))


def update_ledger(versions: DataFrame, path: str, increment: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what the ledger at path lacks of versions, write it as this increment, and return the ledger. An increment of
    the same name is replaced, so a scan that broke off can be repeated."""
    others = open_ledger(versions.sparkSession, path).where(F.col("increment") != increment)
    scan_increment(versions, others, rules, text_col).write.mode("overwrite").parquet(f"{path}/increment={increment}")
    return open_ledger(versions.sparkSession, path)


def _known(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans(start, rank, end, kind)): what the ledger has under exactly these rule versions, sorted; a pair that several
    increments have counts once."""
    keys, kinds = F.array(*(F.lit(r.key) for r in rules)), F.array(*(F.lit(r.kind) for r in rules))
    own = ledger.select("blob", F.filter("scans", lambda s: F.array_contains(keys, s["rule"])).alias("scans")).where(F.size("scans") > 0)
    own = own.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scans"))).alias("scans"))

    def placed(s: Column) -> Column:
        rank = F.array_position(keys, s["rule"]).cast("int") - 1
        return F.transform(s["spans"], lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), F.get(kinds, rank).alias("kind")))

    return own.select("blob", F.array_sort(F.flatten(F.transform("scans", placed))).alias("spans"))


def _to_paths(paths: DataFrame, known: DataFrame) -> DataFrame:
    """paths(blob, ...) with the spans of their blobs. Blobs of more than HOT paths are split in parts."""
    hot = paths.groupBy("blob").count().where(F.col("count") > HOT).select("blob", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
    hot = materialize(hot, "hot-blobs")  # a path in HOT at most
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    parts = F.coalesce("parts", F.lit(1))
    salted = paths.join(hot, "blob", "left").withColumn("part", F.pmod(F.xxhash64(*(c for c in paths.columns if c != "blob")), parts).cast("int")).drop("parts")
    spread = known.join(hot, "blob", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return salted.join(spread, ["blob", "part"], "left").drop("part")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """versions with `spans`, the sorted findings of its content under these rules."""
    own = [c for c in versions.columns if c != "spans"]
    found = _to_paths(versions.select(blob_of(F.col(text_col).cast("string")).alias("blob"), F.struct(*own).alias("own")), _known(ledger, rules))
    return found.select("own.*", "spans")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _in_increments(versions: DataFrame, by: str, path: str | None, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger at path (or a new folder of the shared one) after versions, taken as INCREMENTS parts by a hash of a column."""
    path = path or fresh_path(versions.sparkSession, "ledger")
    run = uuid.uuid4().hex
    for i in range(INCREMENTS):
        ledger = update_ledger(versions.where(F.pmod(F.xxhash64(by), F.lit(INCREMENTS)) == i), path, f"{run}-{i}", rules)
    return ledger


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs. The rows come as
    INCREMENTS parts, by a hash of the id; each scans what the ledger (at path, or a new folder of the shared
    one) lacks, and the findings of the whole ledger are joined back to all rows."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ledger = _in_increments(own, "id", path, rules)
    found = _to_paths(own.select("id", blob_of(F.col("text")).alias("blob")), _known(ledger, rules))
    base = F.filter("spans", lambda x: x["kind"].isin(*(r.kind for r in BASE_RULES)))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(F.col("id").alias(id_col), *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """docs with every finding in its text replaced by mark; overlapping findings are one.
    A null text stays null. The ledger (at path, or a new folder of the shared one) tells the findings. Blobs with findings are
    broadcast if they are of few bytes, so that no text is moved for them; more are joined by shuffling."""
    path = path or fresh_path(docs.sparkSession, "ledger")
    ledger = update_ledger(docs.select(F.col(text_col).cast("string").alias("text")), path, uuid.uuid4().hex, rules)
    known = materialize(_known(ledger, rules).where(F.size("spans") > 0), "found-blobs")
    rows = docs.select(blob_of(F.col(text_col).cast("string")).alias("blob"), F.struct(*docs.columns).alias("own"))
    size = known.agg(F.sum(200 + 60 * F.size("spans"))).first()[0] or 0
    found = rows.join(F.broadcast(known), "blob", "left") if size <= BROADCAST_BYTES else _to_paths(rows, known)
    text = F.col("own")[text_col]
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] > acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).when(x["start"] == acc["at"], F.concat(acc["out"], F.lit(mark))).otherwise(acc["out"])
        return F.struct(gap.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.col("spans").isNull() | text.isNull(), text).otherwise(done)
    return found.select(*(clean.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns))
