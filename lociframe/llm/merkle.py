"""Merkle manifests of a dataset: checkpoint and recompute.

Each row is a leaf. The leaves of a group (a source), in order of id, are hashed in runs of
ARITY into nodes, these again, until one is left, the group's subroot; the subroots, in order of group, are hashed
likewise into the root. Only every STRIDE-th level is stored, as blocks of up to ARITY ** STRIDE consecutive nodes:
an aligned subtree is one row. Proofs go from the root down: each block makes the missing levels of its own subtree
anew, gives each of its nodes the siblings of these levels, and lets them go.

A leaf's place comes from a range partitioning by (group, id, digest) and the counts of
the partitions before, so a group of any size is spread over tasks; a group's top block and a
block of subroots are the only rows that a whole group or dataset has one of.

Defined results: a null field is `-`, an empty one `0:`. Null ids come first; rows that repeat an id
are ordered by digest, and equal rows are leaves of their own. A null group is a group, before all others.
An empty table has no proofs and no root. Texts of any length are hashed whole. Only the columns named are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

ARITY = 16
STRIDE = 2

PROOF = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _hash(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _level_above(digests: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.size(digests) / ARITY).cast("int") - 1)
    return F.transform(runs, lambda j: _hash(F.slice(digests, j * ARITY + 1, ARITY)))


def _height(leaves: Column) -> Column:
    """Levels over the leaves of a tree of so many."""
    out = F.lit(15)
    for h in range(14, -1, -1):
        out = F.when(leaves <= ARITY**h, h).otherwise(out)
    return out


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with `idx`, their place from 0 in their tree in this order, and `size`, the rows of the tree.

    The order must tell all rows apart but for equal ones. Rows are ranged over partitions, sorted and
    written; what moves between partitions is one count for each tree in each."""
    placed = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "placed").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    w = Window.partitionBy(tree)  # a row a partition
    before = F.coalesce(F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(tree, "part", (before - F.col("first")).alias("move"), F.sum("k").over(w).alias("size"))
    return placed.join(runs, [tree, "part"]).withColumn("idx", F.col("at") + F.col("move")).drop("at", "part", "move")


@dataclass(frozen=True)
class Forest:
    """Trees whose every stride-th level is stored.

    levels: by level, blocks (tree, block, size, items(idx, digest, own), node); node is the digest that the
    block comes to, stride levels up or at the top of its tree."""

    levels: dict[int, DataFrame]
    stride: int

    def ends(self, level: int) -> Column:
        return _height(F.col("size")) <= level + self.stride

    def tops(self) -> DataFrame:
        """(tree, node): the top of each tree."""
        found = None
        for level, blocks in self.levels.items():
            one = blocks.where(self.ends(level)).select("tree", "node")
            found = one if found is None else found.unionByName(one)
        return found


def _steps(level: int, stride: int) -> Column:
    return F.least(F.lit(stride), _height(F.col("size")) - level)


def _with_levels(blocks: DataFrame, level: int, stride: int) -> DataFrame:
    """blocks with l0, l1, ...: the digests of the levels of each one's subtree, null over its tree's top."""
    out = blocks.withColumn("steps", _steps(level, stride)).withColumn("l0", F.transform("items", lambda x: x["digest"]))
    for k in range(1, stride + 1):
        out = out.withColumn(f"l{k}", F.when(F.col("steps") >= k, _level_above(F.col(f"l{k - 1}"))))
    return out


def plant(leaves: DataFrame, stride: int = STRIDE) -> Forest:
    """The forest over leaves (tree, idx, size, digest, own); its stored levels are written to the shared folder."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    span, levels, nodes, level = ARITY**stride, {}, leaves, 0
    while True:
        block = F.floor(F.col("idx") / span).cast("long").alias("block")
        items = F.array_sort(F.collect_list(F.struct("idx", "digest", "own"))).alias("items")  # span items at most
        made = _with_levels(nodes.groupBy("tree", block, "size").agg(items), level, stride)
        node = F.coalesce(*(F.when(F.col("steps") == k, F.col(f"l{k}")[0]) for k in range(stride + 1)))
        levels[level] = materialize(made.select("tree", "block", "size", "items", node.alias("node")), f"level-{level}")
        level += stride
        if most <= ARITY**level:
            return Forest(levels, stride)
        over = levels[level - stride].where(_height(F.col("size")) > level)
        nodes = over.select("tree", F.col("block").alias("idx"), "size", F.col("node").alias("digest"), F.lit(None).cast("string").alias("own"))


def proofs(forest: Forest, tops: DataFrame) -> DataFrame:
    """(idx, digest, own, proof, ...): each leaf with its proof and the other columns of tops (tree, proof, ...), the rest of the
    way from the top of each tree."""
    more = [c for c in tops.columns if c not in ("tree", "proof")]
    above = None
    for level, blocks in reversed(forest.levels.items()):
        b = blocks.drop("node")
        ended = b.where(forest.ends(level)).join(tops, "tree")  # one block a tree
        met = ended if above is None else ended.unionByName(b.where(~forest.ends(level)).join(above, ["tree", "block"]))
        met = _with_levels(met, level, forest.stride)

        def siblings(i: Column) -> Column:
            own = []
            for k in range(forest.stride):
                at = F.floor(i / ARITY**k).cast("int")
                inner, row = at % ARITY, F.col(f"l{k}")
                pair = F.struct(F.array_join(F.slice(row, at - inner + 1, inner), "").alias("before"), F.array_join(F.slice(row, at + 2, ARITY - 1 - inner), "").alias("after"))
                own.append(F.when(F.col("steps") > k, F.array(pair)).otherwise(F.array().cast(PROOF)))
            return F.concat(*own, "proof")

        each = F.transform("items", lambda x, i: F.struct(x["idx"].alias("idx"), x["digest"].alias("digest"), x["own"].alias("own"), siblings(i).alias("proof")))
        rows = met.select("tree", *more, F.inline(each))
        above = rows.select("tree", F.col("idx").alias("block"), "proof", *more)
    return rows


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf comes to with the siblings of its proof."""
    return F.aggregate(proof, leaf, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))


def prove(docs: DataFrame, id_col: str, group_col: str, leaf: Column, own: Column, stride: int = STRIDE) -> DataFrame:
    """(id, own, leaf, subroot, root, proof) of each row of docs; own is any value to carry along."""
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit("")).alias("tree")
    rows = docs.select(F.col(id_col).alias("id"), tree, leaf.alias("digest"), own.alias("more"), F.monotonically_increasing_id().alias("tie"))
    rows = numbered(materialize(rows, "leaves"), "tree", ["id", "digest", "tie"])
    kind = dict(rows.dtypes)
    sources = plant(rows.select("tree", "idx", "size", "digest", F.struct("id", "more").alias("own")), stride)
    subroots = sources.tops().withColumnRenamed("tree", "group").withColumn("tree", F.lit(""))
    subroots = numbered(subroots, "tree", ["group"])
    whole = plant(subroots.select("tree", "idx", "size", F.col("node").alias("digest"), F.struct("group").alias("own")), stride)
    top = whole.tops().first()
    root = F.lit(top["node"] if top else None).cast("string")
    start = whole.tops().select("tree", F.array().cast(PROOF).alias("proof"))  # one row
    tops = proofs(whole, start).select(F.col("own.group").alias("tree"), "proof", F.col("digest").alias("subroot"))
    found = proofs(sources, tops)
    return found.select(F.col("own.id").cast(kind["id"]).alias(id_col), F.col("own.more").alias("own"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof")


LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tamper_check(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """One row per document: leaf, subroot, root and the digest of its proof; the root recomputed from
    that proof and the document as it is found now, and whether it is the manifest's.

    Found otherwise are the documents whose id has a CRC-32 divisible by 5: their text has lost its capitals A-Z."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_of(*fields, F.translate("text", *LOWER)))
    p = prove(docs, "doc_id", "source", leaf_of(*fields, F.col("text")), changed, stride)
    folded = fold(F.coalesce("own", "leaf"), F.col("proof"))
    out = p.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql() -> str:
    """DuckDB SQL for tamper_check: all levels at once, then joins with the runs of each."""
    field_sql = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    head = " || ".join(map(field_sql, ("doc_id", "source", "lang", "n_chars")))
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda y: ascii(y)::bigint)), lambda c, b: {bits}), 4294967295)"
    lower = f"translate(text, '{LOWER[0]}', '{LOWER[1]}')"
    runs = "sha256(string_agg(digest, '' order by idx))"
    sides = "coalesce(string_agg(t.digest, '' order by t.idx) filter (where t.idx < pos), '') as b, coalesce(string_agg(t.digest, '' order by t.idx) filter (where t.idx > pos), '') as a"
    power = "cast(power(16, lvl) as bigint)"
    return (
        f"with recursive d as (select doc_id, coalesce('+' || source, '') as tree, sha256({head} || {field_sql('text')}) as leaf, case when ({crc}) % 5 = 0 then sha256({head} || {field_sql(lower)}) end as changed from documents),"
        " o as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n from d),"
        f" t as (select tree, 0 as lvl, idx, leaf as digest, n from o union all select tree, lvl + 1, idx // 16, {runs}, (n + 15) // 16 from t where n > 1 group by tree, lvl, idx // 16, n),"
        " s as (select tree, digest as subroot, row_number() over (order by tree) - 1 as idx, count(*) over () as n from t where n = 1),"
        f" u as (select 0 as lvl, idx, subroot as digest, n from s union all select lvl + 1, idx // 16, {runs}, (n + 15) // 16 from u where n > 1 group by lvl, idx // 16, n),"
        f" p as (select tree, q.idx, lvl, {sides} from (select o.tree, o.idx, lvl, o.idx // {power} as pos from o join (select distinct tree, lvl from t where n > 1) x on o.tree = x.tree) q join t using (tree, lvl) where t.idx // 16 = pos // 16 group by tree, q.idx, lvl, pos),"
        f" v as (select tree, lvl, {sides} from (select s.tree, lvl, s.idx // {power} as pos from s, (select distinct lvl from u where n > 1) x) q join u t using (lvl) where t.idx // 16 = pos // 16 group by tree, lvl, pos),"
        " w as (select *, row_number() over (partition by tree, idx order by top, lvl) as k from (select tree, idx, 0 as top, lvl, b, a from p union all select o.tree, o.idx, 1, lvl, b, a from o join v on o.tree = v.tree) z),"
        " f as (select tree, idx, 0::bigint as k, coalesce(changed, leaf) as acc from o union all select f.tree, f.idx, f.k + 1, sha256(b || acc || a) from f join w on f.tree = w.tree and f.idx = w.idx and w.k = f.k + 1),"
        " g as (select tree, idx, max_by(acc, k) as folded_root from f group by tree, idx), h as (select tree, idx, string_agg(b || a, '' order by k) as siblings from w group by tree, idx), r as (select digest as root from u where n = 1)"
        " select doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256, folded_root, folded_root = root as verified from o join s on o.tree = s.tree join g on o.tree = g.tree and o.idx = g.idx left join h on o.tree = h.tree and o.idx = h.idx, r"
    )
