"""N-gram Jaccard join by prefix filters under several global token orders.

A document is its set of distinct five-word shingles. Two sets of sizes m and n
with Jaccard similarity t or more miss at most n - ceil(t n) of each other's
tokens, so under *any* total order of the tokens they share one of their first
n - ceil(t n) + 1. Three orders are used, in all of which tokens of one set only come first: by the
number of sets that hold a token, by a hash alone, and by the logarithm to base 2 of that number with ties by
another hash. A pair is a candidate only if it shares a
prefix token under all three; only then are its sets fetched and compared.

How it runs:

1. One pass hashes every text to (set size, 128-bit set fingerprint). Equal sets
   are one class from here on, however many documents hold them; the class's smallest id stands for it.
2. A second pass, over the documents that stand for a class, deals all shingles, packed, to buckets by hash. It
   goes block by block: a piece of a block has the block's name, the shingles and, as small
   differences, the classes' numbers in the block, so pieces do not weigh more where buckets are many. A bucket counts
   in how many classes a shingle occurs. Shingles of one class only never link
   anything: they are counted, not kept. What is kept goes back to the block. A class with more of them than it may
   miss has no partner and is dropped, exactly. A shingle in a large part of one
   block's classes travels as one count instead of as its rows ("very common",
   last in order), so no bucket grows with a hot passage.
3. Candidates of a prefix token are first only its classes against one hub (a star),
   twice; verified links are merged into components. Then all pairs of different
   components that can still link are compared; how few these are in a group of near
   copies, _remaining says. A group thus costs a few comparisons per member, not all
   pairs, and no link between components is lost.

Nulls and empty texts have no shingle, component_id is their own doc_id. A row without doc_id has no
name to be linked by: its n_shingles is given, its component_id and class_id are null, and it links nothing. Repeated
rows of one doc_id are one document each; of different texts under one id each is compared. Long texts are
hashed in one piece. Only the id and text columns are read, so other columns, whatever their names, do not matter.
An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _grow, _join, _part, _shrink
from .components import connected_components
from .shared import materialize, without
from .textops import Words, mix, shingle_sets, slices, tidy, tidy_group, utf8

#: Tokens that one bucket task sorts at a time, about.
BUCKET_TOKENS = 2_000_000
#: Tokens a task gathers before it deals them out.
FLUSH_TOKENS = 750_000
#: A token in so many classes of one task's gathering, and this share of them, is very common.
COMMON_LEAST, COMMON_SHARE = 256, 1 / 32
COMMON = np.int32(2**31 - 1)

_PROFILE = "id long, n_shingles long, fp1 long, fp2 long"
_PIECE = "dest long, source long, kind int, payload binary"
TOKENS, COMMONS, OF_COMMON, CLASSES = range(4)  # kinds of pieces
_CLASS = "block long, row int, fp1 long, fp2 long, n long, toks array<long>, pre1 array<long>, pre2 array<long>, pre3 array<long>"


def _sets(column: pa.Array, k: int):
    words = Words(*utf8(column))
    toks, bound = shingle_sets(words, k)
    n = np.diff(bound)
    fp = np.zeros((2, len(n)), np.uint64)
    has = n > 0
    if has.any():
        at = bound[:-1][has]
        fp[0, has] = np.add.reduceat(mix(toks, 0x11), at)
        fp[1, has] = np.add.reduceat(mix(toks, 0x7F4A7C15), at)
    return toks, bound, n, fp


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in slices(batch.column(1)):
                _, _, n, fp = _sets(batch.column(1).slice(s, e - s), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64))], names=["id", "n_shingles", "fp1", "fp2"])

    return run


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["dest", "source", "kind", "payload"])


def _pack(row: np.ndarray, toks: np.ndarray, *more: np.ndarray) -> bytes:
    """Tokens and their classes' numbers in the block, which do not fall."""
    return _join([_shrink(np.diff(row, prepend=0)), toks.tobytes(), *map(_shrink, more)])


def _unpack(payload: bytes) -> tuple[np.ndarray, ...]:
    row, toks, *more = _part(payload)
    return np.cumsum(_grow(row)), np.frombuffer(toks, np.uint64), *map(_grow, more)


def _deal(k: int, buckets: int):
    """Pieces (bucket, block, kind, payload). TOKENS: classes and tokens; COMMONS: tokens that
    are very common in a block; OF_COMMON: classes and their very common tokens; CLASSES: the
    fingerprints and sizes of a block's classes. The last two only pass through a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        seen: set[tuple[int, int]] = set()
        held: list = []
        size = 0

        def flush():
            nonlocal held, size, seq
            block = (part << 24) + seq
            seq += 1
            toks = np.concatenate([h[0] for h in held])
            cnt = np.concatenate([h[1] for h in held])
            fp = np.concatenate([h[2] for h in held], axis=1)
            held, size = [], 0
            seen.clear()  # equal sets of one block are one; of several blocks they meet as one class anyway
            row = np.repeat(np.arange(len(cnt)), cnt)
            by = int(mix(np.array([block], np.uint64))[0] % np.uint64(buckets))
            rows = [(by, block, CLASSES, _join([fp.tobytes(), _shrink(cnt)]))]
            srt = np.sort(toks)
            least = max(COMMON_LEAST, int(len(cnt) * COMMON_SHARE))
            if len(srt) >= least:  # equal values least - 1 apart: at least so many copies
                common = np.unique(srt[least - 1 :][srt[least - 1 :] == srt[: len(srt) - least + 1]])
                if len(common):
                    is_common = np.isin(toks, common)
                    rows.append((by, block, OF_COMMON, _pack(row[is_common], toks[is_common])))
                    b = (common % np.uint64(buckets)).astype(np.int64)
                    rows += [(int(x), block, COMMONS, common[b == x].tobytes()) for x in np.unique(b)]
                    toks, row = toks[~is_common], row[~is_common]
            b = (toks % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            for x in np.flatnonzero(np.diff(cut)).tolist():
                at = order[cut[x] : cut[x + 1]]
                rows.append((x, block, TOKENS, _pack(row[at], toks[at])))
            for i in range(0, len(rows), 64):
                yield from _rows(rows[i : i + 64]).to_batches()

        for batch in batches:
            for s, e in slices(batch.column(0)):
                toks, bound, n, fp = _sets(batch.column(0).slice(s, e - s), k)
                new = np.zeros(len(n), bool)
                for i, key in enumerate(zip(fp[0].tolist(), fp[1].tolist())):
                    if n[i] and key not in seen:
                        seen.add(key)
                        new[i] = True
                held.append((toks[np.repeat(new, n)], n[new], fp[:, new]))
                size += int(n[new].sum())
                if size >= FLUSH_TOKENS:
                    yield from flush()
        if size:
            yield from flush()

    return run


def _count(group: pa.Table) -> pa.Table:
    """A bucket's tokens of more than one class, with their counts, for each block."""
    bucket = group["dest"][0].as_py()
    kinds, sources, payloads = group["kind"].to_numpy(), group["source"].to_numpy(), group["payload"]
    out = [(int(sources[i]), bucket, int(kinds[i]), payloads[int(i)].as_py()) for i in np.flatnonzero(kinds >= OF_COMMON)]
    which = np.flatnonzero(kinds == TOKENS)
    if len(which):
        pieces = [_unpack(payloads[int(i)].as_py()) for i in which]
        toks = np.concatenate([x[1] for x in pieces])
        common = [np.frombuffer(payloads[int(i)].as_py(), np.uint64) for i in np.flatnonzero(kinds == COMMONS)]
        common = np.unique(np.concatenate(common)) if common else np.zeros(0, np.uint64)
        times = np.zeros(len(toks), np.int32)
        part = (toks >> np.uint64(61)).astype(np.int8)
        for x in range(8):  # an eighth of the tokens at a time
            mine = np.flatnonzero(part == x)
            own = toks[mine]
            order = np.argsort(own, kind="stable")
            srt = own[order]
            start = np.flatnonzero(np.concatenate([[True], srt[1:] != srt[:-1]])) if len(srt) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([start, [len(srt)]]))
            df = n.copy()
            if len(common):
                df[np.isin(srt[start], common)] = COMMON
            times[mine[order]] = np.repeat(df, n)
        at = 0
        for i, (row, own) in zip(which, pieces):
            v = times[at : at + len(own)]
            at += len(own)
            keep = v > 1
            if keep.any():
                out.append((int(sources[i]), bucket, TOKENS, _pack(row[keep], own[keep], v[keep])))
    return _rows(out)


def _lists(values: np.ndarray, bound: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(values.view(np.int64)))


def _survivors(percent: int):
    def run(group: pa.Table) -> pa.Table:
        kinds, payloads = group["kind"].to_numpy(), group["payload"]
        keys, size = _part(payloads[int(np.flatnonzero(kinds == CLASSES)[0])].as_py())
        keys, size = np.frombuffer(keys, np.uint64).reshape(2, -1), _grow(size)
        pieces = [_unpack(payloads[int(i)].as_py()) for i in np.flatnonzero(kinds == TOKENS)]
        pieces += [(*x, np.full(len(x[0]), COMMON)) for x in (_unpack(payloads[int(i)].as_py()) for i in np.flatnonzero(kinds == OF_COMMON))]
        row, toks, v = (np.concatenate([np.zeros(0, t), *(x[i] for x in pieces)]) for i, t in enumerate((np.int64, np.uint64, np.int64)))
        del pieces
        need = (size * percent + 99) // 100
        shared = np.bincount(row, minlength=len(size))
        ok = (shared >= need) & (need > 0)
        pick = np.flatnonzero(ok[row])
        pick = pick[np.lexsort((toks[pick], row[pick]))]
        row, toks, v = row[pick], toks[pick], v[pick]
        which = np.flatnonzero(ok)
        bound = np.concatenate([[0], np.cumsum(shared[which])])
        # the prefix is size - need + 1 long; tokens of one class only come first in it and are not here
        prefix = size[which] - need[which] + 1 - (size[which] - shared[which])
        level = np.frexp(v.astype(np.float64))[1]
        pres = []
        for first, tie in ((v, toks), (np.zeros_like(v), mix(toks, 0x2545F491)), (level, mix(toks, 0x6C62272E))):
            order = np.lexsort((tie, first, row))
            place = np.arange(len(row)) - np.repeat(bound[:-1], shared[which])
            chosen = order[place < np.repeat(prefix, shared[which])]
            pres.append(_lists(toks[chosen], np.concatenate([[0], np.cumsum(prefix)])))
        block = np.full(len(which), group["dest"][0].as_py(), np.int64)
        return pa.table({"block": pa.array(block), "row": pa.array(which.astype(np.int32)), "fp1": pa.array(keys[0, which].view(np.int64)), "fp2": pa.array(keys[1, which].view(np.int64)), "n": pa.array(size[which]), "toks": _lists(toks, bound), "pre1": pres[0], "pre2": pres[1], "pre3": pres[2]})

    return run


def _tested(pairs: DataFrame, classes: DataFrame, percent: int, name: str, every: bool) -> DataFrame:
    """Pairs (a, b) with the sizes of both, of what they share, and whether they are linked.

    Only pairs of like sizes that share prefix tokens under the other orders too have their sets fetched and compared.
    With every, the others are returned as well, with the most they can share as they are not linked."""
    side = lambda x, *cols: classes.select(F.col("cid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))
    like = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    both = pairs.select("a", "b").join(side("b", "n", "pre2", "pre3"), "b").join(side("a", "n", "pre2", "pre3"), "a")
    both = both.select("a", "b", "n_a", "n_b", (like & F.arrays_overlap("pre2_a", "pre2_b") & F.arrays_overlap("pre3_a", "pre3_b")).alias("near"))
    both = materialize(both if every else both.where("near"), f"filtered-{name}")
    found = both.where("near").join(side("b", "toks"), "b").join(side("a", "toks"), "a")
    found = found.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("toks_a", "toks_b")).cast("long").alias("shared"))
    found = found.withColumn("linked", F.expr(f"100 * shared >= {percent} * (n_a + n_b - shared)"))
    most = F.expr(f"least(n_a, n_b, ({percent} * (n_a + n_b) - 1) div {100 + percent})")
    return found.unionByName(both.where("not near").select("a", "b", "n_a", "n_b", most.alias("shared"), F.lit(False).alias("linked"))) if every else found


def _pairs(left: DataFrame, right: DataFrame, on: list[str], percent: int, extra: str = "true") -> DataFrame:
    """Pairs of classes of different components that meet in `on`; the right side's columns end in 2."""
    other = right.select(*on, *(F.col(c).alias(f"{c}2") for c in right.columns if c not in on))
    met = left.join(other, on).where(f"comp != comp2 and {extra} and 100 * least(n, n2) >= {percent} * greatest(n, n2)")
    return met.select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b"))


def _remaining(posts: DataFrame, classes: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components that may still link.

    Every class has a home, of the hubs it was compared with the one that most were (or itself).
    Take classes r and m of one home h, of which r, say, is not linked to h, and let them
    link. If all they share is in h, they share at most what r shares with h, so
    |r & h| >= t / (1 + t) (|r| + |m|), which, r and h not being linked, needs |m| < |h|. So only
    three kinds of pairs remain, of which each shares a prefix token besides:

    - of one home, with a shared token that the home lacks. It is looked for among the prefix tokens;
      classes that have prefix tokens of the home as well may share only such ones,
      so for these it is looked for among all tokens;
    - of one home, one side smaller than the home, within the bound above;
    - of different homes."""
    hub = stars.select(F.col("b").alias("cid"), F.col("a").alias("other"), F.col("n_a").alias("n_h"), "hub", "shared", "linked").unionByName(stars.select(F.col("a").alias("cid"), F.col("b").alias("other"), F.col("n_b").alias("n_h"), "hub", "shared", "linked"))
    hub = hub.where("other = hub").drop("other")
    size = hub.groupBy("hub").agg(F.count("*").alias("size"))
    best = hub.join(size, "hub").groupBy("cid").agg(F.max(F.struct("size", (-F.col("hub")).alias("less"), "n_h", "shared", "linked")).alias("x"))
    best = best.select("cid", (-F.col("x.less")).alias("home"), "x.n_h", "x.shared", "x.linked")
    own = posts.select("cid", "n", "comp").distinct().join(best, "cid", "left")
    own = own.select("cid", "n", "comp", F.coalesce("home", "cid").alias("home"), F.coalesce(F.col("n") < F.col("n_h"), F.lit(False)).alias("shrinks"), F.coalesce("shared", "n").alias("held"), F.coalesce("linked", F.lit(True)).alias("near"))
    own = materialize(own, "homes")

    mixed_homes = own.groupBy("home").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("home")
    apart = own.join(mixed_homes, "home", "left_semi").where("cid != home").select("cid", "n", "comp", "home")
    home_toks = classes.select(F.col("cid").alias("home"), F.col("toks").alias("home_toks"))
    apart = apart.join(classes.select("cid", "toks", "pre1"), "cid").join(home_toks, "home")
    rare = F.array_except("pre1", "home_toks")
    apart = apart.select("cid", "n", "comp", "home", F.when(F.size(rare) == F.size("pre1"), rare).otherwise(F.array_except("toks", "home_toks")).alias("new"))
    added = apart.select("cid", "n", "comp", "home", "new", F.explode("new").alias("tok"))
    split = added.groupBy("home", "tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("home", "tok")
    added = added.join(split, ["home", "tok"], "left_semi")
    first = _pairs(added, added, ["home", "tok"], percent, "cid < cid2 and tok = array_min(array_intersect(new, new2))")  # once a pair

    mixed = posts.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tok")
    homed = materialize(posts.select("cid", "n", "tok", "comp").join(mixed, "tok", "left_semi").join(own.drop("n", "comp"), "cid"), "mixed")
    bound = " and ".join(f"({near} or {100 + percent} * {held} >= {percent} * (n + n2))" for near, held in (("near", "held"), ("near2", "held2")))
    second = _pairs(homed.where("shrinks"), homed, ["home", "tok"], percent, bound)
    parts = homed.groupBy("tok", "home").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    across = parts.join(parts.select("tok", F.col("home").alias("home2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "tok").where("home < home2 and not (lo = hi and lo2 = hi2 and lo = lo2)").select("tok", "home", "home2")
    plain = homed.select("cid", "n", "tok", "comp", "home")
    third = _pairs(plain.join(across, ["tok", "home"]).drop("home"), plain.withColumnRenamed("home", "home2"), ["tok", "home2"], percent)
    return first.unionByName(second).unionByName(third)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of docs.

    Documents whose k-word shingle sets have a Jaccard similarity of percent / 100
    or more are linked; component_id is the smallest id reachable by links and
    class_id the smallest id with the very same set. See the module for nulls,
    empty texts, repeated rows and empty tables."""
    conf, name = docs.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    before = conf.get(name)
    conf.set(name, "-1")  # some sixty small joins: as broadcasts each would pass through the driver
    try:
        return _components(docs, id_col, text_col, k, percent, buckets)
    finally:
        conf.set(name, before)


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, buckets: int | None) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("txt"))
    profile = materialize(own.mapInArrow(tidy(_profile(k)), _PROFILE), "profile")
    named = profile.where("n_shingles > 0 and id is not null")
    classes = named.groupBy("fp1", "fp2").agg(F.min("id").alias("cid"))
    stands = materialize(classes, "stands")
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = buckets or int(max(16, -(-total // BUCKET_TOKENS)))

    others = profile.where("id is not null").select("id").distinct().join(stands.select(F.col("cid").alias("id")), "id", "left_anti")
    dealt = without(own.where("id is not null"), others, "id").select("txt").mapInArrow(tidy(_deal(k, buckets)), _PIECE)
    counted = dealt.groupBy("dest").applyInArrow(tidy_group(_count), _PIECE)
    sets = materialize(counted.groupBy("dest").applyInArrow(tidy_group(_survivors(percent)), _CLASS), "sets")
    first = sets.groupBy("fp1", "fp2").agg(F.min(F.struct("block", "row")).alias("x")).join(stands, ["fp1", "fp2"]).select("x.block", "x.row", "cid")
    sets = materialize(sets.drop("fp1", "fp2").join(first, ["block", "row"]).drop("block", "row"), "classes")

    tokens = sets.select("cid", "n", F.struct(((F.col("n") - F.size("toks")) / F.col("n")).alias("alone"), "cid").alias("key"), F.explode("pre1").alias("tok"))
    comps = None
    tested, stars = [], []
    for step in ("first", "second", "rest"):
        if comps is None:
            posts = tokens.withColumn("comp", F.col("cid"))
        else:
            posts = tokens.join(comps, tokens.cid == comps.node, "left").select("cid", "n", "key", "tok", F.coalesce("component", "cid").alias("comp"))
        if step == "rest":
            pairs = _remaining(posts, sets, reduce(DataFrame.unionByName, stars), percent)
        else:
            # the hub of a token is its class with the least share of tokens of its own: of
            # near copies most likely the original; then the like among what is apart from it
            hubs = posts.groupBy("tok").agg(F.min(F.struct("key", "comp")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tok", "hub")
            if step == "second":
                hubs = posts.join(hubs, "tok").where("comp != hub.comp").groupBy("tok").agg(F.min(F.struct("key", "comp")).alias("hub"))
            pairs = posts.join(hubs, "tok").where("comp != hub.comp").select(F.least("cid", "hub.key.cid").alias("a"), F.greatest("cid", "hub.key.cid").alias("b"), F.col("hub.key.cid").alias("hub"))
        pairs = pairs.groupBy("a", "b").agg(F.min("hub").alias("hub")) if step != "rest" else pairs.distinct()
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = materialize(pairs, f"pairs-{step}")
        found = materialize(_tested(pairs, sets, percent, step, step != "rest"), f"tested-{step}")
        tested.append(pairs.select("a", "b"))
        stars.append(found.join(pairs, ["a", "b"])) if step != "rest" else None
        new = found.where("linked").select("a", "b")
        if comps is None or not new.isEmpty():
            # what is linked already is a star of each component, so only new links are worked through
            known = [] if comps is None else [comps.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))]
            comps = materialize(connected_components(reduce(DataFrame.unionByName, [new, *known])), f"components-{step}")

    byset = stands.join(comps, stands.cid == comps.node, "left").select("fp1", "fp2", F.col("cid").alias("class_id"), F.coalesce("component", "cid").alias("component_id"))
    byset = materialize(byset, "by-set")
    out = named.join(byset, ["fp1", "fp2"]).select(F.col("id").alias(id_col), "n_shingles", "component_id", "class_id")
    none = profile.where("n_shingles = 0 or id is null").select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id"), F.col("id").alias("class_id"))
    return out.unionByName(none)
