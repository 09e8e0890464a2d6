import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lociframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text=...):
    return digest(*(field(v) for v in (r[0], r[3], r[2], r[4], r[1] if text is ... else text)))


def climb(nodes):
    """(levels, top) of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 16 * 16
        out.append((nodes[run:at], nodes[at + 1 : run + 16]))
        at //= 16
    return out


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[3] is not None, (r[3] or "").encode())].append(r)
    keys = sorted(groups)
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = climb([leaf(r) for r in groups[k]])
    whole = climb([trees[k][-1][0] for k in keys])
    out = []
    for i, k in enumerate(keys):
        for j, r in enumerate(groups[k]):
            steps = path(trees[k], j) + path(whole, i)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            acc = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])) if tampered else leaf(r)
            for before, after in steps:
                acc = digest(*before, acc, *after)
            out.append((r[0], leaf(r), trees[k][-1][0], whole[-1][0], digest(*(s for b, a in steps for s in b + a)), acc, acc == whole[-1][0]))
    return out


def result(spark, rows, stride=2, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in merkle.tamper_check(df, stride).collect()), key=repr)


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_against_plain_trees(spark, stride):
    """Groups of sizes around runs of 16 and 256, and as many groups as make two levels of subroots."""
    rows, i = [], 0
    for g, size in enumerate([1, 2, 15, 16, 17, 255, 256, 257, 300] + [1] * 10):
        for _ in range(size):
            rows.append((i * 7 % 1009 + g * 2000, f"Text {i} É 😀" * (i % 3), "en" if i % 5 else None, f"s{g:02d}" if g else None, i, "x"))
            i += 1
    assert result(spark, rows, stride) == sorted(plain(rows), key=repr)


def test_a_hot_group_of_three_stored_levels(spark):
    rows = [(i, f"T{i}", "en", "hot" if i % 9 else "é", 1, "") for i in range(5000)]
    assert result(spark, rows, 1, 8) == sorted(plain(rows), key=repr)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, None), (None, None, None, None, None, "clash"), (3, "", "", "", 0, ""), (3, "B", "", "", 0, ""), (3, "B", "", "", 0, ""), (-4, "x" * 300_000 + "Z", "l", "s", 5, ""), (10, None, "l", "s", 5, "")]
    got = result(spark, rows)
    assert got == sorted(plain(rows), key=repr) and len(got) == 7
    assert merkle.tamper_check(spark.createDataFrame([], SCHEMA)).collect() == []
    one = result(spark, [(5, "A", "l", "s", 1, "")])
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == digest()


def test_tampering_shows(spark):
    """Proofs of the untampered manifest refuse exactly the rows whose digest has changed."""
    rows = [(i, "Abc" if i % 2 else "abc", "en", f"s{i % 3}", 3, "") for i in range(200)]
    for r in result(spark, rows):
        assert r[6] == (zlib.crc32(str(r[0]).encode()) % 5 != 0 or r[0] % 2 == 0)


def test_only_every_other_level_is_stored(spark):
    leaves = merkle.numbered(spark.range(1000).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.col("id").alias("own")), "tree", ["own"])
    forest = merkle.plant(leaves.select("tree", "idx", "size", "digest", "own"), 2)
    assert sorted(forest.levels) == [0, 2] and forest.levels[0].count() == 4 and forest.levels[2].count() == 1
