"""Merkle manifests against a plain build of the same trees."""

import random

import pytest
from pyspark.sql import functions as F

from sparkscope.llm import merkle
from sparkscope.llm.merkle import digest


def levels_by_force(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([digest("".join(row[i : i + arity])) for i in range(0, len(row), arity)])
    return levels


def path_by_force(levels, at, arity):
    out = []
    for row in levels[:-1]:
        first = at - at % arity
        out.append(("".join(row[first:at]), "".join(row[at + 1 : first + arity])))
        at //= arity
    return out


def by_force(rows, arity=3):
    """rows: (doc_id, source, leaf); None first, then bytewise. [(doc_id, source, leaf, subroot, root, proof)]"""
    first = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    groups = {}
    for r in sorted(rows, key=lambda r: (first(r[1]), first(r[0]), r[2])):
        groups.setdefault(r[1], []).append(r)
    trees = {s: levels_by_force([r[2] for r in g], arity) for s, g in groups.items()}
    top = levels_by_force([t[-1][0] for t in trees.values()], arity)
    out = []
    for n, (s, g) in enumerate(groups.items()):
        for i, r in enumerate(g):
            out.append((*r, trees[s][-1][0], top[-1][0], path_by_force(trees[s], i, arity) + path_by_force(top, n, arity)))
    return out


def shown(found):
    return [(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["proof"]]) for r in found.collect()]


def order(row):
    return tuple((x is not None, x) for x in row[:3])


@pytest.mark.parametrize("size,range_rows,arity", [(1, 50, 3), (90, 7, 3), (400, 9, 3), (400, 50_000, 3), (300, 8, 2), (130, 1, 4)])
def test_proofs(spark, monkeypatch, size, range_rows, arity):
    monkeypatch.setattr(merkle, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(merkle, "FAN", 3)
    rng = random.Random(size)
    sources = ["hot"] * 20 + [None, "", "Z", "a", "é", "z", "\U0001f600", "￿"] + [f"s{i}" for i in range(12)]
    rows = [(rng.choice([None, rng.randrange(-50, 10_000)]) if i % 9 == 0 else i, rng.choice(sources), digest(str(rng.randrange(size)))) for i in range(size)]
    rows += rows[: size // 4]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(3).withColumns({"_part": F.lit(1), "c0": F.lit("x"), "_Tree": F.lit(None).cast("int")})
    found = merkle.proofs(docs, arity=arity)
    assert [c for c in found.columns] == ["doc_id", "source", "leaf", "_part", "c0", "_Tree", "subroot", "root", "proof"]
    assert sorted(shown(found), key=order) == sorted(by_force(rows, arity), key=order)
    bad = found.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count()
    assert bad == 0
    assert found.filter(merkle.folded(F.sha2(F.lit("x"), 256), F.col("proof")) == F.col("root")).count() == 0
    listed = merkle.manifest(found).collect()
    assert sum(r["rows"] for r in listed) == len(rows) and len({r["root"] for r in listed}) == 1


def test_joining_forests_is_associative():
    rng = random.Random(4)
    sizes = [1, 2, 5, 27, 40]
    nodes = [(t, 0, i, digest(f"{t}.{i}"), i == n - 1) for t, n in enumerate(sizes) for i in range(n)]
    roots = set()
    for _ in range(30):
        parts = [[] for _ in range(6)]
        for n in nodes:
            rng.choice(parts).append(n)
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            forest = merkle.Forest(3, len(sizes))
            for n in [*a, *b]:
                forest.add(*n)
            list(forest.resolve())
            parts.append(forest.left())
        assert len(parts[0]) == 1
        roots.add(parts[0][0][3])
    assert len(roots) == 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, leaf string")
    assert merkle.proofs(docs.filter("doc_id > 1")).count() == 0
    one = merkle.proofs(docs).first()
    assert one["subroot"] == one["root"] == "x" and one["proof"] == []
    with pytest.raises(ValueError):
        merkle.proofs(docs.withColumn("Root", F.lit(1)))
    values = spark.createDataFrame([(1, None, "é\n"), (None, 2, "")], "a long, b int, c string").select(merkle.leaf("a", "b", "c").alias("h")).collect()
    assert [r["h"] for r in values] == [digest("1:1-3:é\n"), digest("-1:20:")]
    long = spark.createDataFrame([("x" * 3_000_000,)], "t string").select(merkle.leaf("t").alias("h")).first()["h"]
    assert long == digest("3000000:" + "x" * 3_000_000)
