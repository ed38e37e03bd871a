"""Segments against a plain model of the same changes; what a refresh writes."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkscope.engine import Engine
from sparkscope.sources import files as stored
from sparkscope.sources.segments import Kept, Store, run_to_merge

KEPT = {"rows": Kept("row", ("id", "kind"), hidden=("note",)), "more": Kept("row", ("id", "kind"), folders=("part",), order=("v",)), "terms": Kept()}


def test_runs():
    assert run_to_merge([]) == 0 and run_to_merge([5]) == 0 and run_to_merge([5, 5, 5]) == 0
    assert run_to_merge([1000, 5, 5, 5, 5]) == 4 and run_to_merge([14, 5, 5, 5, 5]) == 5
    sizes, rewritten = [], 0
    for _ in range(300):
        sizes.append(1)
        n = run_to_merge(sizes)
        if n:
            rewritten += sum(sizes[-n:])
            sizes[-n:] = [sum(sizes[-n:])]
    assert len(sizes) < 12 and rewritten < 300 * 12, "few segments, and a row is rewritten a few times"


def counted(rows):
    return Counter() if rows is None else Counter(map(tuple, rows.select("repo", "id", "kind", "v").collect()))


def content(store, repos=None):
    return counted(store.table("rows", repos))


def test_changes_equal_a_model(spark, tmp_path):
    rng = random.Random(3)
    store, model = Store(spark, str(tmp_path / "s"), KEPT), Counter()
    assert store.table("rows") is None
    for step in range(9):
        repo = "a" if step % 3 else "r=é %/x"
        keys = [(rng.randrange(25), rng.choice(["x", None])) for _ in range(rng.choice([0, 3, 12]))]
        rows = [(i, k, f"{step}", "n") for i, k in keys for _ in range(rng.choice([0, 1, 2]))]
        change = store.begin(repo)
        change.kill(row=spark.createDataFrame([k for k in keys if k[1]] or [], "id long, kind string"))
        added = spark.createDataFrame(rows, "id long, kind string, v string, note string")
        change.add(rows=added, more=added.drop("note").withColumn("part", (F.col("id") % 3).cast("int")), terms=added.select("v").distinct())
        assert content(store) == model, "nothing is seen before the commit"
        model = Counter({r: n for r, n in model.items() if not (r[0] == repo and r[2] and (r[1], r[2]) in keys)}) + Counter((repo, i, k, v) for i, k, v, _ in rows)
        assert counted(change.table("rows")) == Counter({r: n for r, n in model.items() if r[0] == repo})
        change.commit()
        assert content(store) == model and content(store, ["a"]) == Counter({r: n for r, n in model.items() if r[0] == "a"})
        assert counted(store.table("more")) == model
    assert store.table("rows").columns == ["repo", "id", "kind", "v"]
    assert {r["v"] for r in store.table("terms").collect()} >= {r[3] for r in model}
    manifest = store.manifest("a")
    assert len(manifest["tables"]["rows"]) < 5, "segments were merged"

    # What an interrupted change leaves is not seen, and goes with the next one.
    left = store.begin("a")
    left.add(rows=spark.createDataFrame([(99, "x", "lost", "n")], "id long, kind string, v string, note string"))
    assert content(store) == model and os.path.exists(store.path("rows", "a", left.seq))
    change = store.begin("a")
    change.commit()
    assert not os.path.exists(store.path("rows", "a", left.seq)) and content(store) == model

    for repo in store.repos():
        store.begin(repo).compact()
        store.begin(repo).commit()
        manifest = store.manifest(repo)
        assert all(len(s) <= 1 for s in manifest["tables"].values()) and not any(manifest["dead"].values())
        assert len(stored.names(spark, os.path.dirname(store.path("rows", repo, 0)))) <= 1
    assert content(store) == model
    store.drop("a")
    assert content(store) == Counter({r: n for r, n in model.items() if r[0] != "a"}) and store.repos() == ["r=é %/x"]


def test_many_tombstones_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sparkscope.sources.segments.MOST_DEAD", 2)
    store = Store(spark, str(tmp_path / "s"), {"rows": Kept("row", ("id",))})
    first = store.begin("a")
    first.add(rows=spark.range(2000).withColumn("v", F.sha2(F.col("id").cast("string"), 256)))
    first.commit()
    for i in range(5):
        change = store.begin("a")
        change.kill(row=spark.createDataFrame([(i,), (5000 + i,)], "id long"))
        change.add(rows=spark.createDataFrame([(5000 + i, "new")], "id long, v string"))
        change.commit()
    assert len(store.manifest("a")["dead"]["row"]) <= 2
    found = store.table("rows")
    assert found.count() == 2000 and found.filter("id < 5").count() == 0 and found.filter("v = 'new'").count() == 5


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for i in range(60):
        folder = root / f"p{i % 20}"
        folder.mkdir(exist_ok=True)
        (folder / f"m{i}.py").write_text("".join(f"def part_{i}_{j}(value):\n    store.delete_rows(value)\n    return helper_{j % 7}(value, 'text {i} {j}')\n\n\n" for j in range(25)))
    engine = Engine(spark, str(tmp_path_factory.mktemp("store")))
    engine.register(str(root), "tree")
    engine.refresh("tree")
    return engine, root


STATE = {"files": "sha256", "symbols": "symbol_ref", "symbol_calls": "call_text", "symbol_literals": "value", "file_facts": "value", "heuristic_flags": "flag", "modules": "file_ids", "vectors": "vector", "path_audit": "decision", "fts_docs": "text", "postings": "term"}


def state(engine):
    return {t: sorted(map(str, engine.table(t).collect())) for t in STATE}


def rows_of(engine, after=0):
    """Rows of every table in segments younger than ``after``."""
    return {n: sum(s[2] for s in segments if s[0] > after) for n, segments in engine.tables.manifest("tree")["tables"].items()}


def test_a_refresh_writes_what_has_changed(tree):
    engine, root = tree
    whole, last = rows_of(engine), engine.tables.manifest("tree")["seq"]
    size = stored.size(engine.spark, engine.store)
    (root / "p3" / "m3.py").write_text("def only_one(value):\n    return helper_1(value)\n")
    os.remove(root / "p4" / "m4.py")
    done = engine.refresh("tree")
    assert (done["changed"], done["deleted"], done["unchanged"]) == (1, 1, 58)
    wrote = rows_of(engine, last)
    assert wrote["files"] == 1 and wrote["symbols"] == 1 and wrote["path_audit"] == 1 and wrote["modules"] == 2
    assert wrote["fts_docs"] == 4 and wrote["vectors"] == 4, "a file, its symbol and two modules"
    assert wrote["postings"] < 0.1 * whole["postings"] and sum(wrote.values()) < 0.1 * sum(whole.values())
    grown = stored.size(engine.spark, engine.store) - size
    assert grown < 0.5 * size, "a segment of one row is some kilobytes, whatever its rows"
    assert not [n for n in stored.names(engine.spark, engine.store) if n.startswith("_work-")]
    before = state(engine)
    assert len(before["files"]) == 59
    engine.refresh("tree", full=True)
    assert state(engine) == before, "the same as a rebuild"
    engine.vacuum()
    assert state(engine) == before and all(len(s) <= 1 for s in engine.tables.manifest("tree")["tables"].values())
    assert engine.refresh("tree") | {"unchanged": 59} == {"ok": True, "repo": "tree", "added": 0, "changed": 0, "deleted": 0, "unchanged": 59, "modules_changed": 0}
