"""The engine over a small tree: indexing, refresh, questions; and the rules behind it."""

from __future__ import annotations

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from sparkscope import cli
from sparkscope.engine import Engine, normal_path
from sparkscope.functions import paths, stemmer
from sparkscope.functions import text as T
from sparkscope.operators import graph, grams, jobs, ranking, targets, upkeep, vectors
from sparkscope.plans import catalogue
from sparkscope.sources import extract, tree

FILES = {
    "pkg/__init__.py": "",
    "pkg/store.py": "import os\n\n\nclass Store:\n    def delete_rows(self, confirmed=False):\n        '''Delete all rows.'''\n        self.session.delete(1)\n        helper('--yes')\n\n\ndef helper(x):\n    return os.remove(x)\n",
    "pkg/login.py": "from pkg.store import Store\n\n\ndef loginAdmin(user):\n    Store().delete_rows(True)\n    return helper(user)\n",
    "tests/test_store.py": "def test_delete():\n    delete_rows()\n",
    "web/app.js": "function store(){ db.upsert(point); }\n",
    ".env": "SECRET=1\n",
    ".gitignore": "*.tmp\nbuild/\n!keep.tmp\n",
    "x.tmp": "x",
    "keep.tmp": "x",
    "build/out.py": "x = 1\n",
    "data.bin2": "\0\1\2",
    "run": "#!/usr/bin/env python\nprint(1)\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_text(text)
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.register(str(root), "demo")
    e.root = root
    e.first = e.refresh("demo")
    return e


def ask(engine, text):
    return engine.spark.createDataFrame([(0, "demo", text)], "query_id long, repo string, text string")


def test_index_and_audit(engine):
    assert engine.first["ok"] and engine.first["added"] == 7
    audit = {r["path"]: (r["decision"], r["reason"]) for r in engine.table("path_audit").collect()}
    assert audit[".env"] == ("exclude", "env_file") and audit["x.tmp"] == ("exclude", "gitignored") and audit["build/out.py"] == ("exclude", "gitignored")
    assert audit["keep.tmp"] == ("exclude", "cache_file") and audit["data.bin2"] == ("exclude", "binary_sample")
    assert audit["pkg/__init__.py"][0] == "include" and audit["run"] == ("include", "known_source_or_language")


def test_find_search_open_explore(engine):
    found = engine.find(ask(engine, "delete_rows")).orderBy("rank").collect()
    assert found[0]["symbol"] == "pkg.store.Store.delete_rows" and found[0]["score"] == 105
    top = engine.search(ask(engine, "admin logins")).orderBy("final_rank").first()
    assert top["symbol"] == "pkg.login.loginAdmin" and top["result_id"] == "r_01"
    shown = engine.open(engine.spark.createDataFrame([(0, "demo", "helper"), (1, "demo", "nothing?"), (2, "demo", "pkg/")], "ask_id long, repo string, target string"))
    shown = {r["ask_id"]: r for r in shown.collect()}
    assert shown[0]["status"] == "ok" and shown[0]["lines"][2] == "def helper(x):" and shown[1]["status"] == "not_found" and shown[2]["type"] == "module"
    blocks, blast = engine.explore(ask(engine, "delete rows"))
    assert "pkg.store.Store.delete_rows" in {r["symbol_ref"] for r in blocks.collect()}
    called = {r["name"]: r for r in blast.collect()}["delete_rows"]
    assert called["callers"] == ["pkg.login.loginAdmin"] and called["tests"] == ["tests.test_store.test_delete"]


def test_lines_handles_and_folders(engine, capsys):
    first = engine.search(ask(engine, "admin logins")).orderBy("final_rank").collect()
    assert (first[0]["line_start"], first[0]["line_end"]) == (4, 6)
    engine.remember("demo", [r.asDict() for r in first])
    rows = [(0, "demo", "r_01"), (1, "demo", "pkg"), (2, "other", "r_01")]
    got = {r["ask_id"]: r for r in engine.open(engine.spark.createDataFrame(rows, "ask_id long, repo string, target string")).collect()}
    assert got[0]["step"] == 1 and got[0]["symbol_ref"] == "pkg.login.loginAdmin" and "helper" in got[0]["callees"] and got[2]["status"] == "not_found"
    assert got[1]["lines"][0] == "pkg/__init__.py: " and got[1]["lines"][1] == "pkg/login.py: pkg.login.loginAdmin" and len(got[1]["lines"]) == 3
    assert cli.smoke()["ok"]


def test_explore_says_what_is_stale_or_cut(engine):
    text = (engine.root / "pkg/store.py").read_text()
    (engine.root / "pkg/store.py").write_text(text + "# more\n")
    try:
        blocks = engine.explore(ask(engine, "delete rows"), check_stale=True)[0].collect()
    finally:
        (engine.root / "pkg/store.py").write_text(text)
    assert all((b["body"] is None) == (b["path"] == "pkg/store.py") == b["stale"] for b in blocks) and any(b["stale"] for b in blocks)
    assert any(b["flags"] and "destructive_delete" in b["flags"] for b in blocks)


def test_jobs(engine):
    kinds = {(r["target_type"], r["job_type"], r["status"]) for r in engine.table("jobs").collect()}
    assert kinds == {(t, "embedding", "done") for t in ("symbol", "file", "module")}
    assert {r["target_type"] for r in engine.table("vectors").collect()} == {"symbol", "file", "module"}
    engine.refresh("demo", full=True, enrich=True)
    assert engine.embed()["reason"] == "enrichment_pending"

    def generate(prompt, model):
        if "path_prefix: tests" in prompt:
            raise ValueError("too long")
        return {"summary": "zebra crossing", "exact_terms": ["x"]} if prompt.startswith("path: ") else {"exact_terms": ["x"]}

    done = engine.enrich(generate)
    assert done["errors"] == 1 and not done["interrupted"] and done["may_embed"]
    assert engine.embed()["processed"] > 0 and engine.table("jobs").filter("job_type = 'embedding' AND status <> 'done'").isEmpty()
    assert engine.search(ask(engine, "zebra")).count() > 0
    outputs = engine.table("model_outputs").collect()
    assert {r["rejected_reason"] for r in outputs} == {None, "no_accepted_fields"} and not any("exact_terms" in r["json_text"] for r in outputs if r["accepted"])
    status = {r["status"]: r["count"] for r in engine.queue()["jobs"] if r["job_type"] == "module_enrichment"}
    assert status["error"] == 1

    def away(prompt, model):
        raise OSError("Connection refused")

    assert engine.enrich(away)["interrupted"]
    engine.refresh("demo", full=True)


def test_embedding_jobs_wait_for_a_service_that_is_away(engine):
    embedder, before = engine.embedder, engine.table("vectors").count()

    def away(texts):
        raise OSError("Connection refused")

    try:
        engine.embedder = away
        assert engine.refresh("demo", full=True)["ok"]
        waiting = engine.table("jobs").filter("status = 'pending' AND attempts = 0").count()
        assert waiting == before == engine.table("jobs").count() and engine.search(ask(engine, "delete rows")).count() > 0
        assert engine.embed() == {"ok": True, "processed": 0, "errors": 0, "interrupted": True}
    finally:
        engine.embedder = embedder
    assert engine.embed(limit=3)["processed"] == 3 and engine.table("vectors").count() == 3
    assert engine.embed()["processed"] == before - 3 and engine.embed()["processed"] == 0
    assert engine.table("vectors").count() == before and {r["status"] for r in engine.table("jobs").collect()} == {"done"}


def test_calls_of_embedding_jobs(spark):
    """At most 32 texts of one model and repository a call, errors for each text alone, no limit and no single task."""
    names = [c.split()[0] for c in jobs.JOB.split(", ")]
    rows = [(r, "file", i, "embedding", f"m{i % 2}", "pending", 250, "h", 1, 0, None, None if i == 5 else f"{r}-m{i % 2}" if i != 7 else "bad") for r in ("a", "b") for i in range(150)]
    todo = spark.createDataFrame(rows, jobs.JOB + ", text string")

    def embedder(texts):
        if "bad" in texts:
            raise ValueError("too long")
        return [[float(len(texts)), float(len(set(texts) - {""}))] for _ in texts]

    got = jobs.embed(jobs.runnable(todo.select(names), False).join(todo.select("repo", "target_id", "text"), ["repo", "target_id"]), embedder).collect()
    assert len(got) == 300 and {(r.target_id, r.error) for r in got if r.status != "done"} == {(7, "too long")}
    assert all(r.vector[0] <= 32 and r.vector[1] <= 1 for r in got if r.vector) and max(r.vector[0] for r in got if r.vector) > 8
    assert {r.attempts for r in got} == {1}
    plan = jobs.dealt(jobs.runnable(todo, False))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan and "rangepartitioning" in plan


def test_postings_follow_a_refresh(engine):
    (engine.root / "pkg/extra.py").write_text("def quokka():\n    return helper(1)\n")
    engine.refresh("demo")
    assert engine.search(ask(engine, "quokka")).orderBy("final_rank").first()["symbol"] == "pkg.extra.quokka"
    os.remove(engine.root / "pkg/extra.py")
    engine.refresh("demo")
    state = lambda: [sorted(map(str, t.collect())) for t in (engine.index().postings.select("doc", "term", "tf"), engine.table("fts_docs").select("target_id", "text", "dl"))]
    before = state()
    assert "quokka" not in str(before)
    engine.refresh("demo", full=True)
    assert state() == before


def test_delete_and_reset(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    for repo in ("a", "b"):
        os.makedirs(tmp_path / repo)
        (tmp_path / repo / "m.py").write_text(f"def only_{repo}():\n    pass\n")
        e.register(str(tmp_path / repo), repo)
        e.refresh(repo)
    e.delete_repo("a")
    assert {r["repo"] for n in ("files", "symbols", "jobs", "fts_docs", "vectors") for r in e.table(n).collect()} == {"b"} and list(e.repos()) == ["b"]
    assert not e.index().postings.filter("term = 'a'").count() and e.vacuum()["ok"]
    assert e.reset()["ok"] and e.repos() == {} and e.table("files") is None


def test_settings():
    from sparkscope.settings import Settings

    got = Settings.from_env({"SPARKSCOPE_RESULT_LIMIT": "7", "SPARKSCOPE_EMBED_BATCH": "x", "SPARKSCOPE_RESPECT_GITIGNORE": "no"})
    assert (got.result_limit, got.embed_batch, got.respect_gitignore) == (7, 32, False)


def test_flags(engine):
    flags = {(r["name"], r["flag"]) for r in engine.table("heuristic_flags").join(engine.table("symbols"), "symbol_id").collect()}
    assert {("delete_rows", "destructive_delete"), ("delete_rows", "confirmation_gate"), ("helper", "filesystem_access")} <= flags


def test_refresh_is_incremental_and_equals_a_rebuild(engine):
    (engine.root / "pkg/login.py").write_text(FILES["pkg/login.py"] + "\n\ndef logout():\n    pass\n")
    os.remove(engine.root / "web/app.js")
    assert [r["path"] for r in engine.stale("demo").collect()] == ["pkg/login.py"]
    done = engine.refresh("demo")
    assert (done["added"], done["changed"], done["deleted"], done["unchanged"]) == (0, 1, 1, 5)
    state = lambda: {t: sorted(map(str, engine.table(t).collect())) for t in ("files", "symbols", "symbol_calls", "heuristic_flags", "vectors", "modules")}
    before = state()
    engine.refresh("demo", full=True)
    assert state() == before
    engine.rule("demo", "tests", "dir", "exclude")
    assert engine.table("files").filter(F.col("path").startswith("tests/")).count() == 0
    engine.rule("demo", "tests", "dir", "exclude", remove=True)
    assert engine.table("files").filter(F.col("path").startswith("tests/")).count() == 1


def test_paths_and_ignore_rules():
    assert normal_path("/a\\b/./c/") == "a/b/c"
    with pytest.raises(ValueError):
        normal_path("a/../b")
    rules = tree.IgnoreRules([("", "*.log"), ("", "/top"), ("", "a/**/z"), ("sub", "only/"), ("", "!keep.log"), ("", "# no")])
    wanted = {"x/y.log": True, "keep.log": False, "top": True, "x/top": False, "a/b/c/z": True, "a/z": True, "sub/only/f": True, "only/f": False, "sub/only": False}
    assert {p: rules.ignores(p) for p in wanted} == wanted


def test_ignore_rules_as_a_join(spark):
    import random

    rng = random.Random(6)
    patterns = ["*.log", "/top", "a/**/z", "only/", "!keep.log", "# no", "**", "a?", "!a/b/", "b", "/a/*", "x y", "[z].(+)", "**/c/", "", "!**/z"]
    names = ["a", "b", "c", "z", "ab", "x y", "keep.log", "q.log", "only", "top", "[z].(+)", "é"]
    lines = [(rng.choice(["", "a", "a/b", "c"]), p) for p in patterns * 2]
    paths = ["/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate([*paths, None, "", paths[0]])], "_n long, path string").withColumn("ignored", F.lit("old"))
    for chosen in (lines, lines[:5], [x for x in lines if x[1] != "**"], []):
        rules = tree.IgnoreRules(chosen)
        found = tree.match_rules(spark, frame, rules)
        assert found.columns == ["_n", "path", "ignored"] and "Python" not in found._jdf.queryExecution().toString()
        got = {r["_n"]: (r["path"], r["ignored"]) for r in found.collect()}
        assert len(got) == 403 and all(bad == bool(p and rules.ignores(p)) for p, bad in got.values()), chosen


@pytest.mark.parametrize("language", sorted(cli.SMOKE))
def test_extractors(language):
    path, text, symbol, call = cli.SMOKE[language]
    found = extract.extract(text, path, language).symbols
    assert symbol in [s.name for s in found]
    assert call is None or call in [c[0] for s in found for c in s.calls]
    assert not [s.name for s in found if "here" in s.name or "ghost" in s.name]


def test_extractors_take_broken_and_short_code():
    broken = extract.extract("def half(:\n    log.write()\n", "b.py", "python").symbols
    assert broken[0].name == "half" and broken[0].calls[0][0] == "log.write"
    arrow = extract.extract("const pick = async (a) => choose(a);\n", "p.js", "javascript").symbols
    assert arrow[0].name == "pick" and arrow[0].calls[0][0] == "choose"


def test_extractors_take_linear_time():
    import ast
    import time

    make = {
        "python": lambda i: f"def f{i}(a):\n    x = b.c{i}('é', 'q')\n    return g(x, {i})\n",
        "javascript": lambda i: f"class A{i} {{ go(x) {{ db.put{i}(x, 'y'); }} }}\nfunction f{i}() {{ return h(1); }}\n",
        "html": lambda i: f"<p class='x'>\n<b>{i}</b>\n",
        "lua": lambda i: f"function f{i}()\n  if a then b.c(1) end\nend\n",
    }
    for language, of in make.items():
        took = []
        for n in (1_000, 8_000):
            text = "".join(map(of, range(n)))
            start = time.perf_counter()
            found = extract.extract(text, "x", language)
            took.append(time.perf_counter() - start)
            assert language == "html" and len(found.facts) == 2 * n or len(found.symbols) >= n
        assert took[1] < 20 * took[0] + 0.5, (language, took)
    methods = [(s.qualified_name, [c[0] for c in s.calls]) for s in extract.extract("class A { b(x) { db.put(x); } }\n", "a.js", "javascript").symbols]
    assert methods == [("A", ["db.put"]), ("A.b", ["db.put"])]
    text = "@d(1)\ndef é(a):\r\n    s = 'ü' + f(a,\n        b)\n"
    source = extract.Source(text)
    for node in ast.walk(ast.parse(text)):
        if hasattr(node, "lineno"):
            assert source.of(node) == ast.get_source_segment(text, node)


def test_stems_match_a_full_text_engine():
    words = "caresses ponies retries retried running hopping hoping relational conditional valency digitizer radically vietnamization operator feudalism decisiveness callousness formality sensitivity triplicate formative electrical hopefulness revival allowance inference airliner adjustable defensible replacement adjustment dependent adoption communism activate effective rate cease controlling roll happy sky agreed plastered motoring conflated troubled sized falling hissing fizzed failing filing by university über".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    for w in words:
        db.execute("INSERT INTO t VALUES (?)", (w,))
    theirs = dict(db.execute("SELECT doc, term FROM v").fetchall())
    assert [stemmer.porter(stemmer.plain(w)) for w in words] == [theirs[i + 1] for i in range(len(words))]


def test_small_rules(spark):
    one = spark.range(1)
    parts = lambda x: one.select(T.subwords(F.lit(x))).first()[0]
    assert parts("HTTPServer2") == ["HTTP", "Server", "2"] and parts("loginAdmin") == ["login", "Admin"] and parts("MAX_SIZE") == ["MAX", "SIZE"]
    is_test = lambda p, s: one.select(T.is_test(F.lit(p), F.lit(s))).first()[0]
    assert is_test("tests/a.py", None) and is_test("a_test.go", "") and is_test("x.spec.ts", "") and is_test("a.py", "pkg.FooTest.bar")
    assert not is_test("latest.py", "") and not is_test("a.py", "pkg.TestFoo.bar")
    score = lambda t, v: one.select(T.match_score(F.lit(t), F.lit(v))).first()[0]
    assert [score("ab", v) for v in ("AB", "abc", "xab", "x", "")] == [100, 60, 30, 0, 0]
    assert one.select(T.lines(F.lit("a\r\nb\x0cc\n"))).first()[0] == ["a", "b", "c"]
    kinds = {"a.log": "log", ".env.dev": "config", "a.tar": "archive", "x/build/a.py": "generated", "a.min.js": "generated", "README": "config", "a.md": "docs", "a": "unknown"}
    rows = spark.createDataFrame([(p,) for p in kinds], "path string").select("path", paths.kind_of(F.col("path")).alias("k")).collect()
    assert {r["path"]: r["k"] for r in rows} == kinds
    sizes = spark.createDataFrame([(1, i, s) for i, s in enumerate([50, 10, 10, 10])], "query_id int, position int, size long")
    assert ranking.within_budget(sizes, F.lit(20)).count() == 1 and ranking.within_budget(sizes, F.lit(70)).count() == 3
    jobs = spark.createDataFrame([("m", "t", s) for s in ("done", "done", "error")], "model string, job_type string, status string")
    assert upkeep.queue_summary(jobs).first()["percent_done"] == 66.7
    v = [[1.0, 0.0], [0.95, 0.31], [0.8, 0.6], [0.0, 0.0]]
    members = spark.createDataFrame([(0, i, i, x, i == 1) for i, x in enumerate(v)], "query_id int, id int, position int, vector array<double>, protected boolean")
    assert [tuple(r) for r in vectors.families(members, 0.9, 2).collect()] == [(0, 2, 0)]
    assert graph.CALLERS == 6


def test_names_that_hold_a_token(spark, tmp_path):
    rows = [(i, f"A{i}b_Name{i}", f"q.{i}", None) for i in range(40)] + [(100, "b", "", None), (101, None, "é漢字x", None), (102, "aa", "aaa", None), (103, "aa", "aaa", None)]
    table = spark.createDataFrame(rows, "id long, x string, y string, name string")
    tokens = ["NAME1", "b", "q.", "5", "zz", "é漢", "字x", "漢字X", "aa", "AAA", "aaaa", "me12", "", None, "%", "a1b_name1"]
    asked = spark.createDataFrame([(t,) for t in tokens] * 2, "token string")
    names = grams.different((table, ["x", "y"]))
    assert names.count() == 40 * 2 + 4
    grams.write(names, str(tmp_path / "names"))
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    want = sorted({(i, t) for i, x, y, _ in rows for t in tokens if t and (low(t) in low(x or "") or low(t) in low(y or ""))})
    for known in (grams.index(names), grams.read(spark, str(tmp_path / "names"))):
        hits = grams.lookup(asked, known)
        got = grams.holding(table, ["x", "y"], hits)
        assert got.columns == [*table.columns, "token"]
        assert sorted({(r["id"], r["token"]) for r in got.collect()}) == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert grams.lookup(asked, grams.index(names.limit(0))).count() == 0 and grams.lookup(asked.limit(0), grams.index(names)).count() == 0


def test_find_and_resolve_have_no_nested_loops(engine):
    asked = engine.spark.createDataFrame([(0, "demo", "lper")], "ask_id long, repo string, target string")
    plans = [engine.find(ask(engine, "helper")), targets.resolve(asked, engine.table("files"), engine.table("symbols"), engine.table("modules"), None, engine.names())]
    for p in plans:
        text = p._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert plans[1].first()["symbol_ref"] == "pkg.store.helper"


def test_unknown_kinds_find_nothing(engine):
    assert engine.find(ask(engine, "helper"), ("nonsense",)).count() == 0


def test_plain_facts():
    text = "# Title 'ab'\n  #\n#note\n\n key.x: \"some value\"\nno key\n#  \n"
    assert extract.plain_facts(text) == [("heading", "# Title 'ab'", 1, 1), ("string_literal", "ab", 1, 1), ("comment", "#", 2, 2), ("comment", "#note", 3, 3), ("config_key", "key.x", 5, 5), ("string_literal", "some value", 5, 5), ("comment", "#", 7, 7)]
    assert [extract.unquoted(x) for x in (" 'a' ", '"b', "`c`", "''", "'", "d e ")] == ["a", '"b', "c", "", "'", "d e"]


def test_questions_stay_in_their_repository(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    body = "def {0}(x):\n    return purge_all_rows(x)\n"
    # "large" holds 12 symbols nearer to the question than the one of "small", whose words are near, but not the question's.
    for repo, files in {"large": {f"m{i}.py": body.format("purge_rows") for i in range(12)}, "small": {"s.py": "def unrelated(x):\n    return x\n\n\ndef rowPurger(rows):\n    return rows\n"}}.items():
        os.makedirs(tmp_path / repo)
        for path, text in files.items():
            (tmp_path / repo / path).write_text(text)
        e.register(str(tmp_path / repo), repo)
        assert e.refresh(repo)["ok"]
    asked = spark.createDataFrame([(0, "small", "purge rows"), (1, "large", "purge rows")], "query_id long, repo string, text string")
    ranked = e.ranked(asked).collect()
    assert {r["symbol"] for r in ranked if r["query_id"] == 0 and r["vector_rank"] is not None} >= {"s.rowPurger", "s.unrelated"}
    assert sum(r["query_id"] == 1 and r["vector_rank"] is not None for r in ranked) == 10


def test_families_by_each_groups_floor(spark):
    rows = [(q, i, i, [1.0, 0.1 * i], False, floor, least) for q, floor, least in ((0, 0.9, 2), (1, 0.9, 9), (2, 0.99999, 2)) for i in range(4)]
    members = spark.createDataFrame(rows, "query_id long, id long, position long, vector array<double>, protected boolean, floor double, least int")
    out = vectors.families(members, F.col("floor"), F.col("least")).collect()
    assert sorted((r["query_id"], r["id"], r["representative"]) for r in out) == [(0, 1, 0), (0, 2, 0), (0, 3, 0)]


def test_extract_python_takes_all_words(spark, tmp_path):
    import re

    texts = {0: "One two, two THREE", 1: "12 ?", 2: None, 3: " ".join("w" + "abcdefghij"[i // 100] + "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10] for i in range(1000))}
    docs = spark.createDataFrame([(i, t, "src", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["file_id"], r["signature"], r["call_text"]) for r in catalogue.QUERIES["extract_python"](spark, str(tmp_path)).collect()]
    want = [(i, f"def f_{w}(a)", f"store.delete_{w}") for i, t in texts.items() for w in set(re.findall("[a-z]+", (t or "").lower())) or {"x"}]
    assert sorted(got) == sorted(want)
