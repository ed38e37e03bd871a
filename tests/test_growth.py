"""What lets queries grow with their input: work dealt out to all cores, bounded batches, reduction before shuffles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkscope.operators import block_max, grams, graph, lexical, ranking, targets, vectors
from sparkscope.plans import catalogue
from sparkscope.plans import relations as R
from sparkscope.plans import stored
from sparkscope.sources import extract


def shuffled(spark, run):
    """(result, records written to shuffles while ``run`` was at work)."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return run(), total() - before


NESTED = "import os\n\nclass A:\n    @d(1)\n    def f(self):\n        if x:\n            def g(): return h('q')\n        try: pass\n        except E:\n            def i(): pass\n        match y:\n            case 1:\n                def j(): k.l(2)\n\nasync def m():\n    for n in o:\n        class P: pass\n"


def test_symbols_without_facts_are_the_same():
    whole, bare = extract.extract(NESTED, "a/b.py", "python"), extract.extract(NESTED, "a/b.py", "python", facts=False)
    assert [s.qualified_name for s in whole.symbols] == ["A", "A.f", "A.g", "A.i", "A.j", "m", "P"]
    assert bare.symbols == whole.symbols and whole.facts and not bare.facts


def test_extracted_rows_are_handed_over_in_batches(spark, monkeypatch):
    monkeypatch.setattr(extract, "BATCH", 3)
    rows = [("r", i, "a/b.py", "python", NESTED if i % 2 else None) for i in range(20)]
    files = spark.createDataFrame(rows, "repo string, file_id long, path string, language string, text string").coalesce(1)
    got = extract.extract_files(files, facts=False, fields=("name", "calls"))
    assert got.columns == ["repo", "file_id", "path", "language", "parse_errors", "symbols"]
    found = {r["file_id"]: [s["name"] for s in r["symbols"]] for r in got.collect()}
    assert found == {i: ["A", "f", "g", "i", "j", "m", "P"] if i % 2 else [] for i in range(20)}


PLAIN = "def f(a):\n    return b.c(a, 1)\n\ndef g(): pass\n"
#: Texts that can be cut before definitions, and texts that can't.
APART = ["", "\n", PLAIN, PLAIN.strip(), f"import os\n{PLAIN}{PLAIN}", "def f(): h(1); g('x', 2.5)\n\n\n# end", f"{NESTED}def last(): return z(1)(2)\n", PLAIN.replace("\n", "\r\n"), "\n\ndef f():\n    'doc'\n    def g(): return x.y(True)\n    return g", "class A:\n  x: int = 1\ndef f[T](a: T = q(3), *b, c=d(4), **e) -> r(5): ..."]
WHOLE = ["x = '\'\'\ndef f(): pass\n\'\'\'\ndef g(): pass\n", '"""\ndef f(): pass\n"""\ndef g(): pass\n', "@d\ndef f(): pass\n", "def f(): pass\n@d(1)\ndef g(): pass\n", "x = (1,\ndef f(): pass\n", "x = 1\n\\\ndef f(): g()\n", "def f(): pass\n\x0cdef g(): h()\n\ndef i(): pass\n", "def f():\rdef g(): pass\n", "from __future__ import x\ndef f(): pass\n", "def f(:\n  g()\ndef h(): pass\n", "if x:\ndef f(): pass\n", "def f(): return 1\u2028\ndef g(): h()\n", "def f(): pass\0\ndef g(): pass"]


@pytest.mark.parametrize("path", ["a/b.py", "__init__.py"])
def test_blocks_of_python_texts_are_the_whole_text(path):
    leaves = tuple(extract._leaves(tuple(extract.KINDS)))
    for text in APART * 2 + WHOLE:
        out = [["kept"] for _ in leaves]
        n, whole = extract.python_blocks(text, path, leaves, out), extract.python(text, path, facts=False)
        assert (n is None) == (text in WHOLE), text
        assert n in (None, len(whole.symbols)) and (n is None or not whole.errors)
        assert [x[1:] for x in out] == [list(x) if n is not None else [] for x in extract._columns(whole.symbols, leaves)], text


def test_blocks_that_differ_in_names_only(monkeypatch):
    shapes = ["def A(B):\n    return C.A_B(B)\n", "def A(): B(C(1)); C(B(2)); A()\n", "async def A(B, *, C=1.5): await B.C(A)(C % B)['x']\n", "def A():\n  x = {B: C(1), 2: 1.5}\n  def B(): return C(3 % A)\n  match B:\n    case C.A: pass\n    case _: A(True)\n", "def A(B: C) -> B: return [B(C) for C in A if not B is C.C]\n", "def A(): return 1.B\n", "def A(): return 1if B(1)else C\n", "def A(): # B\n  return f'{C()}'\n", "def A(): return 0zq1q + B\n", "class X:\n  @A\n  def B(C): C()\n"]
    names = ["x", "zq1q", "match", "type", "_", "e5", "nöt", "__debug__", "if", "True", "j", "aa", "zz"]
    rng, leaves = random.Random(7), tuple(extract._leaves(tuple(extract.KINDS)))
    for _ in range(150):
        made = {k: rng.choice(names) for k in "ABC"}
        text = "".join(re.sub(r"[ABC](?![a-z])", lambda m: made[m[0]], x) for x in rng.choices(shapes, k=rng.choice((1, 1, 2))))
        out = [[] for _ in leaves]
        n, whole = extract.python_blocks(text, "a/b.py", leaves, out), extract.python(text, "a/b.py", facts=False)
        assert n == (None if whole.errors else len(whole.symbols)) and (n is None or out == [list(x) for x in extract._columns(whole.symbols, leaves)]), text
    parsed, parse = [], extract.ast.parse
    monkeypatch.setattr(extract.ast, "parse", lambda *a, **b: parsed.append(a) or parse(*a, **b))
    text = "".join(f"def f_{i}(a):\n    return other.delete_{i}(a + 77)\n" for i in range(200))
    assert extract.python_blocks(text, "b.py", leaves, [[] for _ in leaves]) == 200 and len(parsed) == 1


def test_repeated_blocks_are_parsed_once(monkeypatch):
    parsed, parse = [], extract.ast.parse
    monkeypatch.setattr(extract.ast, "parse", lambda *a, **b: parsed.append(a) or parse(*a, **b))
    leaves, out = ("name", "calls", "calls.call_text"), [[], [], []]
    for i in range(100):
        assert extract.python_blocks(f"def repeated_{i % 3}(): return f({i % 3})\n" * 20, f"p{i}.py", leaves, out) == 20
    assert len(parsed) == 3 and out[0][:21] == ["repeated_0"] * 20 + ["repeated_1"] and out[2][-1] == "f" and len(out[2]) == 2000


def test_parts_of_calls_and_literals_can_be_named(spark):
    rows = [(1, "python", PLAIN), (2, "python", "@d\n" + PLAIN), (3, "javascript", "function f() { g(1) }"), (4, "python", None), (5, "python", "def f(:")]
    files = spark.createDataFrame([("r", i, "a/b.py", k, t) for i, k, t in rows], "repo string, file_id long, path string, language string, text string")
    whole = extract.extract_files(files).select("file_id", "parse_errors", F.expr("transform(symbols, s -> struct(s.symbol_ref, s.line_start, transform(s.calls, c -> struct(c.call_text)) as calls, transform(s.literals, l -> struct(l.value, l.line_end)) as literals)) as symbols"))
    parts = extract.extract_files(files, facts=False, fields=("symbol_ref", "line_start", "calls.call_text", "literals.value", "literals.line_end")).select(whole.columns)
    assert parts.schema["symbols"].dataType.elementType.names == ["symbol_ref", "line_start", "calls", "literals"]
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))


def test_extract_python_is_dealt_out(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("src").alias("source"), F.lit("en").alias("lang"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.QUERIES["extract_python"](spark, str(tmp_path))
    assert found.select(F.spark_partition_id().alias("p"), "file_id").distinct().groupBy("p").count().count() > 1


def test_callers_of_many_targets_with_one_name(spark):
    n = 600
    symbols = spark.range(n).select(F.col("id").alias("symbol_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("repo"), F.lit("the").alias("name"), (-F.col("id")).alias("ord"))
    calls = spark.range(n).select(F.col("id").alias("symbol_id"), F.explode(F.array(F.lit("the"), F.lit("self.The"), F.lit("the"))).alias("call_text")).withColumn("function_name", F.substring_index("call_text", ".", -1))
    seeds = symbols.select("repo", "symbol_id", "name")
    got, records = shuffled(spark, lambda: [tuple(r) for r in graph.callers(seeds, calls, symbols, 4).select("symbol_id", "n", "caller").collect()])
    want = []
    for i in range(n):
        same = [j for j in range(n - 1, -1, -1) if j != i and (j % 3 == 0) == (i % 3 == 0)][:4]
        want += [(i, k, j) for k, j in enumerate(same)]
    assert sorted(got) == sorted(want)
    assert records < 40 * n


@pytest.mark.parametrize("prefix, stem", [(False, False), (True, False), (True, True)])
def test_best_is_the_top_of_bm25(spark, tmp_path, monkeypatch, prefix, stem):
    rng, some = random.Random(3), "run running runs runner retry retried retrying a an and andes the then".split()
    texts = [" ".join(rng.choices(some, k=rng.randint(0, 9))) for _ in range(120)] + ["run the"] * 40 + [None]
    docs = spark.createDataFrame([(i % 150, t) for i, t in enumerate(texts)], "doc_id long, text string")  # 11 ids are repeated
    posted, dl = lexical.postings(docs, "doc_id", F.col("text")), lexical.lengths(docs, "doc_id", F.col("text"))
    lexical.write_index(posted, dl, str(tmp_path / "index"))
    index = lexical.read_index(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "run the run"), (2, "an"), (3, "zzz"), (4, "retrying"), (5, "then zzz and")], "query_id long, text string")
    order = [F.round("score", 9), F.col("doc")]
    read = lambda df: sorted((r["query_id"], r["doc"], round(r["score"], 9)) for r in df.collect())
    whole = lexical.bm25(asked, lexical.stemmed(posted) if stem else posted, dl, prefix, stem)
    want = read(lexical.top(whole, 3, order))
    monkeypatch.setattr(lexical, "GROUP_DOCS", 20)
    assert want and read(lexical.best(asked, index, 3, prefix, stem)) == want
    monkeypatch.setattr(lexical, "MOST_WORDS", 2)
    assert read(lexical.best(asked, index, 3, prefix, stem)) == want


def test_questions_that_share_words_do_not_multiply_postings(spark, tmp_path):
    docs = spark.range(500).select("id", F.lit("the of").alias("text"))
    lexical.write_index(lexical.postings(docs, "id", F.col("text")), lexical.lengths(docs, "id", F.col("text")), str(tmp_path / "index"))
    index, asked = lexical.read_index(spark, str(tmp_path / "index")), spark.range(300).select(F.col("id").alias("query_id"), F.lit("the of").alias("text"))
    rows, records = shuffled(spark, lambda: lexical.best(asked, index, 2).count())
    assert rows == 600 and records < 20_000


def test_find_works_out_whole_rows_of_the_first_only(spark):
    n, long = 300, "the " * 500
    files = spark.range(n).select(F.lit("r").alias("repo"), F.col("id").alias("file_id"), F.format_string("p%04d", "id").alias("path"), F.lit(1).cast("long").alias("line_count"))
    symbols = spark.range(n).select(F.lit("r").alias("repo"), F.col("id").alias("symbol_id"), F.col("id").alias("file_id"), *[F.lit("x").alias(c) for c in ("name", "qualified_name", "symbol_ref", "signature")], F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    calls = spark.range(n).select(F.col("id").alias("symbol_id"), F.explode(F.array(F.lit("a.the"), F.lit("the"))).alias("call_text"), F.lit("the").alias("function_name"), (F.col("id") + 5).alias("line_start"))
    literals = spark.range(n).filter("id % 2 = 1").select(F.col("id").alias("symbol_id"), F.lit(long).alias("value"), F.lit(1).cast("long").alias("line_start"))
    asked = spark.createDataFrame([(1, "r", "the"), (2, "r", "The"), (3, "q", "the")], "query_id long, repo string, text string")
    got = sorted((r["query_id"], r["rank"], r["target_id"], r["score"], r["why"]) for r in ranking.find(asked, files, symbols, calls, literals, ("call", "literal"), limit=4).collect())
    assert got == [(q, i, i, 100, "call site: a.the") for q in (1, 2) for i in range(4)]
    got = sorted((r["query_id"], r["rank"], r["target_id"], r["score"]) for r in ranking.find(asked, files, symbols, calls, literals, ("literal",), limit=4).collect())
    assert got == [(q, i, 2 * i + 1, 50) for q in (1, 2) for i in range(4)]
    plan = ranking.find(asked, files, symbols, calls, literals, ("call",), limit=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "near-1" in plan or plan.count("LeftSemi") >= 2


def some_code(spark, n, seed=11):
    """(rows, tables) of files, symbols, calls and literals with names of a few letters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aAbcé", k=rng.randint(0, 4)))
    files = [("rs"[i % 2], i, f"p{rng.randint(0, 9)}/{i}", 100) for i in range(n)]
    symbols = [("rs"[i % 2], i, i, word() or None, word(), f"{word()}.{i}", "sig", 1, 2) for i in range(n)]
    calls = [(i, rng.choice(("", "self.")) + w, rng.choice((w, w, None, "")), rng.randint(1, 5)) for i in range(n) for w in [word() for _ in range(3)]]
    literals = [(i, rng.choice((word() * 3, None)), rng.randint(1, 5)) for i in range(0, n, 2)]
    rows = files, symbols, calls, literals
    kinds = "repo string, file_id long, path string, line_count int", "repo string, symbol_id long, file_id long, name string, qualified_name string, symbol_ref string, signature string, line_start int, line_end int", "symbol_id long, call_text string, function_name string, line_start int", "symbol_id long, value string, line_start int"
    return rows, [spark.createDataFrame(r, k) for r, k in zip(rows, kinds)]


@pytest.mark.parametrize("ahead, limit, kinds", [(2, 3, ("symbol", "call", "literal", "path")), (10, 3, ("call",)), (1, 40, ("symbol", "call"))])
def test_find_in_rounds_is_the_plain_result(spark, tmp_path, monkeypatch, ahead, limit, kinds):
    (files, symbols, calls, literals), tables = some_code(spark, 60)
    tokens = ["a", "AB", "abc", "s", "self.", "é", "É", "f.a", "zz", "p1/", "aa", "elf", "1", "bcab"]
    asked = [(i, "rsq"[i % 3], t) for i, t in enumerate(t for t in tokens for _ in range(3))] + [(99, "r", None), (98, "s", " "), (97, None, "a")]
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    score = lambda t, v: 0 if not v else 100 if v.lower() == t.lower() else 60 if v.lower().startswith(t.lower()) else 30 if t.lower() in v.lower() else 0
    want = []
    for q, repo, t in asked:
        if not (t or "").strip() or not repo:
            continue
        found, held = {}, lambda *names: any(low(t) in low(x) for x in names)
        rows = [(i, score(t, a) + 5, 0, 0, "", "definition", "symbol") for _, i, _, a, b, c, *_ in symbols if held(a, b, c)] * ("symbol" in kinds)
        rows += [(i, score(t, f or c), 1, line, c, f"call site: {c}", "symbol") for i, c, f, line in calls if held(c, f)] * ("call" in kinds)
        rows += [(i, score(t, v) - 10, 2, line, v, f"literal: {v}", "symbol") for i, v, line in literals if held(v)] * ("literal" in kinds)
        rows += [(i, score(t, p), 3, 0, "", "path", "file") for _, i, p, _ in files if held(p)] * ("path" in kinds)
        for i, points, *order, why, record in rows:
            if files[i][0] == repo:
                found[record, i] = min(found.get((record, i), (1000,)), (-points, *order, why))
        ranked = sorted((v[0], v[1], files[i][2], i, record, v[-1]) for (record, i), v in found.items())[:limit]
        want += [(q, n, record, i, -m, why) for n, (m, _, _, i, record, why) in enumerate(ranked)]
    monkeypatch.setattr(ranking, "AHEAD", ahead)
    questions = spark.createDataFrame(asked, "query_id long, repo string, text string")
    for names in (None, lambda kind: grams.index(grams.different(({"symbol": tables[1], "call": tables[2], "literal": tables[3], "path": tables[0]}[kind], {"symbol": ranking.SYMBOL_NAMES, "call": ranking.CALL_NAMES, "literal": ranking.LITERAL_NAMES, "path": ranking.PATH_NAMES}[kind])))):
        got = ranking.find(questions, *tables, kinds, limit, names).select("query_id", "rank", "record_type", "target_id", "score", "why").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_find_shuffles_what_it_finds_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranking, "AHEAD", 32, raising=False)
    n, each = 500, 60
    files = spark.range(n).select(F.lit("r").alias("repo"), F.col("id").alias("file_id"), F.format_string("p%04d", "id").alias("path"), F.lit(1).cast("long").alias("line_count"))
    symbols = files.select("repo", F.col("file_id").alias("symbol_id"), "file_id", *[F.lit("x").alias(c) for c in ("name", "qualified_name", "symbol_ref", "signature")], F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    calls = spark.range(n * each).select((F.col("id") % n).alias("symbol_id"), F.concat(F.lit("self.w"), F.col("id") % 5000).alias("call_text"), F.concat(F.lit("w"), F.col("id") % 5000).alias("function_name"), F.lit(1).alias("line_start"))
    calls.write.parquet(str(tmp_path / "calls"))
    calls, literals = spark.read.parquet(str(tmp_path / "calls")), symbols.select("symbol_id", F.col("name").alias("value"), "line_start").limit(0)
    grams.write(grams.different((calls, ranking.CALL_NAMES)), str(tmp_path / "names"))
    asked = spark.createDataFrame([(1, "r", "w7"), (2, "r", "w"), (3, "r", "4999"), (4, "r", "lf")], "query_id long, repo string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with names that are too many for it
    try:
        got, records = shuffled(spark, lambda: ranking.find(asked, files, symbols, calls, literals, ("call",), names=grams.read(spark, str(tmp_path / "names"))).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [sum(r["query_id"] == q for r in got) for q in (1, 2, 3, 4)] == [10, 10, 1, 10]
    assert records < 2 * n * each  # one pass of the two names of each row


@pytest.mark.parametrize("shared", [False, True])
def test_resolve_is_the_plain_result(spark, shared):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(1, 3)))
    files = [("rs"[i % 2], i, f"{word()}/{i}.x", 90) for i in range(60)]
    symbols = [(repo, i, i, word(), f"q.{word()}", f"{word()}.module_{i}.{word()}", "sig", 1, 2, -i) for repo, i, *_ in files]
    modules = [(repo, i, f"d{i}") for i, repo in enumerate("rs" * 3)]
    targets_of = [s[3] for s in symbols[:20]] + [s[5] for s in symbols[20:26]] + [f[2] for f in files[26:32]] + ["d1/", "d2", "module_", "module_11", "odule_7.", ".module_4", "q.ab", "Q.A", "zz", "", None, "b", "a", "1"]
    asks = [(n // 2 if shared else n, rng.choice("rs"), t) for n, t in enumerate(targets_of)] + [(500, None, "a"), (501, "r", "a")]
    low = lambda t: t.lower()
    want = []
    for ask in sorted({a[0] for a in asks}):
        found = []
        for _, repo, t in [a for a in asks if a[0] == ask and a[1] and a[2]]:
            own = [s for s in symbols if s[0] == repo]
            row = lambda s: ("symbol", s[1], files[s[1]][2], s[5], 1, 2)
            found += [(2, (s[9], s[1]), row(s)) for s in own if s[5] == t]
            found += [(3, (f[2], f[1]), ("file", f[1], f[2], None, 1, 80)) for f in files if f[0] == repo and f[2] == t]
            found += [(4, (m[2], m[1]), ("module", m[1], m[2], None, 1, 1)) for m in modules if m[0] == repo and m[2] == t.rstrip("/")]
            found += [(5, (files[s[1]][2], 1, s[1]), row(s)) for s in own if s[3] == t]
            found += [(6, (len(s[5]), s[5], s[1]), row(s)) for s in own if low(t) in low(s[5]) or low(t) in low(s[4])]
        first = min((f[0] for f in found), default=None)
        kept = sorted({f for f in found if f[0] == first} if first == 6 else [f for f in found if f[0] == first], key=lambda f: f[1])[: {5: None, 6: 6}.get(first, 1)]
        status = "not_found" if not kept else "ambiguous" if len(kept) > 1 and first >= 5 else "ok"
        want += [(ask, status, first, n, *f[2]) for n, f in enumerate(kept, 1)] or [(ask, status, *[None] * 8)]
    tables = [spark.createDataFrame(*x) for x in ((asks, "ask_id long, repo string, target string"), (files, "repo string, file_id long, path string, line_count int"), (symbols, "repo string, symbol_id long, file_id long, name string, qualified_name string, symbol_ref string, signature string, line_start int, line_end int, ord long"), (modules, "repo string, module_id long, path_prefix string"))]
    got = {tuple(r) for r in targets.resolve(*tables).collect()}
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_resolve_shuffles_no_row_for_each_question_and_symbol(spark):
    n = 1200
    files = spark.range(n).select(F.lit("r").alias("repo"), F.col("id").alias("file_id"), F.format_string("p/%04d", "id").alias("path"), F.lit(1).alias("line_count"))
    symbols = files.select("repo", F.col("file_id").alias("symbol_id"), "file_id", F.lit("the").alias("name"), F.lit("q.the").alias("qualified_name"), F.format_string("src.word.%07d", "file_id").alias("symbol_ref"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.col("file_id").alias("ord"))
    asked = spark.range(200).select(F.col("id").alias("ask_id"), F.lit("r").alias("repo"), F.when(F.col("id") % 2 == 0, "the").otherwise(F.format_string("rd.%07d", "id")).alias("target"))
    modules = files.select("repo", F.lit(1).alias("module_id"), F.lit("p").alias("path_prefix")).limit(1)
    got, records = shuffled(spark, lambda: targets.resolve(asked, files, symbols, modules).groupBy("step", "status").count().collect())
    assert sorted(map(tuple, got)) == [(5, "ambiguous", 100 * n), (6, "ok", 100)]
    assert records < 40 * n


def test_nearest_by_blocks_is_the_plain_result(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)] + [(90 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(30)]
    rows += [(120, None), (121, [0.0] * 4), (122, [1.0, None, 0.0, 0.0]), (123, [1.0, 1.0]), (124, [])]
    table = spark.createDataFrame(rows, "target_id long, vector array<float>")
    asked = table.filter("target_id % 9 = 0 or target_id > 119").select(F.col("target_id").alias("query_id"), F.col("vector").alias("query_vector"))
    order = [F.desc(F.round("cosine", 9)), F.asc("target_id")]
    read = lambda df: sorted((r["query_id"], r["rank"], r["target_id"], r["cosine"] and round(r["cosine"], 9)) for r in df.collect())
    want = read(lexical.top(vectors._single_scores(asked, table, []), 5, order))
    monkeypatch.setattr(vectors, "BLOCK", 16)
    got = read(vectors.nearest(asked, table, 5))
    assert got == want, ([x for x in got if x not in want][:4], [x for x in want if x not in got][:4], len(got), len(want))
    assert "MapInArrow" in vectors.nearest(asked, table, 5)._jdf.queryExecution().analyzed().toString()


def test_candidates_and_seeds_are_worked_out_once(spark):
    for name in ("explore", "rrf_fuse", "search_ranked", "relevance_gate"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroups" not in plan and "MapInArrow" not in plan, name


def test_lengths_need_no_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A b,c"), (2, None), (3, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(R._built)
    assert sorted(tuple(r) for r in catalogue.QUERIES["fts_doc_len"](spark, str(tmp_path)).collect()) == [(1, 3), (2, 0), (3, 0)]
    assert set(R._built) == before


def test_snippets_are_cut_where_texts_lie(spark):
    rows = [(1, "a b c d e f"), (2, None), (3, "x y b c x x x b c"), (4, "b c"), (4, "z b")]
    docs = spark.createDataFrame(rows, "id long, text string")
    plain = lexical.snippets(docs.filter("id < 4"), "id", F.col("text"), F.array(F.lit("b"), F.lit("C")), 3)
    assert {r["doc"]: r["snippet"] for r in plain.collect()} == {1: "a [b] [c]...", 2: "", 3: "...y [b] [c]..."}
    assert "Window" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert lexical.snippets(docs, "id", F.col("text"), F.array(F.lit("b")), 3).filter("doc = 4").count() > 0


def test_evidence_of_all_is_the_evidence_of_each_pair(spark):
    asked = spark.createDataFrame([(1, "r", "a_b the the"), (2, "r", ""), (3, "q", "x:y"), (4, "r", None)], "query_id long, repo string, query string")
    symbols = spark.createDataFrame([("r", 1, "The.a", "p", None), ("r", 2, None, None, None), ("q", 3, "x", "y_", "z")], "repo string, symbol_id long, symbol string, path string, why string")
    want = asked.join(symbols, "repo").select("query_id", "symbol_id", ranking.evidence(F.col("query"), F.col("symbol"), F.col("path"), F.col("why")).alias("e"))
    read = lambda df: sorted(tuple(r) for r in df.collect())
    assert read(ranking.evidence_of_all(asked, symbols)) == read(want)


def test_names_of_one_kind_are_indexed_alone(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Alpha beta gammagamma", "en", "s")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["name"] for r in stored.names(spark, str(tmp_path), "literal").names.collect()] == ["gammagamma"]
    assert [r["name"] for r in stored.names(spark, str(tmp_path), "path").names.collect()] == ["src/s/doc_1.txt"]


def test_blocks_shuffle_each_text_once_and_no_postings_by_question(spark, tmp_path):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghijklmnop", k=60))) for i in range(400)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(i, " ".join(rng.choices("abcdefghijklmnop", k=60))) for i in range(30)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows, records = shuffled(spark, lambda: catalogue.QUERIES["bm25_block_topk"](spark, str(tmp_path)).count())
    assert rows == 3000  # 300 questions of words in nearly every document, and some 6,400 postings
    assert records < 13_000  # the first ten of each question and group several times over


@pytest.mark.parametrize("group, batch", [(10_000, 10_000), (40, 7)])
def test_blocks_of_odd_ids_equal_the_sql(spark, tmp_path, monkeypatch, group, batch):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(block_max, "GROUP_DOCS", group)
    monkeypatch.setattr(block_max, "MOST_WORDS", batch)
    rng, some = random.Random(4), [f"w{i}" for i in range(25)]
    texts = [" ".join(rng.choices(some, weights=range(1, 26), k=rng.choice((0, 1, 3, 12, 150)))) for _ in range(600)]
    # 40 ids are there twice with other texts, one is null; some texts are null, and a tenth are copies.
    rows = [(None if i == 77 else i % 560, None if i % 50 == 9 else texts[i // 10 if i % 10 == 3 else i]) for i in range(600)] + [(None, "w0 w1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(i, " ".join(rng.choices([*some, "unknown"], k=11))) for i in range(8)] + [(8, "unknown"), (9, None), (10, "w3 w3 w3 w4")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {name} AS SELECT *{', 1 AS n_chars' * (name == 'documents')} FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(base.execute(catalogue.ORACLES["bm25_block_topk"]).fetchall())
    got = sorted(tuple(r) for r in catalogue.QUERIES["bm25_block_topk"](spark, str(tmp_path)).collect())
    assert len(want) > 100 and got == want


def test_blocks_are_sorted_by_term_and_bounded(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "x " * i) for i in range(20)] + [("none", None)], "id string, text string")
    block_max.write_documents(docs, "id", "text", str(tmp_path / "blocks"), size=4)
    found = block_max.read(spark, str(tmp_path / "blocks"))
    rows = [(r["term"], r["n"], [e["dl"] for e in r["entries"]]) for r in found.entries.orderBy("block").collect()]
    assert [sorted(lengths) for _, _, lengths in rows] == [[1, 2], [3, 4, 5, 6], [7, 8, 9, 10], [11, 12, 13, 14], [15, 16, 17, 18], [19]]
    assert [n for _, n, _ in rows] == [2, 4, 4, 4, 4, 1] and found.vocabulary.first()["df"] == 19
    asked = spark.createDataFrame([("q", "x y")], "query_id string, text string")
    assert [r["doc"] for r in block_max.top(asked, found, 2).orderBy("score", "doc").collect()] == ["d19", "d18"]
    block_max.write_documents(docs.filter("id = 'none'"), "id", "text", str(tmp_path / "none"))
    assert block_max.top(asked, block_max.read(spark, str(tmp_path / "none")), 2).count() == 0
