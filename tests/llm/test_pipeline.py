from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from sparkscope.llm import near_duplicates, registry, secrets

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in registry.QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_pipeline_against_its_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = {r.doc_id for r in registry.QUERIES["op3_quality_classifier"](spark, SF).filter("kept").collect()}
    assert set(out) <= kept
    hit = {r.doc_id for r in registry.QUERIES["op10_benchmark_decontamination"](spark, SF).filter("contaminated").collect()}
    assert not set(out) & hit
    near = {r.doc_id: r.component_id for r in registry.QUERIES["op6_minhash_near_dedup"](spark, SF).collect()}
    assert len({near[i] for i in out}) == len(out)
    scanner = secrets.Scanner(secrets.Rules())
    for r in docs.collect():
        if r.doc_id in out:
            text = secrets.masked(r.text, scanner.scan(r.text)[1], "[SECRET]") if r.text else r.text
            assert out[r.doc_id].text == text and out[r.doc_id].decoded == text and out[r.doc_id].n_chars == len(text)


def test_near_duplicates_stage_links_at_80(spark):
    texts = []
    for g in range(40):  # 56 windows of five words, and a copy with up to 19 more
        base = [f"g{g}w{i}" for i in range(60)]
        texts += [base, base + [f"more{i}" for i in range(g % 20)]]
    docs = spark.createDataFrame([(i, " ".join(t), 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    gone = {i for i in range(1, len(texts), 2) if 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1])}
    assert any(100 * len(sets[i] & sets[i - 1]) < 85 * len(sets[i] | sets[i - 1]) for i in gone) and len(gone) < 40
    out = {r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, SF).collect()}
    assert out == set(range(len(texts))) - gone


def test_bands_follow_percent():
    assert near_duplicates.bands_and_rows(85) == (48, 7)
    for percent in range(5, 101, 5):
        bands, rows = near_duplicates.bands_and_rows(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-8


def test_stages_with_odd_rows_and_names(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    rows = [(9001, None, "en", "s", 0), (9002, "", None, None, None), (None, "only one text without an id", "en", "s", 5), (9003, "token=abcdef123456 and more", "en", "s", 3)]
    odd = good.unionByName(spark.createDataFrame(rows, good.schema))
    odd = odd.unionByName(odd.filter("doc_id = 9003"))
    extra = {"_before": F.lit("mine"), "_QUALITY": F.lit("also mine"), "id": F.lit("x"), "print": F.lit(1), "component_id": F.lit(7), "_own_before": F.lit(None).cast("string")}
    odd = odd.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        added = {"token_ids", "n_tokens", "decoded"} if name == "tokens" else set()
        assert set(out.columns) == set(odd.columns) | added, name
        got = out.collect()
        assert got and {(r._before, r._QUALITY, r.id, r.print, r.component_id, r._own_before) for r in got} == {("mine", "also mine", "x", 1, 7, None)}, name
        if name in ("secrets", "tokens"):
            assert len(got) == odd.count()
        if name == "secrets":
            assert [(r.text, r.n_chars) for r in got if r.doc_id == 9003] == [("[SECRET] and more", 17)] * 2
        assert stage(spark, odd.filter("doc_id = -5"), SF).count() == 0, name
