import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkscope.operators import block_max, lexical

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(60)]


def text(n):
    return " ".join(RNG.choices(WORDS, weights=[1 / (i + 1) for i in range(len(WORDS))], k=n))


@pytest.fixture(scope="module")
def corpus():
    texts = [text(int(math.exp(RNG.uniform(0, 6)))) for _ in range(1500)] + [None, "", "w3", "w3"]
    return dict(enumerate(texts))


def by_force(corpus, words, k):
    words = [w for w in words if any(w in (t or "").split() for t in corpus.values())]
    counts = {d: Counter((t or "").split()) for d, t in corpus.items()}
    mean = sum(c.total() for c in counts.values()) / len(corpus)
    df = {w: sum(w in c for c in counts.values()) for w in words}
    scored = []
    for d, c in counts.items():
        s = [max(math.log((len(corpus) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in words if c[w]]
        if s:
            scored.append((round(-sum(s), 9), d))
    return [d for _, d in sorted(scored)[:k]]


def test_top_equals_scoring_everything_and_skips_blocks(spark, corpus, tmp_path):
    docs = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    posted, dl = lexical.postings(docs, "doc_id", F.col("text")), lexical.lengths(docs, "doc_id", F.col("text"))
    block_max.write(posted, dl, f"{tmp_path}/blocks", size=16)
    index = block_max.read(spark, f"{tmp_path}/blocks")
    asked = ["w0", "w7 w7 w40", "w3", "w55 w20 w1 w0", "w0 w1 w2 w3 w4 w5", "nowhere", "nowhere w59", ""]
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    for k in (1, 5, 3000):
        got = block_max.top(questions, index, k, first=3).collect()
        for q, words in enumerate(asked):
            mine = sorted((round(r.score, 9), r.doc) for r in got if r.query_id == q)
            assert [d for _, d in mine] == by_force(corpus, words.split(), k), (k, words)
    work = {r.query_id: r for r in block_max.work(questions, index, 5, first=3).collect()}
    assert work[0].blocks > 80 and work[0].scored < work[0].blocks / 2, work
    assert sum(r.scored for r in work.values()) < 0.8 * sum(r.blocks for r in work.values()), work
    assert set(work) == {q for q, words in enumerate(asked) if words and words != "nowhere"}
    every = {r.query_id: r for r in block_max.work(questions, index, 3000, first=3).collect()}
    assert all(r.scored == r.blocks for r in every.values())


def test_rows_are_bounded_and_empty_tables_are_answered(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    posted, dl = lexical.postings(docs, "doc_id", F.col("text")), lexical.lengths(docs, "doc_id", F.col("text"))
    block_max.write(posted, dl, f"{tmp_path}/hot", size=50)
    hot = block_max.read(spark, f"{tmp_path}/hot")
    most = hot.entries.agg(F.max(F.size("entries")), F.count("*")).first()
    assert most[0] < 100 and most[1] == 300
    question = spark.createDataFrame([(1, "same words")], "query_id long, text string")
    assert [r.doc for r in block_max.top(question, hot, 3).orderBy("doc").collect()] == [0, 1, 2]
    block_max.write(posted.limit(0), dl.limit(0), f"{tmp_path}/none")
    assert block_max.top(question, block_max.read(spark, f"{tmp_path}/none"), 3).count() == 0
