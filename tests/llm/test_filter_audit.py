"""The filter audit against every order walked document by document."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sparkscope.llm import filter_audit
from test_operators import EDGES, prose

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def fails(text):
    text = text or ""
    words = WORD.findall(text)
    upper = sum("A" <= c <= "Z" for c in text)
    return {f for f, bad in zip("ABCD", (len(words) < 200, len(set(words)) * 100 < len(words) * 50, upper * 100 > len(text) * 2, re.search(r"[#$%&*|]", text))) if bad}


def by_force(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    out = Counter()
    rows = []
    for doc_id, text, source in docs:
        bad = fails(text)
        if doc_id is not None and any(o is not None and o < doc_id and (t or "") == (text or "") for o, t, _ in docs):
            bad.add("E")
        own = [x for x in labels if x[0] == doc_id and doc_id is not None]
        rows.append((source or "", bad, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    for part in {r[0] for r in rows}:
        for order in filter_audit.ORDERS:
            for step, f in enumerate(order, 1):
                key = part, order, step
                for p, bad, good, toxic in rows:
                    if p != part:
                        continue
                    before = bad & set(order[: step - 1])
                    out[key, "kept"] += not before and f not in bad
                    here = f in bad and not before
                    out[key, "removed"] += here
                    out[key, "redundant"] += f in bad and bool(before)
                    out[key, "unique_fails"] += bad == {f}
                    out[key, "good_lost"] += here and good
                    out[key, "toxic_lost"] += here and toxic
                    out[part, f] += here
    keys = {k[0] for k in out if isinstance(k[0], tuple)}
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*k, *[int(out[k, c]) for c in counts], int(out[k[0], k[1][k[2] - 1]])) for k in keys)


def test_audit(spark):
    rng = random.Random(2)
    texts = [*EDGES, prose(250), prose(250) + " # ", "Ab cD " * 150, "word " * 300, " ".join(f"w{i}" for i in range(400)), "\x0bé\x1c " * 120, "a b " * 210, "$" + "\U0001f600 " * 200, "A" * 3 + "a" * 147, "A" * 3 + "a" * 146]
    docs = [(i, t, rng.choice(["hot", "hot", "hot", None, "", "é"])) for i, t in enumerate(texts)]
    docs += [(100 + i, texts[i % 12], "hot") for i in range(30)] + [(3, texts[3], "é"), (3, texts[3], "é"), (None, texts[9], "hot"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"part": F.lit(1), "Mask": F.lit("x"), "digest": F.lit(2)}).repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"source": F.lit("x"), "good": F.lit(1)})
    found = filter_audit.audit(frame, said)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == by_force(docs, labels)
    assert filter_audit.audit(frame.filter("doc_id > 1000"), said).count() == 0
    alone = filter_audit.audit(frame.filter("doc_id = 1"), said.limit(0))
    assert alone.count() == 600 and alone.agg(F.sum("good_lost")).first()[0] == 0


def test_inversion_is_exact(spark):
    rng = random.Random(8)
    rows = [("p", m, False, False, rng.choice([1, 7, 10**12])) for m in rng.sample(range(32), 20)] + [("q", 31, True, False, 3)]
    found = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean, n long")
    got = {r["part"]: list(r["every"]) for r in filter_audit.histograms(found).collect()}
    for part in "pq":
        assert got[part] == [sum(r[4] for r in rows if r[0] == part and r[1] == m) for m in range(32)]


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "word and " * 300_000, "s"), (2, "word and " * 300_000, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, labels).collect()}
    assert rows["EABCD", 1]["removed"] == 1 and rows["EABCD", 3]["removed"] == 1 and rows["BEACD", 2]["redundant"] == 1
