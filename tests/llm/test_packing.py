"""Packing against the tokenizer library and the rules of power-of-two pieces."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkscope.llm import common, packing, vocabulary
from test_operators import EDGES, frame, prose

PATH = vocabulary.public_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
DEFINITION = open(PATH, encoding="utf-8").read()
HARD = ["<|endoftext|>a <|endoftext|>", "a\x1c!b", "it's we'll  've", "  x \n\ny", "😀 naïve​", "ⅷ² ʰ中文。", "a\r\n b\t c", "x" * 3000 + "!" * 700 + " " * 900 + "y"]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def packed(spark, docs, **more):
    target = common.fresh_path(spark, "test-packed")
    packing.pack(docs, target, PATH, **more)
    return packing.read(spark, target)


@pytest.mark.parametrize("chunk", [5, 4000])
def test_encoder_equals_the_library(monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    rng, encoder = random.Random(3), packing.Encoder(DEFINITION, True)
    parts = list("ab Z'sre  \n\t,.1é中。Я²\x1c​ ") + ["<|endoftext|>", " word", "'ll", "ème", "\r\n", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + HARD + [prose(3000)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text)[:-1], text


def test_faster_engine_only_where_it_is_the_same():
    parsed = json.loads(DEFINITION)
    assert packing.by_rank(parsed) is not None
    # A token that no listed merge leads to in its own text.
    parsed["model"]["merges"] = [["a", "b"], ["b", "c"], ["a", "bc"]]
    chars = {c: i for i, c in enumerate(sorted(k for k in parsed["model"]["vocab"] if len(k) == 1))}
    parsed["model"]["vocab"] = {**chars, "ab": 300, "bc": 301, "abc": 302}
    assert packing.by_rank(parsed) is None
    assert not packing.cuts_bytes({**parsed, "normalizer": {"type": "NFC"}})


def test_lengths():
    for longest in (1, 8, 1024):
        for n in (1, 7, 8, 1023, 1024, 1025, 5000):
            found = packing.lengths_of(n, longest)
            assert sum(found) == n and found == sorted(found, reverse=True) and all(x <= longest and x & (x - 1) == 0 for x in found)
            assert all(found.count(x) == 1 for x in set(found) - {longest})


def test_packing(spark):
    texts = [*EDGES, *HARD, prose(900), prose(900), prose(5000)]
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("no id")}))
    pieces = packed(spark, docs, longest=64)
    rows = packing.digests(pieces).collect()
    stored = {r["sequence_id"]: r["token_ids"] for r in pieces.collect()}
    assert len(stored) == len(rows), "every sequence has an id of its own"
    whole = {}
    for r in rows:
        ids = stored[r["sequence_id"]]
        assert len(ids) == r["length"] <= 64 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        whole.setdefault(r["doc_id"], []).append((r["start"], r["doc_tokens"], ids))
    want = dict(enumerate(texts)) | {None: "no id"}
    assert set(whole) == set(want)
    for doc_id, parts in whole.items():
        ids = ids_of(want[doc_id])
        times = 2 if doc_id == 3 else 1
        assert all(total == len(ids) for _, total, _ in parts)
        assert sorted((s, x) for s, _, x in parts) == sorted((s, ids[s : s + len(x)]) for s, _, x in parts)
        assert sum(len(x) for _, _, x in parts) == times * len(ids)


def test_packing_edges(spark):
    empty = packed(spark, frame(spark, ["a"]).filter("doc_id > 5"))
    assert empty.count() == 0 and packing.digests(empty).columns[-1] == "ids_crc32"
    named = frame(spark, ["a b"]).withColumnsRenamed({"doc_id": "length_id", "text": "start"}).withColumn("length", F.lit("x"))
    target = common.fresh_path(spark, "test-packed")
    packing.pack(named, target, PATH, id_col="length_id", text_col="start")
    assert packing.read(spark, target, id_col="length_id").count() == 2
    bucket = packing.read(spark, target, id_col="length_id").filter("length = 2")
    assert bucket.count() == 1 and "PartitionFilters: [isnotnull(length" in bucket._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        packing.pack(named, target, PATH, longest=100)
