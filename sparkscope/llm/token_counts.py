"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are produced."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkscope.llm import common
from sparkscope.llm.vocabulary import WordUnits, load

#: Bytes that the counts of units kept by a Python worker take, about.
CACHE_BYTES = 48_000_000
_caches: dict = {}


def merge_count(unit: str, score: dict[str, float]) -> int:
    """Tokens of one unit: symbols at first (characters, or bytes of characters without a piece) minus merges.

    The symbols form a linked list over start positions: ``end[i]`` is where the symbol that starts at ``i`` ends (0
    once it has been merged into its left neighbour), ``before[i]`` where its left neighbour starts. The heap holds
    adjacent pairs as (negative score, start, end); the best score goes first, of equal scores the leftmost. A pair
    is stale if its symbols have changed since.
    """
    n = len(unit)
    symbols = 0
    for c in unit:
        symbols += 1 if c in score else len(c.encode())
    if n < 2:
        return symbols
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        s = score.get(unit[i : i + 2])
        if s is not None:
            heap.append((-s, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue
        end[i], end[j] = e, 0
        symbols -= 1
        p = before[i]
        if p >= 0:
            s = score.get(unit[p:e])
            if s is not None:
                heapq.heappush(heap, (-s, p, e))
        if e < n:
            before[e] = i
            s = score.get(unit[i : end[e]])
            if s is not None:
                heapq.heappush(heap, (-s, i, end[e]))
    return symbols


class _Counts(dict):
    """Counts by key of ``WordUnits``; filled as keys are asked for."""

    def __init__(self, score: dict[str, float]):
        super().__init__()
        self.score, self.held = score, 0

    def __missing__(self, key: str) -> int:
        found = self[key] = merge_count(WordUnits.unit(key), self.score)
        self.held += 160 + 4 * len(key)
        return found

    def bound(self) -> None:
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0


def count_text(text: str | None, counts: _Counts) -> int:
    if not text:
        return 0
    found = sum(map(counts.__getitem__, WordUnits.cut(text)))
    counts.bound()
    return found


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit for every row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens. Rows are counted one by one, so repeated rows and ids stay; an
    empty table gives no rows; other columns are not read. The vocabulary (its size is checked) is broadcast. No
    shuffle: a lost executor costs its running tasks.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(load(model_path).normal())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _caches.get(model_path)
        if counts is None:
            counts = _caches[model_path] = _Counts(shared.value)
        for batch in batches:
            n = [count_text(t.as_py(), counts) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), common.utf8_length(docs[text_col]).alias("n_bytes"), docs[text_col].alias("text"))
    return rows.mapInArrow(common.lean(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
