"""Vector search by cells: vectors are stored by their nearest centroid, and a question reads the cells that can matter.

Centroids are fitted on a bounded sample; every vector is stored. The nearest ``probes`` cells of each question are
scored exactly; how many that are is measured when the index is written, for a wanted recall. In exact mode the k-th best cosine so far then tells which further cells may hold a better vector: no
member of a cell lies nearer to a question than the angle to the centroid less the cell's radius.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscope.operators import lexical
from sparkscope.operators.sizes import MOST_BYTES
from sparkscope.operators.vectors import BLOCK, firsts, taken, unit
from sparkscope.operators.vectors import nearest as vectors_nearest
from sparkscope.session import ship, written
from sparkscope.sources import files as stored

#: Rows that centroids are fitted on, at most, and cells at most: both bound what the driver and each worker hold.
SAMPLE_ROWS, MOST_CELLS = 10_000, 2048
#: Stored vectors that are asked to measure recall, the neighbours that are looked for, and the share that must be found.
ASKED, NEIGHBOURS, RECALL = 64, 10, 0.95
#: The cell of vectors without a direction; it is always read.
NOWHERE = -1
#: Cells of each question that are scored first; of further ones only what reaches the k-th cosine by then is handed over.
FIRST = 8
ROUNDS, SEED = 12, 7


@dataclass(frozen=True)
class Cells:
    """Stored vectors (target_id, vector, further columns, cell), unit centroids by cell, each cell's radius (an angle) and
    number of vectors, and the number of cells that a question needs for the wanted recall."""

    vectors: DataFrame
    centroids: np.ndarray
    radii: dict[int, float]
    sizes: dict[int, int]
    probes: int = 1


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _sound(vector) -> F.Column:
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))


def fit(vectors: DataFrame, rows: int | None = None, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centroids of about the root of ``rows`` cells by spherical k-means on at most ``sample_rows`` vectors."""
    rows = vectors.count() if rows is None else rows
    if not rows:
        return np.zeros((0, 0))
    # Rows by a hash of themselves: the same sample however the table is dealt out.
    picked = vectors.select("vector").orderBy(F.xxhash64("vector")).limit(sample_rows) if rows > sample_rows else vectors.select("vector")
    x = _unit(np.array([r["vector"] for r in picked.collect()], dtype=np.float64))
    x = x[np.abs(x).sum(axis=1) > 0]
    if not len(x):
        return np.zeros((0, 0))
    count = max(1, min(MOST_CELLS, math.isqrt(rows), len(x)))
    rng = np.random.default_rng(SEED)
    centroids = x[rng.choice(len(x), count, replace=False)]
    for _ in range(ROUNDS):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        empty = np.abs(sums).sum(axis=1) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centroids = _unit(sums)
    return centroids


def write(vectors: DataFrame, path: str, centroids: np.ndarray | None = None) -> None:
    """Store (target_id, vector, further columns) by cell. Null vectors and those with null or non-finite components are
    left out, as a cosine with them says nothing; zero vectors lie in a cell of their own."""
    spark = vectors.sparkSession
    sound = vectors.filter(_sound(F.col("vector")))
    centroids = fit(sound) if centroids is None else centroids
    ship(spark)
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("cell int, angle double")
    def place(column: pd.Series) -> pd.DataFrame:
        x = _unit(np.array(column.tolist(), dtype=np.float64)) if len(column) else np.zeros((0, 0))
        if not len(x) or not len(shared.value):
            return pd.DataFrame({"cell": np.full(len(x), NOWHERE), "angle": np.zeros(len(x))})
        near = x @ shared.value.T
        cell = near.argmax(axis=1)
        angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
        flat = np.abs(x).sum(axis=1) == 0
        return pd.DataFrame({"cell": np.where(flat, NOWHERE, cell), "angle": np.where(flat, 0.0, angle)})

    placed = sound.withColumn("_at", place("vector")).select(*vectors.columns, F.col("_at.cell").alias("cell"), F.col("_at.angle").alias("angle"))
    placed.write.parquet(f"{path}/_placed")
    placed = spark.read.parquet(f"{path}/_placed")
    placed.drop("angle").repartition("cell", F.pmod(F.xxhash64("target_id"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/vectors")
    found = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("size")).collect()  # a row for each cell
    stored.delete(spark, f"{path}/_placed")
    told = {"centroids": centroids.tolist(), "radii": {str(r["cell"]): r["radius"] for r in found}, "sizes": {str(r["cell"]): r["size"] for r in found}, "schema": vectors.schema.jsonValue(), "probes": 1}
    stored.write_text(spark, f"{path}/cells.json", json.dumps(told))
    told["probes"] = probes_for(read(spark, path))
    stored.write_text(spark, f"{path}/cells.json", json.dumps(told))


def probes_for(index: Cells, recall: float = RECALL) -> int:
    """Cells that a question must read for ``recall``: over a sample of stored vectors, in what turn their true neighbours'
    cells come. One pass scores the sample against every vector."""
    if not index.radii:
        return 1
    sample = index.vectors.select("target_id", "vector").orderBy(F.xxhash64("vector", "target_id")).limit(ASKED).collect()
    asked = written(index.vectors.sparkSession.createDataFrame([(r["target_id"], list(r["vector"])) for r in sample], f"query_id {dict(index.vectors.dtypes)['target_id']}, query_vector array<double>"), "asked")  # so that its size is known
    near = vectors_nearest(asked, index.vectors, NEIGHBOURS + 1).filter("query_id <> target_id")
    turns = near.join(index.vectors.select("target_id", "cell"), "target_id").join(_bounds(asked, index), ["query_id", "cell"])
    found = sorted(r["turn"] for r in turns.select("turn").collect())
    return int(found[min(len(found) - 1, math.ceil(recall * len(found)) - 1)]) + 1 if found else 1


def read(spark: SparkSession, path: str) -> Cells:
    told = json.loads(stored.read_text(spark, f"{path}/cells.json"))
    schema = T.StructType([*T.StructType.fromJson(told["schema"]).fields, T.StructField("cell", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path}/vectors") if told["radii"] else spark.createDataFrame([], schema)
    return Cells(rows, np.array(told["centroids"], dtype=np.float64), *[{int(c): r for c, r in told[n].items()} for n in ("radii", "sizes")], told["probes"])


def _known(index: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells with a direction, their centroids and radii."""
    known = np.array([c for c in sorted(index.radii) if c != NOWHERE], dtype=np.int64)
    return known, index.centroids[known] if len(known) else np.zeros((0, 0)), np.array([index.radii[c] for c in known])


def _turns(x: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(turn, bound) of unit vectors and cells, the cell without a direction last."""
    angle = np.arccos(np.clip(x @ centroids.T, -1, 1)) if len(centroids) else np.zeros((len(x), 0))
    bound = np.where(np.abs(x).sum(axis=1, keepdims=True) > 0, np.cos(np.maximum(0, angle - radii)), 0.0)
    turn = np.empty(angle.shape, dtype=np.int64)
    np.put_along_axis(turn, np.argsort(angle, axis=1, kind="stable"), np.arange(angle.shape[1])[None, :], axis=1)
    last = np.zeros((len(x), 1))
    return np.hstack([turn, last.astype(np.int64)]), np.hstack([bound, last])


def _bounds(questions: DataFrame, index: Cells) -> DataFrame:
    """(query_id, cell, turn, bound) of each question and cell: turn 0 is the nearest, bound the largest cosine that a
    member may have. One row for each of a bounded number of cells."""
    spark = questions.sparkSession
    ship(spark)
    shared, nowhere = spark.sparkContext.broadcast(_known(index)), NOWHERE in index.radii

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, centroids, radii = shared.value
        cells = [*known, *[NOWHERE] * nowhere]
        for frame in frames:
            for query_id, vector in zip(frame["query_id"], frame["query_vector"]):
                turn, bound = _turns(_unit(np.array([vector], dtype=np.float64)), centroids, radii)
                yield pd.DataFrame({"query_id": [query_id] * len(cells), "cell": cells, "turn": turn[0, : len(cells)], "bound": bound[0, : len(cells)]})

    kind = dict(questions.dtypes)["query_id"]
    asked = questions.filter(_sound(F.col("query_vector"))).select("query_id", "query_vector")
    return asked.mapInPandas(run, f"query_id {kind}, cell int, turn long, bound double")


def _scored(asked: DataFrame, index: Cells, k: int, wanted: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], within: str | None) -> DataFrame:
    """(query_id, target_id, cosine): for each question (query_id, query_vector, worst) and block of vectors at least the first
    ``k`` of the cells that ``wanted`` tells of (turn, bound, worst), less what lies below ``worst``, by products of matrices.

    Neighbouring cells make blocks of about ``BLOCK`` vectors, and a large cell several; each block meets the blocks of
    questions. A question carries its cells as bits, so there are no rows of questions and cells.
    """
    spark, keys = asked.sparkSession, [within] if within else []
    ship(spark)
    shared = spark.sparkContext.broadcast(_known(index))
    kinds = dict(asked.dtypes)["query_id"], dict(index.vectors.dtypes)["target_id"]

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, centroids, radii = shared.value
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                x = _unit(np.array(part["query_vector"].tolist(), dtype=np.float64))
                chosen = wanted(*_turns(x, centroids, radii), part["worst"].to_numpy(dtype=np.float64)[:, None])
                yield part.assign(cells=[row.tobytes() for row in np.packbits(chosen, axis=1)])

    def cells_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [*shared.value[0], NOWHERE]
        for frame in frames:
            if len(frame):
                bits = np.unpackbits(np.array([np.frombuffer(c, dtype=np.uint8) for c in frame["cells"]]), axis=1)
                yield pd.DataFrame({"cell": [known[i] for i in np.flatnonzero(bits.any(axis=0)) if i < len(known)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = (taken(batch.column(c), i) for c in ("_q", "_v"))
                ids = v.values.field("id")
                turn = np.argsort(np.asarray(ids.to_pylist()), kind="stable")
                cell = v.values.field("cell").to_numpy()[turn]
                bits = np.unpackbits(np.array([np.frombuffer(c, dtype=np.uint8) for c in q.values.field("cells").to_pylist()]), axis=1)
                met = bits[:, np.where(cell == NOWHERE, len(known), np.searchsorted(known, cell))].astype(bool)
                some = np.flatnonzero(met.any(axis=1))
                if not len(some):
                    continue
                qx, vx = unit(q)[some], unit(v)[turn]
                width = min(qx.shape[1], vx.shape[1])
                near = np.clip(qx[:, :width] @ vx[:, :width].T, -1, 1)
                worst = q.values.field("worst").to_numpy(zero_copy_only=False)[some, None]
                near[~met[some] | (near < worst - 1e-8)] = -np.inf
                r, c = firsts(near, k)
                yield pa.RecordBatch.from_arrays([q.values.field("id").take(pa.array(some[r])), ids.take(pa.array(turn[c])), pa.array(near[r, c])], ["query_id", "target_id", "cosine"])

    found = asked.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"), F.coalesce("worst", F.lit(-math.inf)).alias("worst"), *keys)
    marked = written(found.mapInPandas(mark, T.StructType([*found.schema.fields, T.StructField("cells", T.BinaryType())])), "marked")
    cells = sorted({r["cell"] for r in marked.mapInPandas(cells_of, "cell int").distinct().collect()} & set(index.sizes))
    blocks, at, room = [], -1, 0
    for c in cells:
        size = index.sizes[c]
        if size > room:
            first, at, room = at + 1, at + -(-size // BLOCK), BLOCK if size < BLOCK else 0
        else:
            first = at
        room -= size
        blocks.append((c, first, max(1, at - first + 1)))
    dealt = F.broadcast(spark.createDataFrame(blocks, "cell int, _first int, _parts int"))  # a row for each cell
    count = max(1, at + 1)
    block = (F.col("_first") + F.pmod(F.xxhash64("target_id"), F.col("_parts"))).alias("_block")
    rows = index.vectors.filter(F.col("cell").isin(cells)).join(dealt, "cell").select(*keys, block, F.struct(F.col("target_id").alias("id"), F.col("vector").cast("array<double>").alias("v"), "cell").alias("e"))
    # As many tasks as blocks: what a task does with a block is work, however few its bytes.
    left = rows.repartition(count, "_block").groupBy(*keys, "_block").agg(F.collect_list("e").alias("_v"))
    number, wide = marked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("query_vector")), F.lit(0)).alias("w")).first()
    deal = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-number // BLOCK)))).alias("_deal")
    entry = F.struct(F.col("query_id").alias("id"), F.col("query_vector").alias("v"), "worst", "cells").alias("e")
    right = marked.select(*keys, deal, entry).groupBy(*keys, "_deal").agg(F.collect_list("e").alias("_q")).drop("_deal")
    right = F.broadcast(right) if number * wide * 8 <= MOST_BYTES else right
    pairs = left.join(right, keys) if keys else left.crossJoin(right)
    return pairs.select("_q", "_v").mapInArrow(run, f"query_id {kinds[0]}, target_id {kinds[1]}, cosine double")


def nearest(questions: DataFrame, index: Cells, k: int = 10, probes: int | None = None, exact: bool = False, within: str | None = None) -> DataFrame:
    """(query_id, target_id, cosine, rank): the k best of each (query_id, query_vector) among the stored vectors.

    The first cells of each question are scored first, and the k-th cosine so far bounds what comes of the others. The cells
    that any question reads (at most ``MOST_CELLS``) are collected, so that the scan lists those cells' folders only;
    ``probes`` are by default what was measured. With ``exact`` the result is that of scoring every vector. ``within`` names
    a column of both sides that must agree. Questions without a sound vector find nothing.
    """
    probes = index.probes if probes is None else probes
    start = min(FIRST, probes)
    asked = questions.filter(_sound(F.col("query_vector"))).select("query_id", "query_vector", *([within] if within else []))
    order = [F.desc(F.round("cosine", 9)), F.asc("target_id")]
    first = _scored(asked.withColumn("worst", F.lit(None).cast("double")), index, k, lambda turn, bound, worst: turn < start, within)
    best = written(lexical.top(first, k, order), "best")
    reached = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("worst"))
    rest = _scored(asked.join(reached, "query_id", "left"), index, k, lambda turn, bound, worst: (turn >= start) & ((turn < probes) | exact) & (bound >= worst - 1e-8), within)
    return lexical.top(best.drop("rank").unionByName(rest), k, order)
