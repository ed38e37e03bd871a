"""Vectors: cosine, top-k search, similar pairs, families of near-identical members, a hashing embedder."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.operators import lexical
from sparkscope.operators.sizes import broadcast_if_small
from sparkscope.session import ship

#: (files below, character budget, cosine floor, family size that stays open)
TIERS = ((500, 13000, 0.90, 5), (5000, 20000, 0.82, 3), (None, 24000, 0.78, 3))

#: Rows of a block of vectors or questions that are scored at once, about.
BLOCK = 2048

# Signs of a service that is away.
AWAY = re.compile("connection refused|connection reset|connection aborted|remote end closed|failed to establish a new connection", re.IGNORECASE)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def nearest(questions: DataFrame, vectors: DataFrame, k: int = 10, within: str | None = None) -> DataFrame:
    """(query_id, target_id, cosine, rank): exact top-k of (query_id, query_vector) among (target_id, vector).

    ``within`` names a column of both sides; a question then meets only the vectors that share its value.

    Blocks of questions meet blocks of vectors; about k rows for each question and block are shuffled.
    """
    keys = [within] if within else []
    asked, kept = questions.select("query_id", "query_vector", *keys), vectors.select("target_id", "vector", *keys)
    order = [F.desc(F.round("cosine", 9)), F.asc("target_id")]
    # Plain vectors are scored by blocks; those with missing or non-finite components one by one.
    sound_q, sound_v = F.coalesce(_finite(F.col("query_vector")), F.lit(False)), F.coalesce(_finite(F.col("vector")), F.lit(False))
    blocks = _block_scores(asked.filter(sound_q), kept.filter(sound_v), k, keys)
    scored = blocks.unionByName(_single_scores(asked.filter(~sound_q), kept, keys)).unionByName(_single_scores(asked.filter(sound_q), kept.filter(~sound_v), keys))
    return lexical.top(scored, k, order)


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))


def _single_scores(asked: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    asked, kept = asked.withColumn("_qn", norm(F.col("query_vector"))), kept.withColumn("_n", norm(F.col("vector")))
    # A batch of questions over the bound is compared in a join as well, whose sides Spark deals out.
    pairs = kept.join(broadcast_if_small(asked), keys or None)
    size = F.col("_n") * F.col("_qn")
    return pairs.select("query_id", "target_id", F.when(size == 0, 0.0).otherwise(dot(F.col("vector"), F.col("query_vector")) / size).alias("cosine"))


def _block_scores(asked: DataFrame, kept: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(query_id, target_id, cosine): for each block of questions and block of vectors at least the first ``k`` of each
    question, by products of matrices. Blocks hold about ``BLOCK`` rows, dealt by hash."""
    kinds = dict(asked.dtypes)["query_id"], dict(kept.dtypes)["target_id"]

    def packed(rows: DataFrame, id_col: str, vector: str, name: str) -> DataFrame:
        deal = F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-rows.count() // BLOCK)))).alias("_deal")
        grouped = rows.select(*keys, deal, id_col, vector).groupBy(*keys, "_deal")
        return grouped.agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias(name)).drop("_deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = (taken(batch.column(c), i) for c in ("_q", "_v"))
                qx, vx = unit(q), unit(v)
                width = min(qx.shape[1], vx.shape[1])
                near = np.clip(qx[:, :width] @ vx[:, :width].T, -1, 1)
                # Rounding may place scores this near to the k-th before it; of equal ones the first k ids are needed.
                turn = np.argsort(np.asarray(v.values.field("id").to_pylist()), kind="stable")
                near = near[:, turn]
                ids_q, ids_v = q.values.field("id").to_pylist(), [v.values.field("id")[int(t)].as_py() for t in turn]
                r, c = firsts(near, k)
                yield pa.RecordBatch.from_arrays([pa.array([ids_q[i] for i in r], q.values.field("id").type), pa.array([ids_v[i] for i in c], v.values.field("id").type), pa.array(near[r, c])], ["query_id", "target_id", "cosine"])

    ship(asked.sparkSession)
    left, right = packed(kept, "target_id", "vector", "_v"), packed(asked, "query_id", "query_vector", "_q")
    pairs = left.join(right, keys) if keys else left.crossJoin(right)
    return pairs.select("_q", "_v").repartition(F.xxhash64("_q", "_v")).mapInArrow(run, f"query_id {kinds[0]}, target_id {kinds[1]}, cosine double")


def taken(column: pa.ListArray, i: int) -> pa.ListArray:
    """The list at ``i`` of a column, without what lies before and after it."""
    flat = column.slice(i, 1).flatten()
    return pa.ListArray.from_arrays([0, len(flat)], flat)


def unit(rows: pa.ListArray) -> np.ndarray:
    """The vectors ``v`` of a list of structs at length 1; shorter ones end in zeros, and those of length 0 stay."""
    flat, size = rows.values.field("v"), len(rows.values)
    lengths = np.diff(flat.offsets.to_numpy())
    x = np.zeros((size, lengths.max(initial=0)))
    x[np.arange(x.shape[1]) < lengths[:, None]] = flat.flatten().to_numpy()
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def firsts(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of at least the ``k`` highest finite values of each row, and of those so near to the k-th that rounding
    may place them before it; of equal values the first ``k``."""
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None] - 2e-9 if near.shape[1] > k else -np.inf
    r, c = np.nonzero((near >= least) & (near > -np.inf))
    turn = np.lexsort((c, -near[r, c], r))
    r, c = r[turn], c[turn]
    at, value = np.arange(len(r)), near[r, c]
    begins = np.ones(len(r), dtype=bool)
    begins[1:] = (r[1:] != r[:-1]) | (value[1:] != value[:-1])
    kept = at - np.maximum.accumulate(np.where(begins, at, 0)) < k
    return r[kept], c[kept]


def similar_pairs(members: DataFrame, floor: Column | float, group: str = "query_id") -> DataFrame:
    """(group, a, b, cosine) of members (group, id, position, vector) of the same group with cosine >= floor; a before b.

    A group is what one question brought up, a few dozen members. For whole tables use a blocked or metric join.
    """
    left = members.select(group, F.col("id").alias("a"), F.col("position").alias("_i"), F.col("vector").alias("_u"))
    right = members.select(group, F.col("id").alias("b"), F.col("position").alias("_j"), F.col("vector").alias("_v"))
    pairs = left.join(right, group).filter(F.col("_i") < F.col("_j"))
    return pairs.select(group, "a", "b", cosine(F.col("_u"), F.col("_v")).alias("cosine")).filter(F.col("cosine") >= floor)


def families(members: DataFrame, floor: Column | float, min_size: Column | int, group: str = "query_id") -> DataFrame:
    """(group, id, representative) of members that collapse into the first member of their family.

    members: (group, id, position, vector, protected). A family is a connected component of pairs with cosine >= floor
    and collapses if it has more than ``min_size`` members; protected members never do. ``floor`` and ``min_size`` may be
    columns of members, with one value in each group.
    """
    id_kind = dict(members.dtypes)["id"]
    group_kind = dict(members.dtypes)[group]

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf[pdf["vector"].notna()].sort_values("position", kind="stable").reset_index(drop=True)
        label = np.arange(len(pdf))
        if len(pdf):
            x = np.array(pdf["vector"].tolist(), dtype=np.float64)
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            near = x @ x.T >= pdf["_floor"].iloc[0] - 1e-12
            np.fill_diagonal(near, True)
            while True:
                new = np.where(near, label[None, :], len(pdf)).min(axis=1)
                if (new == label).all():
                    break
                label = new
        counts = np.bincount(label, minlength=len(pdf) or 1)
        out = [(pdf[group].iloc[i], pdf["id"].iloc[i], pdf["id"].iloc[label[i]]) for i in range(len(pdf)) if label[i] != i and counts[label[i]] > pdf["_least"].iloc[0] and not pdf["protected"].iloc[i]]
        return pd.DataFrame(out, columns=[group, "id", "representative"])

    ship(members.sparkSession)
    bounds = [(b if isinstance(b, Column) else F.lit(b)).alias(n) for b, n in ((floor, "_floor"), (min_size, "_least"))]
    return members.select(group, "id", "position", "vector", "protected", *bounds).groupBy(group).applyInPandas(collapse, f"{group} {group_kind}, id {id_kind}, representative {id_kind}")


def tier(files: Column) -> Column:
    """struct(budget, floor, min_size) by the number of files."""
    out = None
    for below, budget, floor, size in TIERS:
        value = F.struct(F.lit(budget).alias("budget"), F.lit(floor).alias("floor"), F.lit(size).alias("min_size"))
        if below is None:
            return out.otherwise(value)
        out = F.when(files < below, value) if out is None else out.when(files < below, value)
    raise AssertionError("the last tier is open")


def hashing_embedder(width: int = 256) -> Callable[[list[str]], list[list[float]]]:
    """Signed feature hashing of subwords, of unit length. Close in words, not in meaning, as a neural model would be."""
    import re

    part = re.compile(r"[0-9]+|[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+")

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * width
            for word in part.findall(text or ""):
                h = crc32(word.lower().encode())
                v[h % width] += 1.0 if h >> 31 else -1.0
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out

    return embed


def attempt(embedder: Callable[[list[str]], list[list[float]]], texts: list[str], stopped: str | None = None) -> tuple[list, list[str | None], str | None]:
    """(vectors, errors, why the service is away): one call for all ``texts``, and where it fails one for each.

    Nothing is called once ``stopped`` says that the service is away; what is left then has this as its error.
    """
    try:
        if stopped is None:
            return embedder(texts), [None] * len(texts), None
    except Exception as error:  # the service's error is the texts' own
        stopped = str(error) if AWAY.search(str(error)) else None
    found: list = []
    errors: list[str | None] = []
    for text in texts:
        vector, fault = None, stopped
        if stopped is None:
            try:
                vector = embedder([text])[0]
            except Exception as error:
                fault = str(error)
                stopped = fault if AWAY.search(fault) else None
        found.append(vector)
        errors.append(fault)
    return found, errors, stopped


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 32, id_col: str = "target_id", text_col: str = "text") -> DataFrame:
    """(id, vector, error): ``batch`` texts a call; if a call fails, its texts are tried one by one and errors kept. A
    service that is away is not called again in the same task."""
    kind = dict(texts.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found, errors, stopped = attempt(embedder, [t or "" for t in part[text_col]], stopped)
                yield pd.DataFrame({id_col: part[id_col].values, "vector": found, "error": errors})

    ship(texts.sparkSession)
    return texts.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, vector array<float>, error string")


def lsh_pairs(vectors: DataFrame, floor: float, planes: int = 16, tables: int = 8, id_col: str = "target_id", vector_col: str = "vector", seed: int = 7) -> DataFrame:
    """Optional approximate form of ``similar_pairs`` for a whole table: pairs that share a random-hyperplane bucket."""
    import random

    width = vectors.select(F.max(F.size(vector_col))).first()[0] or 0
    rng = random.Random(seed)
    keys = []
    for t in range(tables):
        bits = [F.when(dot(F.col(vector_col), F.array(*[F.lit(rng.gauss(0, 1)) for _ in range(width)])) > 0, "1").otherwise("0") for _ in range(planes)]
        keys.append(F.concat(F.lit(f"{t}:"), *bits))
    keyed = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.explode(F.array(*keys)).alias("key"))
    other = keyed.select(F.col("id").alias("b"), F.col("v").alias("_w"), "key")
    near = keyed.join(other, "key").filter(F.col("id") < F.col("b"))
    return near.select(F.col("id").alias("a"), "b", cosine(F.col("v"), F.col("_w")).alias("cosine")).filter(F.col("cosine") >= floor).distinct()
