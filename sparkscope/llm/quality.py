"""Quality classifier by hierarchical empirical Bayes.

A logistic model, fitted on a bounded sample of labelled rows, gives each document the evidence of its
own text. Host and path rates of bad documents are estimated over all documents by grouped aggregation; the path's
rate is shrunk toward its host's and the host's toward the global one, so that sparse sites fall back on their priors.
A document's log odds are its evidence plus the log odds of its path.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscope.llm import common

#: Labelled rows that are used for fitting, and features that are kept of each head: bounds of what the driver sees.
SAMPLE_ROWS = 20_000
FEATURES = 300
HEADS = ("toxic", "low_quality")
PUNCTUATION = ".,;:!?()[]{}\"'«»¿¡"


def _bin(name: str, value: float, edges: tuple[float, ...]) -> str:
    return f"\x00{name}:{sum(value >= e for e in edges)}"


def features(text: str | None) -> set[str]:
    """Words (lower-cased, outer punctuation cut off) and binned shape figures, whose names start with NUL."""
    words = text.split() if text else []
    if not words:
        return {"\x00empty"}
    found = Counter(words)
    out = {w.strip(PUNCTUATION).lower() for w in found}
    out.discard("")
    n = len(words)
    letters = sum(map(str.isalpha, words))
    marks = sum(text.count(c) for c in "|#$%&*<>{}=\\^~")
    most = max(found.values()) / n
    out.add(_bin("distinct", len(found) / n if n > 20 else 1.0, (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)))
    out.add(_bin("marks", marks / n, (0.02, 0.1, 0.3, 0.6, 1.0, 2.0)))
    out.add(_bin("alphabetic", letters / n, (0.1, 0.3, 0.5, 0.7, 0.9)))
    out.add(_bin("top", most if n > 20 else 0.0, (0.05, 0.1, 0.15, 0.25, 0.5)))
    out.add(_bin("length", (len(text) - n) / n, (3.0, 4.0, 5.0, 6.0, 8.0, 12.0)))
    return out


@dataclass
class Head:
    """Evidence for one label: a sum over features that are present on top of what their absence says."""

    base: float
    weights: dict[str, float]

    def evidence(self, found: set[str]) -> float:
        get = self.weights.get
        return self.base + sum([get(f, 0.0) for f in found])


@dataclass
class Model:
    heads: dict[str, Head]
    priors: dict[str, float]

    def evidence(self, found: set[str]) -> list[float]:
        return [self.heads[h].evidence(found) for h in HEADS]


def labelled_sample(labels: DataFrame, rows: int) -> DataFrame:
    """``rows`` labelled ids at most, the first by a hash of the id; of several labels of an id, the worst counts."""
    ids = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.max(1 - F.coalesce("quality", F.lit(1))).alias("low_quality"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the sample: features are chosen by their gain over all of it, weights by penalised logistic regression.

    A head whose sample has not both kinds of rows gives no evidence and rejects nothing.
    """
    spark = docs.sparkSession
    common.ship(spark)
    sample = labelled_sample(labels, sample_rows)
    # The sample holds sample_rows rows of three numbers at most.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", *HEADS)
    rows = common.materialise(rows, "quality-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic, low in zip(*[c.to_pylist() for c in batch.columns]):
                for f in features(text) | {""}:  # the empty feature counts documents
                    counts[f, toxic, low] += 1
            if len(counts) > 100_000:
                yield _packed(counts)
                counts.clear()
        if counts:
            yield _packed(counts)

    counted = rows.select("text", *HEADS).mapInArrow(common.lean(count), "feature string, toxic int, low_quality int, n long")
    sums = counted.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(h) == 1, F.col("n")).otherwise(0)).alias(h) for h in HEADS])
    sums = common.materialise(sums.filter("n >= 5"), "quality-features")
    total = sums.filter("feature = ''").first()
    fitted = [h for h in HEADS if total and 0 < total[h] < total["n"]]
    chosen: dict[str, int] = {}
    for h in fitted:
        bad, good = total[h], total["n"] - total[h]
        p1, p0 = (F.col(h) + 0.5) / (bad + 1.0), (F.col("n") - F.col(h) + 0.5) / (good + 1.0)
        with_it = F.col(h) * F.log(p1 / p0) + (F.col("n") - F.col(h)) * F.log(p0 / p1)
        without = (bad - F.col(h)) * F.log((1 - p1) / (1 - p0)) + (good - F.col("n") + F.col(h)) * F.log((1 - p0) / (1 - p1))
        best = sums.filter("feature <> ''").withColumn("gain", with_it + without).orderBy(F.desc("gain"), "feature").limit(n_features)
        for r in best.select("feature").collect():
            chosen.setdefault(r["feature"], len(chosen))
    heads = {h: Head(0.0, {}) for h in HEADS}
    priors = {h: 1e-4 for h in HEADS}
    if not fitted:
        return Model(heads, priors)
    shared = spark.sparkContext.broadcast(chosen)

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(shared.value[f] for f in features(t.as_py()) if f in shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.int16()))], ["doc_id", *HEADS, "found"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    # sample_rows rows at most (ids that documents repeat aside, which count once), 2 * n_features numbers each.
    seen = rows.mapInArrow(common.lean(indices), f"doc_id {kind}, toxic int, low_quality int, found array<smallint>").orderBy(F.xxhash64("doc_id"), "doc_id", "found").limit(sample_rows).collect()
    x = np.zeros((len(seen), len(chosen)), dtype=np.float32)
    for i, r in enumerate(seen):
        x[i, r["found"]] = 1.0
    for h in fitted:
        y = np.array([r[h] for r in seen], dtype=np.float64)
        weights, base = logistic(x, y)
        priors[h] = float(min(max(y.mean(), 1e-4), 1 - 1e-4))
        heads[h] = Head(base - math.log(priors[h] / (1 - priors[h])), {f: float(weights[i]) for f, i in chosen.items()})
    return Model(heads, priors)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps; ``penalty`` pulls the weights (not the intercept) to zero."""
    n = x.shape[1]
    full = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    w = np.zeros(n + 1)
    ridge = np.full(n + 1, penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (y - p) - ridge * w
        curve = np.maximum(p * (1 - p), 1e-6).astype(x.dtype)
        step = np.linalg.solve((full * curve[:, None]).T @ full + np.diag(ridge), gradient)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w[:n], float(w[n])


def _packed(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    columns = [pa.array([k[0] for k in keys], pa.string()), *[pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)], pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["feature", *HEADS, "n"])


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True, own: str = "_") -> DataFrame:
    """``docs`` with ``_evidence``, an array of log likelihood ratios in the order of ``HEADS``.

    ``own`` is the prefix of columns of our own, here and below.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.evidence(features(t.as_py())) for t in batch.column(at)]
            columns = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if keep_text or n != text_col]
            yield pa.RecordBatch.from_arrays([*[c for _, c in columns], pa.array(found, pa.list_(pa.float64()))], [*[n for n, _ in columns], f"{own}evidence"])

    return docs.mapInArrow(common.lean(run), T.StructType([*fields, T.StructField(f"{own}evidence", T.ArrayType(T.DoubleType()))]))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def site_rates(scored: DataFrame, model: Model, strength: float = 50.0, own: str = "_") -> DataFrame:
    """(_host, _path, _rates, _host_docs, _path_docs): posterior rates by head, for each path.

    A rate is (bad + strength * parent's rate) / (documents + strength), where a document's share of bad is its own
    posterior under the global prior. Sums are partial before the shuffle, so a hot host costs a row a task.
    """
    prior = [math.log(p / (1 - p)) for p in (min(max(model.priors[h], 1e-4), 1 - 1e-4) for h in HEADS)]
    bad = [_sigmoid(F.col(f"{own}evidence")[i] + prior[i]) for i in range(len(HEADS))]
    paths = scored.groupBy(F.col(f"{own}host").alias("_host"), F.col(f"{own}path").alias("_path")).agg(F.count("*").alias("_path_docs"), *[F.sum(b).alias(f"_bad{i}") for i, b in enumerate(bad)])
    paths = common.materialise(paths, "quality-paths")
    names = [f"_bad{i}" for i in range(len(HEADS))]
    hosts = paths.groupBy("_host").agg(F.sum("_path_docs").alias("_host_docs"), *[F.sum(n).alias(f"_host{n}") for n in names])
    total = hosts.agg(F.sum("_host_docs"), *[F.sum(f"_host{n}") for n in names]).first()
    overall = [((total[i + 1] or 0.0) + 1.0) / ((total[0] or 0) + 2.0) for i in range(len(HEADS))]
    hosts = hosts.select("_host", "_host_docs", *[((F.col(f"_host{n}") + strength * overall[i]) / (F.col("_host_docs") + strength)).alias(f"_host{n}") for i, n in enumerate(names)])
    joined = paths.withColumnRenamed("_host", "_h").join(hosts, F.col("_h").eqNullSafe(F.col("_host"))).drop("_h")
    rates = F.array(*[(F.col(n) + strength * F.col(f"_host{n}")) / (F.col("_path_docs") + strength) for n in names])
    return common.materialise(joined.select("_host", "_path", rates.alias("_rates"), "_host_docs", "_path_docs"), "quality-rates")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, strength: float = 50.0, model: Model | None = None, text_col: str = "text", keep_text: bool = True, id_col: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with struct ``_quality``: host, path, host_docs, path_docs, toxic, low_quality, kept.

    toxic and low_quality are posterior probabilities; kept means that neither reaches ``threshold``. host and path
    are expressions over ``docs``, by default the source, and the source with the language. Null and empty texts
    have the evidence of an empty text; null hosts are one site. Repeated rows are scored alike; an empty table gives
    none. A column that is already called ``_quality`` is replaced; all others keep their values, whatever their names.
    """
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col)
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", "source", "lang") if path is None else path
    own = common.free_prefix(docs)
    sited = docs.withColumns({f"{own}host": host, f"{own}path": path})
    rates = site_rates(with_evidence(sited.select(f"{own}host", f"{own}path", text_col), model, text_col, keep_text=False, own=own), model, strength, own)
    scored = with_evidence(sited, model, text_col, keep_text, own)
    # The table of paths is a written one: Spark broadcasts it only if its size is under the session's bound.
    rates = rates.select(F.struct("*").alias(f"{own}site"))
    mine = {n: F.col(f"{own}site.{n}") for n in ("_host", "_path", "_rates", "_host_docs", "_path_docs")}
    joined = scored.join(rates, F.col(f"{own}host").eqNullSafe(mine["_host"]) & F.col(f"{own}path").eqNullSafe(mine["_path"]), "left")
    odds = [_sigmoid(F.col(f"{own}evidence")[i] + _logit(mine["_rates"][i])) for i in range(len(HEADS))]
    kept = (odds[0] < threshold) & (odds[1] < threshold)
    quality = F.struct(F.col(f"{own}host").alias("host"), F.col(f"{own}path").alias("path"), mine["_host_docs"].alias("host_docs"), mine["_path_docs"].alias("path_docs"), odds[0].alias("toxic"), odds[1].alias("low_quality"), kept.alias("kept"))
    columns = [c for c in docs.columns if c != "_quality" and (keep_text or c != text_col)]
    return joined.select(*columns, quality.alias("_quality"))
