"""Vector search by cells against scoring every vector."""

import numpy as np
from pyspark.sql import functions as F

from sparkscope.operators import cells, vectors
from test_growth import shuffled

SF = "/root/testdata/sf0.01"


def stored_cells(spark, rows, path):
    cells.write(rows, str(path))
    return cells.read(spark, str(path))


def test_recall_and_cells_read(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("vector"))
    asked = rows.filter("target_id % 50 = 0").select(F.col("target_id").alias("query_id"), F.col("vector").alias("query_vector"))
    index = stored_cells(spark, rows, tmp_path / "cells")
    assert index.vectors.count() == rows.count(), "every vector is stored"
    want = {(r["query_id"], r["target_id"]) for r in vectors.nearest(asked, rows, 10).collect()}
    got = {(r["query_id"], r["target_id"]) for r in cells.nearest(asked, index, 10).collect()}
    recall = len(want & got) / len(want)
    assert recall >= 0.9, recall
    exact = [tuple(r) for r in cells.nearest(asked, index, 10, exact=True).orderBy("query_id", "rank").collect()]
    whole = [tuple(r) for r in vectors.nearest(asked, rows, 10).orderBy("query_id", "rank").collect()]
    assert [r[:2] + r[3:] for r in exact] == [r[:2] + r[3:] for r in whole] and np.allclose([r[2] for r in exact], [r[2] for r in whole])
    one = cells.nearest(asked.limit(1), index, 10)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().toString().replace("isnotnull(cell#", "[cell#").replace("[[", "[")
    files = index.vectors.select(F.input_file_name().alias("f"))
    near = [r["cell"] for r in cells._bounds(asked.limit(1), index).filter(F.col("turn") < index.probes).collect()]
    read = index.vectors.filter(F.col("cell").isin(near)).select(F.input_file_name().alias("f"))
    assert read.distinct().count() < 0.8 * files.distinct().count()


def test_groups_ties_and_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    data = [(i, [float(x) for x in centres[i % 12] + 0.2 * rng.normal(size=8)], "large" if i % 3 else "small") for i in range(600)]
    data += [(1000 + i, data[5][1], "small") for i in range(15)]  # copies: ties go by target_id
    data += [(2000, [0.0] * 8, "small"), (2001, None, "small"), (2002, [float("nan")] * 8, "large"), (2003, [], "large"), (2004, [float("inf")] + [0.0] * 7, "large")]
    rows = spark.createDataFrame(data, "target_id long, vector array<float>, repo string").repartition(3)
    index = stored_cells(spark, rows, tmp_path / "cells")
    sound = rows.filter("target_id <= 2000")
    assert index.vectors.count() == sound.count() and cells.NOWHERE in index.radii
    questions = [(i, [float(x) for x in rng.normal(size=8)], "small" if i % 2 else "large") for i in range(20)]
    questions += [(50, data[5][1], "small"), (51, [0.0] * 8, "small"), (52, None, "large"), (53, [-float(x) for x in centres.sum(axis=0)], "small")]
    asked = spark.createDataFrame(questions, "query_id long, query_vector array<float>, repo string")
    full = asked.filter("query_vector IS NOT NULL")
    for within in (None, "repo"):
        for k in (3, 40):
            want = [tuple(r)[:2] + (r["rank"],) for r in vectors.nearest(full, sound, k, within).orderBy("query_id", "rank").collect()]
            got = [tuple(r)[:2] + (r["rank"],) for r in cells.nearest(asked, index, k, probes=2, exact=True, within=within).orderBy("query_id", "rank").collect()]
            assert got == want, (within, k)


def test_empty_and_single(spark, tmp_path):
    none = spark.createDataFrame([], "target_id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<float>")
    empty = stored_cells(spark, none, tmp_path / "none")
    assert cells.nearest(asked, empty, exact=True).count() == 0 and cells.nearest(asked, empty).count() == 0
    one = stored_cells(spark, spark.createDataFrame([(7, [0.5, 0.5])], "target_id long, vector array<float>"), tmp_path / "one")
    assert cells.nearest(asked, one).first()["target_id"] == 7
    assert cells.nearest(asked.limit(0), one, exact=True).count() == 0
    flat = stored_cells(spark, spark.createDataFrame([(7, [0.0, 0.0])], "target_id long, vector array<float>"), tmp_path / "flat")
    assert cells.nearest(asked, flat, exact=True).first()["cosine"] == 0.0


def test_questions_meet_blocks_of_cells(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(2000)], "target_id long, vector array<float>")
    index = stored_cells(spark, rows, tmp_path / "cells")
    assert sum(index.sizes.values()) == 2000 and len(index.sizes) > 20
    asked = rows.filter("target_id % 5 = 0").select(F.col("target_id").alias("query_id"), F.col("vector").alias("query_vector"))
    run = lambda: cells.nearest(asked, index, 3, probes=12, exact=True)
    got, records = shuffled(spark, lambda: sorted(tuple(r)[:2] + (r["rank"],) for r in run().collect()))
    assert got == sorted(tuple(r)[:2] + (r["rank"],) for r in vectors.nearest(asked, rows, 3).collect())
    # No rows of questions and cells, and no pairs of questions and vectors outside the products.
    assert records < 12_000, records
    assert "MapInArrow" in run()._jdf.queryExecution().analyzed().toString()
