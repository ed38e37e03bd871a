"""Stored indexes of the driver's tables: built once an application, and again when a table's files change."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkscope.operators import block_max, cells, grams, lexical, ranking
from sparkscope.plans import relations as R
from sparkscope.plans.relations import _built, stamp
from sparkscope.session import shared_dir

def index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The index of the words of ``documents``."""
    source = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, f"{stamp(spark, source)}-index")
    if key not in _built:
        path = f"{shared_dir(spark)}/sparkscope/{key[0]}/{key[1]}-{uuid.uuid4().hex}"
        docs = R.documents(spark, sf_dir).select("doc_id", "w")
        lengths = docs.select(F.col("doc_id").alias("doc"), F.size("w").cast("long").alias("dl"))
        lexical.write_index(lexical.postings(docs, "doc_id", F.lit(None), by=F.col("w")), lengths, path, max(4, R.pieces(spark, source) // 8))
        _built[key] = path
    return lexical.read_index(spark, _built[key])


def blocks(spark: SparkSession, sf_dir: str) -> block_max.Blocks:
    """The postings of ``documents`` in blocks."""
    key = (spark.sparkContext.applicationId, f"{stamp(spark, f'{sf_dir}/documents.parquet')}-blocks")
    if key not in _built:
        path = f"{shared_dir(spark)}/sparkscope/{key[0]}/{key[1]}-{uuid.uuid4().hex}"
        block_max.write_documents(R.table(spark, sf_dir, "documents"), "doc_id", "text", path)
        _built[key] = path
    return block_max.read(spark, _built[key])


#: The relations that hold names of each kind, and in which columns.
NAMED = {"symbol": (R.symbols, ranking.SYMBOL_NAMES), "call": (R.calls, ranking.CALL_NAMES), "literal": (R.literals, ranking.LITERAL_NAMES), "path": (R.files, ranking.PATH_NAMES)}


def names(spark: SparkSession, sf_dir: str, *kinds: str) -> grams.Names:
    """The index of the names of some kinds, all of them by default; each kind is stored by itself."""
    found = []
    for kind in kinds or NAMED:
        key = (spark.sparkContext.applicationId, f"{stamp(spark, f'{sf_dir}/documents.parquet')}-names-{kind}")
        if key not in _built:
            path = f"{shared_dir(spark)}/sparkscope/{key[0]}/{key[1]}-{uuid.uuid4().hex}"
            relation, columns = NAMED[kind]
            grams.write(grams.different((relation(spark, sf_dir), columns)), path)
            _built[key] = path
        found.append(grams.read(spark, _built[key]))
    return reduce(grams.both, found)


def vector_cells(spark: SparkSession, sf_dir: str) -> cells.Cells:
    """The vectors of ``embeddings`` by cell."""
    key = (spark.sparkContext.applicationId, f"{stamp(spark, f'{sf_dir}/embeddings.parquet')}-cells")
    if key not in _built:
        path = f"{shared_dir(spark)}/sparkscope/{key[0]}/{key[1]}-{uuid.uuid4().hex}"
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("vector"))
        cells.write(rows, path)
        _built[key] = path
    return cells.read(spark, _built[key])
