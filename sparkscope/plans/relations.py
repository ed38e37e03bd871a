"""The engine's relations as views of the driver's tables, in Spark and, for the oracles, in SQL.

Each document is a file with one symbol: its first word is the symbol's name, its first line the signature, each of its
other words a call, and each word of eight letters or more a literal.
"""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.functions.text import words
from sparkscope.session import shared_dir

#: What has been stored for an application and a state of a table's files.
_built: dict[tuple[str, str], str] = {}
#: Bytes of the given files for each task that deals them out.
PIECE = 16 * 1024 * 1024


def listed(spark: SparkSession, path: str) -> list[tuple]:
    """(path, bytes, time of change) of a table's files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of a table's files: names, sizes and times of change."""
    return hashlib.sha256(repr(listed(spark, path)).encode()).hexdigest()[:24]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession, source: str) -> int:
    """Tasks that a table's files are dealt out to: one for each ``PIECE`` bytes, and one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(sum(n for _, n, _ in listed(spark, source)) / PIECE))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``w``, ``head`` and ``line_count``: the words, first line and number of lines of each text.

    Stored once an application and dealt out to many files. A given file may be a single row group, which one task reads,
    and all relations are cut from the words, which are found once; a relation reads the columns it needs.
    """
    source = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, f"{stamp(spark, source)}-documents")
    if key not in _built:
        path = f"{shared_dir(spark)}/sparkscope/{key[0]}/{key[1]}-{uuid.uuid4().hex}"
        lines = F.split("text", "\n")
        dealt = table(spark, sf_dir, "documents").repartition(pieces(spark, source), F.xxhash64("doc_id", "text"))
        dealt.withColumns({"w": words(F.col("text")), "head": lines[0], "line_count": F.size(lines).cast("long")}).write.parquet(path)
        _built[key] = path
    return spark.read.parquet(_built[key])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    path = F.concat(F.when(F.col("doc_id") % 7 == 0, "tests/").otherwise("src/"), "source", F.lit("/doc_"), "doc_id", F.lit(".txt"))
    return d.select(F.col("lang").alias("repo"), F.col("doc_id").alias("file_id"), path.alias("path"), "text", "line_count")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).filter(F.size("w") > 0)
    name = F.col("w")[0]
    return d.select(
        F.col("lang").alias("repo"), F.col("doc_id").alias("symbol_id"), F.col("doc_id").alias("file_id"), name.alias("name"),
        F.concat("source", F.lit("."), name).alias("qualified_name"), F.concat("lang", F.lit("."), "source", F.lit("."), name, F.lit("."), "doc_id").alias("symbol_ref"),
        F.col("head").alias("signature"), F.col("text").alias("primary_text"),
        F.lit(1).cast("long").alias("line_start"), F.least("line_count", F.lit(80).cast("long")).alias("line_end"), F.col("doc_id").alias("ord"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).filter(F.size("w") > 1)
    called = d.select("doc_id", F.posexplode(F.slice("w", F.lit(2), F.size("w"))).alias("p", "fn"))
    odd = F.col("p") % 2 == 1
    return called.select(F.col("doc_id").alias("symbol_id"), F.when(odd, F.concat(F.lit("self."), "fn")).otherwise(F.col("fn")).alias("call_text"), F.when(odd, "self").alias("receiver"), F.col("fn").alias("function_name"), (F.col("p") + 1).cast("long").alias("line_start"), (F.col("p") + 1).cast("long").alias("line_end"))


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("symbol_id"), F.posexplode("w").alias("p", "value")).filter(F.length("value") >= 8).select("symbol_id", F.lit("string").alias("literal_type"), "value", (F.col("p") + 1).cast("long").alias("line_start"))


def questions(spark: SparkSession, sf_dir: str, count: int = 6) -> DataFrame:
    """The benchmark's items as questions: their first ``count`` words, asked of one repository each."""
    b = table(spark, sf_dir, "benchmark").withColumn("w", F.slice(words(F.col("text")), 1, count)).filter(F.size("w") > 0)
    return b.select(F.col("item_id").alias("query_id"), F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("item_id") % 4 + 1).cast("int")).alias("repo"), F.array_join("w", " ").alias("text"))


def chunks(spark: SparkSession, sf_dir: str, count: int = 6) -> DataFrame:
    """All of the benchmark's texts as questions of ``count`` words each; the last of an item may be shorter."""
    b = table(spark, sf_dir, "benchmark").withColumn("w", words(F.col("text"))).filter(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / count).cast("int") - 1), lambda i: F.array_join(F.slice(F.col("w"), i * count + 1, count), " "))
    return b.select("item_id", F.posexplode(cut).alias("n", "text")).select((F.col("item_id") * 100_000 + F.col("n")).alias("query_id"), F.lit("en").alias("repo"), "text")


# The same in SQL. Texts hold no carriage returns.
W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
CTES = {
    "files": "SELECT lang AS repo, doc_id AS file_id, CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE 'src/' END || source || '/doc_' || doc_id || '.txt' AS path, text, len(string_split(text, chr(10))) AS line_count FROM documents",
    "dw": f"SELECT *, {W} AS w FROM documents",
    "symbols": "SELECT lang AS repo, doc_id AS symbol_id, doc_id AS file_id, w[1] AS name, source || '.' || w[1] AS qualified_name, lang || '.' || source || '.' || w[1] || '.' || doc_id AS symbol_ref, string_split(text, chr(10))[1] AS signature, text AS primary_text, CAST(1 AS BIGINT) AS line_start, least(len(string_split(text, chr(10))), 80) AS line_end, doc_id AS ord FROM dw WHERE len(w) > 0",
    "calls": "SELECT doc_id AS symbol_id, CASE WHEN p % 2 = 1 THEN 'self.' || fn ELSE fn END AS call_text, CASE WHEN p % 2 = 1 THEN 'self' END AS receiver, fn AS function_name, p + 1 AS line_start, p + 1 AS line_end FROM (SELECT doc_id, unnest(w[2:]) AS fn, generate_subscripts(w[2:], 1) - 1 AS p FROM dw)",
    "literals": "SELECT doc_id AS symbol_id, 'string' AS literal_type, value, p AS line_start FROM (SELECT doc_id, unnest(w) AS value, generate_subscripts(w, 1) AS p FROM dw) WHERE length(value) >= 8",
    "questions": f"SELECT item_id AS query_id, ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS repo, array_to_string(w[1:6], ' ') AS text FROM (SELECT item_id, {W} AS w FROM benchmark) WHERE len(w) > 0",
    "chunks": f"SELECT item_id * 100000 + i AS query_id, 'en' AS repo, array_to_string(w[i * 6 + 1:i * 6 + 6], ' ') AS text FROM (SELECT item_id, w, unnest(range(CAST(ceil(len(w) / 6.0) AS BIGINT))) AS i FROM (SELECT item_id, {W} AS w FROM benchmark) WHERE len(w) > 0)",
    "posted": "SELECT doc_id AS doc, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM dw) GROUP BY ALL",
    "dl": "SELECT doc_id AS doc, len(w) AS dl FROM dw",
    "asked": "SELECT query_id, unnest(string_split(text, ' ')) AS q, generate_subscripts(string_split(text, ' '), 1) AS n FROM questions",
}
NEEDS = {"symbols": ["dw"], "calls": ["dw"], "literals": ["dw"], "posted": ["dw"], "dl": ["dw"], "asked": ["questions"]}


def sql(needs: str, body: str) -> str:
    """A query over some of the relations above, which ``needs`` names."""
    names: list[str] = []
    for n in needs.split():
        for x in [*NEEDS.get(n, []), n]:
            if x not in names:
                names.append(x)
    ctes = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in names]
    text = body.strip()
    recursive = text.startswith("RECURSIVE ")
    text = text.removeprefix("RECURSIVE ")
    if text.startswith("WITH "):
        return f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes + [text.removeprefix('WITH ')])}" if ctes else f"WITH {'RECURSIVE ' * recursive}{text.removeprefix('WITH ')}"
    return f"WITH {', '.join(ctes)} {text}" if ctes else text
