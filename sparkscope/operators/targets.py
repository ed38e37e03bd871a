"""Resolving what a user names, and opening it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions.text import directory
from sparkscope.operators import grams
from sparkscope.operators.sizes import broadcast_if_small
from sparkscope.operators.upkeep import ancestors
from sparkscope.session import written

FUZZY = 6
COLUMNS = ("type", "target_id", "path", "symbol_ref", "line_start", "line_end")


def handles(ranked: DataFrame, order: str = "final_rank", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``ranked`` with ``result_id``: r_01, r_02 and so on."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return ranked.withColumn("result_id", F.format_string("r_%02d", n))


def resolve(asked: DataFrame, files: DataFrame, symbols: DataFrame, modules: DataFrame, cached: DataFrame | None = None, names: grams.Names | None = None) -> DataFrame:
    """(ask_id, status, step, n, type, target_id, path, symbol_ref, line_start, line_end) for each (ask_id, repo, target).

    Steps, of which the first with a match counts: a result handle, an exact symbol name in full, a path, a module, a
    bare name, a part of a full name (at most 6, shortest first). One match is "ok"; several bare names or parts are
    "ambiguous", one row each; none is "not_found". Parts of names are found through the index ``names``, or one made of
    the symbols.
    """
    named = symbols.join(files.select("file_id", "path"), "file_id").select("repo", F.lit("symbol").alias("type"), F.col("symbol_id").alias("target_id"), "path", "symbol_ref", "line_start", "line_end", "name", "qualified_name", "ord")
    # Both are read by each step; stored, Spark knows how few the questions are, and symbols need not be shuffled to meet them.
    asked, named = written(asked.select("ask_id", "repo", "target"), "asked"), written(named, "named")
    none = F.lit(None).cast("string")
    as_files = files.select("repo", F.lit("file").alias("type"), F.col("file_id").alias("target_id"), "path", none.alias("symbol_ref"), F.lit(1).alias("line_start"), F.least("line_count", F.lit(80)).alias("line_end"), F.col("path").alias("_key"))
    as_modules = modules.select("repo", F.lit("module").alias("type"), F.col("module_id").alias("target_id"), F.col("path_prefix").alias("path"), none.alias("symbol_ref"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.col("path_prefix").alias("_key"))
    own = ["ask_id", *COLUMNS]

    def step(n: int, found: DataFrame, *order: Column) -> DataFrame:
        return found.select(*own, F.lit(n).alias("step"), F.row_number().over(Window.partitionBy("ask_id").orderBy(*order, "target_id")).alias("n"))

    def met(table: DataFrame, key: Column, by: DataFrame = asked) -> DataFrame:
        wanted = by.select("ask_id", F.col("repo").alias("_repo"), key.alias("_asked"))
        return table.join(broadcast_if_small(wanted), (F.col("_repo") == F.col("repo")) & (F.col("_asked") == F.col("_key")))

    target = F.col("target")
    steps = []
    if cached is not None:
        steps.append(step(1, asked.select("ask_id", "repo", F.col("target").alias("result_id")).join(cached, ["repo", "result_id"]), F.col("path")))
    steps.append(step(2, met(named.withColumn("_key", F.col("symbol_ref")), target), F.col("ord")).filter("n = 1"))
    steps.append(step(3, met(as_files, target), F.col("path")).filter("n = 1"))
    steps.append(step(4, met(as_modules, F.rtrim(target, F.lit("/"))), F.col("path")).filter("n = 1"))
    early = written(reduce(DataFrame.unionByName, steps), "resolved")
    left = written(asked.filter("ask_id IS NOT NULL").join(early.select("ask_id").distinct(), "ask_id", "left_anti").withColumn("_asks", F.count("*").over(Window.partitionBy("ask_id"))), "left")
    # Bare names: a row for each question and symbol, so symbols are numbered once for each name, not for each question, and
    # questions meet them last. Questions that share an id are numbered together.
    bare = named.withColumn("_key", F.col("name"))
    keys = left.select("repo", target.alias("_key")).distinct()
    bare = bare.join(broadcast_if_small(keys), ["repo", "_key"], "left_semi")
    same = Window.partitionBy("repo", "_key")
    numbered = bare.select("repo", "_key", *COLUMNS, F.row_number().over(same.orderBy("path", "line_start", "target_id")).alias("n"), F.count("*").over(same).alias("_many"))
    spark = asked.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = written(numbered.repartition(tasks, "target_id", "n"), "numbered")
    once, shared = left.filter("_asks = 1"), left.filter("_asks > 1")
    by_name = met(numbered, target, once).select(*own, F.lit(5).alias("step"), "n", "_many")
    together = step(5, met(bare, target, shared), F.col("path"), F.col("line_start"))
    # Only what no earlier step has resolved is looked for in parts of names.
    named_so = left.join(numbered.filter("n = 1").select("repo", F.col("_key").alias("target")), ["repo", "target"], "left_semi")
    named_so = written(named_so.select("ask_id", "_asks").distinct(), "named")
    rest = written(left.filter(target != "").join(broadcast_if_small(named_so), "ask_id", "left_anti").select("ask_id", "repo", target.alias("token")), "rest")
    parts = ["symbol_ref", "qualified_name"]
    hits = written(grams.lookup(rest.select("token"), names or grams.index(grams.different((symbols, parts)))), "hits")
    close = grams.holding(named, parts, hits).join(broadcast_if_small(rest), ["repo", "token"]).dropDuplicates(["ask_id", "target_id"])
    close = step(6, close, F.length("symbol_ref"), F.col("symbol_ref")).filter(F.col("n") <= FUZZY)
    whole = Window.partitionBy("ask_id")
    first = early.unionByName(together).unionByName(close).withColumn("_first", F.min("step").over(whole)).filter(F.col("step") == F.col("_first"))
    first = first.withColumn("_many", F.count("*").over(whole)).drop("_first")
    out = asked.select("ask_id").join(broadcast_if_small(named_so.filter("_asks = 1")), "ask_id", "left_anti").join(first, "ask_id", "left").unionByName(by_name)
    status = F.when(F.col("step").isNull(), "not_found").when((F.col("_many") > 1) & (F.col("step") >= 5), "ambiguous").otherwise("ok")
    return out.select("ask_id", status.alias("status"), "step", "n", *COLUMNS)


def open_lines(found: DataFrame, files: DataFrame, around: int = 2) -> DataFrame:
    """``found`` files and symbols with ``first_line`` and ``lines``: a symbol's lines and two on either side, or a file's span."""
    pad = F.when(F.col("type") == "symbol", around).otherwise(0)
    first = F.greatest(F.lit(1), F.col("line_start") - pad)
    text = files.select("path", "repo", F.col("lines").alias("_lines"))
    joined = found.join(text, ["repo", "path"])
    return joined.withColumns({"first_line": first, "lines": F.slice(F.col("_lines"), first, F.greatest(F.lit(0), F.col("line_end") + pad - first + 1))}).drop("_lines")


def list_modules(found: DataFrame, files: DataFrame, symbols: DataFrame, most: int = 80) -> DataFrame:
    """(ask_id, lines) of modules (ask_id, repo, path): the first files by path below each, one line with its symbols a file."""
    folders = F.array_union(F.array(F.lit("")), ancestors(directory(F.col("path"))))
    inside = files.select("repo", "file_id", F.col("path").alias("_file"), F.explode(folders).alias("path"))
    met = found.select("ask_id", "repo", "path").join(inside, ["repo", "path"])
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy("ask_id").orderBy("_file"))).filter(F.col("_n") <= most)
    names = symbols.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "symbol_ref"))), lambda x: x["symbol_ref"]), ", ").alias("_names"))
    line = F.concat(F.col("_file"), F.lit(": "), F.coalesce("_names", F.lit("")))
    return met.join(names, "file_id", "left").groupBy("ask_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]).alias("lines"))


def list_directory(files: DataFrame, symbols: DataFrame, prefix: Column, most: int = 80) -> DataFrame:
    """(repo, path, line_count, symbols) of files in a directory, the first 80 by path in each repository; symbols by position."""
    inside = files.filter((prefix == "") | F.col("path").startswith(F.concat(prefix, F.lit("/"))))
    order = Window.partitionBy("repo").orderBy("path")
    inside = inside.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    names = symbols.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("symbols"))
    return inside.join(names, "file_id", "left").select("repo", "path", "line_count", F.coalesce("symbols", F.lit("")).alias("symbols"))
