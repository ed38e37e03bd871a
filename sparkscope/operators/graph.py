"""The name-based call graph: neighbours, callers, blast radius, trails.

A call meets a definition by name. A call's text also meets it by its last dotted part, without regard to ASCII case.
Each way is an equi-join, so no comparison of all calls with all names is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions.text import fold, is_test, last_segment
from sparkscope.operators.sizes import broadcast_if_small

CALLEES, CALLERS, BLAST, TRAIL_CALLERS, TRAIL_CALLEES, TRAIL_FLAGS = 2, 6, 8, 10, 12, 6


def callers(targets: DataFrame, calls: DataFrame, symbols: DataFrame, most: int, whole_text: bool = False) -> DataFrame:
    """(*targets, caller, n): distinct symbols that call each target (repo, symbol_id, name), the first ``most`` by position."""
    # By the called name as written, by the folded last part of a dotted call, and by a call's whole text. Targets of one
    # repository and name have the same callers but for themselves: callers are looked for once for each such name, and
    # all but the first ``most`` + 1 go before they meet the targets.
    site, text = calls.withColumnRenamed("symbol_id", "caller"), F.col("call_text")
    ways = [(site, F.col("function_name"), F.col("name")), (site.filter(F.contains(text, F.lit("."))), fold(last_segment(text)), fold(F.col("name")))]
    ways += [(site, text, F.col("name"))] if whole_text else []
    place = symbols.select(F.col("symbol_id").alias("caller"), "repo", F.col("ord").alias("_ord"))
    names = targets.select("name").distinct()
    found = [rows.select("caller", key.alias("_key")).join(broadcast_if_small(names.withColumn("_key", name)), "_key").select("name", "caller") for rows, key, name in ways]
    met = reduce(DataFrame.unionByName, found).distinct().join(place, "caller")
    met = met.join(broadcast_if_small(targets.select("repo", "name").distinct()), ["repo", "name"], "left_semi")
    first = met.withColumn("_n", F.dense_rank().over(Window.partitionBy("repo", "name").orderBy("_ord", "caller"))).filter(F.col("_n") <= most + 1).drop("_n")
    each = targets.distinct().join(first, ["repo", "name"]).filter(F.col("caller") != F.col("symbol_id"))
    order = Window.partitionBy(*targets.columns).orderBy("_ord", "caller")
    return each.withColumn("n", F.row_number().over(order) - 1).filter(F.col("n") < most).select(*targets.columns, "caller", "n")


def callees(targets: DataFrame, calls: DataFrame, symbols: DataFrame, most: int = CALLEES) -> DataFrame:
    """(*targets, function_name, callee, n): up to ``most`` definitions of each name that a target calls."""
    seeds = broadcast_if_small(targets.select("symbol_id").distinct())
    called = calls.filter(F.col("function_name").isNotNull()).select("symbol_id", "function_name").join(seeds, "symbol_id", "left_semi").distinct()
    defined = symbols.select(F.col("symbol_id").alias("callee"), "repo", F.col("name").alias("function_name"), "ord")
    order = Window.partitionBy("repo", "function_name").orderBy("ord", "callee")
    defined = defined.withColumn("n", F.row_number().over(order) - 1).filter(F.col("n") < most)
    return targets.join(called, "symbol_id").join(defined, ["repo", "function_name"]).select(*targets.columns, "function_name", "callee", "n")


def spine(seeds: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, symbol_id, position, is_seed): seeds, then their callees and callers, each symbol at its first place.

    ``seeds``: (query_id, repo, symbol_id, name, seed_rank).
    """
    base = seeds.select("query_id", "repo", "symbol_id", "name", "seed_rank")
    down = callees(base, calls, symbols).select("query_id", F.col("callee").alias("found"), "seed_rank", F.lit(1).alias("step"), F.col("function_name").alias("via"), "n")
    up = callers(base, calls, symbols, CALLERS).select("query_id", F.col("caller").alias("found"), "seed_rank", F.lit(2).alias("step"), F.lit("").alias("via"), "n")
    own = base.select("query_id", F.col("symbol_id").alias("found"), "seed_rank", F.lit(0).alias("step"), F.lit("").alias("via"), F.lit(0).alias("n"))
    every = own.unionByName(down).unionByName(up)
    # All seeds come before all neighbours.
    every = every.withColumn("late", (F.col("step") > 0).cast("int"))
    first = every.groupBy("query_id", "found").agg(F.min(F.struct("late", "seed_rank", "step", "via", "n")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "found")
    return first.select("query_id", F.col("found").alias("symbol_id"), (F.row_number().over(order) - 1).alias("position"), (F.col("at.late") == 0).alias("is_seed"))


def blast_radius(targets: DataFrame, calls: DataFrame, symbols: DataFrame, files: DataFrame, most: int = BLAST) -> DataFrame:
    """(*targets, callers, tests): who calls each target, split into code and tests; names in order of position."""
    met = callers(targets, calls, symbols, most)
    about = symbols.join(files.select("file_id", "path"), "file_id").select(F.col("symbol_id").alias("caller"), "symbol_ref", "path")
    told = met.join(about, "caller").withColumn("test", is_test(F.col("path"), F.col("symbol_ref")))

    def names(which):
        kept = F.sort_array(F.collect_list(F.when(which, F.struct("n", "symbol_ref"))))
        return F.transform(kept, lambda x: x["symbol_ref"])

    grouped = told.groupBy(*targets.columns).agg(names(~F.col("test")).alias("callers"), names(F.col("test")).alias("tests"))
    keys = ["query_id", "symbol_id"] if "query_id" in targets.columns else ["symbol_id"]
    empty = F.array().cast("array<string>")
    return targets.join(grouped.select(*keys, "callers", "tests"), keys, "left").withColumns({"callers": F.coalesce("callers", empty), "tests": F.coalesce("tests", empty)})


def trail(targets: DataFrame, calls: DataFrame, symbols: DataFrame, flags: DataFrame) -> DataFrame:
    """(*targets, callers, callees, flags): names around a symbol, at most 10, 12 and 6 of them."""
    refs = symbols.select(F.col("symbol_id").alias("caller"), "symbol_ref")
    wanted = broadcast_if_small(targets.select("symbol_id").distinct())
    up = callers(targets, calls, symbols, TRAIL_CALLERS, whole_text=True).join(refs, "caller")
    up = up.groupBy("symbol_id").agg(F.sort_array(F.collect_list(F.struct("n", "symbol_ref"))).alias("u"))

    def firsts(table: DataFrame, column: str, most: int, name: str) -> DataFrame:
        seen = table.filter(F.col(column).isNotNull()).join(wanted, "symbol_id", "left_semi").groupBy("symbol_id", column).agg(F.min("line_start").alias("line"))
        order = Window.partitionBy("symbol_id").orderBy("line", column)
        cut = seen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
        return cut.groupBy("symbol_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", column))), lambda x: x[column]).alias(name))

    empty = F.array().cast("array<string>")
    out = targets.join(up, "symbol_id", "left").join(firsts(calls, "call_text", TRAIL_CALLEES, "callees"), "symbol_id", "left").join(firsts(flags, "flag", TRAIL_FLAGS, "flags"), "symbol_id", "left")
    return out.select(*targets.columns, F.coalesce(F.transform("u", lambda x: x["symbol_ref"]), empty).alias("callers"), F.coalesce("callees", empty).alias("callees"), F.coalesce("flags", empty).alias("flags"))
