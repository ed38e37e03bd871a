"""Fusion of rankings, exact lookup, relevance gate and size budget."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions.text import evidence_terms, fold, is_test, match_score, shortened
from sparkscope.operators import grams
from sparkscope.operators.sizes import broadcast_if_small
from sparkscope.session import written

RRF_K = 60
TYPE_PRIOR = {"symbol": 0.5, "file": 0.25}
TEST_PENALTY = 1.0
SEED_RATIO, SEEDS, MAX_SYMBOLS = 0.5, 5, 12
# Characters of a body that are shown, and what marks one that was cut.
SEED_CHARS, NEIGHBOR_CHARS = 1600, 600
TRUNCATED = "\n… (truncated — open for full body)"


def shown_body(body: Column, is_seed: Column) -> Column:
    """A symbol's body as explore shows it."""
    most = F.when(is_seed, SEED_CHARS).otherwise(NEIGHBOR_CHARS)
    return F.when(F.length(body) > most, F.concat(F.substr(body, F.lit(1), most), F.lit(TRUNCATED))).otherwise(body)


def candidates(lexical: DataFrame, semantic: DataFrame, on: list[str]) -> DataFrame:
    """Full outer merge of two ranked lists (query_id, *on, rank): lexical_rank, vector_rank, and ``position``.

    Lexical candidates come first, in their order, then those of the vectors only.
    """
    keys = ["query_id", *on]
    both = lexical.select(*keys, F.col("rank").alias("lexical_rank")).join(semantic.select(*keys, F.col("rank").alias("vector_rank")), keys, "full_outer")
    order = Window.partitionBy("query_id").orderBy(F.col("lexical_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), *on)
    return both.withColumn("position", F.row_number().over(order) - 1)


def evidence(query: Column, symbol: Column, path: Column, why: Column) -> Column:
    """How many terms of the question (repeated ones each) occur in the candidate's name, path or reason."""
    blank = F.lit("")
    text = F.translate(F.lower(F.concat_ws(" ", F.coalesce(symbol, blank), F.coalesce(path, blank), F.coalesce(why, blank))), "_", " ")
    return F.size(F.filter(evidence_terms(query), lambda t: F.contains(text, t)))


def evidence_of_all(questions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, symbol_id, evidence) of all (query_id, repo, query) and the (repo, symbol_id, symbol, path, why) of their
    repository: ``evidence``, with each different term looked for once in a symbol's text, not once for each question."""
    blank = F.lit("")
    asked = questions.select("query_id", "repo", evidence_terms(F.col("query")).alias("_terms"))
    wanted = asked.groupBy("repo").agg(F.array_distinct(F.flatten(F.collect_list("_terms"))).alias("_wanted"))
    text = F.translate(F.lower(F.concat_ws(" ", F.coalesce("symbol", blank), F.coalesce("path", blank), F.coalesce("why", blank))), "_", " ")
    # Two uses of the text keep it from being worked out for each term.
    held = symbols.select("repo", "symbol_id", text.alias("_text")).join(F.broadcast(wanted), "repo")  # a row for each repository
    held = held.select("repo", "symbol_id", F.when(F.length("_text") > 0, F.filter("_wanted", lambda t: F.contains("_text", t))).otherwise(F.array().cast("array<string>")).alias("_held"))
    return held.join(broadcast_if_small(asked), "repo").select("query_id", "symbol_id", F.size(F.filter("_terms", lambda t: F.array_contains("_held", t))).alias("evidence"))


def rerank(found: DataFrame, limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, query, position, lexical_rank, vector_rank, record_type, path, symbol, why).

    Adds evidence_rank, the five signals, score and final_rank. Equal scores keep the order of positions.
    """
    scored = found.withColumn("evidence", evidence(F.col("query"), F.col("symbol"), F.col("path"), F.col("why")))
    by_evidence = Window.partitionBy("query_id").orderBy(F.desc("evidence"), "position")
    scored = scored.withColumn("evidence_rank", F.when(F.col("evidence") > 0, F.row_number().over(by_evidence) - 1))

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (k + F.col(rank) + 1), F.lit(0.0))

    prior = F.lit(0.0)
    for kind, weight in TYPE_PRIOR.items():
        prior = F.when(F.col("record_type") == kind, weight / (k + 1)).otherwise(prior)
    penalty = F.when(is_test(F.col("path"), F.col("symbol")), -TEST_PENALTY / (k + 1)).otherwise(0.0)
    scored = scored.withColumns({"lexical": share("lexical_rank"), "semantic": share("vector_rank"), "by_evidence": share("evidence_rank"), "type_prior": prior, "test_penalty": penalty})
    scored = scored.withColumn("score", F.col("lexical") + F.col("semantic") + F.col("by_evidence") + F.col("type_prior") + F.col("test_penalty"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "position")
    out = scored.withColumn("final_rank", F.row_number().over(order) - 1)
    return out if limit is None else out.filter(F.col("final_rank") < limit)


def seeds(ranked: DataFrame, most: int = SEEDS, ratio: float = SEED_RATIO) -> DataFrame:
    """Symbols that are no tests: the first ``most`` of each question, less those under ``ratio`` of the best score."""
    symbols = ranked.filter((F.col("record_type") == "symbol") & ~is_test(F.col("path"), F.col("symbol")))
    order = Window.partitionBy("query_id").orderBy("final_rank")
    first = symbols.withColumn("seed_rank", F.row_number().over(order) - 1).filter(F.col("seed_rank") < most)
    return gate(first, ratio)


def gate(scored: DataFrame, ratio: float = SEED_RATIO) -> DataFrame:
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("_best", best).filter(F.col("score") >= ratio * F.col("_best")).drop("_best")


def within_budget(ordered: DataFrame, budget: Column, most: int = MAX_SYMBOLS, size: str = "size", position: str = "position") -> DataFrame:
    """The longest prefix of each question's rows with at most ``most`` rows and ``budget`` characters; the first always stays."""
    order = Window.partitionBy("query_id").orderBy(position)
    used = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = ordered.withColumns({"_used": used, "_n": F.row_number().over(order)})
    fits = (F.col("_n") == 1) | ((F.col("_n") <= most) & (F.col("_used") <= budget))
    return numbered.filter(fits).withColumnRenamed("_used", "used").drop("_n")


#: Columns that are searched for names.
SYMBOL_NAMES, CALL_NAMES, LITERAL_NAMES, PATH_NAMES = ("name", "qualified_name", "symbol_ref"), ("call_text", "function_name"), ("value",), ("path",)


def all_names(files: DataFrame, symbols: DataFrame, calls: DataFrame, literals: DataFrame) -> DataFrame:
    """(name_id, name) of all that ``find`` and ``resolve`` search."""
    return grams.different((files, PATH_NAMES), (symbols, SYMBOL_NAMES), (calls, CALL_NAMES), (literals, LITERAL_NAMES))


#: Targets of each repository, the first by path, whose rows are read for a token before its names are looked up.
AHEAD = 256


def first_sites(rows: DataFrame, columns: tuple[str, ...], value: Column, wanted: DataFrame, places: DataFrame, names: Callable[[], grams.Names], limit: int, what: str) -> DataFrame:
    """(symbol_id, token) of the first ``limit`` targets, by score and path, of each of ``wanted`` (repo, token): those that
    one of ``columns`` of ``rows`` (symbol_id, …) holds, with the score of ``value``. places: (repo, symbol_id, path).

    There are four rounds, each for the tokens that have found fewer than ``limit`` targets so far: values that are a token;
    values that begin with one; all rows of each repository's first targets by path; all rows with a name that holds a token,
    by the index ``names``. No target of a later round that was not found before stands before those of an earlier one. So
    rows meet tokens, and go through no shuffle before they have been found, as long as tokens are few, and common ones,
    which many names hold, need no names. Targets with equal places in the order (repeated ids) are one target.
    """
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in columns}).select("symbol_id", *columns, F.lower(F.coalesce(value, F.lit(""))).alias("_value"))
    held = reduce(Column.__or__, [F.contains(fold(F.col(c)), fold(F.col("token"))) for c in columns])
    minus = -match_score(F.col("token"), F.col("_value"))

    def words(left: DataFrame, key: Column) -> DataFrame:
        return left.select("token").distinct().withColumn("_low", F.lower("token")).withColumn("_key", key)

    def same(left: DataFrame) -> DataFrame:
        return rows.withColumn("_key", F.col("_value")).join(broadcast_if_small(words(left, F.col("_low"))), "_key").filter(held)

    def prefixes(left: DataFrame) -> DataFrame:
        begun = words(left, F.substring("_low", 1, grams.GRAM))
        lengths = sorted(r[0] for r in begun.select(F.length("_key")).distinct().collect())
        begins = F.array(*[F.substring("_value", 1, n) for n in lengths])
        return rows.withColumn("_key", F.explode(begins)).join(broadcast_if_small(begun), "_key").filter(F.startswith("_value", "_low") & held)

    def ahead(left: DataFrame) -> DataFrame:
        order = Window.partitionBy("repo").orderBy("path", "symbol_id")
        some = places.join(broadcast_if_small(left.select("repo").distinct()), "repo", "left_semi").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= AHEAD)
        some = written(some.select("repo", "symbol_id").distinct(), f"ahead-{what}")
        return rows.join(broadcast_if_small(some), "symbol_id").distinct().join(broadcast_if_small(left), "repo").filter(held & (minus < 0))

    def rest(left: DataFrame) -> DataFrame:
        hits = written(grams.lookup(left.select("token"), names()), f"found-names-{what}")
        return grams.holding(rows, list(columns), hits)

    found, left = None, wanted
    for n, sites in enumerate((same, prefixes, ahead, rest)):
        best = sites(left).groupBy("symbol_id", "token").agg(F.min(minus).alias("minus"))
        best = best.join(places, "symbol_id").join(broadcast_if_small(left), ["repo", "token"], "left_semi")
        order = Window.partitionBy("repo", "token").orderBy("minus", "path", "symbol_id")
        best = written(best.withColumn("_at", F.dense_rank().over(order)).filter(F.col("_at") <= limit).drop("_at"), f"first-{what}-{n}")
        found = best if found is None else found.unionByName(best)
        done = found.filter("minus < 0").groupBy("repo", "token").agg(F.count_distinct("path", "symbol_id").alias("_n")).filter(F.col("_n") >= limit)
        left = written(left.join(done, ["repo", "token"], "left_anti"), f"left-{what}-{n}")
        if left.isEmpty():
            break
    found = found.groupBy("repo", "token", "symbol_id", "path").agg(F.min("minus").alias("minus"))
    order = Window.partitionBy("repo", "token").orderBy("minus", "path", "symbol_id")
    return written(found.withColumn("_at", F.dense_rank().over(order)).filter(F.col("_at") <= limit).select("symbol_id", "token").distinct(), f"near-{what}")


def find(questions: DataFrame, files: DataFrame, symbols: DataFrame, calls: DataFrame, literals: DataFrame, kinds: tuple[str, ...] = ("symbol", "call", "literal", "path"), limit: int = 10, names: grams.Names | Callable[[str], grams.Names] | None = None) -> DataFrame:
    """Exact lookup of each question's token in names, calls, literals and paths: the best reason for each target.

    Matching ignores ASCII case and takes the token literally. Scores: 100 same, 60 prefix, 30 part; 5 more for a
    definition, 10 less for a literal. Of equal scores of a target, the earlier kind wins, then the earlier line.
    Unknown kinds find nothing. ``names`` is the index of all that is searched, or gives the one of a kind when it is
    asked for; without it one is made of the tables. Of symbols, calls and literals the targets are found first
    (``first_sites``), and whole rows are worked out for these alone.
    """
    asked = questions.select("query_id", "repo", F.trim("text").alias("token")).filter("token <> ''")
    wanted = written(asked.select("repo", "token").filter("repo IS NOT NULL").distinct(), "wanted")
    searched = {"symbol": (symbols, SYMBOL_NAMES), "call": (calls, CALL_NAMES), "literal": (literals, LITERAL_NAMES), "path": (files, PATH_NAMES)}

    def known(kind: str) -> grams.Names:
        return names(kind) if callable(names) else names or grams.index(grams.different(searched[kind]))

    owner = symbols.join(files.select("file_id", "path"), "file_id")
    places = written(owner.select("repo", "symbol_id", "path").distinct(), "places") if {"symbol", "call", "literal"} & set(kinds) else None

    def holds(columns: tuple[str, ...]) -> Column:
        return reduce(Column.__or__, [F.contains(fold(F.coalesce(c, F.lit(""))), fold(F.col("token"))) for c in columns])

    def chosen(near: DataFrame) -> DataFrame:
        """The symbols of the first targets."""
        some = symbols.join(broadcast_if_small(near.select("symbol_id").distinct()), "symbol_id", "left_semi").join(files.select("file_id", "path"), "file_id")
        return some.select("repo", "symbol_id", "path", F.col("symbol_ref").alias("symbol"), "name", "qualified_name", "signature", "line_start", "line_end")

    def sites(kind: str, rows: DataFrame, value: Column, bonus: int, why: Column, tie: str) -> DataFrame:
        """The best row of each of the first targets and tokens, with the symbol and the questions of its repository."""
        columns = searched[kind][1]
        near = first_sites(rows, columns, value, wanted, places, lambda: known(kind), limit, kind)
        plain = rows.join(broadcast_if_small(near.select("symbol_id").distinct()), "symbol_id", "left_semi").withColumns({c: F.coalesce(c, F.lit("")) for c in columns})
        first = F.min(F.struct((-(match_score(F.col("token"), value) + bonus)).alias("minus"), "line", F.col(tie).alias("tie"), why.alias("why"))).alias("_first")
        best = plain.join(broadcast_if_small(near), "symbol_id").filter(holds(columns)).groupBy("symbol_id", "token").agg(first)
        best = best.select("symbol_id", "token", (-F.col("_first.minus")).alias("score"), "_first.line", "_first.tie", "_first.why")
        return best.join(chosen(near), "symbol_id").join(asked, ["repo", "token"])

    branches = []
    target = [F.col("query_id"), F.lit("symbol").alias("record_type"), F.col("symbol_id").alias("target_id"), F.col("path"), F.col("symbol"), F.col("signature"), F.col("line_start"), F.col("line_end")]
    if "symbol" in kinds:
        near = first_sites(symbols.select("symbol_id", *SYMBOL_NAMES), SYMBOL_NAMES, F.col("name"), wanted, places, lambda: known("symbol"), limit, "symbol")
        hits = chosen(near).join(broadcast_if_small(near), "symbol_id").filter(holds(("name", "qualified_name", "symbol"))).join(asked, ["repo", "token"])
        branches.append(hits.select(*target, F.lit("definition").alias("why"), (match_score(F.col("token"), F.col("name")) + 5).alias("score"), F.lit(0).alias("kind_order"), F.lit(0).alias("line"), F.lit("").alias("tie")))
    if "call" in kinds:
        value = F.coalesce(F.when(F.col("function_name") != "", F.col("function_name")), F.col("call_text"))
        hits = sites("call", calls.select("symbol_id", "call_text", "function_name", F.col("line_start").alias("line")), value, 0, F.concat(F.lit("call site: "), F.col("call_text")), "call_text")
        branches.append(hits.select(*target, "why", "score", F.lit(1).alias("kind_order"), "line", "tie"))
    if "literal" in kinds:
        hits = sites("literal", literals.select("symbol_id", "value", F.col("line_start").alias("line")), F.col("value"), -10, F.concat(F.lit("literal: "), shortened(F.col("value"))), "value")
        branches.append(hits.select(*target, "why", "score", F.lit(2).alias("kind_order"), "line", "tie"))
    if "path" in kinds or not branches:
        hits = written(grams.lookup((asked if "path" in kinds else asked.limit(0)).select("token"), known("path")), "found-names")
        hits = grams.holding(files.select("repo", "file_id", "path", "line_count"), list(PATH_NAMES), hits).join(asked, ["repo", "token"]).filter(F.lit("path" in kinds))
        none = F.lit(None).cast("string")
        branches.append(hits.select("query_id", F.lit("file").alias("record_type"), F.col("file_id").alias("target_id"), "path", none.alias("symbol"), none.alias("signature"), F.lit(1).alias("line_start"), F.least(F.col("line_count"), F.lit(80)).alias("line_end"), F.lit("path").alias("why"), match_score(F.col("token"), F.col("path")).alias("score"), F.lit(3).alias("kind_order"), F.lit(0).alias("line"), F.lit("").alias("tie")))
    found = branches[0]
    for b in branches[1:]:
        found = found.unionByName(b)
    own = Window.partitionBy("query_id", "record_type", "target_id").orderBy(F.desc("score"), "kind_order", "line", "tie")
    best = found.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n", "line", "tie")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "kind_order", "path", "target_id")
    return best.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < limit).drop("kind_order")
