"""Keeping an index up to date: change detection, upserts, cascading deletes, modules, rules, the work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions.paths import rule_priority
from sparkscope.functions.text import directory

STATUSES = ("pending", "running", "done", "error")


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, change): added, deleted, changed or unchanged. Unchanged needs the same sha256 and mtime_ns."""
    old = before.select(*keys, F.col("sha256").alias("_sha"), F.col("mtime_ns").alias("_mtime"), F.lit(True).alias("_old"))
    new = after.select(*keys, "sha256", "mtime_ns", F.lit(True).alias("_new"))
    same = (F.col("sha256") == F.col("_sha")) & (F.col("mtime_ns") == F.col("_mtime"))
    change = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNull(), "added").when(same, "unchanged").otherwise("changed")
    return old.join(new, keys, "full_outer").select(*keys, change.alias("change"))


def stale(indexed: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose content on disk differs from the index; missing and unreadable files are not stale."""
    now = current.select(*keys, F.col("sha256").alias("_now"))
    return indexed.join(now, keys).filter(F.col("_now").isNotNull() & (F.col("sha256") != F.col("_now"))).select(*keys)


def latest(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The last row of each key: an upsert over a log of rows. Rows of equal order are told apart by their content."""
    rest = [c for c in rows.columns if c not in {*keys, order}]
    best = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in rest])
    return rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given files and what hangs on them: symbols, calls, literals, facts, flags, vectors, jobs."""
    out = dict(tables)
    ids = files.select("file_id").distinct()
    symbols = tables["symbols"].join(ids, "file_id", "left_semi").select("symbol_id")
    for name in ("files", "symbols", "file_facts"):
        out[name] = without(tables[name], ids, ["file_id"])
    for name in ("symbol_calls", "symbol_literals", "heuristic_flags"):
        out[name] = without(tables[name], symbols, ["symbol_id"])
    targets = ids.select(F.lit("file").alias("target_type"), F.col("file_id").alias("target_id")).unionByName(symbols.select(F.lit("symbol").alias("target_type"), F.col("symbol_id").alias("target_id")))
    for name in ("vectors", "jobs", "model_outputs"):
        if name in tables:
            out[name] = without(tables[name], targets, ["target_type", "target_id"])
    return out


def under(path: Column, prefix: Column) -> Column:
    """Whether a path lies in a directory; everything lies in the root."""
    return (prefix == "") | path.startswith(F.concat(prefix, F.lit("/")))


def modules(files: DataFrame) -> DataFrame:
    """(repo, name, path_prefix, file_ids, files): one for each directory that holds files."""
    grouped = files.groupBy("repo", directory(F.col("path")).alias("path_prefix")).agg(F.sort_array(F.collect_set("file_id")).alias("file_ids"))
    return grouped.select("repo", F.translate("path_prefix", "/", ".").alias("name"), "path_prefix", "file_ids", F.size("file_ids").cast("long").alias("files"))


def dirty_modules(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path_prefix, state): modules that are new, gone, or have other files than before."""
    keys = ["repo", "path_prefix"]
    old = before.select(*keys, F.col("file_ids").alias("_old"))
    joined = old.join(after.select(*keys, "file_ids"), keys, "full_outer")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("file_ids").isNull(), "gone").when(F.col("_old") != F.col("file_ids"), "dirty")
    return joined.select(*keys, state.alias("state")).filter("state IS NOT NULL")


def ancestors(path: Column) -> Column:
    """The path and every directory above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def matching_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths`` (repo, path) with the manual rule that decides: rule_action, rule_kind, rule_path; null without one.

    Paths meet rules by equality with one of their ancestors. Highest priority wins, then the longest path, then the
    newest rule.
    """
    clean = rules.select("repo", F.rtrim("path", F.lit("/")).alias("rule_path"), F.col("path_kind").alias("rule_kind"), F.col("action").alias("rule_action"), F.col("ord").alias("_ord"))
    met = paths.select("repo", "path", F.explode(ancestors(F.col("path"))).alias("rule_path")).join(clean, ["repo", "rule_path"])
    met = met.withColumn("_priority", rule_priority(F.col("rule_path"), F.col("rule_kind"), F.col("rule_action"), F.col("path"))).filter("_priority IS NOT NULL")
    best = Window.partitionBy("repo", "path").orderBy(F.desc("_priority"), F.desc(F.length("rule_path")), F.desc("_ord"))
    first = met.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("repo", "path", "rule_action", "rule_kind", "rule_path")
    return paths.join(first, ["repo", "path"], "left")


def decide(paths: DataFrame) -> DataFrame:
    """Precedence over (rule_action, rule_kind, ignored, auto): manual include, ignored, manual exclude, automatic."""
    manual = lambda action: F.concat(F.lit("manual_"), F.col("rule_kind"), F.lit(f"_{action}"))
    kind = F.col("auto.kind")
    include = F.struct(F.lit("include").alias("decision"), manual("include").alias("reason"), F.col("kind").alias("kind"))
    ignored = F.struct(F.lit("exclude").alias("decision"), F.lit("gitignored").alias("reason"), F.col("kind").alias("kind"))
    exclude = F.struct(F.lit("exclude").alias("decision"), manual("exclude").alias("reason"), kind.alias("kind"))
    chain = F.when(F.col("rule_action") == "include", include).when(F.col("ignored"), ignored).when(F.col("rule_action") == "exclude", exclude).otherwise(F.col("auto"))
    return paths.withColumn("_d", chain).select(*[c for c in paths.columns if c not in ("auto", "kind")], "_d.*").drop("_d")


def enqueue(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Those of ``wanted`` jobs that are not there yet: same target, type, model and input hash count as the same."""
    keys = ["target_type", "target_id", "job_type", "model", "input_hash"]
    return wanted.dropDuplicates(keys).join(jobs.select(*keys).distinct(), keys, "left_anti").select(*wanted.columns)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def queue_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("model", "job_type", "status").agg(F.count("*").alias("count"))


def queue_summary(jobs: DataFrame) -> DataFrame:
    """By job type: a count for each status, total, remaining and percent_done (100 for an empty queue)."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]
    grouped = jobs.groupBy("job_type").agg(*counts, F.count("*").alias("total"))
    percent = F.when(F.col("total") == 0, 100.0).otherwise(F.round(F.col("done") / F.col("total") * 100, 1))
    return grouped.withColumns({"remaining": F.col("total") - F.col("done"), "percent_done": percent})
