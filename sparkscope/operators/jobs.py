"""The work queue of models: what is queued for a change, in which order it runs, what of an answer is taken."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.operators import upkeep, vectors
from sparkscope.session import ship

JOB = "repo string, target_type string, target_id long, job_type string, model string, status string, priority int, input_hash string, tokens long, attempts int, error string"
OUTPUT = "repo string, target_type string, target_id long, model string, output_type string, json_text string, accepted boolean, rejected_reason string"
# Priorities by target, fields of answers that are taken.
ENRICHMENT = {"symbol": 50, "file": 100, "module": 150}
EMBEDDING = {"symbol": 200, "file": 250, "module": 300}
ACCEPTED = ("purpose", "summary", "behavior_aliases", "likely_queries", "search_tags")
MAX_ATTEMPTS = 3
ORDER = ("model", "repo", "priority", "target_type", "target_id")
FACTS_EMBEDDED, FACTS_OUTLINED = 100, 80


def _listed(value: Column, *order: str | Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"])


def texts(files: DataFrame, symbols: DataFrame, facts: DataFrame, modules: DataFrame, most_facts: int = FACTS_EMBEDDED, refs: bool = True) -> DataFrame:
    """(repo, target_type, target_id, text): what stands for each symbol, file and module.

    A symbol's own text; a file's path, language, first facts and symbols; a module's files with their symbols (full names
    with ``refs``, else bare ones). Each side is aggregated before it is joined.
    """
    of_symbols = symbols.select("repo", F.lit("symbol").alias("target_type"), F.col("symbol_id").alias("target_id"), F.col("primary_text").alias("text"))
    said = facts.groupBy("file_id").agg(F.array_join(F.slice(_listed(F.concat_ws("=", "fact_type", "value"), "line_start", "fact_type"), 1, most_facts), "; ").alias("facts"))
    line = F.concat(F.col("symbol_ref"), F.lit(" "), "symbol_type", F.lit(" "), "line_start", F.lit("-"), "line_end")
    held = symbols.groupBy("file_id").agg(F.array_join(_listed(line, "line_start", "symbol_ref"), "; ").alias("held"), F.array_join(_listed(F.col("symbol_ref" if refs else "name"), "line_start", "symbol_ref"), ", ").alias("names"))
    full = files.select("repo", "file_id", "path", "language").join(said, "file_id", "left").join(held, "file_id", "left").na.fill("", ["language", "facts", "held", "names"])
    of_files = full.select("repo", F.lit("file").alias("target_type"), F.col("file_id").alias("target_id"), F.concat(F.lit("path: "), "path", F.lit("\nlanguage: "), "language", F.lit("\nfacts: "), "facts", F.lit("\nsymbols: "), "held").alias("text"))
    inside = modules.select("repo", "module_id", "name", "path_prefix", F.explode("file_ids").alias("file_id")).join(full.select("file_id", "path", "names"), "file_id")
    joined = F.array_join(_listed(F.concat(F.col("path"), F.lit(" ["), "names", F.lit("]")), "path"), "; ")
    of_modules = inside.groupBy("repo", "module_id", "name", "path_prefix").agg(joined.alias("files"))
    of_modules = of_modules.select("repo", F.lit("module").alias("target_type"), F.col("module_id").alias("target_id"), F.concat(F.lit("module: "), "name", F.lit("\npath_prefix: "), "path_prefix", F.lit("\nfiles: "), "files").alias("text"))
    return of_symbols.unionByName(of_files).unionByName(of_modules)


def symbol_prompts(symbols: DataFrame, files: DataFrame, calls: DataFrame, literals: DataFrame, flags: DataFrame) -> DataFrame:
    """(target_id, prompt) of symbols: calls, literals and flags are listed each by itself, then joined."""

    def of(table: DataFrame, value: Column, name: str) -> DataFrame:
        return table.groupBy("symbol_id").agg(F.array_join(_listed(value, "line_start"), ", ").alias(name))

    every = symbols.join(files.select("file_id", "path"), "file_id")
    for table, value, name in ((calls, F.col("call_text"), "calls"), (literals, F.col("value"), "literals"), (flags, F.concat_ws(":", "flag", "evidence_value"), "flags")):
        every = every.join(of(table, value, name), "symbol_id", "left")
    every = every.withColumn("_lines", F.concat_ws("-", "line_start", "line_end"))
    parts = [("path", "path"), ("symbol", "symbol_ref"), ("lines", "_lines"), ("signature", "signature"), ("calls", "calls"), ("literals", "literals"), ("heuristic flags", "flags"), ("docstring", "docstring")]
    lines = [F.concat(F.lit(f"{title}: "), F.coalesce(F.col(c), F.lit(""))) for title, c in parts]
    asks = F.lit("Answer with one JSON object; its keys are among purpose, behavior_aliases and likely_queries.")
    return every.select(F.col("symbol_id").alias("target_id"), F.concat_ws("\n", *lines, F.lit("raw symbol code:"), F.substring("primary_text", 1, 6000), F.lit(""), asks).alias("prompt"))


def fan_out(targets: DataFrame, model: str, enrich: bool = False, summary_model: str = "") -> DataFrame:
    """Jobs for (repo, target_type, target_id, text): an embedding each and, if wanted, an enrichment."""

    def jobs(kind: Column, model: str, priorities: dict[str, int]) -> DataFrame:
        priority = F.coalesce(*[F.when(F.col("target_type") == t, p) for t, p in priorities.items()])
        return targets.select("repo", "target_type", "target_id", kind.alias("job_type"), F.lit(model).alias("model"), F.lit("pending").alias("status"), priority.alias("priority"), F.sha2("text", 256).alias("input_hash"), upkeep.token_estimate(F.col("text")).alias("tokens"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))

    out = jobs(F.lit("embedding"), model, EMBEDDING)
    return out.unionByName(jobs(F.concat("target_type", F.lit("_enrichment")), summary_model, ENRICHMENT)) if enrich else out


def runnable(jobs: DataFrame, enrichment: bool, limit: int | None = None) -> DataFrame:
    """Pending jobs of a sort, all of them or the first ``limit`` in the order of ORDER; failed enrichment comes again up
    to MAX_ATTEMPTS times."""
    is_enrichment = F.col("job_type").endswith("_enrichment")
    again = (F.col("status") == "error") & is_enrichment & (F.col("attempts") < MAX_ATTEMPTS)
    found = jobs.filter((is_enrichment if enrichment else ~is_enrichment) & ((F.col("status") == "pending") | again))
    return found if limit is None else found.orderBy(*ORDER).limit(limit)


def dealt(jobs: DataFrame) -> DataFrame:
    """The rows in ranges of ORDER, one a task and sorted in it: jobs of a model and repository run beside one another, and
    a repository with very many jobs takes several tasks."""
    return jobs.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def is_away(error: Column) -> Column:
    return F.coalesce(error.rlike(f"(?i){vectors.AWAY.pattern}"), F.lit(False))


def embed(todo: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """Run embedding jobs (*job, text): the jobs with their new status, and ``vector``.

    A call has at most ``batch`` texts of one model and repository. If it fails, its texts are tried one by one, and errors
    are their own; once the service is away, nothing more of the task is tried, and its jobs stay pending. Null texts count
    as empty.
    """
    fields = [c.split()[0] for c in JOB.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for frame in frames:
            for _, part in frame.groupby(["model", "repo"], sort=False, dropna=False):
                for at in range(0, len(part), batch):
                    own = part.iloc[at : at + batch]
                    found, errors, stopped = vectors.attempt(embedder, [t or "" for t in own["text"]], stopped)
                    yield own[fields].assign(error=errors, vector=found)

    ship(todo.sparkSession)
    ran = dealt(todo.select(*fields, "text")).mapInPandas(run, f"{JOB}, vector array<float>")
    pending = is_away(F.col("error"))
    status = F.when(pending, "pending").when(F.col("error").isNotNull(), "error").otherwise("done")
    return ran.withColumns({"status": status, "attempts": F.col("attempts") + F.when(pending, 0).otherwise(1)})


def enrich(prompts: DataFrame, generate: Callable[[str, str], object]) -> DataFrame:
    """Run ``generate(prompt, model)`` for each of (*job, prompt): the job with its new status, and its output.

    An answer is a dictionary, of which the fields in ACCEPTED are taken. An error that shows a service to be away leaves
    the job and all later ones of its partition pending; other errors are the job's own.
    """
    fields = [c.split()[0] for c in JOB.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for frame in frames:
            answers, taken, errors = [], [], []
            for prompt, model in zip(frame["prompt"], frame["model"]):
                answer = fault = None
                if stopped is None:
                    try:
                        answer = generate(prompt, model)
                    except Exception as e:  # the model's error is the job's
                        fault = str(e)
                        stopped = fault if vectors.AWAY.search(fault) else None
                failed = stopped or fault
                errors.append(failed)
                answers.append(None if failed is not None else json.dumps(answer, sort_keys=True, default=str))
                wanted = {k: answer[k] for k in ACCEPTED if k in answer} if isinstance(answer, dict) else None
                taken.append(None if wanted is None else json.dumps(wanted, sort_keys=True, default=str))
            yield frame[fields].assign(error=errors, _answer=answers, _taken=taken)

    ship(prompts.sparkSession)
    ran = dealt(prompts.select(*fields, "prompt")).mapInPandas(run, f"{JOB}, _answer string, _taken string")
    pending = is_away(F.col("error"))
    status = F.when(pending, "pending").when(F.col("error").isNotNull(), "error").otherwise("done")
    accepted = F.coalesce(F.col("_taken") != "{}", F.lit(False))
    reason = F.when(F.col("_answer").isNotNull() & ~accepted, F.when(F.col("_taken").isNull(), "not_json_object").otherwise("no_accepted_fields"))
    told = {"json_text": F.when(accepted, F.col("_taken")).otherwise(F.col("_answer")), "accepted": accepted, "rejected_reason": reason}
    return ran.withColumns({"status": status, "attempts": F.col("attempts") + F.when(pending, 0).otherwise(1), **told}).drop("_answer", "_taken")


def outputs(ran: DataFrame) -> DataFrame:
    return ran.filter("status = 'done'").select("repo", "target_type", "target_id", "model", F.col("job_type").alias("output_type"), "json_text", "accepted", "rejected_reason")


def may_embed(jobs: DataFrame) -> bool:
    """Embeddings run only once no enrichment is pending."""
    return jobs.filter(F.col("job_type").endswith("_enrichment") & F.col("status").isin("pending", "running")).isEmpty()
