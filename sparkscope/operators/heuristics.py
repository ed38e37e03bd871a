"""Behaviour flags of symbols, from the verbs in the names that they call and the classes of receivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions.text import fold, identifier_runs, last_segment, subwords

# Verbs by flag, names of receivers by class, and rules that need both.
VERBS = {
    "destructive_clear": ("drop", "truncate", "destroy", "purge", "wipe", "clear", "erase", "reset"),
    "destructive_delete": ("delete", "remove", "discard", "unlink", "prune", "pop"),
    "append_write": ("append", "push", "extend", "concat"),
    "insert_write": ("insert", "create", "register"),
    "update_write": ("update", "upsert", "patch", "modify", "edit", "replace"),
    "overwrite_write": ("write", "overwrite", "save", "store", "persist", "dump", "flush", "commit"),
    "data_read": ("read", "load", "fetch", "select", "query", "find", "list", "scan"),
    "network_call": ("request", "send", "download", "upload", "connect"),
    "vector_search": ("search", "knn", "ann", "similarity", "retrieve", "cosine", "euclidean", "manhattan"),
    "embedding_call": ("embed", "embedding", "vectorize"),
    "generation_call": ("generate", "complete", "completion", "chat", "prompt", "llm", "agent"),
}
RECEIVERS = {
    "db": ("db", "database", "session", "sess", "repo", "repository", "store", "dao", "cursor", "conn", "connection", "table", "collection", "coll", "model", "orm", "sql", "redis", "cache", "mongo", "postgres", "pg", "sqlite", "engine"),
    "net": ("client", "http", "https", "api", "request", "requests", "urllib", "httpx", "axios", "socket", "sock", "ws", "websocket", "url", "rpc", "grpc", "channel", "session", "gateway", "service", "svc", "backend", "remote", "upstream", "endpoint", "bucket", "transport", "gql", "graphql"),
    "fs": ("path", "file", "fs", "os", "io", "dir", "directory", "stream", "handle", "fh", "fp", "shutil", "tempfile", "glob"),
}
GATED = (
    ("net", ("get", "post", "put", "patch", "head", "delete", "fetch", "request", "send", "connect", "open", "stream", "download", "upload"), "network_call"),
    ("db", ("get", "find", "list", "scan", "load", "fetch", "select", "query", "read"), "data_read"),
    ("db", ("set", "put", "save", "store", "write"), "overwrite_write"),
    ("fs", ("open", "read", "write", "close", "create", "remove", "copy", "move", "rename", "mkdir", "makedirs", "scandir", "listdir"), "filesystem_access"),
)
JOB_WORKERS = ("job", "jobs", "task", "tasks", "worker", "workers")
JOB_DEFERS = ("queue", "enqueue", "background", "async", "defer", "dispatch", "schedule", "spawn", "delay")
JOB_STRONG = ("enqueue", "dispatch", "schedule", "spawn")
GUARD_NOTE = "confirmed/yes guard near destructive call"


def name_tokens(name: Column) -> Column:
    return F.transform(F.flatten(F.transform(identifier_runs(name), subwords)), F.lower)


def _any(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def call_flags(function_name: Column, receiver: Column) -> Column:
    """Flags of one call, in the order of the rules, each once."""
    verbs, owner = name_tokens(function_name), name_tokens(receiver)
    flags = [F.when(_any(verbs, words), flag) for flag, words in VERBS.items()]
    flags.append(F.when(_any(verbs, JOB_STRONG) | _any(verbs, JOB_WORKERS) & _any(verbs, JOB_DEFERS), "background_job"))
    flags += [F.when(_any(owner, RECEIVERS[kind]) & _any(verbs, words), flag) for kind, words, flag in GATED]
    return F.array_distinct(F.array_compact(F.array(*flags)))


def flag_calls(calls: DataFrame) -> DataFrame:
    """(symbol_id, flag, evidence_type, evidence_value, line_start, line_end): once for each symbol, flag and call text."""
    name = F.coalesce(F.when(F.col("function_name") != "", F.col("function_name")), last_segment(F.col("call_text")))
    rows = calls.withColumn("flag", F.explode(call_flags(name, F.col("receiver"))))
    own = Window.partitionBy("symbol_id", "flag", "call_text").orderBy("line_start", "line_end")
    first = rows.withColumn("_n", F.row_number().over(own)).filter("_n = 1")
    return first.select("symbol_id", "flag", F.lit("call").alias("evidence_type"), F.col("call_text").alias("evidence_value"), "line_start", "line_end")


def confirmation_gates(symbols: DataFrame, flags: DataFrame) -> DataFrame:
    """A flag for symbols that call something destructive and ask for confirmation in their signature or text."""
    guard = F.lit(False)
    for column, part in (("signature", "yes"), ("signature", "confirm"), ("primary_text", "--yes"), ("primary_text", "confirmed")):
        guard = guard | F.contains(fold(F.coalesce(F.col(column), F.lit(""))), F.lit(part))
    risky = flags.filter(F.col("flag").isin("destructive_clear", "destructive_delete")).select("symbol_id")
    return symbols.filter(guard).join(risky, "symbol_id", "left_semi").select("symbol_id", F.lit("confirmation_gate").alias("flag"), F.lit("signature_or_text").alias("evidence_type"), F.lit(GUARD_NOTE).alias("evidence_value"), "line_start", "line_end")


def all_flags(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    flags = flag_calls(calls)
    return flags.unionByName(confirmation_gates(symbols, flags))


def reasons(flags: DataFrame, calls: DataFrame, most: int = 3) -> DataFrame:
    """(symbol_id, why): up to three flags with evidence, then calls; three in all, each once."""

    def first(table: DataFrame, value: Column, part: int) -> DataFrame:
        order = Window.partitionBy("symbol_id").orderBy("line_start", "value")
        cut = table.select("symbol_id", "line_start", value.alias("value")).withColumn("n", F.row_number().over(order))
        return cut.filter(F.col("n") <= most).select("symbol_id", F.struct(F.lit(part).alias("part"), "n", "value").alias("r"))

    both = first(flags, F.concat("flag", F.lit(" ("), "evidence_value", F.lit(")")), 0).unionByName(first(calls, F.col("call_text"), 1))
    listed = F.transform(F.sort_array(F.collect_list("r")), lambda r: r["value"])
    return both.groupBy("symbol_id").agg(F.array_join(F.slice(F.array_distinct(listed), 1, most), ", ").alias("why"))
