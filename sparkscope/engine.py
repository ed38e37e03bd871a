"""The engine: repositories are indexed into tables of segments, and questions are answered from them.

A refresh compares the tree with the index and writes segments for what has changed only: rows of changed files and of
the modules that they are in, and tombstones for the rows before. It is seen once its manifest is switched, so no plan
reads what it overwrites and an interrupted refresh leaves the index as it was.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscope.functions import paths as P
from sparkscope.functions import text as T
from sparkscope.operators import graph, grams, heuristics, jobs, lexical, ranking, targets, upkeep, vectors
from sparkscope.settings import Settings
from sparkscope.sources import extract, files as stored, tree
from sparkscope.sources.segments import Change, Kept, Store

_OF_FILE, _OF_SYMBOL = Kept("file", ("file_id",)), Kept("file", ("file_id",), hidden=("file_id",))
_TARGET = ("target_type", "target_id")
TABLES = {
    "files": _OF_FILE, "symbols": _OF_FILE, "file_facts": _OF_FILE, "symbol_calls": _OF_SYMBOL, "symbol_literals": _OF_SYMBOL, "heuristic_flags": _OF_SYMBOL,
    "modules": Kept("module", ("module_id",)), "path_audit": Kept("path", ("path",)),
    "vectors": Kept("vector", _TARGET), "jobs": Kept("job", _TARGET), "model_outputs": Kept("output", _TARGET),
    "fts_docs": Kept("text", ("target_id",)), "postings": Kept("text", ("target_id",), folders=("part",), order=("term",)), "vocabulary": Kept(),
    "names": Kept(), "name_lists": Kept(folders=("part",), order=("gram",)), "name_counts": Kept(),
}
RULES = "repo string, path string, path_kind string, action string, reason string, ord long"
HANDLE = "result_id string, repo string, type string, target_id long, path string, symbol_ref string, line_start int, line_end int"
KNOWN = "path string, decision string, reason string, kind string, size long, file_id long, sha256 string, mtime_ns long"
FLAGS_SHOWN, LISTED = 4, 80


class Engine:
    def __init__(self, spark: SparkSession, store: str, embedder=None, settings: Settings | None = None):
        self.spark, self.store, self.settings = spark, store, settings or Settings()
        self.embedder = embedder or vectors.hashing_embedder()
        self.tables = Store(spark, store, TABLES)

    # State -----------------------------------------------------------------------------------------------------------

    def _json(self, name: str, value=None):
        if value is not None:
            stored.write_text(self.spark, f"{self.store}/{name}", json.dumps(value, indent=2, sort_keys=True))
            return value
        return json.loads(stored.read_text(self.spark, f"{self.store}/{name}") or "{}")

    def repos(self) -> dict:
        return self._json("repos.json")

    def register(self, root: str, slug: str | None = None) -> dict:
        """Register a tree, or give a known name another root."""
        root = os.path.abspath(root)
        slug = slug or os.path.basename(root)
        repos = self.repos()
        repos[slug] = {"root": root, "head": tree.head(root), "registered": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        self._json("repos.json", repos)
        return {"ok": True, "repo": slug, **repos[slug]}

    def table(self, name: str, repos: list[str] | None = None) -> DataFrame | None:
        """A table of all repositories or of some; None before anything was indexed."""
        return self.tables.table(name, repos)

    def index(self) -> lexical.Index:
        return lexical.Index(self.table("postings").withColumnRenamed("target_id", "doc"), self.table("fts_docs").select(F.col("target_id").alias("doc"), "dl"), self.table("vocabulary").drop("repo").distinct())

    def names(self) -> grams.Names:
        """The index of names; it also holds some that no row has any more."""
        return grams.Names(*[self.table(n).drop("repo") for n in ("names", "name_lists", "name_counts")])

    def rules(self) -> DataFrame:
        rows = [(r["repo"], r["path"], r["path_kind"], r["action"], r.get("reason"), i) for i, r in enumerate(self._json("rules.json").get("rules", []))]
        return self.spark.createDataFrame(rows, RULES)

    def rule(self, repo: str, path: str, path_kind: str, action: str, reason: str | None = None, remove: bool = False) -> dict:
        """Add (or renew) or remove a manual rule, and look again at the paths that it covers."""
        path = normal_path(path)
        key = {"repo": repo, "path": path, "path_kind": path_kind, "action": action}
        old = self._json("rules.json").get("rules", [])
        rules = [r for r in old if {k: r[k] for k in key} != key]
        self._json("rules.json", {"rules": rules if remove else [*rules, {**key, "reason": reason}]})
        done = self.refresh(repo, within=path)
        return {**done, **key, "removed": len(rules) < len(old) if remove else False}

    def vacuum(self) -> dict:
        """Merge every table into one segment a repository, and delete what no reader needs and work in progress."""
        gone = 0
        for repo in self.tables.repos():
            self.tables.begin(repo).compact()
            gone += self.tables.vacuum(repo)
        for n in stored.names(self.spark, self.store):
            if n.startswith("_work-"):
                stored.delete(self.spark, f"{self.store}/{n}")
        return {"ok": True, "deleted": gone}

    def reset(self) -> dict:
        """Forget everything: repositories, rules, handles and tables."""
        for n in stored.names(self.spark, self.store):
            stored.delete(self.spark, f"{self.store}/{n}")
        return {"ok": True}

    def delete_repo(self, slug: str) -> dict:
        """Remove a repository with all that hangs on it."""
        self.tables.drop(slug)
        for name, drop in (("repos.json", lambda x: {k: v for k, v in x.items() if k != slug}), ("handles.json", lambda x: {k: v for k, v in x.items() if k != slug}), ("rules.json", lambda x: {"rules": [r for r in x.get("rules", []) if r["repo"] != slug]})):
            self._json(name, drop(self._json(name)))
        return {"ok": True, "deleted": slug}

    def _written(self, rows: DataFrame, work: str) -> DataFrame:
        """``rows`` as a table of work in progress."""
        path = f"{work}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # Indexing --------------------------------------------------------------------------------------------------------

    def classified(self, slug: str, within: str = "") -> DataFrame:
        """(repo, path, decision, reason, kind, size, mtime_ns, sha256, language) of every file in the tree, or in a part of it."""
        root, most = self.repos()[slug]["root"], self.settings.max_file_bytes
        listed = tree.list_files(root)
        ignored = sorted(tree.ignored(root, listed)) if self.settings.respect_gitignore else []
        left_out = self.spark.createDataFrame([(p,) for p in ignored], "path string").withColumn("ignored", F.lit(True))
        read = tree.read_files(self.spark, root, slug, [p for p in listed if not within or p == within or p.startswith(f"{within}/")], most, content=False)
        kind = P.kind_of(F.col("path"))
        auto = P.decision(F.col("path"), F.col("size"), F.col("sample"), most)
        ruled = upkeep.matching_rules(read, self.rules()).join(left_out, "path", "left")
        ruled = ruled.withColumns({"ignored": F.coalesce("ignored", F.lit(False)), "kind": kind, "auto": auto})
        language = P.language_of(F.col("path"), F.make_valid_utf8(F.col("sample").cast("string")))
        return upkeep.decide(ruled).withColumn("language", language)

    def _differences(self, slug: str, within: str, full: bool) -> DataFrame:
        """(path, change, and both states) of the paths that differ from the index, all known ones if ``full``.

        change: added, changed or deleted for files of the index (unchanged if only ``full`` brings them up), null for
        paths of which the decision alone differs.
        """
        audit = self.table("path_audit", [slug])
        if audit is None:
            old = self.spark.createDataFrame([], KNOWN)
        else:
            old = audit.join(self.table("files", [slug]).select("path", "file_id", "sha256", "mtime_ns"), "path", "left").filter(covered(F.col("path"), within)).select(*[c.split()[0] for c in KNOWN.split(", ")])
        old = old.select("path", *[F.col(c).alias(f"old_{c}") for c in old.columns if c != "path"], F.lit(True).alias("_old"))
        seen = self.classified(slug, within).select("path", "decision", "reason", "kind", "size", "mtime_ns", "sha256", "language", F.lit(True).alias("_new"))
        both = seen.join(old, "path", "full_outer")
        wanted, had = (F.col("decision") == "include") & F.col("sha256").isNotNull(), F.col("old_file_id").isNotNull()
        wanted = F.coalesce(wanted, F.lit(False))
        same = (F.col("sha256") == F.col("old_sha256")) & (F.col("mtime_ns") == F.col("old_mtime_ns"))
        change = F.when(wanted & ~had, "added").when(~wanted & had, "deleted").when(wanted & ~same, "changed").when(wanted, "unchanged")
        of = lambda prefix: F.struct(*[F.col(f"{prefix}{c}") for c in ("decision", "reason", "kind", "size")])
        moved = ~(of("").eqNullSafe(of("old_"))) | F.col("_new").isNull() | F.col("_old").isNull()
        both = both.withColumns({"change": change, "audit": moved})
        return both if full else both.filter((F.col("change") != "unchanged") | F.col("audit"))

    def refresh(self, slug: str, full: bool = False, within: str = "", enrich: bool = False) -> dict:
        """Bring a repository's index up to date; ``full`` reads every file anew, ``within`` looks at one path or folder only."""
        if slug not in self.repos():
            return {"ok": False, "error": "repo_not_registered", "message": f"No repo registered as {slug}."}
        work, spark = f"{self.store}/_work-{uuid.uuid4().hex}", self.spark
        before = lambda name: self.table(name, [slug])
        delta = self._written(self._differences(slug, within, full), work)
        known = before("files")
        mine = known.filter(covered(F.col("path"), within)).count() if known is not None else 0
        if known is not None and delta.isEmpty():
            stored.delete(spark, work)
            return {"ok": True, "repo": slug, "added": 0, "changed": 0, "deleted": 0, "unchanged": mine, "modules_changed": 0}
        touched = delta.filter(F.col("change").isNotNull() if full else F.col("change").isin("added", "changed", "deleted"))
        counts = {r["change"]: r["count"] for r in delta.filter("change IS NOT NULL").groupBy("change").count().collect()}
        counts["unchanged"] = mine - counts.get("changed", 0) - counts.get("deleted", 0)
        ids = self._written(touched.select("path", F.xxhash64(F.lit(slug), "path").alias("file_id"), T.directory(F.col("path")).alias("folder")), work)
        folders = ids.select("folder").distinct()
        old_symbols = known is not None and before("symbols").join(ids.select("file_id"), "file_id", "left_semi").select("symbol_id")
        old_modules = before("modules").join(folders, F.col("path_prefix") == F.col("folder"), "left_semi") if known is not None else None
        old_modules = self._written(old_modules, work) if old_modules is not None else None
        gone_symbols = self._written(old_symbols, work) if known is not None else spark.createDataFrame([], "symbol_id long")

        change = self.tables.begin(slug)
        now = change.table
        audit = delta.filter("audit AND _new").select("path", "decision", "reason", "kind", "size")
        reading = touched.filter("change <> 'deleted'").select("path", "language")
        content = tree.read_files(spark, self.repos()[slug]["root"], slug, reading.select("path"), self.settings.max_file_bytes).filter("content IS NOT NULL").join(reading, "path")
        modules_of = folders.select(F.xxhash64(F.lit(slug), "folder").alias("module_id"))
        change.kill(path=delta.filter("audit").select("path"), file=ids, module=modules_of)
        fresh = self._tables(content, work)
        names = self._written(ranking.all_names(*[fresh[n] for n in ("files", "symbols", "symbol_calls", "symbol_literals")]), work)
        lists = self._written(grams.lists(names), work)
        change.add(path_audit=audit, **fresh, names=names, name_lists=lists, name_counts=grams.counts(lists))

        # What stands for a file or a module needs the files of its folder, and no others.
        near = now("files").withColumn("folder", T.directory(F.col("path"))).join(folders, "folder", "left_semi").drop("folder")
        inside = near.select("file_id")
        modules = self._written(upkeep.modules(near).withColumn("module_id", F.xxhash64("repo", "path_prefix")), work)
        dirty = upkeep.dirty_modules(old_modules, modules).count() if old_modules is not None else modules.count()
        scope = {"files": near, "modules": modules, **{n: now(n).join(inside, "file_id", "left_semi") for n in ("symbols", "file_facts")}}

        # Targets that have changed: files, their symbols before and now, and the modules that they are in.
        target = lambda kind, rows, of: rows.select(F.lit(kind).alias("target_type"), of.alias("target_id"))
        fresh_symbols = scope["symbols"].join(ids.select("file_id"), "file_id", "left_semi").select("symbol_id")
        changed = target("file", ids, F.col("file_id")).unionByName(target("module", folders, F.xxhash64(F.lit(slug), "folder")))
        changed = changed.unionByName(target("symbol", fresh_symbols.unionByName(gone_symbols), F.col("symbol_id")))
        changed = self._written(changed.distinct(), work)
        keys = list(_TARGET)
        change.kill(**dict.fromkeys(("vector", "job", "output", "text"), changed))
        texts = self._written(jobs.texts(scope["files"], scope["symbols"], scope["file_facts"], modules).join(changed, keys, "left_semi"), work)
        wanted = texts.limit(0) if enrich else texts  # embeddings wait for enrichment
        embedded = vectors.embed(wanted.select(F.concat_ws(":", *keys).alias("target"), "text"), self.embedder, self.settings.embed_batch, id_col="target")
        of_key = F.split("target", ":", 2)
        embedded = self._written(embedded.select(of_key[0].alias("target_type"), of_key[1].cast("long").alias("target_id"), "vector", "error"), work)
        model = self.settings.embed_model
        found = embedded.filter("vector IS NOT NULL").select(*keys, "vector", F.lit(model).alias("model"))
        queued = jobs.fan_out(texts, model, enrich, self.settings.summary_model)
        # Embeddings that wait for nothing are made at once; jobs say how that went.
        failed = embedded.select(*keys, F.lit("embedding").alias("job_type"), F.lit(True).alias("_ran"), F.col("error").alias("_error"))
        away = jobs.is_away(F.col("_error"))
        status = F.when(F.col("_ran") & F.col("_error").isNull(), "done").when(F.col("_ran") & ~away, "error").otherwise(F.col("status"))
        queued = queued.join(failed, [*keys, "job_type"], "left").withColumns({"status": status, "error": F.coalesce("_error", "error"), "attempts": F.when(F.col("_ran") & ~away, 1).otherwise(0)}).select(*[c.split()[0] for c in jobs.JOB.split(", ")])
        change.add(modules=modules, vectors=found, jobs=queued, model_outputs=spark.createDataFrame([], jobs.OUTPUT))
        near_symbols = scope["symbols"].select("symbol_id")
        scope |= {"heuristic_flags": now("heuristic_flags").join(near_symbols, "symbol_id", "left_semi"), "model_outputs": now("model_outputs")}
        self._add_texts(change, self.documents(scope.__getitem__).join(changed.withColumnRenamed("target_type", "record_type"), ["record_type", "target_id"], "left_semi"), work)
        change.commit()
        stored.delete(spark, work)
        return {"ok": True, "repo": slug, **{k: counts.get(k, 0) for k in ("added", "changed", "deleted", "unchanged")}, "modules_changed": dirty}

    def _add_texts(self, change: Change, documents: DataFrame, work: str) -> None:
        """Documents of full-text search, their postings, and the terms of these."""
        documents = self._written(documents.withColumn("dl", F.size(T.words(F.col("text"))).cast("long")), work)
        posted = self._written(lexical.stemmed(lexical.postings(documents, "target_id", F.col("text"))), work)
        by_part = posted.withColumnRenamed("doc", "target_id").withColumn("part", lexical.part_of(F.col("term")))
        change.add(fts_docs=documents, postings=by_part, vocabulary=posted.select("term").distinct())

    def _tables(self, fresh: DataFrame, work: str) -> dict[str, DataFrame]:
        text = F.make_valid_utf8(F.col("content").cast("string"))
        lines = T.lines(text)
        files = fresh.select("repo", F.xxhash64("repo", "path").alias("file_id"), "path", "language", F.col("size").alias("size_bytes"), "sha256", "mtime_ns", text.alias("text"), lines.alias("lines"), F.size(lines).alias("line_count"))
        found = self._written(extract.extract_files(files), work)
        one = found.select("repo", "file_id", "path", F.posexplode("symbols").alias("at", "s")).select("repo", "file_id", "at", "path", "s.*")
        one = one.dropDuplicates(["file_id", "qualified_name", "line_start"])
        one = one.withColumn("symbol_id", F.xxhash64("repo", "path", "qualified_name", "line_start")).withColumn("ord", F.struct("path", "at"))
        symbols = one.select("repo", "symbol_id", "file_id", "name", "qualified_name", "symbol_ref", "symbol_type", "signature", "decorators", "docstring", "line_start", "line_end", "primary_text", "ord")
        calls = one.select("repo", "file_id", "symbol_id", F.explode("calls").alias("c")).select("repo", "file_id", "symbol_id", "c.*")
        literals = one.select("repo", "file_id", "symbol_id", F.explode("literals").alias("c")).select("repo", "file_id", "symbol_id", "c.*")
        facts = found.select("repo", "file_id", F.explode("facts").alias("f")).select("repo", "file_id", "f.*")
        flags = heuristics.all_flags(symbols.drop("file_id"), calls.drop("file_id")).join(symbols.select("repo", "file_id", "symbol_id"), "symbol_id")
        return {"files": files.drop("text"), "symbols": symbols, "symbol_calls": calls, "symbol_literals": literals, "file_facts": facts, "heuristic_flags": flags}

    def enrich(self, generate: Callable[[str, str], object], limit: int | None = None) -> dict:
        """Run pending enrichment jobs through ``generate(prompt, model)`` and make accepted answers searchable."""
        of = lambda n: self.table(n)
        every = of("jobs")
        todo = jobs.runnable(every, True, limit)
        outlines = jobs.texts(of("files"), of("symbols"), of("file_facts"), of("modules"), jobs.FACTS_OUTLINED, refs=False).filter("target_type <> 'symbol'")
        asks = F.concat("text", F.lit("\n\nAnswer with one JSON object; its keys are among summary (short), behavior_aliases and likely_queries."))
        prompts = outlines.select("target_type", "target_id", asks.alias("prompt"))
        of_symbols = jobs.symbol_prompts(of("symbols"), of("files"), of("symbol_calls"), of("symbol_literals"), of("heuristic_flags"))
        prompts = prompts.unionByName(of_symbols.select(F.lit("symbol").alias("target_type"), "target_id", "prompt"))
        work = f"{self.store}/_work-{uuid.uuid4().hex}"
        ran = self._written(jobs.enrich(todo.join(prompts, list(_TARGET)), generate), work)
        names = [c.split()[0] for c in jobs.JOB.split(", ")]
        keys = list(_TARGET)
        for slug in sorted(r["repo"] for r in ran.select("repo").distinct().collect()):
            mine = ran.filter(F.col("repo") == slug)
            targets_ = self._written(mine.select(*keys).distinct(), work)
            kept = lambda name: self.table(name, [slug]).join(targets_, keys, "left_semi")  # noqa: B023, E731
            every_job = self._written(upkeep.upsert(kept("jobs"), mine.select(names), [*keys, "job_type", "model", "input_hash"]), work)
            outputs = self._written(upkeep.upsert(kept("model_outputs"), jobs.outputs(mine), [*keys, "output_type"]), work)
            change = self.tables.begin(slug)
            change.kill(**dict.fromkeys(("job", "output", "text"), targets_))
            change.add(jobs=every_job, model_outputs=outputs)
            about = self.documents(change.table).join(targets_.withColumnRenamed("target_type", "record_type"), ["record_type", "target_id"], "left_semi")
            self._add_texts(change, about, work)
            change.commit()
        done = {r["status"]: r["count"] for r in ran.groupBy("status").count().collect()}
        stored.delete(self.spark, work)
        return {"ok": not done.get("error"), "processed": done.get("done", 0), "errors": done.get("error", 0), "interrupted": bool(done.get("pending")), "may_embed": jobs.may_embed(self.table("jobs"))}

    def embed(self, limit: int | None = None) -> dict:
        """Run pending embedding jobs, once no enrichment waits. Where the service is away, jobs stay pending."""
        every = self.table("jobs")
        if every is None or not jobs.may_embed(every):
            return {"ok": False, "processed": 0, "reason": "nothing_indexed" if every is None else "enrichment_pending"}
        keys, work = list(_TARGET), f"{self.store}/_work-{uuid.uuid4().hex}"
        texts = jobs.texts(*[self.table(n) for n in ("files", "symbols", "file_facts", "modules")]).select("repo", *keys, "text")
        ran = self._written(jobs.embed(jobs.runnable(every, False, limit).join(texts, ["repo", *keys]), self.embedder, self.settings.embed_batch), work)
        names = [c.split()[0] for c in jobs.JOB.split(", ")]
        for slug in sorted(r["repo"] for r in ran.filter("status <> 'pending'").select("repo").distinct().collect()):
            mine = ran.filter((F.col("repo") == slug) & (F.col("status") != "pending"))
            targets_ = self._written(mine.select(*keys).distinct(), work)
            kept = self.table("jobs", [slug]).join(targets_, keys, "left_semi")
            every_job = self._written(upkeep.upsert(kept, mine.select(names), [*keys, "job_type", "model", "input_hash"]), work)
            change = self.tables.begin(slug)
            change.kill(**dict.fromkeys(("job", "vector"), targets_))
            change.add(jobs=every_job, vectors=mine.filter("vector IS NOT NULL").select(*keys, "vector", "model"))
            change.commit()
        done = {r["status"]: r["count"] for r in ran.groupBy("status").count().collect()}
        stored.delete(self.spark, work)
        return {"ok": not done.get("error"), "processed": done.get("done", 0), "errors": done.get("error", 0), "interrupted": bool(done.get("pending"))}

    # Questions -------------------------------------------------------------------------------------------------------

    def documents(self, table: Callable[[str], DataFrame]) -> DataFrame:
        """(record_type, target_id, repo, path, symbol, text): what full-text search covers. Each side is aggregated first."""
        files, symbols, modules = table("files"), table("symbols"), table("modules")
        listed = lambda value, *order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]), " ")
        facts = table("file_facts").groupBy("file_id").agg(listed(F.concat_ws(":", "fact_type", "value"), "line_start", "fact_type").alias("facts"))
        flags = table("heuristic_flags").groupBy("symbol_id").agg(listed(F.concat_ws(":", "flag", "evidence_value"), "line_start", "flag").alias("flags"))
        said = table("model_outputs").filter("accepted").groupBy("target_type", "target_id").agg(listed(F.col("json_text"), "output_type").alias("said"))
        said = said.select(F.col("target_type").alias("record_type"), "target_id", "said")
        blank = F.lit("")
        of_files = files.join(facts, "file_id", "left").select(F.lit("file").alias("record_type"), F.col("file_id").alias("target_id"), "repo", "path", blank.alias("symbol"), F.concat_ws(" ", "path", T.module_of(F.col("path")), T.augmented(F.concat_ws(" ", "path", "language", "facts"))).alias("text"))
        of_symbols = symbols.join(files.select("file_id", "path"), "file_id").join(flags, "symbol_id", "left").select(F.lit("symbol").alias("record_type"), F.col("symbol_id").alias("target_id"), "repo", "path", F.col("symbol_ref").alias("symbol"), F.concat_ws(" ", "path", "symbol_ref", T.augmented(F.concat_ws(" ", "primary_text", "symbol_ref")), "flags").alias("text"))
        inside = modules.select("module_id", "repo", "name", "path_prefix", F.explode("file_ids").alias("file_id")).join(files.select("file_id", "path"), "file_id")
        names = symbols.groupBy("file_id").agg(listed(F.col("name"), "line_start").alias("names"))
        of_modules = inside.join(names, "file_id", "left").groupBy("module_id", "repo", "name", "path_prefix").agg(listed(F.concat_ws(" ", "path", "names"), "path").alias("body"))
        of_modules = of_modules.select(F.lit("module").alias("record_type"), F.col("module_id").alias("target_id"), "repo", F.col("path_prefix").alias("path"), blank.alias("symbol"), F.concat_ws(" ", "name", "path_prefix", T.augmented(F.col("body"))).alias("text"))
        every = of_files.unionByName(of_symbols).unionByName(of_modules).join(said, ["record_type", "target_id"], "left")
        return every.withColumn("text", F.concat_ws(" ", "text", "said")).drop("said")

    def ranked(self, questions: DataFrame) -> DataFrame:
        """All fused candidates of (query_id, repo, text)."""
        index, docs = self.index(), self.table("fts_docs")
        scored = lexical.bm25(questions, index.postings, index.lengths, prefix=True, stem=True, vocab=index.vocabulary)
        about = docs.select("record_type", "target_id", F.col("repo").alias("_repo"), "path", "symbol")
        asked = questions.select("query_id", "repo", F.col("text").alias("query"))
        scored = scored.withColumnRenamed("doc", "target_id").join(about, "target_id").join(asked, "query_id").filter("repo = _repo")
        by_words = lexical.top(scored, 30, [F.round("score", 9), F.col("record_type"), F.col("path"), F.col("target_id")]).select("query_id", "target_id", "rank")
        vectors_of = vectors.embed(questions.select(F.col("query_id").alias("target_id"), "text"), self.embedder).select(F.col("target_id").alias("query_id"), F.col("vector").alias("query_vector"))
        vectors_of = vectors_of.filter("query_vector IS NOT NULL").join(questions.select("query_id", "repo"), "query_id")
        by_meaning = vectors.nearest(vectors_of, self.table("vectors").select("target_id", "repo", "vector"), 10, within="repo").select("query_id", "target_id", "rank")
        found = ranking.candidates(by_words, by_meaning, ["target_id"]).join(about, "target_id").join(asked, "query_id").filter("repo = _repo").drop("_repo")
        why = heuristics.reasons(self.table("heuristic_flags"), self.table("symbol_calls")).withColumnRenamed("symbol_id", "target_id")
        # What has neither flags nor calls shows where its text has the question's words.
        shown = found.select("target_id", "query_id", "query").join(docs.select("target_id", "text"), "target_id").withColumn("at", F.struct("query_id", "target_id"))
        snippet = lexical.snippets(shown, "at", F.col("text"), T.query_terms(F.col("query"))).select("doc.*", "snippet")
        found = found.join(why, "target_id", "left").join(snippet, ["query_id", "target_id"], "left")
        # Reasons for what has neither flags nor calls.
        reason = F.coalesce("why", F.when(F.col("lexical_rank").isNull(), "semantic alias match; inspect before trusting").otherwise(F.coalesce("snippet", F.lit("lexical match"))))
        return ranking.rerank(found.withColumn("why", reason).drop("snippet"))

    def lines(self) -> DataFrame:
        """(target_id, line_start, line_end) of every target: a symbol's own, a file's first 80, a module's first."""
        of_symbols = self.table("symbols").select(F.col("symbol_id").alias("target_id"), "line_start", "line_end")
        of_files = self.table("files").select(F.col("file_id").alias("target_id"), F.lit(1).alias("line_start"), F.least("line_count", F.lit(LISTED)).alias("line_end"))
        return of_symbols.unionByName(of_files).unionByName(self.table("modules").select(F.col("module_id").alias("target_id"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end")))

    def search(self, questions: DataFrame, limit: int | None = None) -> DataFrame:
        first = self.ranked(questions).filter(F.col("final_rank") < (limit or self.settings.result_limit))
        return targets.handles(first.join(self.lines(), "target_id", "left"))

    def remember(self, repo: str, rows: list[dict]) -> None:
        """Keep the handles of what was shown last (rows in order); ``open`` resolves them."""
        kept = [{"result_id": f"r_{i:02d}", "repo": repo, "type": r.get("record_type") or "symbol", **{c: r.get(c) for c in ("target_id", "path", "line_start", "line_end")}, "symbol_ref": r.get("symbol") or r.get("symbol_ref")} for i, r in enumerate(rows, 1)]
        self._json("handles.json", {**self._json("handles.json"), repo: kept})

    def find(self, questions: DataFrame, kinds: tuple[str, ...] = ("symbol", "call", "literal", "path"), limit: int = 10) -> DataFrame:
        return ranking.find(questions, self.table("files"), self.table("symbols"), self.table("symbol_calls"), self.table("symbol_literals"), kinds, limit, self.names())

    def explore(self, questions: DataFrame, check_stale: bool = False) -> tuple[DataFrame, DataFrame]:
        """(blocks, blast radius): the seeds of each question and their neighbours, rendered within the budget.

        Blocks come by file, files in the order of their first block (file_position, position). A block of a family's
        further member has no body but collapsed_to, its representative. With ``check_stale`` files are looked at where
        they lie, and those that have changed show no bodies. ``truncated`` tells that the question had more symbols.
        """
        symbols, calls, files = self.table("symbols"), self.table("symbol_calls"), self.table("files")
        seeds = ranking.seeds(self.ranked(questions)).join(symbols.select(F.col("symbol_id").alias("target_id"), "name"), "target_id")
        work = f"{self.store}/_work-{uuid.uuid4().hex}"
        seeds = self._written(seeds.select("query_id", "repo", F.col("target_id").alias("symbol_id"), "name", "seed_rank"), work)
        order = self._written(graph.spine(seeds, calls, symbols), work)
        sizes = files.groupBy("repo").agg(F.count("*").alias("_files")).withColumn("tier", vectors.tier(F.col("_files"))).select("repo", "tier")
        body = F.array_join(F.slice("lines", F.col("line_start"), F.greatest(F.lit(0), F.col("line_end") - F.col("line_start") + 1)), "\n")
        full = order.join(symbols.select("symbol_id", "repo", "file_id", "symbol_ref", "signature", "line_start", "line_end"), "symbol_id").join(files.select("file_id", "path", "lines"), "file_id").join(sizes, "repo")
        members = order.join(self.table("vectors").filter("target_type = 'symbol'").select(F.col("target_id").alias("symbol_id"), "vector"), "symbol_id").join(questions.select("query_id", "repo"), "query_id").join(sizes, "repo")
        members = members.select("query_id", F.col("symbol_id").alias("id"), "position", "vector", F.col("is_seed").alias("protected"), "tier")
        folded = vectors.families(members, F.col("tier.floor"), F.col("tier.min_size")).withColumnRenamed("id", "symbol_id")
        names = symbols.select(F.col("symbol_id").alias("representative"), F.col("symbol_ref").alias("collapsed_to"))
        full = full.join(folded.join(names, "representative", "left"), ["query_id", "symbol_id"], "left").join(self._flags_shown(), "symbol_id", "left")
        if check_stale:
            changed = [self.stale(r["repo"]) for r in questions.select("repo").distinct().collect() if r["repo"] in self.repos()]
            now = changed[0]
            for c in changed[1:]:
                now = now.unionByName(c)
            full = full.join(now.select("repo", "path").distinct().withColumn("stale", F.lit(True)), ["repo", "path"], "left")
        else:
            full = full.withColumn("stale", F.lit(None).cast("boolean"))
        hidden = F.col("collapsed_to").isNotNull() | F.coalesce("stale", F.lit(False))
        sized = full.withColumn("body", F.when(~hidden, ranking.shown_body(body, F.col("is_seed")))).withColumn("size", F.coalesce(F.length("body"), F.lit(0)) + F.length("symbol_ref") + F.length("signature"))
        sized = sized.withColumn("_all", F.count("*").over(Window.partitionBy("query_id")))
        blocks = ranking.within_budget(sized, F.col("tier.budget"))
        blocks = blocks.withColumns({"file_position": F.min("position").over(Window.partitionBy("query_id", "path")), "truncated": F.count("*").over(Window.partitionBy("query_id")) < F.col("_all"), "stale": F.coalesce("stale", F.lit(False))})
        columns = ("query_id", "file_position", "position", "path", F.col("symbol_id").alias("target_id"), "symbol_ref", "signature", "line_start", "line_end", "flags", "is_seed", "stale", "collapsed_to", "body", "truncated")
        return blocks.select(*columns), graph.blast_radius(seeds, calls, symbols, files)

    def _flags_shown(self) -> DataFrame:
        """(symbol_id, flags): the first different flags of each symbol."""
        seen = self.table("heuristic_flags").groupBy("symbol_id", "flag").agg(F.min("line_start").alias("line"))
        cut = seen.withColumn("_n", F.row_number().over(Window.partitionBy("symbol_id").orderBy("line", "flag"))).filter(F.col("_n") <= FLAGS_SHOWN)
        return cut.groupBy("symbol_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "flag"))), lambda x: x["flag"]), ", ").alias("flags"))

    def open(self, asked: DataFrame) -> DataFrame:
        """Resolve (ask_id, repo, target): lines of files and symbols (first_line, lines), listings of modules
        (one line a file), and who calls a symbol and what it calls (callers, callees, flags)."""
        files, symbols = self.table("files"), self.table("symbols")
        handles = [tuple(r[c.split()[0]] for c in HANDLE.split(", ")) for rows in self._json("handles.json").values() for r in rows]
        cached = self.spark.createDataFrame(handles, HANDLE) if handles else None
        found = targets.resolve(asked, files, symbols, self.table("modules"), cached, self.names())
        ready = found.filter("status = 'ok'").join(asked.select("ask_id", "repo"), "ask_id")
        shown = targets.open_lines(ready.filter("type <> 'module'"), files).select("ask_id", "first_line", "lines")
        listing = targets.list_modules(ready.filter("type = 'module'"), files, symbols, LISTED).select("ask_id", F.lit(1).alias("first_line"), "lines")
        around = ready.filter("type = 'symbol'").join(symbols.select(F.col("symbol_id").alias("target_id"), "name"), "target_id").select("repo", F.col("target_id").alias("symbol_id"), "name").distinct()
        trail = graph.trail(around, self.table("symbol_calls"), symbols, self.table("heuristic_flags")).select(F.col("symbol_id").alias("target_id"), "callers", "callees", "flags")
        return found.join(shown.unionByName(listing), "ask_id", "left").join(trail, "target_id", "left")

    def stale(self, slug: str) -> DataFrame:
        """Indexed files whose content on disk is another now."""
        files = self.table("files").filter(F.col("repo") == slug)
        root = self.repos()[slug]["root"]
        now = tree.read_files(self.spark, root, slug, tree.list_files(root), self.settings.max_file_bytes, content=False)
        return upkeep.stale(files, now, ["repo", "path"])

    def queue(self) -> dict:
        """The work queue by model, type and status, and how far each type is."""
        every = self.table("jobs")
        order = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]
        return {"ok": True, "jobs": order(upkeep.queue_status(every), "model", "job_type", "status"), "summary": order(upkeep.queue_summary(every), "job_type")} if every is not None else {"ok": True, "jobs": [], "summary": []}

    def status(self) -> dict:
        files = self.table("files")
        counts = {r["repo"]: r["count"] for r in files.groupBy("repo").count().collect()} if files is not None else {}
        return {"ok": True, "store": self.store, "repos": {s: {**r, "files": counts.get(s, 0)} for s, r in self.repos().items()}}


def covered(path: Column, within: str) -> Column:
    """Whether a path is ``within`` or lies in it; everything lies in the root."""
    return (path == within) | upkeep.under(path, F.lit(within))


def normal_path(path: str) -> str:
    """A relative path with forward slashes; one that leaves the repository is refused."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"{path} leaves the repository")
    return "/".join(parts)
