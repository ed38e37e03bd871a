"""Source trees: listing, ignore rules, and reading files on the executors."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.functions.paths import IGNORED, MAX_BYTES, SAMPLE_BYTES
from sparkscope.operators.sizes import broadcast_if_small
from sparkscope.operators.upkeep import ancestors
from sparkscope.session import ship


def list_files(root: str) -> list[str]:
    """Relative paths of regular files, sorted; ignored folders are not entered."""
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in IGNORED]
        inside = os.path.relpath(folder, root)
        for name in names:
            if name not in IGNORED and os.path.isfile(os.path.join(folder, name)):
                found.append(name if inside == "." else f"{inside}/{name}".replace(os.sep, "/"))
    return sorted(found)


def git(root: str, *arguments: str) -> str | None:
    """Output of a git command, or None if it fails in any way."""
    try:
        done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, timeout=60, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.decode("utf-8", "replace")


def head(root: str) -> str | None:
    found = git(root, "rev-parse", "HEAD")
    return found.strip() if found else None


def allowed_by_git(root: str) -> set[str] | None:
    if (git(root, "rev-parse", "--is-inside-work-tree") or "").strip() != "true":
        return None
    listed = git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    return None if listed is None else {p for p in listed.split("\0") if p}


class IgnoreRules:
    """Rules of ``.gitignore`` files: (folder, pattern) in order. For a path and each folder above it the last rule that
    matches decides, so a negation can bring back what lies below an ignored folder."""

    def __init__(self, lines: list[tuple[str, str]]):
        self.rules = [r for base, raw in lines if (r := self._compile(base, raw))]

    @staticmethod
    def _compile(base: str, raw: str):
        line = raw.rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            return None
        keep, line = line.startswith("!"), line.removeprefix("!")
        folders_only, line = line.endswith("/"), line.removesuffix("/")
        anywhere = "/" not in line
        tokens = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        body = "".join(tokens.get(t, re.escape(t)) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", line.lstrip("/")))
        return base, re.compile(("(?:.*/)?" if anywhere else "") + body + r"\Z"), keep, folders_only

    def ignores(self, path: str) -> bool:
        parts, out = path.split("/"), False
        for n in range(1, len(parts) + 1):
            part = "/".join(parts[:n])
            for base, pattern, keep, folders_only in self.rules:
                if folders_only and n == len(parts) or base and part != base and not part.startswith(base + "/"):
                    continue
                if pattern.match(part[len(base) + 1 :] if base else part):
                    out = not keep
        return out


def ignore_rules(root: str) -> IgnoreRules | None:
    lines = []
    for path in [p for p in list_files(root) if p.split("/")[-1] == ".gitignore"]:
        with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
            lines += [(path.rpartition("/")[0], line) for line in f.read().splitlines()]
    return IgnoreRules(lines) if lines else None


def ignored(root: str, paths: list[str]) -> set[str]:
    """Paths that git, or else the ``.gitignore`` files, leave out."""
    allowed = allowed_by_git(root)
    if allowed is not None:
        return set(paths) - allowed
    rules = ignore_rules(root)
    return {p for p in paths if rules.ignores(p)} if rules else set()


def read_files(spark: SparkSession, root: str, repo: str, paths: list[str] | DataFrame, max_bytes: int = MAX_BYTES, content: bool = True) -> DataFrame:
    """(repo, path, size, mtime_ns, sample, sha256, content) read on the executors, for which ``root`` must be a shared folder.

    sha256 and content are null above ``max_bytes``; all are null for a file that is gone or can't be read. Without
    ``content`` files are read for their sha256 and it stays null.
    """
    ship(spark)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["path"]:
                try:
                    full = os.path.join(root, path)
                    stat = os.stat(full)
                    with open(full, "rb") as f:
                        data = f.read(max_bytes + 1)
                    whole = len(data) <= max_bytes
                    out.append((path, stat.st_size, stat.st_mtime_ns, data[:SAMPLE_BYTES], hashlib.sha256(data).hexdigest() if whole else None, data if whole and content else None))
                except OSError:
                    out.append((path, *[None] * 5))
            yield pd.DataFrame(out, columns=["path", "size", "mtime_ns", "sample", "sha256", "content"]).astype({"size": "Int64", "mtime_ns": "Int64"})

    if isinstance(paths, DataFrame):
        listed = paths.select("path")
    else:
        listed = spark.createDataFrame([(p,) for p in paths], "path string")
        listed = listed.repartition(max(1, min(len(paths) // 64, spark.sparkContext.defaultParallelism * 4)))
    return listed.mapInPandas(read, "path string, size long, mtime_ns long, sample binary, sha256 string, content binary").select(F.lit(repo).alias("repo"), "*")


def match_rules(spark: SparkSession, paths: DataFrame, rules: IgnoreRules, path_col: str = "path") -> DataFrame:
    """``paths`` with ``ignored``; null and empty paths are not ignored.

    Different paths become rows for themselves and the folders above them, which meet the rules of every folder around
    them by equality; of what matches, the deepest row's last rule decides.
    """
    kept = paths.drop("ignored")
    compiled = [(i, base, rf"(?d)\A(?:{pattern.pattern.removesuffix(chr(92) + 'Z')})\z", keep, folders_only) for i, (base, pattern, keep, folders_only) in enumerate(rules.rules)]
    table = spark.createDataFrame(compiled, "_ord int, _base string, _pattern string, _keep boolean, _folders boolean")
    parts = F.split("_path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("_n"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("_part"), (n == F.size(parts)).alias("_whole")))
    each = kept.select(F.col(path_col).alias("_path")).filter("_path <> ''").distinct().select("_path", F.inline(above))
    around = each.select("*", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ancestors(F.col("_part"))))).alias("_base"))
    inner = F.when(F.col("_base") == "", F.col("_part")).otherwise(F.substr("_part", F.length("_base") + 2))
    met = around.join(broadcast_if_small(table), "_base").filter(~(F.col("_folders") & F.col("_whole")) & F.rlike(inner, F.col("_pattern")))
    last = met.groupBy("_path").agg(F.max_by(~F.col("_keep"), F.struct("_n", "_ord")).alias("_ignored"))
    return kept.join(last, kept[path_col] == last["_path"], "left").select(*[kept[c] for c in kept.columns], F.coalesce("_ignored", F.lit(False)).alias("ignored"))
