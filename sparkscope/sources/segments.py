"""Tables kept as immutable segments, a folder for each repository.

A change writes new segments and tombstones (keys of rows that are gone) and then the repository's manifest, by one
rename, so it costs what has changed and is seen whole or not at all. Readers take the segments that the manifest names
and leave out rows with a younger tombstone. Segments are merged by size, neighbours in age, so that their number stays
small and a row is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import copy
import json
import re
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscope.sources import files as stored

#: So many neighbouring segments are merged, each at most ``GROWTH`` times as large as all younger ones together.
LEAST, GROWTH = 4, 2
#: Segments of tombstones beyond this are merged.
MOST_DEAD = 8
#: Segments of a change that are written at the same time.
AT_ONCE = 6


@dataclass(frozen=True)
class Kept:
    """How a table is kept: its tombstones' name and key columns (rows with a null in them are never hidden; no name: rows
    are never hidden, and equal ones become one when segments are merged), columns for the store alone, and folders and order within a segment."""

    space: str | None = None
    key: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


def escaped(name: str) -> str:
    """A repository's name as part of a path, as Spark reads it back."""
    return re.sub(r"""[\x00-\x1f\x7f"#%'*/:=?\\{}\[\]^ ]""", lambda m: f"%{ord(m[0]):02X}", name)


def run_to_merge(sizes: list[int]) -> int:
    """How many of the youngest segments (oldest first) are merged next; 0 for none."""
    if not sizes:
        return 0
    n, total = 1, sizes[-1]
    while n < len(sizes) and sizes[-n - 1] <= GROWTH * total:
        total += sizes[-n - 1]
        n += 1
    return n if n >= LEAST else 0


class Store:
    def __init__(self, spark: SparkSession, root: str, kept: dict[str, Kept]):
        self.spark, self.root, self.kept = spark, root, kept
        self.spaces = {k.space: k.key for k in kept.values() if k.space}
        stored.make_folder(spark, f"{root}/manifests")

    def repos(self) -> list[str]:
        """The repositories that have a manifest."""
        found = [n.removesuffix(".json") for n in stored.names(self.spark, f"{self.root}/manifests") if n.endswith(".json")]
        return [re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), n) for n in found]

    def manifest(self, repo: str) -> dict:
        """seq (the youngest number given), tables and dead ([number, bytes, rows] of each segment, oldest first) and schemas."""
        text = stored.read_text(self.spark, f"{self.root}/manifests/{escaped(repo)}.json")
        return json.loads(text) if text else {"seq": 0, "tables": {}, "dead": {}, "schemas": {}, "previous": {}}

    def path(self, name: str, repo: str, seq: int) -> str:
        return f"{self.root}/{name}/repo={escaped(repo)}/seq={seq}"

    def table(self, name: str, repos: list[str] | None = None) -> DataFrame | None:
        """The rows of a table that are alive, of all repositories or of some; None if no manifest knows the table."""
        return self.merged(name, {r: self.manifest(r) for r in (self.repos() if repos is None else repos)})

    def merged(self, name: str, manifests: dict[str, dict], only: set[int] | None = None, all_columns: bool = False) -> DataFrame | None:
        """The rows that are alive by ``manifests``; ``only`` takes some segments."""
        how = self.kept[name]
        schema = next((m["schemas"][name] for m in manifests.values() if name in m["schemas"]), None)
        if schema is None:
            return None
        rows = self._read(name, T.StructType.fromJson(schema), [(r, s[0]) for r, m in manifests.items() for s in m["tables"].get(name, []) if only is None or s[0] in only])
        dead = self._dead(how.space, manifests) if how.space else None
        if dead is not None:
            same = [rows[c] == dead[c] for c in ("repo", *how.key)]
            rows = rows.join(dead, reduce(lambda a, b: a & b, same) & (rows["seq"] < dead["dead"]), "left_anti")
        shown = [f["name"] for f in schema["fields"] if all_columns or f["name"] not in how.hidden]
        return rows.select("repo", *shown)

    def _read(self, name: str, schema: T.StructType, chosen: list[tuple[str, int]]) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("repo", T.StringType()), T.StructField("seq", T.LongType())])
        if not chosen:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(*[self.path(name, r, s) for r, s in chosen])

    def _dead(self, space: str, manifests: dict[str, dict]) -> DataFrame | None:
        """(repo, *key, dead): tombstones. Each hides rows of its key in segments older than ``dead``."""
        chosen = [(r, s[0]) for r, m in manifests.items() for s in m["dead"].get(space, [])]
        schema = next((m["schemas"][f"_dead/{space}"] for m in manifests.values() if f"_dead/{space}" in m["schemas"]), None)
        if not chosen or schema is None:
            return None
        return self._read(f"_dead/{space}", T.StructType.fromJson(schema), chosen).drop("seq")

    def begin(self, repo: str) -> Change:
        return Change(self, repo)

    def drop(self, repo: str) -> None:
        """Forget a repository: its manifest first, then its segments."""
        stored.delete(self.spark, f"{self.root}/manifests/{escaped(repo)}.json")
        for name in [*self.kept, *(f"_dead/{s}" for s in self.spaces)]:
            stored.delete(self.spark, f"{self.root}/{name}/repo={escaped(repo)}")

    def vacuum(self, repo: str) -> int:
        """Delete segments that neither the manifest nor the one before it names: merged ones, and what a change left
        that was not committed."""
        manifest, gone = self.manifest(repo), 0
        for name in [*self.kept, *(f"_dead/{s}" for s in self.spaces)]:
            group, key = ("dead", name.removeprefix("_dead/")) if name.startswith("_dead/") else ("tables", name)
            needed = {s[0] for s in manifest[group].get(key, [])} | set(manifest["previous"].get(group, {}).get(key, []))
            folder = f"{self.root}/{name}/repo={escaped(repo)}"
            for n in stored.names(self.spark, folder):
                if n.startswith("seq=") and int(n[4:]) not in needed:
                    stored.delete(self.spark, f"{folder}/{n}")
                    gone += 1
        return gone


class Change:
    """A change of one repository: tombstones and rows are written as they come, and seen by others after ``commit``."""

    def __init__(self, store: Store, repo: str):
        self.store, self.repo = store, repo
        self.manifest = copy.deepcopy(store.manifest(repo))
        self.manifest["previous"] = {g: {k: [s[0] for s in v] for k, v in self.manifest[g].items()} for g in ("tables", "dead")}
        #: Rows of this change have this number, and its tombstones hide those with smaller ones.
        self.seq = self._number()

    def _number(self) -> int:
        """Larger than all before, also than those of changes that were never committed."""
        self.manifest["seq"] = max(self.manifest["seq"] + 1, time.time_ns())
        return self.manifest["seq"]

    def _write(self, name: str, rows: DataFrame, seq: int, how: Kept) -> list[int] | None:
        spark, path = self.store.spark, self.store.path(name, self.repo, seq)
        rows = rows.drop("repo")
        schema = rows.schema.jsonValue()
        for f in schema["fields"]:
            f["nullable"], f["metadata"] = True, {}
        self.manifest["schemas"][name] = schema
        out = rows.sortWithinPartitions(*how.folders, *how.order) if how.order else rows
        (out.write.partitionBy(*how.folders) if how.folders else out.write).parquet(path)
        count = spark.read.schema(T.StructType.fromJson(schema)).parquet(path).count()
        if not count:
            stored.delete(spark, path)
            return None
        return [seq, stored.size(spark, path), count]

    def add(self, **rows: DataFrame) -> None:
        """New rows of tables, by name. The tables are written at the same time."""
        self._all([("tables", name, name, r, self.store.kept[name]) for name, r in rows.items()])

    def kill(self, **keys: DataFrame) -> None:
        """Hide all rows of the tables of these spaces with these keys that were there before this change."""
        held = {k.space for n, k in self.store.kept.items() if self.manifest["tables"].get(n)}
        dead = F.lit(self.seq).cast("long").alias("dead")
        self._all([("dead", space, f"_dead/{space}", k.select(*self.store.spaces[space], dead).distinct(), Kept()) for space, k in keys.items() if space in held])

    def _all(self, writes: list[tuple]) -> None:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            segments = list(pool.map(lambda w: self._write(w[2], w[3], self.seq, w[4]), writes))
        for (group, key, *_), segment in zip(writes, segments):
            if segment:
                self.manifest[group].setdefault(key, []).append(segment)

    def table(self, name: str) -> DataFrame | None:
        """A table of the repository with this change."""
        return self.store.merged(name, {self.repo: self.manifest})

    def commit(self) -> dict:
        """Merge what is due, switch the manifest and delete what no reader needs. Returns the segments by table."""
        for name in self.store.kept:
            self._merge(name, run_to_merge([s[1] for s in self.manifest["tables"].get(name, [])]))
        self._prune()
        self._switch()
        return {n: len(s) for n, s in self.manifest["tables"].items()}

    def compact(self) -> None:
        """Merge every table into one segment."""
        for name, segments in self.manifest["tables"].items():
            if len(segments) > 1 or self.manifest["dead"].get(self.store.kept[name].space):
                self._merge(name, len(segments))
        self._prune()
        self._switch()

    def _switch(self) -> None:
        stored.write_text(self.store.spark, f"{self.store.root}/manifests/{escaped(self.repo)}.json", json.dumps(self.manifest, sort_keys=True))
        self.store.vacuum(self.repo)

    def _merge(self, name: str, count: int) -> None:
        if not count:
            return
        segments = self.manifest["tables"][name]
        rows = self.store.merged(name, {self.repo: self.manifest}, {s[0] for s in segments[-count:]}, all_columns=True)
        if not self.store.kept[name].space:
            rows = rows.distinct()
        merged = self._write(name, rows, self._number(), self.store.kept[name])
        self.manifest["tables"][name] = segments[:-count] + ([merged] if merged else [])

    def _prune(self) -> None:
        """Drop tombstones that are older than all rows, and merge them when they are many."""
        for space, segments in self.manifest["dead"].items():
            oldest = min((s[0] for n, k in self.store.kept.items() if k.space == space for s in self.manifest["tables"].get(n, [])), default=None)
            segments[:] = [s for s in segments if oldest is not None and s[0] > oldest]
            if len(segments) > MOST_DEAD:
                rows = self.store._dead(space, {self.repo: self.manifest}).groupBy(*self.store.spaces[space]).agg(F.max("dead").alias("dead"))
                segments[:] = [self._write(f"_dead/{space}", rows, self._number(), Kept())]
