"""Merkle manifests of datasets: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Rows lie in ranges of (group, order). A range's hashes form a sparse forest: nodes that are not resolved yet, keyed by
tree, level and index. Joining two forests and resolving every run of siblings that is now complete is associative, so
ranges are merged in a tree of small jobs, neighbours first; what is left of a range is a few nodes a level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.llm import common

#: Rows of a range, about; ranges merged at once.
RANGE_ROWS, FAN = 50_000, 8
#: The tree over the groups' roots; a group's tree has the number of the group.
TOP = -1
NODE = "tree long, level int, at long, hash string, final boolean"
RUN = "tree long, level int, run long, kids array<string>, hash string, final boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column | str) -> Column:
    """Lower-case hex SHA-256 of the fields: each ``-`` if null, else its bytes in UTF-8, counted, ``:`` and itself."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf leads to with its proof."""
    return F.aggregate(proof, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def siblings(proof: Column) -> Column:
    """The hashes of a proof as one text, level by level."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "")


class Forest:
    """Unresolved nodes by tree and level. ``final`` tells that a node is the last of its level, so the arity of the last
    run is known as soon as that node is there; every other run has ``arity`` members."""

    def __init__(self, arity: int, groups: int):
        self.arity, self.groups = arity, groups
        self.nodes: dict[int, dict[int, dict[int, tuple[str, bool]]]] = {}

    def add(self, tree: int, level: int, at: int, value: str, final: bool) -> None:
        self.nodes.setdefault(tree, {}).setdefault(level, {})[at] = value, final

    def resolve(self) -> Iterator[tuple]:
        """Replace complete runs by their parents, from the leaves up; yields (tree, level, run, kids, hash, final)."""
        for tree in [*(t for t in self.nodes if t != TOP), TOP]:
            levels, level = self.nodes.get(tree, {}), 0
            while levels and level <= max(levels):
                row = levels.get(level, {})
                for run in sorted({at // self.arity for at in row}):
                    kids, first = [], run * self.arity
                    while len(kids) < self.arity and first + len(kids) in row and not (kids and kids[-1][1]):
                        kids.append(row[first + len(kids)])
                    if not kids or (len(kids) < self.arity and not kids[-1][1]):
                        continue
                    if run == 0 and kids[0][1]:  # the only node of its level: the tree's root
                        if tree != TOP:
                            del row[0]
                            self.add(TOP, 0, tree, kids[0][0], tree == self.groups - 1)
                        continue
                    for i in range(len(kids)):
                        del row[first + i]
                    values, final = [k[0] for k in kids], kids[-1][1]
                    parent = digest("".join(values))
                    self.add(tree, level + 1, run, parent, final)
                    yield tree, level, run, values, parent, final
                if not row:
                    levels.pop(level, None)
                level += 1

    def left(self) -> list[tuple]:
        return [(tree, level, at, value, final) for tree, levels in self.nodes.items() for level, row in levels.items() for at, (value, final) in row.items()]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in schema], schema)], schema=schema)


_NODES = pa.schema([("at_part", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("hash", pa.string()), ("final", pa.bool_()), ("kids", pa.list_(pa.string()))])
_NODES_SQL = f"at_part long, {NODE}, kids array<string>"


def _in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (sorted within partitions by ``_group``) with their place: part, group_in_part, row_in_group, and
    ``final``, whether the next row is of another group; null for the last row of a partition."""
    kept = rows.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        group, row, last, held = -1, 0, object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, places, final = [], [], []
            for value in batch.column(kept.index("_group")).to_pylist():
                if value != last:
                    group, row, last = group + 1, 0, value
                numbers.append(group)
                places.append(row)
                row += 1
            final = [a != b for a, b in zip(numbers, numbers[1:])]
            if held is not None:
                yield closed(held, places[0] == 0)
            held = batch, numbers, places, final, part
        if held is not None:
            yield closed(held, None)

    def closed(held, last: bool | None) -> pa.RecordBatch:
        batch, numbers, places, final, part = held
        own = [pa.array([part] * batch.num_rows, pa.int64()), pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), pa.array([*final, last], pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, *own], [*kept, "_part", "_number", "_place", "_final"])

    return rows.mapInArrow(run, f"{schema}, _part long, _number long, _place long, _final boolean")


def _headers(ordered: DataFrame) -> tuple[list[tuple], int]:
    """For each part: the number of its first group among all, rows of that group in earlier parts, whether its last row
    is the last of its group, its first leaf and its last one (tree, index). And how many groups there are.

    One row a part comes to the driver, so what is folded there grows with the number of tasks only.
    """
    key = F.sha2("_group", 256)
    last = F.max(F.struct("_number", "_place"))
    found = ordered.groupBy("_part").agg(last["_number"].alias("last"), last["_place"].alias("place"), F.max(F.when(F.col("_number") == 0, key)).alias("first_key"), F.max_by(key, "_number").alias("last_key"))
    out: list[list] = []
    group, rows, before = -1, 0, None
    for h in sorted(found.collect(), key=lambda r: r["_part"]):
        more = before is not None and h["first_key"] == before["last_key"]
        start, offset = (group, rows) if more else (group + 1, 0)
        if out:
            out[-1][3] = not more
        group, rows, before = start + h["last"], h["place"] + 1 + (offset if h["last"] == 0 else 0), h
        out.append([h["_part"], start, offset, True, group, rows - 1])
    return [tuple(x) for x in out], group + 1


def proofs(rows: DataFrame, leaf_col: str = "leaf", group_col: str = "source", order_col: str = "doc_id", arity: int = 3) -> DataFrame:
    """``rows`` with subroot, root and proof (array of left and right, from the leaf up).

    In each group (null first, then bytewise) leaves ascend by ``order_col`` (null first). While several nodes remain,
    every ``arity`` neighbours, fewer at the end, become the digest of their joined hex digests. The roots of the groups,
    in their order, likewise give the root. ``left`` and ``right`` are the digests beside a row's own node in its run.

    Ties in the order lie by leaf; repeated rows are leaves of their own. Empty tables have no rows and no root. Columns
    of ``rows`` pass through unless they are called subroot, root or proof, which is an error.

    Ranges hold about ``RANGE_ROWS`` rows wherever groups begin, so a large group is split. The result costs a sort of
    the hashes, not of the rows they stand for. Each pass is written to the shared folder.
    """
    spark = rows.sparkSession
    taken = {c.lower() for c in rows.columns} & {"subroot", "root", "proof"}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the way of the result's")
    common.ship(spark)
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    back = {v: k for k, v in names.items()}
    own = rows.select(*[rows[c].alias(n) for c, n in names.items()])
    written = common.materialise(own.select("*", F.col(names[group_col]).cast("string").alias("_group")), "leaves")
    total = written.count()
    result = ", ".join(f"`{n}` {t}" for n, t in own.dtypes) + ", subroot string, root string, left array<string>, right array<string>"
    if not total:
        return _shown(spark.createDataFrame([], result), back)
    order, value = names[order_col], names[leaf_col]
    sort = [F.col("_group").asc_nulls_first(), F.col(order).asc_nulls_first(), F.col(value), F.col("_row")]
    ranged = written.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(-(-total // RANGE_ROWS), *sort).sortWithinPartitions(*sort)
    ordered = common.materialise(_in_order(ranged.drop("_row")), "ordered")
    headers, groups = _headers(ordered)
    parts = spark.createDataFrame(headers, "_part long, _start long, _offset long, _closed boolean, _last_tree long, _last_at long")
    placed = ordered.join(parts, "_part").select(
        "_part", (F.col("_start") + F.col("_number")).alias("_tree"), (F.col("_place") + F.when(F.col("_number") == 0, F.col("_offset")).otherwise(0)).alias("_at"), F.coalesce("_final", "_closed").alias("_final"), *back
    )

    def local(table: pa.Table) -> tuple[Forest, list[tuple]]:
        forest = Forest(arity, groups)
        for tree, at, value_, final in zip(*[table.column(c).to_pylist() for c in ("_tree", "_at", value, "_final")]):
            forest.add(tree, 0, at, value_, final)
        return forest, list(forest.resolve())

    def fragment(key: tuple, table: pa.Table) -> pa.Table:
        forest, _ = local(table)
        return _table([(key[0].as_py(), *n, None) for n in forest.left()], _NODES)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        forest = Forest(arity, groups)
        for tree, level, at, value_, final in zip(*[table.column(c).to_pylist() for c in ("tree", "level", "at", "hash", "final")]):
            forest.add(tree, level, at, value_, final)
        part = key[0].as_py()
        runs = [(part, tree, level, run, h, final, kids) for tree, level, run, kids, h, final in forest.resolve()]
        return _table(runs + [(part, *n, None) for n in forest.left()], _NODES)

    nodes = common.materialise(placed.select("_part", "_tree", "_at", "_final", value).groupBy("_part").applyInArrow(fragment, _NODES_SQL), "forest")
    rounds, left = [], headers[-1][0] + 1
    while left > 1 or not rounds:
        near = nodes.filter("kids IS NULL").withColumn("at_part", F.floor(F.col("at_part") / FAN).cast("long"))
        nodes = common.materialise(near.groupBy("at_part").applyInArrow(merged, _NODES_SQL), "forest")
        rounds.append(nodes.filter("kids IS NOT NULL"))
        left = -(-left // FAN) if left > 1 else 0
    runs = reduce(DataFrame.unionByName, rounds).select("tree", "level", F.col("at").alias("run"), "kids", "hash", "final")

    # Runs that reach beyond a part hold its first leaf or its last one, or the trees of these.
    deep = 1
    while arity**deep < total:
        deep += 1
    ends = parts.select("_part", F.explode(F.array(F.struct(F.col("_start").alias("g"), F.col("_offset").alias("i")), F.struct(F.col("_last_tree").alias("g"), F.col("_last_at").alias("i")))).alias("e"))
    paths = ends.select("_part", F.explode(F.array(F.struct(F.col("e.g").alias("tree"), F.col("e.i").alias("i")), F.struct(F.lit(TOP).cast("long").alias("tree"), F.col("e.g").alias("i")))).alias("p"))
    steps = F.array(*[F.struct(F.lit(n).alias("level"), F.expr(f"p.i div {arity ** (n + 1)}L").alias("run")) for n in range(deep)])
    wanted = paths.select("_part", "p.tree", F.inline(steps)).distinct()
    beyond = common.materialise(wanted.join(runs, ["tree", "level", "run"]), "beyond")
    schema = pa.schema([("subroot", pa.string()), ("root", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])

    def proved(table: pa.Table, others: pa.Table) -> pa.Table:
        _, own_runs = local(table)
        known = {(tree, level, run): (kids, h, final) for tree, level, run, kids, h, final in own_runs}
        for tree, level, run, kids, h, final in zip(*[others.column(c).to_pylist() for c in ("tree", "level", "run", "kids", "hash", "final")]):
            known[tree, level, run] = kids, h, final
        above: dict[tuple[int, int], tuple] = {}

        def path(tree: int, level: int, at: int, h: str, final: bool) -> tuple[list, list, str, str]:
            """Left and right siblings from a node up, the root of its group, the root."""
            if at == 0 and final:
                if tree == TOP:
                    return [], [], h, h
                left_, right_, _, root = path(TOP, 0, tree, h, tree == groups - 1)
                return left_, right_, h, root
            run, place = divmod(at, arity)
            kids, parent, last = known[tree, level, run]
            held = above.get((tree, level))
            if held is None or held[0] != run:
                held = above[tree, level] = run, path(tree, level + 1, run, parent, last)
            left_, right_, subroot, root = held[1]
            return ["".join(kids[:place]), *left_], ["".join(kids[place + 1 :]), *right_], subroot, root

        table = table.sort_by([("_tree", "ascending"), ("_at", "ascending")])
        found, tree_before = [], None
        for tree, at, h, final in zip(*[table.column(c).to_pylist() for c in ("_tree", "_at", value, "_final")]):
            if tree != tree_before:
                above, tree_before = {k: v for k, v in above.items() if k[0] == TOP}, tree
            left_, right_, subroot, root = path(tree, 0, at, h, final)
            found.append((subroot, root, left_, right_))
        added = _table(found, schema)
        return pa.table([*[table.column(n) for n in back], *added.columns], names=[*back, *schema.names])

    found = placed.groupBy("_part").cogroup(beyond.groupBy("_part")).applyInArrow(proved, result)
    return _shown(found, back)


def _shown(found: DataFrame, back: dict[str, str]) -> DataFrame:
    return found.select(*[F.col(n).alias(c) for n, c in back.items()], "subroot", "root", F.arrays_zip("left", "right").alias("proof"))


def manifest(found: DataFrame, group_col: str = "source") -> DataFrame:
    """The manifest of a dataset from the rows of ``proofs``: (group, rows, subroot, root)."""
    return found.groupBy(group_col).agg(F.count("*").alias("rows"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))
