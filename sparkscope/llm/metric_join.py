"""Near-duplicate vectors by an exact metric range join.

Angles are the metric. Pivots cut the vectors into cells (nearest pivot); a vector that may have a neighbour within the
radius in another cell, by the triangle inequality and by its distance from the plane between the two pivots, is
replicated there. Cells are joined independently, in tiles of bounded size. Of two cells only the one with the smaller
number gets the other's boundary vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.llm import common
from sparkscope.llm.components import connected

CELL_ROWS, BLOCK_ROWS, CHUNK_ROWS = 2048, 4096, 8192
#: Bounds of what is broadcast: pivots, and numbers in them.
MAX_PIVOTS, MAX_PIVOT_NUMBERS = 1024, 4_000_000
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.empty((0, 0))
    x = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pick_pivots(vectors: DataFrame, n: int, width: int) -> np.ndarray:
    """Vectors with the smallest hashes of their ids: a bounded number, the same for the same input."""
    k = max(1, min(-(-n // CELL_ROWS), MAX_PIVOTS, MAX_PIVOT_NUMBERS // width))
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(k).select("v").collect()
    x = np.array([r["v"] for r in rows], dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.unique(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), axis=0)


def reach(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and a mask of the other cells that may hold vectors within ``radius`` (an angle)."""
    dot = np.clip(x @ pivots.T, -1.0, 1.0)
    home = dot.argmax(axis=1)
    own = dot[np.arange(len(x)), home][:, None]
    triangle = np.arccos(dot) <= np.arccos(own) + 2 * radius + SLACK
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(pivots @ pivots.T, -1, 1), 0.0))[home]
    plane = dot - own >= -np.sin(radius) * apart - SLACK if radius < np.pi / 2 else np.ones_like(triangle)
    near = triangle & plane
    near[np.arange(len(x)), home] = False
    return home, near


def place(vectors: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """(rep, many, v, cell, home): each vector in its cell, and in those of smaller number that it may reach into."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                home, near = reach(_matrix(part.column(2)), shared.value, radius)
                near &= np.arange(near.shape[1]) < home[:, None]
                rows, cells = np.nonzero(near)
                rows = np.concatenate([np.arange(len(home)), rows])
                cells = np.concatenate([home, cells])
                own = np.arange(len(rows)) < len(home)
                for a in range(0, len(rows), 5000):
                    taken = [c.take(pa.array(rows[a : a + 5000])) for c in part.columns]
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(cells[a : a + 5000].astype(np.int32)), pa.array(own[a : a + 5000])], ["rep", "many", "v", "cell", "home"])

    kinds = dict(vectors.dtypes)
    return vectors.select("rep", "many", "v").mapInArrow(run, f"rep {kinds['rep']}, many long, v {kinds['v']}, cell int, home boolean")


def tile(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Linked pairs between the rows of a and b, for 256 rows of a at a time: (first row, mask)."""
    for start in range(0, len(a), 256):
        yield start, a[start : start + 256] @ b.T >= least


def join_tile(table: pa.Table, least: float) -> pa.Table:
    """Links within a tile: rep, links (weighted by copies), root (smallest rep that is reachable in the tile)."""
    left, home = table.column("left").to_numpy(zero_copy_only=False), table.column("home").to_numpy(zero_copy_only=False)
    rep, many, x = table.column("rep").to_numpy(), table.column("many").to_numpy(), _matrix(table.column("v"))
    ia, ib = np.flatnonzero(left), np.flatnonzero(~left)
    counts = np.zeros(len(rep), dtype=np.int64)
    label = rep.copy()
    masks = []
    for start, mask in tile(x[ia], x[ib], least):
        rows = ia[start : start + len(mask)]
        mask &= rep[rows][:, None] != rep[ib][None, :]
        hit_rows, hit_columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        if len(hit_rows):
            counts[rows] += mask @ many[ib]
            counts[ib] += np.where(home[ib], 0, many[rows] @ mask)  # pairs within the cell come up from both sides
            masks.append((rows[hit_rows], ib[hit_columns], mask[np.ix_(hit_rows, hit_columns)]))
    # The same vector may be in the tile on both sides; it carries one label.
    names, of = np.unique(rep, return_inverse=True)
    best = names.copy()
    big = np.iinfo(best.dtype).max if best.dtype.kind == "i" else None
    changed = bool(masks)
    while changed:
        before = best.copy()
        for rows, columns, mask in masks:
            np.minimum.at(best, of[rows], np.where(mask, best[of[columns]][None, :], big).min(axis=1))
            np.minimum.at(best, of[columns], np.where(mask, best[of[rows]][:, None], big).min(axis=0))
        changed = bool((best != before).any())
    label = best[of]
    kept = np.flatnonzero((counts > 0) | (label != rep))
    return pa.table({"rep": rep[kept], "links": counts[kept], "root": label[kept]})


def range_join(rows: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each of ``rows``: id, n_links, component_id (smallest id reachable by links), kept.

    Two vectors link if their cosine, in double precision, is ``cosine`` (over 0) or more. Null, empty and zero vectors
    and those with null or non-finite numbers link with nothing, nor do rows with a null id. Shorter vectors count as
    filled up with zeros. Equal vectors are joined as one with a weight and counted as links. Rows that share an id
    are one node of a component. Other columns are not read.
    """
    spark = rows.sparkSession
    common.ship(spark)
    v = F.col(vector_col)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    sound = F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.col(id_col).isNotNull(), F.lit(False))
    base = rows.select(F.col(id_col).alias("id"), v.alias("v"), sound.alias("sound"))
    hashes = [F.xxhash64("v").alias("k1"), F.xxhash64(F.reverse("v"), F.lit(7)).alias("k2")]
    vectors = base.filter("sound").select("id", "v", *hashes).groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("many"), F.first("v").alias("v"))
    vectors = common.materialise(vectors, "vectors")
    n, width, narrowest = vectors.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    if not n:
        return rows.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.col(id_col).isNotNull().alias("kept"))
    if narrowest < width:
        zero = F.lit(0).cast(vectors.schema["v"].dataType.elementType)
        vectors = vectors.withColumn("v", F.concat("v", F.array_repeat(zero, width - F.size("v"))))
    placed = place(vectors, pick_pivots(vectors, n, width), float(np.arccos(cosine)))
    placed = common.materialise(placed, "placed")
    # One row for each cell, MAX_PIVOTS at most.
    cells = placed.groupBy("cell").agg(F.sum(F.col("home").cast("int")).alias("h"), F.count("*").alias("all")).collect()
    blocks = {r["cell"]: -(-r["h"] // BLOCK_ROWS) or 1 for r in cells}
    chunks = {r["cell"]: -(-r["all"] // CHUNK_ROWS) for r in cells}
    size = max(blocks) + 1

    def parts(counts: dict):
        return F.element_at(F.array(*[F.lit(counts.get(c, 1)) for c in range(size)]), F.col("cell") + 1)

    block, chunk = [F.pmod(F.xxhash64("rep", F.lit(s)), parts(c)).cast("int") for s, c in ((1, blocks), (2, chunks))]
    left = placed.filter("home").select("rep", "many", "v", "cell", "home", F.lit(True).alias("left"), block.alias("block"), F.explode(F.sequence(F.lit(0), parts(chunks) - 1)).alias("chunk"))
    right = placed.select("rep", "many", "v", "cell", "home", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), parts(blocks) - 1)).alias("block"), chunk.alias("chunk"))
    kind = dict(vectors.dtypes)["rep"]
    joined = left.unionByName(right).groupBy("cell", "block", "chunk").applyInArrow(lambda t: join_tile(t, cosine), f"rep {kind}, links long, root {kind}")
    found = common.materialise(joined, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = vectors.select("k1", "k2", "rep", "many").join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("_links"), F.coalesce("label", "rep").alias("_component"))
    named = common.materialise(named, "named")
    keyed = base.select("id", *[F.when(F.col("sound"), h).alias(k) for h, k in zip((F.xxhash64("v"), F.xxhash64(F.reverse("v"), F.lit(7))), ("k1", "k2"))])
    out = keyed.join(named, ["k1", "k2"], "left")
    component = F.coalesce("_component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
