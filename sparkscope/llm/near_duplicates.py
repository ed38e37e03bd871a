"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges.

Documents with equal shingle sets (of one size and one 128-bit fingerprint) form a class first, so copies cost no
candidates. Each class has a signature of one
permutation with optimal densification, whose bands put it into buckets. Every bucket proposes a star: all members
against the one that meets most others. Links are confirmed on full shingle sets. Members of a bucket that the stars
left in several components get narrower buckets from their rarest shingles (an exact filter); in these, members are
compared with further centres, ranks 1 to 8, to 32, to 128 and so on, until all have been centres or one component is
left. So no link between members of a bucket is lost, and groups are not paired out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.llm import common
from sparkscope.llm.components import connected
from sparkscope.llm.shingles import mix, shingle_sets

U = np.uint64
#: Two documents at the similarity asked for share no band with a probability of MISSED at most, where a band's hashes
#: count as independent: (1 - 0.85**7)**48 or (1 - 0.80**5)**47. Rows are as many as MOST_BANDS bands allow, and 7 at most.
MISSED, MOST_BANDS, MOST_ROWS = 1e-8, 48, 7
FIRST_CENTRES, MORE_CENTRES = 8, 4
#: Members that are compared with a centre in one group; a centre with more is sent to several groups.
GROUP_MEMBERS = 500


def bands_and_rows(percent: int) -> tuple[int, int]:
    def bands(rows: int) -> int:
        shared = (percent / 100) ** rows
        return math.ceil(math.log(MISSED) / math.log1p(-shared)) if shared < 1 else 1

    rows = max([r for r in range(1, MOST_ROWS + 1) if bands(r) <= MOST_BANDS], default=1)
    return bands(rows), rows


class Signer:
    """Signatures of one permutation: the hash range is cut into equal bins, a bin's value is its smallest hash.

    An empty bin takes the value of a full one, found by its own sequence of hashed probes (optimal densification).
    """

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.edges = np.array([-(-(i << 64) // self.bins) for i in range(self.bins)], dtype=np.uint64)
        self.factors = mix(np.arange(1, rows + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        self.probes: list[np.ndarray] = []

    def probe(self, t: int) -> np.ndarray:
        while t >= len(self.probes):
            k = len(self.probes)
            self.probes.append((mix(np.arange(self.bins, dtype=np.uint64) * U(0x100000001B3) + U(k * 0x51ED270B + 1)) % U(self.bins)).astype(np.int64))
        return self.probes[t]

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """``hashes``: sorted, distinct, at least one."""
        at = np.searchsorted(hashes, self.edges)
        full = np.append(at[1:], len(hashes)) > at
        out = hashes[np.minimum(at, len(hashes) - 1)]
        if len(hashes) == 1:
            return np.full(self.bins, hashes[0])
        empty, t = np.flatnonzero(~full), 0
        while len(empty):
            source = self.probe(t)[empty]
            found = full[source]
            out[empty[found]] = out[source[found]]
            empty, t = empty[~found], t + 1
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        rows = self.signature(hashes).reshape(self.bands, self.rows)
        return mix((rows * self.factors).sum(axis=1) ^ self.salt)


def sketches(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, bands): set size, 128-bit fingerprint of the set, band keys. Empty sets have no bands."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(*bands_and_rows(percent))
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sizes, f1, f2, keys = [], [], [], []
                for s in shingle_sets(part.column(1).to_pylist()):
                    sizes.append(len(s))
                    f1.append(mix(s * U(0xD6E8FEB86659FD93)).sum())
                    f2.append(mix(s + U(0xA0761D6478BD642F)).sum())
                    keys.append(signer.keys(s).view(np.int64) if len(s) else np.empty(0, dtype=np.int64))
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.empty(0, dtype=np.int64)])))
                prints = [pa.array(np.array(f, dtype=np.uint64).view(np.int64)) for f in (f1, f2)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *prints, bands], ["id", "n", "f1", "f2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(common.lean(run), f"id {kind}, n long, f1 long, f2 long, bands array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) for those of ``pairs`` (member, hub: ids of ``texts``) whose full shingle sets have
    100 * |intersection| >= percent * |union|.

    A hub's text goes once to each group of about GROUP_MEMBERS of its members, ahead of theirs, so a task holds the
    set of one hub and a batch of members.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / GROUP_MEMBERS).cast("int").alias("groups"))
    dealt = pairs.join(common.materialise(sizes, "hubs"), "hub")
    dealt = common.materialise(dealt.select("hub", F.pmod(F.xxhash64("member"), F.col("groups")).alias("part"), "member"), "dealt")
    of = texts.withColumnRenamed("id", "member")
    members = dealt.join(of, "member").select("hub", "part", F.lit(1).alias("side"), "member", "text")
    hubs = dealt.select("hub", "part", F.col("hub").alias("member")).distinct().join(of, "member").select("hub", "part", F.lit(0).alias("side"), "member", "text")
    rows = hubs.unionByName(members).repartition("hub", "part").sortWithinPartitions("hub", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        of_hub: list[np.ndarray] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                hub, group, side, member = [part.column(i).to_pylist() for i in range(4)]
                good = []
                for i, s in enumerate(shingle_sets(part.column(4).to_pylist())):
                    if not side[i]:
                        # Rows that share an id are one document; the texts of a hub are looked at one by one.
                        of_hub = [*of_hub, s] if at == (hub[i], group[i]) else [s]
                        at = hub[i], group[i]
                        continue
                    for x in of_hub if at == (hub[i], group[i]) else ():
                        both = len(np.intersect1d(x, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(x) + len(s) - both):
                            good.append(i)
                            break
                linked = [sorted((member[i], hub[i])) for i in good]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], part.column(0).type) for k in (1, 0)], ["a", "b"])

    kind = dict(pairs.dtypes)["hub"]
    return rows.mapInArrow(common.lean(run), f"a {kind}, b {kind}")


def _close_in_size(percent: int):
    return 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept.

    Null and empty texts have no shingles and no links. Rows that share an id are rows of one document, which links by
    any of their texts; a null id links with nothing and is not kept. Repeated rows stay, other columns are not read.
    """
    print_of = ["f1", "f2", "n"]
    sketch = common.materialise(sketches(docs, percent, id_col, text_col), "sketches")
    prints = common.materialise(sketch.select("id", *print_of), "prints")
    some = sketch.filter("n > 0 AND id IS NOT NULL")
    signed = common.materialise(some.groupBy(*print_of).agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "signed")
    common.discard(sketch)
    classes = common.materialise(signed.select(*print_of, "rep"), "classes")

    buckets = signed.select("rep", "n", F.explode("bands").alias("key"))
    sizes = common.materialise(buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    met_in = common.materialise(buckets.join(sizes, "key"), "buckets")
    common.discard(signed)
    common.discard(sizes)
    met = common.materialise(met_in.groupBy("rep").agg(F.sum("size").alias("met")), "met")
    shared = common.materialise(met_in.join(met, "rep").select("key", "rep", "n", "met"), "ranked")
    common.discard(met_in)
    # Only texts that share a bucket are compared; they are taken out of the corpus once.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = common.materialise(texts.join(met.select(F.col("rep").alias("id")), "id", "left_semi"), "texts")

    best = shared.groupBy("key").agg(F.max(F.struct("met", F.negative("rep").alias("minus"), "rep", "n")).alias("c"))
    best = common.materialise(best.select("key", F.col("c.rep").alias("_rep"), F.col("c.n").alias("_n")), "centres")
    stars = shared.join(best, "key").filter(F.col("rep") != F.col("_rep")).filter(_close_in_size(percent))
    tried = common.materialise(stars.select(F.col("rep").alias("member"), F.col("_rep").alias("hub")).distinct(), "pairs")
    links = common.materialise(confirm(tried, texts, percent).distinct(), "links")
    labels = connected(links)

    split = _unjoined(shared, labels, 0)
    if split is not None:
        shared = prefix_buckets(split, texts, percent)
        low, high = 0, FIRST_CENTRES
        while (split := _unjoined(shared, labels, low)) is not None:
            order = Window.partitionBy("key").orderBy(F.desc("met"), "rep")
            centres = split.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= high).filter(F.col("rank") > low)
            centres = common.materialise(centres.select("key", F.col("rep").alias("_rep"), F.col("n").alias("_n"), F.col("met").alias("_met"), F.col("label").alias("_label"), F.col("slack").alias("_slack")), "centres")
            near = (F.col("label") != F.col("_label")) & _close_in_size(percent) & (F.least("slack", "_slack") * (100 + percent) >= (F.col("n") + F.col("_n")) * percent)
            # Of two documents the hub is always the one that meets more others, so that a pair has one form.
            first = F.struct(-F.col("met"), "rep") < F.struct(-F.col("_met"), "_rep")
            pair = [F.when(first, F.col("_rep")).otherwise(F.col("rep")).alias("member"), F.when(first, F.col("rep")).otherwise(F.col("_rep")).alias("hub")]
            pairs = split.join(centres, "key").filter(near).select(*pair).distinct()
            pairs = common.materialise(pairs.join(tried, ["member", "hub"], "left_anti"), "pairs")
            if not pairs.isEmpty():
                tried = tried.unionByName(pairs)
                found = common.materialise(confirm(pairs, texts, percent).distinct(), "links")
                if not found.isEmpty():
                    links = links.unionByName(found)
                    labels = connected(links)
            low, high = high, high * MORE_CENTRES

    named = classes.select(*print_of, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = common.materialise(named.select(*print_of, F.coalesce("label", "rep").alias("_component")), "classes")
    out = prints.join(named, print_of, "left")
    component = F.coalesce("_component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def prefix_buckets(split: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Narrower buckets (key, rep, n, met, slack) for documents that share a band, but were not joined by the stars.

    Two sets that are close enough share one of the first n - ceil(percent * n / 100) + 1 shingles of each, in any
    fixed order. Rare shingles go first here, so that what many documents share makes no bucket unless it is nearly
    all of a document. ``slack`` counts the shingles from this one on: the intersection of two sets is no larger than
    the smaller slack at the first shingle that they share. No link is lost, and documents that only have a passage in
    common meet no more.
    """
    reps = split.select("rep", "met").distinct()
    rows = texts.withColumnRenamed("id", "rep").join(reps, "rep").select("rep", "met", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sets = list(shingle_sets(part.column(2).to_pylist()))
                sizes = [len(s) for s in sets]
                owner = pa.array(np.repeat(np.arange(len(sets)), sizes))
                prints = np.array([s.sum() for s in sets], dtype=np.uint64).view(np.int64)
                whole = np.concatenate([*sets, np.empty(0, dtype=np.uint64)]).view(np.int64)
                columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(prints)]
                yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in columns], pa.array(whole)], ["rep", "met", "n", "print", "key"])

    kind = dict(split.dtypes)["rep"]
    shingles = common.materialise(rows.mapInArrow(common.lean(run), f"rep {kind}, met long, n long, print long, key long"), "shingles")
    held = common.materialise(shingles.groupBy("key").agg(F.count("*").alias("held")), "held")
    order = Window.partitionBy("rep", "print").orderBy("held", "key")
    ranked = shingles.join(held, "key").withColumn("rank", F.row_number().over(order))
    first = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    prefix = ranked.filter(F.col("rank") <= first).filter("held > 1").select("key", "rep", "n", "met", (F.col("n") - F.col("rank") + 1).alias("slack"))
    prefix = common.materialise(prefix, "prefixes")
    common.discard(shingles)
    common.discard(held)
    return prefix


def _unjoined(shared: DataFrame, labels: DataFrame, rank: int) -> DataFrame | None:
    """Members of buckets that hold several components and more than ``rank`` members, with their labels."""
    labelled = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = common.materialise(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).filter(f"x <> y AND size > {rank}").select("key")
    open_keys = common.materialise(open_keys, "open")
    if open_keys.isEmpty():
        return None
    return common.materialise(labelled.join(open_keys, "key"), "split")
