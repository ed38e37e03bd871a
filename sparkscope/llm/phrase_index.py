"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table, partitioned by document: a row is a shard, the posting lists (positions of every word) of
some documents. The benchmark's windows are then answered from the stored lists, in blocks of bounded size. Its terms
are counted over the whole index first; a window is looked up from its rarest term: the list of that term, less the
term's offset in the window, holds the possible starts, and each further list, shifted by its own offset, keeps those
that it contains. No list crosses the network and no term is a shuffle key, so none can be hot; memory depends on the
sizes of a shard and of a block only.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.llm import common

#: Weight of the benchmark's windows that are sent to the executors at once: a window is one, and so is a word of an item
#: shorter than a window, or 32 bytes of text. A larger benchmark takes several passes over the index.
BLOCK_WEIGHT = 200_000
#: Windows of a piece of an item: long items are cut, with an overlap of a window less a word.
PIECE_WINDOWS = 1_000
#: Characters of the documents of a shard, about (one document at least). Rows stay small, and few are read at once: the
#: JVM's heap grows with values that are large beside its regions.
SHARD_CHARS = 100_000
READER = {"spark.sql.parquet.columnarReaderBatchSize": "32"}
#: Possible places that are looked at together.
PLACES = 500_000
#: Words on either side of a window's rarest term in which proximity matches have the window's other terms.
REACH = 20
#: ASCII letters to lower case, other ASCII but digits to a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LAST = np.int64(np.iinfo(np.int64).max)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def posting_lists(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(first position and number of words of each text, terms, length of each term's list, the lists one after another).

    Positions run on over texts, with a gap between two.
    """
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    flat, starts, counts = array("i"), [], []
    for text in texts:
        words = words_of(text)
        starts.append(len(flat))
        counts.append(len(words))
        flat.extend(map(number.__getitem__, words))
        flat.append(-1)
    numbers = np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, dtype=np.int32)
    at = np.flatnonzero(numbers >= 0)
    key = np.sort((numbers[at].astype(np.int64) << 32) | at)
    lengths = np.bincount(numbers[at], minlength=len(number)).astype(np.int32)
    return np.array(starts, dtype=np.int32), np.array(counts, dtype=np.int32), list(number), lengths, (key & 0xFFFFFFFF).astype(np.int32)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the index of ``docs``: a row a shard, with its documents (ids, prints, counts of words, first positions) and
    its lists (terms joined by spaces, lengths and positions as 4 little-endian bytes each).

    ``print`` is a hash of the text: with the id it names a row, and rows that agree in both have the same words.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    ids = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array]] = []
        texts: list[str | None] = []
        size = 0

        def shard() -> pa.RecordBatch:
            starts, counts, terms, lengths, positions = posting_lists(texts)
            own = [pa.concat_arrays([x[i] for x in held]) for i in (0, 1)]
            ends = pa.array([0, len(texts)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (*own, pa.array(counts), pa.array(starts))]
            data = [pa.array([x], pa.binary()) for x in (b" ".join(terms), lengths.astype("<i4").tobytes(), positions.astype("<i4").tobytes())]
            return pa.RecordBatch.from_arrays([*lists, *data], ["ids", "prints", "counts", "starts", "terms", "lengths", "positions"])

        for batch in batches:
            found = batch.column(2).to_pylist()
            for a, b in common.slices([t or "" for t in found], SHARD_CHARS):
                more = sum(len(t or "") for t in found[a:b])
                if texts and size + more > SHARD_CHARS:
                    yield shard()
                    held, texts, size = [], [], 0
                own = pa.array(range(a, b))  # taken, not sliced: a slice would keep the batch's texts in memory
                held.append((batch.column(0).take(own), batch.column(1).take(own)))
                texts += found[a:b]
                size += more
        if texts:
            yield shard()

    kind = ids.simpleString()
    index = rows.mapInArrow(common.lean(run), f"ids array<{kind}>, prints array<bigint>, counts array<int>, starts array<int>, terms binary, lengths binary, positions binary")
    return common.materialise(index, "postings")


@dataclass
class Windows:
    """The windows of a block of items, equal ones once. ``terms`` numbers their words; ``matrix`` has a row of terms for
    each window, filled up with its first; ``order`` the offsets in it from the rarest term on."""

    terms: dict[bytes, int] = field(default_factory=dict)
    items: list[list[str]] = field(default_factory=list)
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    matrix: np.ndarray = field(default_factory=lambda: np.empty((0, 0), dtype=np.int64))
    order: np.ndarray = field(default_factory=lambda: np.empty((0, 0), dtype=np.int64))

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], width: int) -> Windows:
        out = cls()
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [out.terms.setdefault(w, len(out.terms)) for w in words_of(text)]
            if ids:
                for i in range(max(1, len(ids) - width + 1)):
                    owners.setdefault(tuple(ids[i : i + width]), set()).add(item)
        out.items = [sorted(x) for x in owners.values()]
        out.sizes = np.array([len(w) for w in owners], dtype=np.int64)
        widest = int(out.sizes.max(initial=0))
        out.matrix = np.array([[*w, *[w[0]] * (widest - len(w))] for w in owners], dtype=np.int64).reshape(len(owners), widest)
        return out

    def rank(self, frequency: dict[int, int]) -> None:
        """Set ``order`` from the terms' occurrences in the index; of equally rare terms the first in byte order counts."""
        by = sorted(self.terms, key=lambda t: (frequency.get(self.terms[t], 0), t))
        place = np.empty(len(by), dtype=np.int64)
        place[[self.terms[t] for t in by]] = np.arange(len(by))
        if len(self.matrix):
            order = np.argsort(place[self.matrix], axis=1, kind="stable")
            self.order = np.where(order < self.sizes[:, None], order, 0)  # what fills a row up is its first term


class Lists:
    """The posting lists of one shard for the terms of some windows, as sorted keys: term number, then position."""

    def __init__(self, windows: Windows, starts: np.ndarray, counts: np.ndarray, terms: bytes, lengths: np.ndarray, positions: np.ndarray):
        self.windows, self.starts, self.counts = windows, starts.astype(np.int64), counts.astype(np.int64)
        get = windows.terms.get
        number = np.array([get(t, -1) for t in terms.split()], dtype=np.int64)
        held = np.flatnonzero(number >= 0)
        by = held[np.argsort(number[held])]
        first = np.cumsum(lengths, dtype=np.int64) - lengths
        sizes = lengths[by].astype(np.int64)
        taken = np.repeat(first[by] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        keys = (np.repeat(number[by], sizes) << 32) + positions[taken]
        self.keys = np.append(keys, LAST)
        self.bounds = np.searchsorted(keys, np.arange(len(windows.terms) + 1, dtype=np.int64) << 32)

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, rank of each offset, position of the window's rarest term) for all windows whose terms occur here,
        about PLACES at a time."""
        w = self.windows
        if not len(w.matrix):
            return
        sizes = np.diff(self.bounds)
        possible = np.flatnonzero((sizes[w.matrix] > 0).all(axis=1))
        rarest = w.matrix[possible, w.order[possible, 0]]
        many = sizes[rarest]
        group = np.cumsum(many) // PLACES
        for g in np.unique(group):
            own = group == g
            n = many[own]
            at = np.repeat(self.bounds[rarest[own]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield np.repeat(possible[own], n), np.repeat(w.order[possible[own]], n, axis=0), self.keys[at] & 0xFFFFFFFF

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) where a window's words follow one another: offset-adjusted lists, intersected rarest first."""
        for window, order, position in self.places():
            start = position - order[:, 0]
            for k in range(1, order.shape[1]):
                key = (self.windows.matrix[window, order[:, k]] << 32) + start + order[:, k]
                good = self.keys[np.searchsorted(self.keys, key)] == key
                window, order, start = window[good], order[good], start[good]
            yield window, start

    def near(self, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its rarest term) where all its other terms lie within ``reach`` words, in one document."""
        for window, order, position in self.places():
            doc = self.document(position)
            low = np.maximum(position - reach, self.starts[doc])
            high = np.minimum(position + reach, self.starts[doc] + self.counts[doc] - 1)
            for k in range(1, order.shape[1]):
                term = self.windows.matrix[window, order[:, k]] << 32
                good = self.keys[np.searchsorted(self.keys, term + low)] <= term + high
                window, order, position, low, high = window[good], order[good], position[good], low[good], high[good]
            yield window, position

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1


def _lists(batch: pa.RecordBatch, windows: Windows) -> Iterator[tuple[Lists, pa.Array, pa.Array]]:
    """The shards of a batch of the index, with their documents' ids and prints."""
    for i in range(batch.num_rows):
        ids, prints, counts, starts = [batch.column(c)[i].values for c in range(4)]
        terms, lengths, positions = [batch.column(c)[i].as_py() for c in (4, 5, 6)]
        numbers = [np.frombuffer(x, dtype="<i4") for x in (lengths, positions)]
        yield Lists(windows, starts.to_numpy(), counts.to_numpy(), terms, *numbers), ids, prints


def pieces(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text", most: int = PIECE_WINDOWS) -> DataFrame:
    """(item, text, weight): the items' words in pieces of at most ``most`` windows, which hold each window of an item and
    no other one. Equal pieces of an item are one; items without words have none."""
    folded = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)), F.lit(most))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, most + width - 1))).alias("words"))
    weight = F.greatest(F.size("words"), F.octet_length(F.array_join("words", " ")) / 32)
    return cut.select("item", F.array_join("words", " ").alias("text"), weight.cast("long").alias("weight")).distinct()


def _blocks(benchmark: DataFrame, width: int, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The pieces of the benchmark in blocks of at most ``limit`` by weight, or of one piece, cut by a hash."""
    cut = common.materialise(pieces(benchmark, width, id_col, text_col, max(1, min(PIECE_WINDOWS, limit - width + 1))), "pieces")
    total = cut.agg(F.sum("weight")).first()[0]
    n = -(-(total or 0) // limit) or 1
    of = F.xxhash64("item", "text")
    while n > 1 and cut.groupBy(F.pmod(of, F.lit(n))).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).filter((F.col("w") > limit) & (F.col("n") > 1)).take(1):
        n += -(-n // 2)  # blocks by a hash are uneven: more of them, until none is too large
    if n > 1:  # a block is then read without the others
        whole, cut = cut, common.materialise(cut.withColumn("block", F.pmod(of, F.lit(n))).repartitionByRange("block").sortWithinPartitions("block"), "pieces")
        common.discard(whole)
    for k in range(n):
        block = cut if n == 1 else cut.filter(F.col("block") == k)
        yield [(r["item"], r["text"]) for r in block.select("item", "text").collect()]
    common.discard(cut)


def frequencies(index: DataFrame, terms: dict[bytes, int]) -> dict[int, int]:
    """Occurrences in the whole index of each of ``terms``, by number: as many rows as terms, which a block bounds."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), dtype=np.int64)
        get = shared.value.get
        for batch in batches:
            for joined, lengths in zip(batch.column(0), batch.column(1)):
                number = np.array([get(t, -1) for t in joined.as_py().split()], dtype=np.int64)
                own = np.flatnonzero(number >= 0)
                total[number[own]] += np.frombuffer(lengths.as_py(), dtype="<i4")[own]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    counted = index.select("terms", "lengths").mapInArrow(common.lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    with common.settings(index.sparkSession, READER):
        found = {r["term"]: r["n"] for r in counted.collect()}
    shared.destroy()
    return found


def _search(index: DataFrame, benchmark: DataFrame, answer, schema: str, width: int, item_col: str, item_text_col: str, block: int) -> DataFrame:
    """What ``answer(lists, ids, prints)`` gives for each shard and block of the benchmark; each block is written."""
    spark, out = index.sparkSession, None
    for items in _blocks(benchmark, width, item_col, item_text_col, block):
        windows = Windows.of(items, width)
        windows.rank(frequencies(index, windows.terms) if windows.terms else {})
        shared = spark.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in _lists(batch, shared.value):
                    yield from answer(*shard)

        with common.settings(spark, READER):
            found = common.materialise(index.mapInArrow(common.lean(run), schema), "hits")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges, which are sorted by start; ranges that only touch stay apart at a gap between documents."""
    reach = np.maximum.accumulate(stop)
    first = np.append(True, start[1:] > reach[:-1]) if len(start) else np.empty(0, dtype=bool)
    at = np.flatnonzero(first)
    return start[at], reach[np.append(at[1:], len(start)) - 1] if len(at) else reach


def hits(index: DataFrame, benchmark: DataFrame, width: int = 10, reach: int = REACH, item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_WEIGHT) -> DataFrame:
    """(id, print, spans, items, near_items) of the documents of ``index`` with any match.

    spans are runs of hit words (start, stop), items those with a window in the document, near_items those with a window
    whose terms all lie within ``reach`` words of an occurrence of its rarest term.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def answer(lists: Lists, ids: pa.Array, prints: pa.Array) -> Iterator[pa.RecordBatch]:
        sizes, names = lists.windows.sizes, lists.windows.items
        of: dict[int, tuple[set[str], set[str]]] = {}
        starts, stops = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for k, matches in enumerate((lists.phrases(), lists.near(reach))):
            for window, position in matches:
                pairs = np.unique((lists.document(position) << 32) | window)
                for d, w in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()):
                    of.setdefault(d, (set(), set()))[k].update(names[w])
                if not k:
                    starts.append(position)
                    stops.append(position + sizes[window])
        if not of:
            return
        start, stop = np.concatenate(starts), np.concatenate(stops)
        by = np.argsort(start)
        start, stop = _merged(start[by], stop[by])
        doc = lists.document(start)
        rows = sorted(of)
        spans = [[{"start": int(a), "stop": int(b)} for a, b in zip(start[i:j] - lists.starts[d], stop[i:j] - lists.starts[d])] for d, i, j in zip(rows, np.searchsorted(doc, rows), np.searchsorted(doc, rows, side="right"))]
        texts = pa.list_(pa.string())
        columns = [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), *[pa.array([sorted(of[d][k]) for d in rows], texts) for k in (0, 1)]]
        taken = pa.array(rows)
        yield pa.RecordBatch.from_arrays([ids.take(taken), prints.take(taken), *columns], ["id", "print", "spans", "items", "near_items"])

    schema = f"id {kind}, print long, spans array<struct<start:bigint,stop:bigint>>, items array<string>, near_items array<string>"
    found = _search(index, benchmark, answer, schema, width, item_col, item_text_col, block)
    united = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "items", "near_items")]
    return common.materialise(found.groupBy("id", "print").agg(*united), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_WEIGHT) -> DataFrame:
    """One row for each of ``docs``: id, n_words, n_hit (hit words), spans (of hit words), items, near_items, contaminated.

    Words: runs of non-ASCII characters, ASCII letters (lower-cased) and digits. A window is ``width`` consecutive
    words of an item; an item with fewer words is one window, one without words (null, empty) none. A document word
    inside any occurrence of a window is hit; windows do not cross documents. Repeated rows, items and ids stay rows
    of their own; equal windows of several items count for each. A null item id counts as an empty one. Empty tables
    give no rows or no hits. Other columns are not read, whatever they are called.
    """
    index = build(docs, id_col, text_col)
    found = hits(index, benchmark, width, reach, item_col, item_text_col, block)
    each = common.materialise(index.select(F.explode(F.arrays_zip("ids", "prints", "counts")).alias("d")).select(F.col("d.ids").alias("id"), F.col("d.prints").alias("print"), F.col("d.counts").cast("long").alias("n_words")), "words")
    common.discard(index)
    met = found.select(F.col("id").alias("_id"), F.col("print").alias("_print"), "spans", "items", "near_items")
    joined = each.join(met, F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), "left")
    none = F.array().cast("array<string>")
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last"))

    def add(s, x):
        return F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["last"]))).alias("n"), F.greatest(s["last"], x["stop"]).alias("last"))

    n_hit = F.coalesce(F.aggregate(F.array_sort("spans"), state, add)["n"], F.lit(0))
    out = joined.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.array_sort("spans").alias("spans"), *[F.array_sort(F.coalesce(c, none)).alias(c) for c in ("items", "near_items")])
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, without those that hold a window of the benchmark (see ``decontaminate``)."""
    index = build(docs, id_col, text_col)
    found = hits(index, benchmark, **options)
    common.discard(index)
    p = common.free_prefix(docs)
    gone = found.filter(F.size("items") > 0).select(F.col("id").alias(f"{p}id"), F.col("print").alias(f"{p}print"))
    met = F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}of") == F.col(f"{p}print"))
    return docs.withColumn(f"{p}of", F.xxhash64(text_col)).join(gone, met, "left_anti").select(*docs.columns)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest of ``decontaminate``: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, reach: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_WEIGHT) -> DataFrame:
    """Each match as a row: id, item, start (word number), kind.

    kind is "phrase" for exact windows. With ``reach``, also "near": places of a window's rarest term that have its
    other terms within ``reach`` words on either side, in any order.
    """
    index = build(docs, id_col, text_col)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def answer(lists: Lists, ids: pa.Array, prints: pa.Array) -> Iterator[pa.RecordBatch]:
        names = lists.windows.items
        for name, found in (("phrase", lists.phrases()), ("near", lists.near(reach) if reach is not None else ())):
            for window, position in found:
                doc = lists.document(position)
                many = [len(names[w]) for w in window.tolist()]
                own = np.repeat(np.arange(len(window)), many)
                item = [i for w in window.tolist() for i in names[w]]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[own])), pa.array(item, pa.string()), pa.array((position - lists.starts[doc])[own]), pa.array([name] * len(item), pa.string())], ["id", "item", "start", "kind"])

    found = _search(index, benchmark, answer, f"id {kind}, item string, start long, kind string", width, item_col, item_text_col, block)
    common.discard(index)
    return found.withColumnRenamed("id", id_col)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
